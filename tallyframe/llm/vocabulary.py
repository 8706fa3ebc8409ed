"""Public tokenizers by the path of their vocabulary file, and the bytes behind their ids.

The driver reads a file once and Spark carries its bytes to the tasks, so the
path need not exist on executors. Texts are encoded whole: a very long one is
handed to the encoder in pieces, cut where no token can reach across.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import sentencepiece
import tiktoken

LONG_TEXT = 1 << 18  # characters handed to an encoder at once, where the text has a blank to cut before
# Both kinds of token may begin with the blank before a word and never reach over it from the word before.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
# Fixed value: the word pattern of the byte-level vocabulary.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    """Where the installed vocabulary files lie; callers may name any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_long(text: str) -> Iterator[str]:
    """The text in pieces of about ``LONG_TEXT`` characters, each after the first beginning with a blank."""
    start = 0
    while len(text) - start > LONG_TEXT:
        found = _CUT.search(text, start + LONG_TEXT)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Ids of texts, and for every id its bytes: ``flat[starts[id]:starts[id + 1]]``."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.tokens = tokens

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError


class ByteLevel(Vocabulary):
    """A byte-level vocabulary; strings of special tokens in a text are plain text.

    The ranks of the file go to the faster of the installed byte-level encoders;
    its ids equal those of the ``tokenizers`` library (tests compare both).
    """

    def __init__(self, file: bytes) -> None:
        made = json.loads(file)
        special = {t["id"] for t in made["added_tokens"] if t["special"]}
        letters = _byte_letters()
        entries = made["model"]["vocab"]
        tokens = [b""] * (1 + max(max(entries.values()), *special))
        ranks = {}
        for entry, number in entries.items():
            if number not in special:
                tokens[number] = bytes(letters[c] for c in entry)
                ranks[tokens[number]] = number
        super().__init__(tokens)
        self._encoder = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        made = [self._encoder.encode_to_numpy(part, disallowed_special=()) for part in cut_long(text)]
        return made[0] if len(made) == 1 else np.concatenate(made)


class Pieces(Vocabulary):
    """A vocabulary of pieces with byte fallback; the encoder puts a blank before a text itself."""

    def __init__(self, file: bytes) -> None:
        self._encoder = sentencepiece.SentencePieceProcessor(model_proto=file)
        tokens = []
        for number in range(self._encoder.get_piece_size()):
            piece = self._encoder.id_to_piece(number)
            found = _BYTE_PIECE.fullmatch(piece)
            tokens.append(bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode())
        super().__init__(tokens)
        self.cuttable = not any("▁" in self._encoder.id_to_piece(k).lstrip("▁") for k in range(len(tokens)))

    def encode(self, text: str) -> np.ndarray:
        parts = cut_long(text) if self.cuttable else [text]
        # The blank that a later piece begins with is the one that the encoder adds.
        made = [self._encoder.encode(part if k == 0 else part[1:]) for k, part in enumerate(parts)]
        return np.concatenate([np.array(m, dtype=np.uint32) for m in made])


@lru_cache(maxsize=4)
def loaded(file: bytes) -> Vocabulary:
    """The vocabulary in a file's bytes, once for each Python worker."""
    return ByteLevel(file) if file[:1] == b"{" else Pieces(file)


def file_bytes(path: str) -> bytes:
    return Path(path).read_bytes()
