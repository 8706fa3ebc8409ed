"""Near duplicates by a chosen-path set similarity join.

Every distinct shingle set gets 64 minwise tokens. Independent trees branch the
documents: a node picks one or two of the 64 positions, and its documents go to
the child of their token there, so a pair of similarity s shares 4s/3 children
on average. Small nodes are compared exhaustively: nodes with few open pairs
as rows of pairs, others, up to a bounded number of documents and shingles, with
their full sets in one task. A larger node is compared with two pivots and
branches again; documents that links have joined already need no comparison, so
large groups of copies vanish after a level and what is left thins out from
level to level. The first two trees go before the others, so that these find most
copies joined. Links are confirmed on full sets, which move only for documents
whose tokens show a partner, and components are contracted by min labels.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.hashing import shingle_sets, slices, spread
from tallyframe.session import materialise

TOKENS = 64
TREES = 16
WAVES = (2, TREES)  # trees up to these are branched one after the other: what the first join, the rest need not compare
PER_ROW = 8  # a node with at most so many open pairs for each document is compared by rows of pairs
NODE_DOCS, NODE_SHINGLES = 4_096, 2_000_000  # a node up to both sizes (16 MB) is compared in one task
ALIKE = 32  # of 64 tokens; a pair of similarity 0.75 has fewer with probability 1e-5
BROADCAST_IDS = 500_000  # at most so many ids (4 MB) are broadcast to a scan; more are joined by shuffle

_seeds = np.random.default_rng(20_231)
_FACTORS = _seeds.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_TERMS = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def min_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, one row each."""
    out = np.empty((len(sets), TOKENS), dtype=np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat((flat * _FACTORS[k] + _TERMS[k]) >> np.uint64(32), starts)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [k for k, s in enumerate(sets) if len(s)]
            tokens = min_tokens([sets[k] for k in full]).view(np.int32)
            rows: list = [None] * len(sets)
            for k, row in zip(full, tokens):
                rows[k] = row
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]),
                    pa.array(rows, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_shingles", "digest", "tokens"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            made = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in made], pa.binary()),
                    pa.array(made, pa.binary()),
                ],
                names=["doc_id", "digest", "members"],
            )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("set_a"), batch.column("set_b")):
            a = np.frombuffer(left.as_buffer(), np.uint64)
            b = np.frombuffer(right.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _node_links(table: pa.Table) -> pa.Table:
    """Links that join the components of one node, all of them: every pair is compared unless joined already."""
    docs, label = table.column("doc").to_numpy(), table.column("comp").to_numpy().copy()
    order = np.argsort(docs, kind="stable")
    docs, label = docs[order], label[order]
    members = table.column("members").to_pylist()
    sets = [np.frombuffer(members[k], np.uint64) for k in order]
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    posting = np.argsort(shingle, kind="stable")
    holder = np.repeat(np.arange(len(docs)), sizes)[posting]
    starts = np.searchsorted(shingle[posting], np.arange(shingle.max() + 2))
    links = []

    def join(x: int) -> None:
        own = shingle[ends[x] : ends[x + 1]]
        both = np.bincount(holder[spread(starts[own], starts[own + 1])[0]], minlength=len(docs))
        for y in np.flatnonzero(100 * both >= 75 * (sizes[x] + sizes - both)):
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                links.append((docs[x], docs[y]))

    # After some pivots the largest component is left out: it only grows, and of two documents in it nothing is asked.
    pivots = np.linspace(0, len(docs) - 1, 5).astype(int)
    for x in pivots:
        join(x)
    values, counts = np.unique(label, return_counts=True)
    major = int(np.flatnonzero(label == values[counts.argmax()])[0])
    for x in range(len(docs)):
        if label[x] != label[major]:
            join(x)
    pairs = np.sort(np.array(links, dtype=np.int64).reshape(-1, 2), axis=1)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _partners(table: pa.Table) -> pa.Table:
    """The documents of one node that tokens show alike to one of another component; only their sets are looked at."""
    docs, comp = table.column("doc").to_numpy(), table.column("comp").to_numpy()
    flat = table.column("tokens").combine_chunks().flatten().to_numpy()
    tokens = np.ascontiguousarray(flat.reshape(-1, TOKENS).T)
    found = np.zeros(len(docs), dtype=bool)
    for x in range(len(docs)):
        equal = np.zeros(len(docs) - x, dtype=np.uint8)
        for row in tokens:
            equal += row[x:] == row[x]
        alike = np.flatnonzero((equal >= ALIKE) & (comp[x:] != comp[x])) + x
        found[alike] = True
        found[x] |= len(alike) > 0
    return table.select(["node", "doc", "comp"]).filter(pa.array(found))


def contracted(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for the nodes of an edge list; the root is the smallest node of its component.

    Every round points each node to its smallest neighbour, takes two jumps
    along these pointers and replaces the edges by those between the roots.
    """
    left = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "dedup-edges"
    )
    roots: DataFrame | None = None
    while left.limit(1).count():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        up = materialise(up, "dedup-pointers")

        def jump(pointers: DataFrame) -> DataFrame:
            upper = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            return pointers.join(upper, "p").select("u", F.col("q").alias("p"))

        step = materialise(jump(jump(up)), "dedup-roots")
        at_u = step.select("u", F.col("p").alias("pu"))
        at_v = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = materialise(
            left.join(at_u, "u").join(at_v, "v").where("pu <> pv")
            .select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(),
            "dedup-edges",
        )
        found = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        if roots is None:
            roots = found
        else:
            moved = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = materialise(roots, "dedup-components")
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def _first_level(first: int, last: int) -> Column:
    """The nodes of the first level of some trees as an array."""
    pick = random.Random(7)
    nodes = []
    for tree in range(TREES):
        for k in pick.sample(range(TOKENS), 1 + (tree % 3 == 0)):
            if first <= tree < last:
                nodes.append(F.xxhash64(F.lit(tree), F.lit(k), F.get("tokens", F.lit(k))))
    return F.array(*nodes)


def _first_rows(heads: DataFrame, first: int, last: int) -> DataFrame:
    rows = heads.select(
        F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), F.explode(_first_level(first, last)).alias("node")
    )
    # Most nodes of the first level hold one document.
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return rows.join(shared, "node", "left_semi").select("doc", "size", "node")


def _children() -> Column:
    """The children of a row's node: one position of the tokens, for a third of the nodes two."""
    def child(salt: int) -> Column:
        k = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", k, F.get("tokens", k))

    second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(3)) == 0
    return F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))


def _open_nodes(rows: DataFrame) -> DataFrame:
    """The rows of nodes with more than one component, each with its node's kind, main component and pivots.

    ``rows`` has node, doc, size, comp.
    """
    parts = rows.groupBy("node", "comp").agg(
        F.count(F.lit(1)).alias("c"), F.min("doc").alias("pivot"), F.sum("size").alias("s")
    )
    nodes = parts.groupBy("node").agg(
        F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"),
        F.max(F.struct("c", "comp", "pivot")).alias("main"),
        F.min_by("pivot", F.xxhash64("pivot", "node")).alias("second_pivot"),
        F.count(F.lit(1)).alias("comps"), F.sum("s").alias("shingles"),
    ).where("comps > 1")
    open_pairs = (F.col("n").cast("double") * F.col("n") - F.col("squares")) / 2
    kind = F.when(open_pairs <= PER_ROW * F.col("n"), "pairs").when(
        (F.col("n") <= NODE_DOCS) & (F.col("shingles") <= NODE_SHINGLES), "task"
    ).otherwise("large")
    nodes = nodes.select(
        "node", kind.alias("kind"), F.col("main.comp").alias("major"), F.col("main.pivot").alias("first_pivot"),
        "second_pivot",
    )
    return materialise(rows.join(nodes, "node"), "dedup-nodes")


def _pairs(placed: DataFrame) -> DataFrame:
    """Open pairs of the small nodes and pivot pairs of the large ones."""
    small = placed.where("kind = 'pairs'").withColumn("light", F.col("comp") != F.col("major"))
    # Of two documents in the largest component of a node nothing is asked: one side is always outside it.
    one, two = small.where("light").alias("x"), small.alias("y")
    size_x, size_y = F.col("x.size"), F.col("y.size")
    inner = one.join(
        two,
        (F.col("x.node") == F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
        & (~F.col("y.light") | (F.col("x.doc") < F.col("y.doc")))
        & (100 * F.least(size_x, size_y) >= 75 * F.greatest(size_x, size_y)),
    ).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
    pivots = placed.where("kind = 'large'").select(
        "doc", F.explode(F.array("first_pivot", "second_pivot")).alias("pivot")
    ).where("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
    return inner.unionByName(pivots).distinct()


def _links(placed: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the components of open nodes, all confirmed on full sets.

    Tokens first sort out what is far from alike, so few full sets move.
    """
    def sketch(side: str) -> DataFrame:
        return signed.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"tokens_{side}"))

    equal = F.aggregate(
        F.zip_with("tokens_a", "tokens_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    alike = materialise(
        _pairs(placed).join(sketch("a"), "a").join(sketch("b"), "b").where(equal >= ALIKE).select("a", "b"),
        "dedup-alike",
    )
    near = placed.where("kind = 'task'").select("node", "doc", "comp").join(
        signed.select(F.col("doc_id").alias("doc"), "tokens"), "doc"
    )
    in_task = materialise(
        near.groupBy("node").applyInArrow(_partners, "node bigint, doc bigint, comp bigint"), "dedup-partners"
    )
    ids = materialise(
        alike.select(F.col("a").alias("doc_id")).unionByName(alike.select(F.col("b").alias("doc_id")))
        .unionByName(in_task.select(F.col("doc").alias("doc_id"))).distinct(),
        "dedup-ids",
    )
    asked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(asked, "doc_id", "left_semi")
    sets = texts.mapInArrow(_set_rows, "doc_id bigint, digest binary, members binary")
    # A repeated doc_id has several texts; the one that was signed counts.
    sets = sets.join(signed.select("doc_id", "digest").join(asked, "doc_id", "left_semi"), ["doc_id", "digest"])
    sets = materialise(sets.dropDuplicates(["doc_id"]).select("doc_id", "members"), "dedup-sets")

    def members(side: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(side), F.col("members").alias(f"set_{side}"))

    tested = alike.join(members("b"), "b").join(members("a"), "a").select("a", "b", "set_a", "set_b")
    in_pairs = tested.mapInArrow(_confirmed, "a bigint, b bigint")
    whole = in_task.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("node", "doc", "comp", "members")
    in_nodes = whole.groupBy("node").applyInArrow(_node_links, "a bigint, b bigint")
    return materialise(in_pairs.unionByName(in_nodes), "dedup-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of every document of ``docs`` (doc_id, text): similarity of five-word shingle sets of 0.75 or more.

    Result: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links), kept (doc_id = component_id), class_id (smallest doc_id with the
    same set; null for an empty set). There is one row for each distinct doc_id;
    of rows that repeat an id the one with the largest digest counts. Null and
    empty texts have empty sets and are linked with nothing. Rows without
    doc_id cannot be named: each comes back with null ids and is kept. Other
    columns are not read.
    """
    named = docs.select("doc_id", "text").where("doc_id is not null")
    signed = materialise(
        named.mapInArrow(_signed, "doc_id bigint, n_shingles bigint, digest binary, tokens array<int>"), "dedup-tokens"
    )
    best = signed.groupBy("doc_id").agg(
        F.max_by(F.struct("n_shingles", "digest", "tokens"), F.coalesce("digest", F.lit(b""))).alias("s"),
        F.count(F.lit(1)).alias("rows"),
    )
    if best.where("rows > 1").limit(1).count():
        signed = materialise(best.select("doc_id", "s.*"), "dedup-tokens")
    # Equal sets are one class, so exact copies take no part in what follows.
    firsts = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = materialise(
        signed.select("doc_id", "n_shingles", "digest").join(firsts, "digest", "left").drop("digest"), "dedup-classes"
    )
    heads = signed.join(members.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    heads = materialise(heads, "dedup-heads")
    waves = list(zip((0, *WAVES), WAVES))
    rows = materialise(_first_rows(heads, *waves.pop(0)), "dedup-rows")
    roots: DataFrame | None = None
    while waves or rows.limit(1).count():
        if roots is None:
            labelled = rows.withColumn("comp", F.col("doc"))
        else:
            labelled = rows.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select(
                "node", "doc", "size", F.coalesce("root", "doc").alias("comp")
            )
        placed = _open_nodes(labelled)
        links = _links(placed, heads, named)
        if roots is None:
            roots = contracted(links)
        else:
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = contracted(links.unionByName(known))
        tokens = heads.select(F.col("doc_id").alias("doc"), "tokens")
        rows = placed.where("kind = 'large'").select("node", "doc", "size").join(tokens, "doc").select(
            "doc", "size", F.explode(_children()).alias("node")
        ).distinct()
        if waves:
            rows = rows.unionByName(_first_rows(heads, *waves.pop(0)))
        rows = materialise(rows, "dedup-rows")
    result = members.withColumn("component_id", F.coalesce("class_id", "doc_id"))
    if roots is not None:
        result = members.join(
            roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left"
        ).withColumn("component_id", F.coalesce("root", "class_id", "doc_id"))
    result = result.select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id"
    )
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(
        _signed, "doc_id bigint, n_shingles bigint, digest binary, tokens array<int>"
    )
    return result.unionByName(nameless.select(
        "doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"),
        F.lit(None).cast("bigint").alias("class_id"),
    ))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; rows without doc_id stay."""
    gone = materialise(near_duplicates(docs).where("not kept").select("doc_id"), "dedup-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
