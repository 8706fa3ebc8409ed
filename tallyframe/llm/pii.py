"""Personal data: fixed patterns, and words around them that give them away.

The corpus tells how strongly a word reveals a protected value: with n(t), n(e)
and n(t, e) the rows that hold the word, the value, and the word next to the
value, the word tells the value with the smoothed probability
``p = n(t, e) / (n(t) + s)`` and so reveals ``log(N p / n(e))`` of the
``log(N / n(e))`` that the value itself is worth. Words above one share are
generalised, above another removed, wherever they stand in a row that holds them
next to the value. All of it is DataFrame functions and grouped counts; values
and words are rows, placed by running totals, so many of them in one text cost
one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "general", "removed")

# The patterns find the same leftmost matches as their plain forms. They add that a match begins where its run
# of characters begins (or a match has just ended), and possessive loops, so a long run costs one walk and no
# recursion. A card is a whole run of 16 to 19 digits, as shorter and longer runs are dropped anyway.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][\x20-]?[0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDLES = {"email": "@", "phone": "+"}
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
# A word begins and ends with a letter (or its marks). The corpus counts and the words next to a value both use
# this pattern; the loop is over single characters, so going back over a long tail of dashes needs no recursion.
_TERM = r"\p{L}[\p{L}\p{M}'-]*(?<=[\p{L}\p{M}])"


@dataclass(frozen=True)
class Disclosure:
    reach: int = 5  # words at either side of a value that count as next to it
    window: int = 200  # code points in which these words are looked for
    smoothing: float = 1.0  # rows with the word, but not the value, that are added to those seen
    generalise: float = 0.6
    remove: float = 0.9
    letters: int = 3  # shorter words are not judged


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def term(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    match = text.rlike(PATTERNS[kind])
    return text.contains(_NEEDLES[kind]) & match if kind in _NEEDLES else match


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind in ("email", "ip") else _digits(value)
    return F.xxhash64(F.lit(kind), plain)


_MARK = "array<struct<gap:int,len:int,id:bigint,ok:boolean>>"
WORD = "word"


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before each match of a pattern, and the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found


def _marks(text: Column, pattern: str, mark, valid) -> Column:
    """For each match the length of the text before it, its own, its identity and whether it holds."""
    pieces, found = _pieces(text, pattern)
    return F.zip_with(pieces, found, lambda p, v: F.struct(
        F.length(p).alias("gap"), F.length(v).alias("len"), mark(v).alias("id"), valid(v).alias("ok")
    )).cast(_MARK)


def _without_mails(text: Column) -> Column:
    """The text with blanks for the letters of its addresses, as long as before; other values have no letters."""
    pieces, found = _pieces(text, PATTERNS["email"])
    ends = F.element_at(F.split(text, PATTERNS["email"], -1), -1)
    blank = F.zip_with(pieces, found, lambda p, v: F.concat(p, F.repeat(F.lit(" "), F.length(v))))
    return F.when(text.contains("@"), F.concat(F.array_join(blank, ""), ends)).otherwise(text)


def _base(docs: DataFrame, options: Disclosure) -> DataFrame:
    """One row for each row of docs, with its own number; those that may hold values carry marks for values and words."""
    t = F.col("t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    none = F.array().cast(_MARK)

    def values(kind: str) -> Column:
        marks = _marks(t, PATTERNS[kind], lambda v: _entity(kind, v), lambda v: _valid(kind, v))
        # The costly half runs on texts that match the pattern only.
        return F.when(_matches(kind, t), marks).otherwise(none)

    found = rows.select("rid", "doc_id", "t", *[values(k).alias(k) for k in BASE_KINDS])
    words = _marks(
        _without_mails(t), _TERM, lambda v: F.xxhash64(F.lower(v)), lambda v: F.length(F.lower(v)) >= options.letters
    )
    some = F.greatest(*[F.size(F.filter(k, lambda m: m["ok"])) for k in BASE_KINDS]) > 0
    return found.select(
        "rid", "doc_id", F.xxhash64("t").alias("h"), *BASE_KINDS, F.when(some, words).otherwise(none).alias(WORD)
    )


def _places(base: DataFrame, options: Disclosure) -> DataFrame:
    """Values, and the words that may tell one, as rows: rid, kind, i, start, end, id, near.

    ``i`` numbers the words of a row; for a value it is the word behind it. A word is ``near`` when it is among those
    next to a value; words that are near nowhere in their row go. One shuffle of the unopened marks serves all windows.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("marks")) for k in (*BASE_KINDS, WORD)]))
    holds = F.greatest(*[F.size(k) for k in BASE_KINDS]) > 0
    rows = base.where(holds).select("rid", *BASE_KINDS, WORD).repartition("rid").select("rid", kinds.alias("k")).select(
        "rid", "k.kind", F.posexplode("k.marks").alias("i", "m"))
    running = (Window.unboundedPreceding, 0)
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(*running)
    word, value = F.col("kind") == WORD, (F.col("kind") != WORD) & F.col("ok")
    placed = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(before).cast("int")).select(
        "rid", "kind", "i", (F.col("end") - F.col("m.len")).alias("start"), "end", "m.id", "m.ok"
    )
    # Words and values in one order say how many words stand before a value, and which values are next to a word.
    along = Window.partitionBy("rid").orderBy("start", word).rowsBetween(*running)
    back = Window.partitionBy("rid").orderBy(F.desc("start"), word.desc()).rowsBetween(*running)
    counted = placed.withColumn("i", F.when(word, F.col("i")).otherwise(F.count_if(word).over(along).cast("int")))
    last = F.last(F.when(value, F.col("i")), True)
    near = word & F.col("ok") & (
        F.coalesce(last.over(along) > F.col("i") - options.reach, F.lit(False))
        | F.coalesce(last.over(back) <= F.col("i") + options.reach, F.lit(False))
    )
    met = F.max("near").over(Window.partitionBy("rid", "kind", "id"))
    return counted.withColumn("near", near).withColumn("met", met).where(value | (word & F.col("met"))).drop("ok", "met")


def _near(places: DataFrame, options: Disclosure) -> DataFrame:
    """Distinct (rid, entity, term) of the words around each value: the nearest ones, within the window."""
    around = places.where(F.col("kind") != WORD).select(
        "rid", F.col("id").alias("entity"), F.col("start").alias("from"), F.col("end").alias("to"),
        F.explode(F.sequence(F.col("i") - options.reach, F.col("i") + options.reach - 1)).alias("i"),
    )
    inside = (F.col("start") >= F.col("from") - options.window) & (F.col("end") <= F.col("to") + options.window)
    return around.join(places.where("near").select("rid", "i", "start", "end", F.col("id").alias("term")), ["rid", "i"]).where(
        inside).select("rid", "entity", "term").distinct()


def _term_rows(docs: DataFrame, options: Disclosure) -> DataFrame:
    """In how many rows each word of the corpus occurs, by the word's hash."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TERM), F.lit(0))
    words = F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w))))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def _revealing(pairs: DataFrame, places: DataFrame, docs: DataFrame, total: int, options: Disclosure) -> DataFrame:
    """(entity, term, kind) of the words that reveal too much."""
    both = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    values = places.where(F.col("kind") != WORD).select("rid", F.col("id").alias("entity")).distinct().groupBy(
        "entity").agg(F.count(F.lit(1)).alias("n_entity"))
    told = F.log(F.lit(float(total)) * F.col("n_both") / F.col("n_entity") / (F.col("n_term") + options.smoothing))
    worth = F.log(F.lit(float(total)) / F.col("n_entity"))
    share = F.when(worth > 0, told / worth)
    return (
        both.join(values, "entity").join(_term_rows(docs, options), "term")
        .withColumn("share", share).where(F.col("share") >= options.generalise)
        .select("entity", "term", "share",
                F.when(F.col("share") >= options.remove, "removed").otherwise("general").alias("kind"))
    )


def spans(docs: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, h (hash of the text) and an array of spans per kind for every row of ``docs``."""
    base = materialise(_base(docs, options), "pii-base")
    places = materialise(_places(base, options), "pii-places")
    pairs = materialise(_near(places, options), "pii-near")
    revealing = _revealing(pairs, places, docs, base.count(), options)
    told = pairs.join(revealing, ["entity", "term"]).groupBy("rid", "term").agg(F.max("kind").alias("kind"))
    words = places.where(F.col("kind") == WORD).select("rid", "start", "end", F.col("id").alias("term"))
    found = words.join(told, ["rid", "term"]).select("rid", "kind", "start", "end").unionByName(
        places.where(F.col("kind") != WORD).select("rid", "kind", "start", "end")
    ).groupBy("rid").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).alias(k) for k in KINDS
    ])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.select("rid", "doc_id", "h").join(found, "rid", "left").select(
        "doc_id", "h", *[F.coalesce(k, none).alias(k) for k in KINDS]
    )


def _listed(kind: str) -> Column:
    return F.transform(
        F.col(kind), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    )


def personal_data(docs: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """Counts and spans of personal data in every row of ``docs`` (doc_id, text).

    ``spans`` lists kind:start:end in code points by kind, then start; ``general``
    and ``removed`` are the words to be generalised and removed. A null text is
    empty and has no spans; rows with a null or repeated doc_id are results of
    their own, and equal rows have equal results; a row counts as often as it is
    there. Other columns are not read; no rows give no rows. In a corpus of a
    few rows a word next to a value tells too little to be judged.
    """
    found = spans(docs, options)
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.concat(*[_listed(k) for k in BASE_KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[_listed(k) for k in KINDS]), ",").alias("spans"),
    )


def _masked(text: Column, all_spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first names the mask."""
    def step(acc: Column, s: Column) -> Column:
        mask = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], before, mask).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(
        F.array_sort(all_spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def _named(kind: str) -> Column:
    return F.transform(
        F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def sanitised(docs: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """The rows of ``docs`` with personal data masked and revealing words generalised or removed in ``text``."""
    found = spans(docs, options)
    named = F.concat(*[_named(k) for k in KINDS])
    # Rows without spans need no change, and equal rows share one.
    marked = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), named.alias("all")).where(
        F.size("all") > 0
    ).dropDuplicates(["d", "g"])
    marked = materialise(marked, "pii-spans")
    # Every span needs a value in its row: texts that match no pattern stay as they are and where they are.
    text = F.coalesce("text", F.lit(""))
    likely = reduce(or_, [_matches(k, text) for k in BASE_KINDS])
    rows = docs.where(likely).select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("h"))
    joined = rows.join(marked, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    masked = F.when(F.col("all").isNull(), F.col("row.text")).otherwise(_masked(F.col("row.text"), F.col("all")))
    changed = joined.select(*[
        masked.alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns
    ])
    return docs.where(~likely).union(changed)
