"""The prefix trie of conversations, rolled up by centroids.

A node is a distinct sequence of first turns. A turn is known by 128 bits, a
prefix by the exclusive or of the bits of its turns, salted by their places, so
texts are read where they lie and never move. For every node the rows of its
members at or below it are counted: that is the sum of the members of all nodes
of its subtree, a weight whose subtree sums are known before any rollup.

With it the forest of parent edges is split at centroids. In a component of
weight w the nodes whose subtree weighs more than w / 2 are one path from the
top; its lower end is the centroid. The totals of the components below the
centroid are added to all nodes of that path, its weight is taken off them, and
the centroid goes out, which leaves components of at most half the weight each.
So every node is added once to each of its ancestors, in as many rounds as the
weight can be halved, however deep the trie is. Components up to ``IN_TASK``
nodes are split on by the same rule within one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.ranks import running_total
from tallyframe.session import materialise

IN_TASK = 50_000  # nodes of a component that one task splits; larger ones are split by joins
BLOCK = 65_536  # turns of a conversation in one window
CELL = 4_096  # neighbouring conv_ids joined to one text
BROADCAST_ROWS = 500_000  # components (some 70 bytes each) that are broadcast; more are joined by shuffle

KEY = ["k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns by place: conv_id, place (1 on), key_a, key_b (bits of role and text), points (code points of the text).

    Turns stand in the order of their number, null first; equal numbers in the
    order of role and a hash of the text. Null roles and texts are empty. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("key_a"), F.xxhash64(F.lit(2), text, role).alias("key_b"),
        F.char_length(text).cast("bigint").alias("points"), F.lit(1).alias("one"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key_a"), F.col("key_b")]
    rows = materialise(running_total(turns, order, "one", "at", "bigint"), "trie-turns")
    first = rows.groupBy("conv_id").agg(F.min("at").alias("first"))
    placed = rows.join(first, "conv_id").select(
        "conv_id", (F.col("at") - F.col("first") + 1).alias("place"), "key_a", "key_b", "points"
    )
    return materialise(placed, "trie-places")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the key of its prefix, that of the prefix before, and the turns of its conversation from it on."""
    salted = turns.select(
        "conv_id", "depth", "points", F.floor(F.col("depth") / BLOCK).alias("block"),
        F.xxhash64(F.lit(3), "depth", "key_a", "key_b").alias("s1"),
        F.xxhash64(F.lit(4), "depth", "key_b", "key_a").alias("s2"),
    )
    blocks = salted.groupBy("conv_id", "block").agg(
        F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.max("depth").alias("last")
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("b2"), F.max("last").over(whole).alias("turns"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = salted.withColumn("i1", F.bit_xor("s1").over(inside)).withColumn("i2", F.bit_xor("s2").over(inside))
    k1, k2 = (F.col(f"b{n}").bitwiseXOR(F.col(f"i{n}")) for n in (1, 2))
    return materialise(
        running.join(blocks, ["conv_id", "block"]).select(
            "conv_id", "depth", "points", k1.alias("k1"), k2.alias("k2"),
            k1.bitwiseXOR(F.col("s1")).alias("p1"), k2.bitwiseXOR(F.col("s2")).alias("p2"),
            (F.col("turns") - F.col("depth") + 1).alias("left"),
        ),
        "trie-prefixes",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of a partition sorted by node and cell; a node's texts are read one after the other."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "digest": digest.hexdigest()}], schema=schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) == node:
                digest.update(b",")
            else:
                if node:
                    yield row()
                node, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
    if node:
        yield row()


def _ends(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """Node and digest of the ids of the conversations that end there."""
    ended = prefixes.where("left = 1").select("conv_id", *KEY).unionByName(
        members.join(prefixes.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
        .select("conv_id", F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"))
    )
    # conv_ids are distinct, so a cell of neighbours has at most CELL of them, however many end at a node.
    cells = ended.groupBy(*KEY, F.floor(F.col("conv_id") / CELL).alias("cell")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    cells = materialise(cells, "trie-ends")
    per_node = cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cells"))
    few = cells.join(per_node.where("cells = 1"), KEY, "left_semi").select(*KEY, F.sha2("ids", 256).alias("digest"))
    many = cells.join(per_node.where("cells > 1"), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "cell")
    return few.unionByName(many.select(*KEY, "ids").mapInArrow(_digests, "k1 bigint, k2 bigint, digest string"))


def _lower(link: np.ndarray) -> np.ndarray:
    """The end of every chain of links."""
    while True:
        further = link[link]
        if np.array_equal(further, link):
            return link
        link = further


def split_in_task(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``values`` in a forest, by centroids; a top has parent -1.

    All components are split at the same time, one centroid each in a round.
    """
    n = len(parent)
    sums, weight, me = np.zeros_like(values), weight.copy(), np.arange(n)
    top = _lower(np.where(parent < 0, me, parent))
    live = me
    while len(live):
        heavy = live[2 * weight[live] > weight[top[live]]]
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        last = np.append(top[heavy][1:] != top[heavy][:-1], True)
        centre = np.full(n, -1)
        centre[top[heavy[last]]] = heavy[last]
        is_centre = np.zeros(n, dtype=bool)
        is_centre[heavy[last]] = True
        live = live[~is_centre[live]]
        above = parent[live]
        starts = (above < 0) | is_centre[above] | (top[live] == live)
        link = me.copy()
        link[live] = np.where(starts, live, above)
        link = _lower(link)
        # Totals of the components, then of those below each centroid.
        total = np.zeros_like(values)
        np.add.at(total, link[live], values[live])
        tops = live[link[live] == live]
        below = tops[(parent[tops] >= 0) & is_centre[parent[tops]]]
        moved = np.zeros_like(values)
        moved[heavy[last]] = values[heavy[last]]
        np.add.at(moved, parent[below], total[below])
        own = centre[top[heavy]]
        sums[heavy] += moved[own]
        taken = weight[own]
        path = heavy != own
        weight[heavy[path]] -= taken[path]
        top = link
    return sums


_ROLLED = "k1 bigint, k2 bigint, leaves bigint, saved bigint"


def _small(table: pa.Table) -> pa.Table:
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    place = {key: k for k, key in enumerate(zip(columns["k1"].tolist(), columns["k2"].tolist()))}
    is_top = (columns["k1"] == columns["c1"]) & (columns["k2"] == columns["c2"])
    parent = np.array([place.get(p, -1) for p in zip(columns["p1"].tolist(), columns["p2"].tolist())], dtype=np.int64)
    parent[is_top] = -1
    values = np.stack([columns["leaf"], columns["own"]], axis=1)
    sums = split_in_task(parent, columns["depth"], columns["weight"], values)
    return pa.table({
        "k1": columns["k1"], "k2": columns["k2"],
        "leaves": columns["leaves"] + sums[:, 0], "saved": columns["saved"] + sums[:, 1],
    })


def _offered(components: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(components) if rows <= BROADCAST_ROWS else components


def _split(state: DataFrame, totals: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One round for large components: ``state`` without a change of rows, with ``out`` set at the centroids.

    ``totals`` (c1, c2, total) has one row for each component: at most one for IN_TASK nodes.
    """
    comp, n = ["c1", "c2"], totals.count()
    rows = state.join(_offered(totals, n), comp)
    heavy = rows.where(2 * F.col("weight") > F.col("total"))
    lowest = heavy.groupBy(*comp).agg(F.max_by(F.struct("k1", "k2", "depth", "weight"), "depth").alias("z"))
    centres = materialise(
        lowest.select(*comp, F.col("z.k1").alias("z1"), F.col("z.k2").alias("z2"), F.col("z.depth").alias("z_depth"),
                      F.col("z.weight").alias("z_weight")),
        "trie-centres",
    )
    rows = rows.join(_offered(centres, n), comp)
    # A node's ancestor below the centroid is the prefix of its own member at that depth.
    steps = prefixes.select(
        F.col("conv_id"), F.col("depth").alias("step"), F.col("k1").alias("n1"), F.col("k2").alias("n2"),
        F.col("p1").alias("z1"), F.col("p2").alias("z2"),
    )
    deeper = rows.where("depth > z_depth").withColumn("step", F.col("z_depth") + 1)
    deeper = deeper.join(steps, ["conv_id", "step", "z1", "z2"], "left").drop("step")
    other = rows.where("depth <= z_depth").withColumn("n1", F.lit(None).cast("bigint")).withColumn(
        "n2", F.lit(None).cast("bigint"))
    is_centre = (F.col("k1") == F.col("z1")) & (F.col("k2") == F.col("z2"))
    labelled = materialise(
        deeper.unionByName(other).withColumn("out", is_centre).withColumn("under", F.col("n1").isNotNull() | is_centre),
        "trie-labels",
    )
    moved = labelled.where("under").groupBy(*comp).agg(F.sum("leaf").alias("m_leaf"), F.sum("own").alias("m_own"))
    labelled = labelled.join(_offered(moved, n), comp)
    on_path = 2 * F.col("weight") > F.col("total")

    def added(column: str, more: str) -> Column:
        return (F.col(column) + F.when(on_path, F.col(more)).otherwise(F.lit(0))).alias(column)

    return materialise(
        labelled.select(
            *KEY, "p1", "p2", F.coalesce("n1", "c1").alias("c1"), F.coalesce("n2", "c2").alias("c2"), "conv_id", "depth",
            (F.col("weight") - F.when(on_path & ~F.col("out"), F.col("z_weight")).otherwise(F.lit(0))).alias("weight"),
            "leaf", "own", added("leaves", "m_leaf"), added("saved", "m_own"), "out",
        ),
        "trie-state",
    )


def _rollup(nodes: DataFrame, prefixes: DataFrame, in_task: int) -> DataFrame:
    """k1, k2, leaves, saved: subtree sums of ``leaf`` and ``own`` over ``nodes``, one tree from the root (0, 0)."""
    zero = F.lit(0).cast("bigint")
    # Written, so that the joins below see columns and not constants.
    state = materialise(
        nodes.select(
            *KEY, F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), zero.alias("c1"), zero.alias("c2"),
            "conv_id", "depth", "weight", "leaf", "own", zero.alias("leaves"), zero.alias("saved"), F.lit(False).alias("out"),
        ),
        "trie-state",
    )
    comp, done = ["c1", "c2"], []
    while True:
        sizes = state.where("not out").groupBy(*comp).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
        large = materialise(sizes.where(F.col("n") > in_task).select(*comp, "total"), "trie-large")
        n_large = large.count()
        small = state.where("not out").join(_offered(large, n_large), comp, "left_anti")
        # A component is in one task, with others up to about as many nodes.
        tasks = max(1, -(-small.count() // in_task))
        bin_ = F.pmod(F.xxhash64(*comp), F.lit(tasks))
        done.append(materialise(small.withColumn("bin", bin_).groupBy("bin").applyInArrow(_small, _ROLLED), "trie-rolled"))
        done.append(state.where("out").select(*KEY, "leaves", "saved"))
        if not n_large:
            break
        state = _split(state.where("not out").drop("out"), large, prefixes)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def prefix_trie(turns: DataFrame, members: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Nodes of the prefix trie of all conversations.

    ``turns`` has conv_id, depth (1 on, without gaps), key_a, key_b and points as
    from ``numbered``; ``members`` has each conv_id once, also those without
    turns, which end at the root. Result: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times code points of the last
    text), ends_sha256 (of the ids of members that end here, ascending and joined
    by commas; of the empty string if none do). Equal conversations share their
    nodes; empty texts are turns like others. Without members there is no node.
    """
    prefixes = _prefixes(turns)
    inner = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points"), F.sum("left").alias("weight"),
    )
    zero = F.lit(0).cast("bigint")
    at_root = members.select("conv_id", F.lit(1).cast("bigint").alias("left")).unionByName(
        prefixes.where("depth = 1").select(F.lit(None).cast("bigint").alias("conv_id"), "left")
    )
    root = at_root.agg(
        F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"), F.sum("left").alias("weight")
    ).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), F.lit(None).cast("bigint").alias("p1"),
        F.lit(None).cast("bigint").alias("p2"), "n_convs", zero.alias("points"), "weight",
    )
    found = materialise(inner.unionByName(root), "trie-found")
    children = found.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = materialise(
        found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("points")),
        "trie-nodes",
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = materialise(
        nodes.select(*KEY, "p1", "p2", "conv_id", "depth", "n_convs", "n_children").join(parents, ["p1", "p2"], "left"),
        "trie-named",
    )
    return named.join(_rollup(nodes, prefixes, in_task), KEY).join(_ends(prefixes, members), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
