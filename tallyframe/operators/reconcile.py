"""Key-by-key reconciliation of two tables.

A first pass over the key columns alone (the census) settles every row count
without a join and finds keys held by very many rows. Ordinary keys are then
joined; for heavy keys the number of differing pairs is computed from counts per
distinct value, so no list of pairs is ever built for them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import cells
from tallyframe.functions.ranks import running_total
from tallyframe.operators import keys as K
from tallyframe.session import materialise

PASSED, FAILED, SLOW, ERROR, SKIPPED = "PASSED", "FAILED", "SLOW", "ERROR", "SKIPPED"
ROW_COLUMN = "<row>"
MISSING_IN_TARGET, MISSING_IN_SOURCE, VALUE_DIFF = "missing_in_target", "missing_in_source", "value_diff"


@dataclass(frozen=True)
class CompareOptions:
    key_columns: Sequence[str] = ()
    exclude_columns: Sequence[str] = ()
    float_tolerance: float = 1e-9
    column_tolerances: Mapping[str, float] = field(default_factory=dict)
    datetime_tolerance_seconds: float = 0.0
    null_equals_null: bool = True
    case_insensitive_columns: Sequence[str] = ()
    whitespace_columns: Sequence[str] = ()
    schema_policy: str = "warn"
    change_column: str | None = None
    since: str | None = None
    sample_fraction: float | None = None
    sample_seed: int = 42
    segment_columns: Sequence[str] = ()
    max_compare_rows: int = 0
    ad_hoc_keys: bool = False
    # A key is heavy when its row pairs, or its rows, exceed these. At most
    # total rows / 1000 keys can be heavy by the first, far fewer in practice.
    heavy_pairs: int = 1_000_000
    heavy_rows: int = 1_000_000


@dataclass(frozen=True)
class KeyCensus:
    source_rows: int
    target_rows: int
    matched: int
    missing_in_target: int
    missing_in_source: int
    duplicate_keys_source: int
    duplicate_keys_target: int
    null_keys: int
    heavy_keys: int


def since_filter(df: DataFrame, column: str | None, since: str | None) -> DataFrame:
    """Rows changed at or after ``since``; rows without a readable time stay in."""
    if not column or not since or column not in df.columns:
        return df
    kind = df.schema[column].dataType
    if cells.is_temporal(kind):
        # Compared in the column's own type, so that the filter reaches the scan.
        at = cells.q(column)
        bound = F.lit(since).cast("timestamp_ntz").cast(kind) if kind.typeName() != "timestamp" else F.lit(since).cast(kind)
    else:
        at = cells.moment(cells.q(column), kind)
        bound = F.lit(since).cast("timestamp")
    return df.where(at.isNull() | (at >= bound))


def sample_by_key(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """A key is in the sample on both sides or on neither."""
    bucket = F.pmod(F.xxhash64(*[cells.q(k) for k in keys], F.lit(seed)), F.lit(1_000_000))
    return df.where(bucket < int(fraction * 1_000_000))


def same_key(left: str, right: str, n: int, nullable: bool) -> Column:
    pairs = [(F.col(f"{left}{i}"), F.col(f"{right}{i}")) for i in range(n)]
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) if nullable else l == r for l, r in pairs])


class Comparison:
    """Two prepared tables and the lazy tables of what differs between them."""

    def __init__(self, source: DataFrame, target: DataFrame, options: CompareOptions = CompareOptions()):
        self.options = o = options
        if o.max_compare_rows:
            total = source.count() + target.count()
            if total > o.max_compare_rows:
                raise K.RowLimitExceeded(f"{total} rows exceed the limit of {o.max_compare_rows}")
        source = since_filter(source, o.change_column, o.since)
        target = since_filter(target, o.change_column, o.since)
        self.missing_in_target, self.extra_in_target = K.schema_difference(
            source, target, o.exclude_columns
        )
        if o.schema_policy == "error" and (self.missing_in_target or self.extra_in_target):
            raise K.SchemaMismatch(self.missing_in_target, self.extra_in_target)
        source, target, self.keys = K.resolved_keys(
            source, target, o.key_columns, o.exclude_columns, o.ad_hoc_keys
        )
        shared = K.shared_columns(source, target, o.exclude_columns)
        self.columns = [c for c in shared if c not in self.keys]
        keep = self.keys + self.columns
        source = self._tidy(source.select(*[cells.q(c) for c in keep]))
        target = self._tidy(target.select(*[cells.q(c) for c in keep]))
        self._types = [
            (source.schema[c].dataType, target.schema[c].dataType) for c in self.columns
        ]
        self._kinds = [
            cells.pair_kind(s, t, o.datetime_tolerance_seconds) for s, t in self._types
        ]
        key_types = [
            K.key_type(source.schema[k].dataType, target.schema[k].dataType, k) for k in self.keys
        ]
        self.source = self._side(source, "s", key_types)
        self.target = self._side(target, "t", key_types)

    def _tidy(self, df: DataFrame) -> DataFrame:
        o = self.options
        return cells.tidied(
            cells.normalised(df), list(o.case_insensitive_columns), list(o.whitespace_columns)
        )

    def _side(self, df: DataFrame, tag: str, key_types: list[str]) -> DataFrame:
        ks = [cells.q(k).cast(t).alias(f"{tag}k{i}") for i, (k, t) in enumerate(zip(self.keys, key_types))]
        vs = [cells.q(c).alias(f"{tag}{i}") for i, c in enumerate(self.columns)]
        side = df.select(*ks, *vs)
        o = self.options
        if o.sample_fraction is None:
            return side
        # After the cast to the common key type: equal keys of other types hash differently.
        return sample_by_key(side, [f"{tag}k{i}" for i in range(len(self.keys))], o.sample_fraction, o.sample_seed)

    def _keys_of(self, tag: str) -> list[Column]:
        return [F.col(f"{tag}k{i}") for i in range(len(self.keys))]

    # -- census ------------------------------------------------------------

    @cached_property
    def key_counts(self) -> DataFrame:
        """Rows per key on each side: ``k0.., m, n, heavy``."""
        names = [f"k{i}" for i in range(len(self.keys))]

        def one(side: DataFrame, tag: str, m: int, n: int) -> DataFrame:
            ks = [c.alias(k) for c, k in zip(self._keys_of(tag), names)]
            return side.select(*ks, F.lit(m).alias("m"), F.lit(n).alias("n"))

        both = one(self.source, "s", 1, 0).unionAll(one(self.target, "t", 0, 1))
        o = self.options
        counted = both.groupBy(*names).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
        heavy = (F.col("m").cast("double") * F.col("n") > o.heavy_pairs) | (
            F.col("m") + F.col("n") > o.heavy_rows
        )
        return counted.withColumn("heavy", heavy)

    @cached_property
    def census(self) -> KeyCensus:
        m, n, heavy = F.col("m"), F.col("n"), F.col("heavy")
        any_null = reduce(lambda a, b: a | b, [F.col(f"k{i}").isNull() for i in range(len(self.keys))])
        wide = m.cast("decimal(19,0)") * n.cast("decimal(19,0)")
        row = self.key_counts.agg(
            F.sum("m").alias("source_rows"),
            F.sum("n").alias("target_rows"),
            F.sum(F.when(~heavy, m * n)).alias("light_pairs"),
            F.sum(F.when(heavy, wide)).alias("heavy_pairs"),
            F.sum(F.when(n == 0, m)).alias("missing_in_target"),
            F.sum(F.when(m == 0, n)).alias("missing_in_source"),
            F.sum(F.when(m > 1, m - 1)).alias("duplicate_keys_source"),
            F.sum(F.when(n > 1, n - 1)).alias("duplicate_keys_target"),
            F.count_if(any_null).alias("null_keys"),
            F.count_if(heavy).alias("heavy_keys"),
        ).first().asDict()
        counts = {k: int(v or 0) for k, v in row.items()}
        matched = counts.pop("light_pairs") + counts.pop("heavy_pairs")
        return KeyCensus(matched=matched, **counts)

    @cached_property
    def _heavy(self) -> DataFrame:
        return materialise(self.key_counts.where("heavy").drop("heavy"), "heavy-keys")

    def _part(self, side: DataFrame, tag: str, how: str, heavy: DataFrame | None = None) -> DataFrame:
        if self.census.heavy_keys == 0:
            return side
        on = same_key(f"{tag}k", "k", len(self.keys), self.census.null_keys > 0)
        return side.join(self._heavy if heavy is None else heavy, on, how)

    # -- cell differences --------------------------------------------------

    def _differs(self, i: int) -> Column:
        o = self.options
        s, t = F.col(f"s{i}"), F.col(f"t{i}")
        equal = cells.cells_equal(
            s, t, self._kinds[i], *self._types[i], self._tolerance(i), o.datetime_tolerance_seconds
        )
        return cells.cells_differ(s, t, equal, o.null_equals_null)

    def _tolerance(self, i: int) -> float:
        return float(self.options.column_tolerances.get(self.columns[i], self.options.float_tolerance))

    @cached_property
    def column_counts(self) -> DataFrame:
        """``ordinal, mismatch_count`` for every compared column."""
        spark = self.source.sparkSession
        if not self.columns:
            return spark.createDataFrame([], "ordinal int, mismatch_count bigint")
        on = same_key("sk", "tk", len(self.keys), self.census.null_keys > 0)
        joined = self._part(self.source, "s", "left_anti").join(
            self._part(self.target, "t", "left_anti"), on, "inner"
        )
        wide = joined.agg(
            *[F.count_if(self._differs(i)).alias(f"c{i}") for i in range(len(self.columns))]
        )
        tall = wide.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("ordinal"), F.col(f"c{i}").cast("bigint").alias("mismatch_count")
                        )
                        for i in range(len(self.columns))
                    ]
                )
            )
        )
        if self.census.heavy_keys:
            extra = self._heavy_values.groupBy("ordinal").agg(
                F.sum("pairs").cast("bigint").alias("mismatch_count")
            )
            tall = tall.unionAll(extra).groupBy("ordinal").agg(
                F.sum("mismatch_count").cast("bigint").alias("mismatch_count")
            )
        return tall

    def by_column(self) -> DataFrame:
        """Tall summary ``column_name, mismatch_count, compared_rows``, with the row pseudo-column."""
        c = self.census
        names = F.array(*[F.lit(n) for n in self.columns]) if self.columns else F.array(F.lit(""))
        per_column = self.column_counts.select(
            "ordinal",
            F.element_at(names, F.col("ordinal") + 1).alias("column_name"),
            F.col("mismatch_count").cast("bigint").alias("mismatch_count"),
            F.lit(c.matched).cast("bigint").alias("compared_rows"),
        )
        missing = c.missing_in_target + c.missing_in_source
        if not missing:
            return per_column
        row = self.source.sparkSession.range(1).select(
            F.lit(len(self.columns)).alias("ordinal"),
            F.lit(ROW_COLUMN).alias("column_name"),
            F.lit(missing).cast("bigint").alias("mismatch_count"),
            F.lit(missing).cast("bigint").alias("compared_rows"),
        )
        return per_column.unionAll(row)

    def by_type(self) -> DataFrame:
        return self.summary().select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("mismatch_type"), F.col(col).alias("mismatch_count"))
                        for name, col in (
                            (VALUE_DIFF, "value_mismatch_count"),
                            (MISSING_IN_TARGET, "missing_in_target_count"),
                            (MISSING_IN_SOURCE, "missing_in_source_count"),
                        )
                    ]
                )
            )
        )

    def match_percent(self) -> DataFrame:
        """Match rate per column, most differences first; the row pseudo-column loses ties."""
        rate = F.round(100 * (1 - F.try_divide(F.col("mismatch_count"), F.col("compared_rows"))), 4)
        return (
            self.by_column()
            .withColumn("match_pct", F.when(rate < 0, F.lit(0.0)).otherwise(rate))
            .orderBy(
                F.col("mismatch_count").desc(), F.col("column_name") == ROW_COLUMN, F.lower("column_name")
            )
            .drop("ordinal")
        )

    def summary(self, name: str = "reconcile", duration: float | None = None,
                max_duration: float | None = None) -> DataFrame:
        """One result row; row counts come from the census, cell counts from the join."""
        c = self.census

        def count(value: int) -> Column:
            return F.lit(value).cast("bigint")  # a count beyond 64 bits is an error, not another type

        slow = bool(max_duration and duration is not None and duration > max_duration)
        cellwise = self.column_counts.agg(
            F.coalesce(F.sum("mismatch_count"), F.lit(0)).cast("bigint").alias("value_mismatch_count")
        )
        clean = (
            (F.col("value_mismatch_count") == 0)
            & F.lit(c.missing_in_target == 0 and c.missing_in_source == 0)
        )
        return cellwise.select(
            F.lit(name).alias("query_name"),
            count(c.source_rows).alias("source_row_count"),
            count(c.target_rows).alias("target_row_count"),
            count(c.matched).alias("matched_count"),
            count(c.missing_in_target).alias("missing_in_target_count"),
            count(c.missing_in_source).alias("missing_in_source_count"),
            F.col("value_mismatch_count"),
            count(c.duplicate_keys_source).alias("duplicate_keys_source"),
            count(c.duplicate_keys_target).alias("duplicate_keys_target"),
            F.when(~clean, F.lit(FAILED)).otherwise(F.lit(SLOW if slow else PASSED)).alias("status"),
            F.lit(slow).alias("slow"),
        )

    def proved_equal(self) -> bool:
        """Whether checksums of what is compared, after all options, already prove that no cell differs.

        They do where both sides have the same columns and types, no key is
        repeated or missing, and nulls equal nulls.
        """
        c, o = self.census, self.options
        if self.missing_in_target or self.extra_in_target or not o.null_equals_null:
            return False
        if any(s != t for s, t in self._types) or "never" in self._kinds:
            return False
        if c.missing_in_target or c.missing_in_source or c.duplicate_keys_source or c.duplicate_keys_target:
            return False
        width, nk = len(self.columns), len(self.keys)
        names = [*[f"k{i}" for i in range(nk)], *[f"c{i}" for i in range(width)]]

        def plain(side: DataFrame, tag: str) -> DataFrame:
            found = [*self._keys_of(tag), *[F.col(f"{tag}{i}") for i in range(width)]]
            return side.select(*[column.alias(n) for column, n in zip(found, names)])

        return same_content(plain(self.source, "s"), plain(self.target, "t")).first()["identical"]

    def clean_summary(self, name: str = "reconcile") -> DataFrame:
        """The result row of two sides without differences, from the census alone."""
        c = self.census
        counts = {
            "source_row_count": c.source_rows, "target_row_count": c.target_rows, "matched_count": c.matched,
            "missing_in_target_count": 0, "missing_in_source_count": 0, "value_mismatch_count": 0,
            "duplicate_keys_source": c.duplicate_keys_source, "duplicate_keys_target": c.duplicate_keys_target,
        }
        return self.source.sparkSession.range(1).select(
            F.lit(name).alias("query_name"),
            *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()],
            F.lit(PASSED).alias("status"), F.lit(False).alias("slow"),
        )

    def summary_by(self, key: str) -> DataFrame:
        """One result row per value of one key column, all from the same census and join."""
        i = self.keys.index(key)
        m, n = F.col("m"), F.col("n")
        counts = self.key_counts.groupBy(F.col(f"k{i}").alias("g")).agg(
            F.sum("m").alias("source_row_count"), F.sum("n").alias("target_row_count"),
            F.sum(m * n).alias("matched_count"),
            F.coalesce(F.sum(F.when(n == 0, m)), F.lit(0)).alias("missing_in_target_count"),
            F.coalesce(F.sum(F.when(m == 0, n)), F.lit(0)).alias("missing_in_source_count"),
        )
        out = counts.withColumn("value_mismatch_count", F.lit(0).cast("bigint"))
        if self.columns:
            on = same_key("sk", "tk", len(self.keys), self.census.null_keys > 0)
            joined = self._part(self.source, "s", "left_anti").join(
                self._part(self.target, "t", "left_anti"), on, "inner"
            )
            cellwise = sum(
                (self._differs(j).cast("int") for j in range(1, len(self.columns))), self._differs(0).cast("int")
            )
            found = joined.groupBy(F.col(f"sk{i}").alias("h")).agg(F.sum(cellwise).cast("bigint").alias("c"))
            if self.census.heavy_keys:
                heavy = self._heavy_values.groupBy(F.col(f"k{i}").alias("h")).agg(F.sum("pairs").cast("bigint").alias("c"))
                found = found.unionAll(heavy).groupBy("h").agg(F.sum("c").cast("bigint").alias("c"))
            out = counts.join(found, F.col("g").eqNullSafe(F.col("h")), "left").withColumn(
                "value_mismatch_count", F.coalesce("c", F.lit(0).cast("bigint"))
            ).drop("h", "c")
        issues = F.col("missing_in_target_count") + F.col("missing_in_source_count") + F.col("value_mismatch_count")
        return out.withColumn("status", F.when(issues == 0, PASSED).otherwise(FAILED)).withColumnRenamed("g", key)

    # -- records -----------------------------------------------------------

    def _key_map(self, ks: list[Column]) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(k) for k in self.keys]), F.array(*[k.cast("string") for k in ks])
        )

    def records(self, limit: int | None = None) -> DataFrame:
        """Typed mismatch records; ``limit`` keeps the first ones in the fixed report order.

        A record of differing cells is one key, column, source value and segment
        values of the source row, whatever the number of rows below the key.
        ``pair_count`` says for how many row pairs it stands, and the target value
        is the smallest one that differs, null if only nulls do. A segment value
        that the source row lacks is the smallest of the key's target rows. Every
        row without a partner is a record.
        """
        n, width = len(self.keys), len(self.columns)
        single = not (self.census.duplicate_keys_source or self.census.duplicate_keys_target)
        on = same_key("sk", "tk", n, self.census.null_keys > 0)
        crossed = None if single else self._crossed
        joined = (
            self._part(self.source, "s", "left_anti", crossed).withColumn("in_s", F.lit(True))
            .join(self._part(self.target, "t", "left_anti", crossed).withColumn("in_t", F.lit(True)), on, "full_outer")
        )
        both = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
        # One small code per finding: a column's ordinal, or which side is missing.
        codes = [F.when(both & self._differs(i), F.lit(i)) for i in range(width)]
        codes += [F.when(F.col("in_t").isNull(), F.lit(-2)), F.when(F.col("in_s").isNull(), F.lit(-1))]
        ks = [F.when(F.col("in_s"), F.col(f"sk{i}")).otherwise(F.col(f"tk{i}")).alias(f"k{i}") for i in range(n)]
        cell_columns = [F.col(f"{side}{i}") for side in "st" for i in range(width)]
        found = joined.select(*ks, *cell_columns, F.explode(F.array(*codes)).alias("code")).where("code is not null")
        names = [f"k{i}" for i in range(n)]
        order = ["category", "ordinal", *[F.col(k).asc_nulls_first() for k in names]]
        found = found.withColumn("category", F.when(F.col("code") == -2, 0).when(F.col("code") == -1, 1).otherwise(2))
        found = found.withColumn("ordinal", F.greatest(F.col("code"), F.lit(-1)))
        if single and limit is not None:
            # Keys are unique, so the order is total; the first ones are picked before any value is turned into text.
            found = found.orderBy(*order).limit(limit)
        units = found.select(
            *names, "category", "ordinal", self._by_code("s").alias("source_value"),
            self._by_code("t").alias("target_value"), self._target_order().alias("target_order"),
            self._segments("st" if single else "s", found_key=names).alias("segments"),
        )
        if single:
            units = units.withColumn("pair_count", F.lit(1).cast("bigint"))
        else:
            # Rows without a partner stay records of their own.
            alone = F.when(F.col("category") < 2, F.monotonically_increasing_id())
            units = self._with_target_segments(units, names).withColumn("alone", alone)
            least = F.struct(F.col("target_value").isNull(), "target_order", "target_value")
            units = units.groupBy(*names, "category", "ordinal", "source_value", "segments", "alone").agg(
                F.min(least).alias("least"), F.count(F.lit(1)).alias("pair_count")
            ).select(*names, "category", "ordinal", "source_value", "segments", "pair_count", "least.target_value")
            if self.census.heavy_keys:
                units = units.unionByName(self._heavy_records(names))
            if limit is not None:
                units = units.orderBy(
                    *order, F.col("source_value").asc_nulls_first(), F.array_join("segments", ",", "")
                ).limit(limit)
        label = F.element_at(F.array(*[F.lit(c) for c in self.columns] or [F.lit("")]), F.col("ordinal") + 1)
        kinds = F.array(*[F.lit(k) for k in (MISSING_IN_TARGET, MISSING_IN_SOURCE, VALUE_DIFF)])
        wanted = self._segment_names()
        segments = F.lit(None).cast("map<string,string>")
        if wanted:
            segments = F.map_from_arrays(F.array(*[F.lit(w) for w in wanted]), F.col("segments"))
        return units.select(
            self._key_map([F.col(k) for k in names]).alias("key_values"),
            F.when(F.col("ordinal") < 0, ROW_COLUMN).otherwise(label).alias("column_name"),
            "source_value", "target_value", F.element_at(kinds, F.col("category") + 1).alias("mismatch_type"),
            *self._deltas(), segments.alias("segment_values"), "pair_count",
        )

    def _by_code(self, side: str) -> Column:
        """The text of the found cell, or whether the row is there."""
        out = F.when(F.col("code") == (-1 if side == "s" else -2), "missing").when(F.col("code") < 0, "present")
        for i, kinds in enumerate(self._types):
            out = out.when(F.col("code") == i, cells.text(F.col(f"{side}{i}"), kinds[side == "t"]))
        return out

    def _place(self, side: str, i: int) -> Column:
        """Where a cell stands among numbers or times, if it is compared within a tolerance."""
        c, kind = F.col(f"{side}{i}"), self._kinds[i]
        if kind == "tolerant":
            return c.cast("double")
        if kind == "time":
            return F.unix_micros(c.cast("timestamp")).cast("double")
        return F.lit(None).cast("double")

    def _target_order(self) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("double"))
        for i in range(len(self.columns)):
            out = out.when(F.col("code") == i, self._place("t", i))
        return out

    def _deltas(self) -> list[Column]:
        """Delta and relative delta of a record, read back from its texts."""
        none = F.lit(None).cast("double")
        delta, relative = F.when(F.lit(False), none), F.when(F.lit(False), none)
        for i, (st, tt) in enumerate(self._types):
            s, t = cells.read_back(F.col("source_value"), st), cells.read_back(F.col("target_value"), tt)
            own = F.col("ordinal") == i
            delta = delta.when(own, cells.delta(s, st, t, tt))
            relative = relative.when(own, cells.relative_delta(s, st, t, tt))
        return [delta.alias("delta"), relative.alias("relative_delta")]

    def _segment_names(self) -> list[str]:
        return [c for c in self.options.segment_columns if c in self.keys or c in self.columns]

    def _segments(self, sides: str, found_key: Sequence[str]) -> Column:
        """Segment values as an array, from the first of ``sides`` that has one; the target's where no source row is."""
        values = []
        for name in self._segment_names():
            if name in self.keys:
                values.append(F.col(found_key[self.keys.index(name)]).cast("string"))
                continue
            i = self.columns.index(name)
            texts = {x: cells.text(F.col(f"{x}{i}"), self._types[i][x == "t"]) for x in "st"}
            own = F.coalesce(*[texts[x] for x in sides])
            values.append(F.when(F.col("code") == -1, texts["t"]).otherwise(own) if sides == "s" else own)
        return F.array(*values).cast("array<string>")

    def _with_target_segments(self, units: DataFrame, names: list[str]) -> DataFrame:
        """Fill segment values that differing source rows lack with the smallest of the key's target rows."""
        other = [c for c in self._segment_names() if c not in self.keys]
        if not other:
            return units
        texts = []
        for name in self._segment_names():
            i = self.columns.index(name) if name in other else None
            texts.append(F.lit(None).cast("string") if i is None else F.min(cells.text(F.col(f"t{i}"), self._types[i][1])))
        least = self.target.groupBy(*self._keys_of("t")).agg(F.array(*texts).alias("least_segments"))
        joined = units.join(least, same_key("k", "tk", len(self.keys), self.census.null_keys > 0), "left")
        filled = F.zip_with("segments", F.coalesce("least_segments", "segments"), lambda a, b: F.coalesce(a, b))
        segments = F.when(F.col("category") == 2, filled).otherwise(F.col("segments"))
        return joined.withColumn("segments", segments).drop("least_segments", *[f"tk{i}" for i in range(len(self.keys))])

    # -- heavy keys --------------------------------------------------------

    @cached_property
    def _crossed(self) -> DataFrame:
        """Heavy keys with rows on both sides; one-sided rows are no pairs and need no counting."""
        return self._heavy.where("m > 0 and n > 0")

    def _cells_of(self, side: DataFrame, tag: str) -> DataFrame:
        """One row per key, column, distinct value and segment values, with its row count.

        ``v`` is the value as compared text, ``d`` as shown, ``x`` as a number where a tolerance applies.
        """
        out = []
        for i in range(len(self.columns)):
            t = self._types[i][0 if tag == "s" else 1]
            c, kind = F.col(f"{tag}{i}"), self._kinds[i]
            v = cells.text(c.cast("timestamp"), t) if kind in ("time", "moment") else cells.text(c, t)
            out.append(F.struct(
                F.lit(i).alias("ordinal"), v.alias("v"), cells.text(c, t).alias("d"), self._place(tag, i).alias("x")
            ))
        names = [f"{tag}k{i}" for i in range(len(self.keys))]
        segments = F.array().cast("array<string>")
        if tag == "s":
            segments = self._segments("s", names) if self._segment_names() else segments
            side = side.withColumn("code", F.lit(0)).withColumns(
                {f"t{i}": F.lit(None).cast(t) for i, (_, t) in enumerate(self._types)}
            )
        return (
            side.select(*names, segments.alias("segments"), F.inline(F.array(*out)))
            .groupBy(*names, "ordinal", "v", "d", "x", "segments")
            .agg(F.count(F.lit(1)).alias("rows"))
        )

    @cached_property
    def _heavy_values(self) -> DataFrame:
        """Per heavy key, column, source value and segments: how many row pairs differ, and the smallest target that does."""
        o, nk = self.options, len(self.keys)
        nullable = self.census.null_keys > 0
        shared = self._crossed
        s = materialise(self._cells_of(self._part(self.source, "s", "left_semi", shared), "s"), "heavy-source")
        t = materialise(self._cells_of(self._part(self.target, "t", "left_semi", shared), "t"), "heavy-target")
        never = [i for i, kind in enumerate(self._kinds) if kind == "never"]
        names = [f"k{i}" for i in range(nk)]

        def keyed(df: DataFrame, tag: str, *columns: Column | str) -> DataFrame:
            return df.select(*[c.alias(k) for c, k in zip(self._keys_of(tag), names)], *columns)

        # The two smallest different target values of a key and column.
        targets = keyed(t, "t", "ordinal", F.struct("x", "v", "d").alias("z"), "v", "rows")
        first = targets.where("v is not null").groupBy(*names, "ordinal").agg(F.min("z").alias("first"))
        first = materialise(first, "heavy-first")
        on_first = same_key("k", "fk", nk, nullable) & (F.col("ordinal") == F.col("ford"))
        renamed = first.select(
            *[F.col(k).alias(f"f{k}") for k in names], F.col("ordinal").alias("ford"), "first"
        )
        second = (
            targets.where("v is not null").join(renamed, on_first).where(F.col("v") != F.col("first.v"))
            .groupBy(*[f"f{k}" for k in names], "ford").agg(F.min("z").alias("second"))
        )
        smallest = renamed.alias("a").join(
            second.alias("b"),
            reduce(lambda a, b: a & b, [F.col(f"a.f{k}").eqNullSafe(F.col(f"b.f{k}")) for k in names])
            & (F.col("a.ford") == F.col("b.ford")), "left",
        ).select(*[f"a.f{k}" for k in names], "a.ford", "first", "second")

        per_value = targets.groupBy(*[F.col(k).alias(f"t{k}") for k in names], F.col("ordinal").alias("tord"), F.col("v").alias("tv"),
                                    F.col("z.x").alias("tx")).agg(F.sum("rows").alias("equal_rows"))
        same_value = (
            F.col("v").eqNullSafe(F.col("tv")) if o.null_equals_null else F.col("v") == F.col("tv")
        )
        if never:
            same_value = same_value & (~F.col("ordinal").isin(never) | F.col("v").isNull())
        on = same_key("k", "tk", nk, nullable) & (F.col("ordinal") == F.col("tord")) & same_value
        # Rows without a place are those of exact columns and the nulls of the others.
        exact = keyed(s, "s", "ordinal", "v", "d", "x", "segments", F.col("rows").alias("m")).where("x is null").join(
            per_value.where("tx is null"), on, "left",
        ).select(
            *names, "ordinal", "v", "d", "segments", "m",
            F.coalesce(F.col("equal_rows"), F.lit(0)).cast("decimal(38,0)").alias("equal_rows"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("string").alias("after"),
        )
        values = exact
        near = [i for i, kind in enumerate(self._kinds) if kind in ("tolerant", "time")]
        if near:
            values = values.unionByName(self._near_values(s, t, near))
        hot = shared.select(*[F.col(k).alias(f"h{k}") for k in names], F.col("n").alias("partners"))
        joined = values.join(hot, same_key("k", "hk", nk, nullable)).join(smallest, on_first, "left")
        differing = F.col("m").cast("decimal(19,0)") * (F.col("partners") - F.col("equal_rows")).cast("decimal(19,0)")
        is_first = F.col("v").eqNullSafe(F.col("first.v")) & ~F.col("ordinal").isin(never or [-1])
        least = F.when(F.col("low").isNotNull(), F.when(F.col("first.x") < F.col("low"), F.col("first.d")).otherwise(
            F.col("after"))).when(is_first, F.col("second.d")).otherwise(F.col("first.d"))
        return joined.select(
            *names, "ordinal", F.col("d").alias("source_value"), "segments", differing.alias("pairs"),
            least.alias("target_value"),
        ).where("pairs > 0")

    def _near_values(self, s: DataFrame, t: DataFrame, near: list[int]) -> DataFrame:
        """Target rows within tolerance of each source value, from one running total.

        Target values and the two ends of every source value's interval are put
        in one global order; the interval's count is the difference of the
        running totals at its ends, and the first target behind it begins where
        the total at its end stands.
        """
        nk = len(self.keys)
        tolerances = {
            i: self._tolerance(i) if self._kinds[i] == "tolerant"
            else float(round(self.options.datetime_tolerance_seconds * 1_000_000))
            for i in near
        }
        names = [f"k{i}" for i in range(nk)]
        x = F.col("x")
        high = _interval_end(x, tolerances, 1)
        low = _interval_end(x, tolerances, -1)
        none = F.lit(0).cast("bigint")
        targets = t.where("x is not null").groupBy(
            *[c.alias(k) for c, k in zip(self._keys_of("t"), names)], "ordinal", F.col("x").alias("at")
        ).agg(F.sum("rows").alias("w"), F.min(F.struct("v", "d")).getField("d").alias("d")).select(
            *names, "ordinal", "at", F.lit(1).alias("kind"), "w", "d"
        )
        sources = s.where("x is not null").select(
            *[c.alias(k) for c, k in zip(self._keys_of("s"), names)], "ordinal", "v", "d", "x", "segments",
            F.col("rows").alias("m"), low.alias("low"), high.alias("high"),
        )
        ends = sources.select(*names, "ordinal", F.col("low").alias("at"), F.lit(0).alias("kind")).unionAll(
            sources.select(*names, "ordinal", F.col("high").alias("at"), F.lit(2).alias("kind"))
        ).distinct().withColumn("w", none).withColumn("d", F.lit(None).cast("string"))
        order = [F.col(k).asc_nulls_first() for k in names] + [F.col("ordinal"), F.col("at"), F.col("kind")]
        totals = materialise(running_total(targets.unionByName(ends), order, "w"), "heavy-totals")
        nullable = self.census.null_keys > 0

        def at_end(df: DataFrame, end: str, kind: int) -> DataFrame:
            found = totals.where(F.col("kind") == kind).select(
                *[F.col(k).alias(f"e{k}") for k in names], F.col("ordinal").alias("eord"),
                F.col("at").alias("eat"), F.col("running_total").alias(f"upto_{end}"),
            )
            on = same_key("k", "ek", nk, nullable) & (F.col("ordinal") == F.col("eord")) & (F.col(end) == F.col("eat"))
            return df.join(found, on).drop(*[f"e{k}" for k in names], "eord", "eat")

        placed = at_end(at_end(sources, "low", 0), "high", 2)
        behind = totals.where("kind = 1").select(
            *[F.col(k).alias(f"b{k}") for k in names], F.col("ordinal").alias("bord"),
            (F.col("running_total") - F.col("w")).alias("begins"), F.col("d").alias("after"),
        )
        on = same_key("k", "bk", nk, nullable) & (F.col("ordinal") == F.col("bord")) & (F.col("upto_high") == F.col("begins"))
        return placed.join(behind, on, "left").select(
            *names, "ordinal", "v", "d", "segments", "m",
            (F.col("upto_high") - F.col("upto_low")).cast("decimal(38,0)").alias("equal_rows"), "low", "after",
        )

    def _heavy_records(self, names: list[str]) -> DataFrame:
        units = self._heavy_values.withColumn("category", F.lit(2))
        # Filling may give rows of one source value the same segments; its target is one and the same.
        return self._with_target_segments(units, names).groupBy(
            *names, "category", "ordinal", "source_value", "segments"
        ).agg(F.sum("pairs").cast("bigint").alias("pair_count"), F.min("target_value").alias("target_value"))


def _interval_end(x: Column, tolerances: Mapping[int, float], sign: int) -> Column:
    """The outermost double whose rounded distance from ``x`` is within tolerance.

    A rounded distance equals the tolerance up to half a step beyond it, so the
    end lies between ``x + tolerance`` and ``x + next double``; of the doubles
    around their middle the outermost that passes the comparison itself is it.
    """
    def pick(values: Mapping[int, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("ordinal"))

    tol = pick(tolerances)
    beyond = pick({i: math.nextafter(v, math.inf) for i, v in tolerances.items()})
    near, far = x + tol * sign, x + beyond * sign
    middle = near + (far - near) / 2
    step = F.abs(middle) * F.lit(1.12e-16)  # adding this moves a double to its neighbour
    around = F.array(x, near, *[middle + step * k for k in range(-4, 5)])
    inside = F.filter(around, lambda c: (c == x) | (F.abs(c - x) <= tol))
    return F.array_max(inside) if sign > 0 else F.array_min(inside)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: count, and xor and sum of two hashes of each row.

    Each cell goes in with its column, its type and whether it is null, so a
    value that moves to another column, or a null that does, changes the hash.
    """
    prepared = cells.normalised(df)
    parts = [F.lit(len(prepared.columns))]
    for f in prepared.schema:
        cell = cells.text(cells.q(f.name), f.dataType)
        parts += [F.lit(f"{f.name}:{f.dataType.simpleString()}"), cell.isNull(), F.coalesce(cell, F.lit(""))]
    hashes = {"a": F.xxhash64(*parts), "b": F.xxhash64(F.lit("second"), *reversed(parts))}
    sums = []
    for name, h in hashes.items():
        sums += [
            F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"xor_{name}"),
            F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"sum_{name}"),
        ]
    return prepared.agg(F.count(F.lit(1)).alias("row_count"), *sums)


def same_content(source: DataFrame, target: DataFrame) -> DataFrame:
    """Checksum pre-check: one row saying whether the two tables hold the same rows."""
    shared = K.shared_columns(source, target)
    sides = [
        fingerprint(side.select(*[cells.q(c) for c in shared])).withColumn("side", F.lit(name))
        for side, name in ((source, "s"), (target, "t"))
    ]
    prints = F.struct("row_count", "xor_a", "sum_a", "xor_b", "sum_b")
    return sides[0].unionAll(sides[1]).agg(
        F.max(F.when(F.col("side") == "s", F.col("row_count"))).alias("source_row_count"),
        F.max(F.when(F.col("side") == "t", F.col("row_count"))).alias("target_row_count"),
        (F.min(prints) == F.max(prints)).alias("identical"),
    )


def reconcile(source: DataFrame, target: DataFrame, options: CompareOptions = CompareOptions(),
              checksum_first: bool = False, name: str = "reconcile") -> DataFrame:
    """The result row of a comparison; equal checksums save the comparison of cells."""
    comparison = Comparison(source, target, options)
    if checksum_first and comparison.proved_equal():
        return comparison.clean_summary(name)
    return comparison.summary(name)
