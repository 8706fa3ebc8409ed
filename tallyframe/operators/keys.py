"""Choosing the columns two tables are matched on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.functions import cells
from tallyframe.functions.ranks import with_row_number

ROW_KEY = "__row__"

# Column names taken as a key when none is given.
KEY_NAMES = ("id", "ID", "Id")
AD_HOC_KEY_NAMES = (
    "id", "employee id", "employee_id", "order id", "order_id",
    "customer id", "customer_id", "account id", "account_id",
)


class SchemaMismatch(ValueError):
    def __init__(self, missing_in_target: list[str], extra_in_target: list[str]):
        super().__init__(
            f"schemas differ: missing in target {missing_in_target}, extra in target {extra_in_target}"
        )
        self.missing_in_target = missing_in_target
        self.extra_in_target = extra_in_target


class RowLimitExceeded(ValueError):
    pass


def column_id(name: str) -> str:
    """Column names are excluded by letters and digits alone: `Load_Date` is `load date`."""
    return re.sub("[^a-z0-9]", "", name.lower())


def excluded(names: Iterable[str], exclude: Iterable[str]) -> set[str]:
    ids = {column_id(e) for e in exclude}
    return {n for n in names if column_id(n) in ids}


def schema_difference(
    source: DataFrame, target: DataFrame, exclude: Iterable[str] = ()
) -> tuple[list[str], list[str]]:
    s = set(source.columns) - excluded(source.columns, exclude)
    t = set(target.columns) - excluded(target.columns, exclude)
    return sorted(s - t), sorted(t - s)


def shared_columns(source: DataFrame, target: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    there = set(target.columns)
    gone = excluded(source.columns, exclude)
    return [c for c in source.columns if c in there and c not in gone]


def checked_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> list[str]:
    absent = [k for k in keys if k not in source.columns or k not in target.columns]
    if absent:
        raise ValueError(f"key columns not present in both inputs: {absent}")
    return list(keys)


def inferred_keys(source: DataFrame, target: DataFrame) -> list[str] | None:
    """Key guess for ad-hoc comparisons: well-known names, any case, then a lone shared column."""
    shared = shared_columns(source, target)
    by_lower = {c.strip().lower(): c for c in reversed(shared)}
    for name in AD_HOC_KEY_NAMES:
        if name in by_lower:
            return [by_lower[name]]
    return shared if len(shared) == 1 else None


def resolved_keys(
    source: DataFrame, target: DataFrame, keys: Sequence[str] = (), exclude: Iterable[str] = (),
    ad_hoc: bool = False,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Explicit keys, else an id column, else the only shared column, else row position."""
    requested = [k for k in keys if k]
    if requested:
        return source, target, checked_keys(source, target, requested)
    shared = shared_columns(source, target)
    if ad_hoc:
        guess = inferred_keys(source, target)
        if guess:
            return source, target, guess
    else:
        for name in KEY_NAMES:
            if name in shared:
                return source, target, [name]
        if len(shared) == 1:
            return source, target, shared
    return (*by_position(source, target, exclude), [ROW_KEY])


def by_position(
    source: DataFrame, target: DataFrame, exclude: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Both sides sorted by their shared columns and numbered from one."""
    order = shared_columns(source, target, exclude)
    if not order:
        raise ValueError("no shared columns to align rows by")
    sides = [cells.normalised(source), cells.normalised(target)]
    for name in order:
        s, t = (side.schema[name].dataType for side in sides)
        if cells.pair_kind(s, t, 0.0) == "never" or not _sortable(s) or not _sortable(t):
            sides = [
                side.withColumn(name, cells.text(cells.q(name), side.schema[name].dataType))
                for side in sides
            ]
    return tuple(with_row_number(side, order, ROW_KEY) for side in sides)


def _sortable(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def key_type(s: T.DataType, t: T.DataType, name: str) -> str:
    if cells.is_integral(s) and cells.is_integral(t):
        return "bigint"
    if cells.is_numeric(s) and cells.is_numeric(t):
        return "double"
    if cells.is_temporal(s) and cells.is_temporal(t):
        return "timestamp"
    if type(s) is type(t) and _sortable(s):
        return s.simpleString()
    raise ValueError(f"key column '{name}' has types {s.simpleString()} and {t.simpleString()}")
