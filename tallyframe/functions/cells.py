"""Column expressions for normalising, comparing and describing single cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The textual shape of a UUID.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# The textual shape of a number.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)\s*$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """A column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, _FRACTIONAL)


def is_numeric(t: T.DataType) -> bool:
    return is_integral(t) or is_fractional(t)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, _TEMPORAL)


def number(c: Column, t: T.DataType) -> Column:
    """Numeric reading of a column: NULL for text that is no number, and for NaN."""
    if isinstance(t, T.DecimalType):
        return c.cast("double")
    if is_fractional(t):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_integral(t):
        return c.cast("double")
    if isinstance(t, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(t, T.StringType):
        # Casting text that is no number throws inside Spark, so the shape is tested first.
        return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))
    return F.lit(None).cast("double")


def moment(c: Column, t: T.DataType) -> Column:
    """Timestamp reading of a column: NULL where it cannot be parsed."""
    if is_temporal(t):
        return c.cast("timestamp")
    if isinstance(t, T.StringType):
        return F.try_to_timestamp(c)
    return F.lit(None).cast("timestamp")


def text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def read_back(c: Column, t: T.DataType) -> Column:
    """A cell of type ``t`` from its text, so far as :func:`number` needs it."""
    if is_numeric(t):
        return c.try_cast("double").cast(t) if not is_integral(t) else c.try_cast(t)
    if isinstance(t, T.BooleanType):
        return c.try_cast("boolean")
    return c


def normalised(df: DataFrame) -> DataFrame:
    """Decimals to double, NaN to NULL, UUID text to upper case, zoneless times to UTC."""
    out = []
    for field in df.schema:
        c, t = q(field.name), field.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(t, T.StringType):
            c = F.when((F.length(c) == 36) & c.rlike(UUID_PATTERN), F.upper(c)).otherwise(c)
        elif isinstance(t, T.TimestampNTZType):
            c = c.cast("timestamp")
        elif isinstance(t, T.NullType):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def tidied(df: DataFrame, lower: list[str] | tuple = (), spaces: list[str] | tuple = ()) -> DataFrame:
    """Fold case and collapse whitespace in the named text columns."""
    changed = {}
    for field in df.schema:
        name = field.name
        if not isinstance(field.dataType, T.StringType) or name not in {*lower, *spaces}:
            continue
        c = q(name)
        if name in spaces:
            c = F.trim(F.regexp_replace(c, "(?U)\\s+", " "))
        if name in lower:
            c = F.lower(c)
        changed[name] = c
    if not changed:
        return df
    return df.select(*[changed.get(n, q(n)).alias(n) for n in df.columns])


def pair_kind(s: T.DataType, t: T.DataType, time_tolerance: float) -> str:
    """How two column types are compared: exact, number, tolerant, time or never."""
    if is_numeric(s) and is_numeric(t):
        return "tolerant" if is_fractional(s) or is_fractional(t) else "exact"
    if is_temporal(s) and is_temporal(t):
        return "time" if time_tolerance > 0 else "moment"
    if type(s) is type(t):
        return "exact"
    return "never"


def cells_equal(
    s: Column, t: Column, kind: str, s_type: T.DataType, t_type: T.DataType,
    tolerance: float, time_tolerance: float,
) -> Column:
    """Equality of two non-null cells."""
    if kind == "tolerant":
        a, b = s.cast("double"), t.cast("double")
        # The first test only matters for equal infinities.
        return (a == b) | (F.abs(a - b) <= F.lit(float(tolerance)))
    if kind == "time":
        gap = F.abs(F.unix_micros(s.cast("timestamp")) - F.unix_micros(t.cast("timestamp")))
        return gap <= F.lit(int(round(time_tolerance * 1_000_000)))
    if kind == "moment":
        return s.cast("timestamp") == t.cast("timestamp")
    if kind == "never":
        return F.lit(False)
    if isinstance(s_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(s) == F.to_json(t)
    return s == t


def cells_differ(s: Column, t: Column, equal: Column, nulls_match: bool) -> Column:
    return (
        F.when(s.isNull() & t.isNull(), F.lit(not nulls_match))
        .when(s.isNull() | t.isNull(), F.lit(True))
        .otherwise(~equal)
    )


def delta(s: Column, s_type: T.DataType, t: Column, t_type: T.DataType) -> Column:
    if isinstance(s_type, _TEMPORAL) or isinstance(t_type, _TEMPORAL):
        return F.lit(None).cast("double")
    return number(t, t_type) - number(s, s_type)


def relative_delta(s: Column, s_type: T.DataType, t: Column, t_type: T.DataType) -> Column:
    return F.try_divide(delta(s, s_type, t, t_type), number(s, s_type))
