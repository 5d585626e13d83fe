"""Column-expression helpers shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.constants import BOOLEAN_PAIRS, DATE_FORMATS, WHITESPACE

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def q(name: str) -> str:
    """Back-quote a column name for use inside SQL expression strings."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_atomic(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType,
                               T.VariantType if hasattr(T, "VariantType") else T.BinaryType))


def columns_of(df: DataFrame, pred) -> list[str]:
    return [f.name for f in df.schema.fields if pred(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_numeric)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_string)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, is_datetime)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one concept in the reference; normalise float NaN to NULL."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(col(f.name)), F.lit(None).cast(f.dataType))
                         .otherwise(col(f.name)).alias(f.name))
            changed = True
        else:
            exprs.append(col(f.name))
    return df.select(*exprs) if changed else df


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: casts numerics, coerces strings (bad values -> NULL)."""
    dt = dtype_of(df, name)
    c = col(name)
    if is_numeric(dt) or is_boolean(dt):
        return c.cast("double")
    if is_datetime(dt):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return F.expr(f"try_cast({q(name)} AS DOUBLE)")


def as_string(name: str) -> Column:
    return col(name).cast("string")


def parse_timestamp(c: Column) -> Column:
    """Lenient timestamp parse of a string: first format that parses wins."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in DATE_FORMATS])


def strip(c: Column | str) -> Column:
    """The value without white space of any kind (tabs and newlines included) at its ends."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def head(df: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows of an ordered frame; all rows when ``k`` is None."""
    return df if k is None else df.limit(k)


def ladder(c: Column, cuts: Sequence[tuple[float, object]], lowest) -> Column:
    """Label of the first ``c >= cut`` in the given order."""
    out = None
    for cut, label in cuts:
        out = F.when(c >= cut, label) if out is None else out.when(c >= cut, label)
    return out.otherwise(lowest)


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of literals (one row per column name and the like), small enough to be broadcast."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = [f.strip().split(" ") for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rnd(c: Column, digits: int = 0) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the shortest decimal text of ``x`` (0.00015 -> 0.0002)
    while most engines, and the reference's numpy values, round the binary value
    (0.00015 is 1.4999...e-4 -> 0.0001).  Scaling first makes both agree.
    """
    if isinstance(c, str):
        c = F.col(c)
    if digits == 0:
        return F.round(c.cast("double"))
    s = float(10 ** digits)
    return F.round(c.cast("double") * s) / s


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return rnd(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def r4(c: Column) -> Column:
    return rnd(c, 4)


def bool_pair_match(lo: Column, hi: Column) -> Column:
    """True when the two distinct trimmed values form one of the boolean pairs."""
    conds = []
    for a, b in BOOLEAN_PAIRS:
        x, y = sorted([a, b])
        conds.append((lo == F.lit(x)) & (hi == F.lit(y)))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


TRUE_STRINGS = [a for a, _ in BOOLEAN_PAIRS]


def canonical_bool(df: DataFrame, name: str) -> Column:
    """Map a boolean-like column to true/false (fixes string Yes/No and 1.0/0.0)."""
    dt = dtype_of(df, name)
    c = col(name)
    if is_boolean(dt):
        return c
    if is_numeric(dt):
        return F.when(c.isNull(), None).otherwise(c.cast("double") == 1.0)
    s = strip(c.cast("string"))
    return F.when(c.isNull(), None).otherwise(s.isin(TRUE_STRINGS))


def name_tokens(name: str) -> list[str]:
    """Lower-case word tokens of a column name (split on non-alphanumerics and camelCase)."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [t for t in re.split(r"[^0-9a-zA-Z]+", spaced.lower()) if t]


def name_contains(name: str, parts: Iterable[str]) -> bool:
    low = name.lower()
    return any(p in low for p in parts)


def name_has_token(name: str, parts: Iterable[str]) -> bool:
    toks = set(name_tokens(name))
    return any(p in toks for p in parts)


def strength_label(r: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """Ladder of ``abs(r) >= cut -> label`` in the given order."""
    out = None
    for cut, label in cuts:
        cond = F.abs(r) >= cut
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def severity_rank(c: Column) -> Column:
    return (F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2)
            .when(c == "low", 1).otherwise(0))


def sig(c: Column, digits: int = 10) -> Column:
    """Round to a number of significant digits (stable across engines for large values)."""
    e = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), e - (digits - 1))
    return F.when((c == 0) | c.isNull(), c.cast("double")).otherwise(F.round(c / scale) * scale)


def tall_agg(df: DataFrame, cols: Sequence[str], make, fields: Sequence[str],
             shared: dict[str, Column] | None = None, batch: int = 40) -> DataFrame:
    """One wide aggregate per batch of columns, unpivoted to one row per column.

    ``make(c)`` returns a dict field -> aggregate Column for column ``c``.  Columns are
    batched so that very wide tables stay under the generated-code method limit.
    """
    shared = shared or {}
    parts = []
    for start in range(0, len(cols), batch):
        chunk = list(cols[start:start + batch])
        aggs = [v.alias(k) for k, v in shared.items()]
        for i, c in enumerate(chunk):
            for fld, expr in make(c).items():
                aggs.append(expr.alias(f"{i}__{fld}"))
        one = df.agg(*aggs)
        parts.append(tall(one, chunk, fields, shared=list(shared)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tall(df_one_row: DataFrame, names: Sequence[str], fields: Sequence[str],
         key: str = "column", shared: Sequence[str] = ()) -> DataFrame:
    """Unpivot a one-row wide aggregate with columns ``{i}__{field}`` into one row per name.

    ``shared`` columns (plain names, e.g. the row count) are repeated on every row.
    """
    structs = []
    for i, n in enumerate(names):
        parts = [F.lit(n).alias(key)] + [F.col(f"`{i}__{fld}`").alias(fld) for fld in fields]
        structs.append(F.struct(*parts))
    return df_one_row.select(*[F.col(s) for s in shared],
                             F.explode(F.array(*structs)).alias("_r")).select("_r.*", *shared)


def scalar_structs(t: DataFrame, cols: Sequence[str], fields: Sequence[str], prefix: str = "__s") -> DataFrame:
    """One row with a struct ``<prefix><i>`` of ``fields`` per column of a (column, fields...) table."""
    return t.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.struct(*fields))).alias(f"{prefix}{i}")
                             for i, c in enumerate(cols)])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row: the row is broadcast, nothing is
    shuffled, and columns that are not used later are pruned from the scan."""
    return df.crossJoin(F.broadcast(one_row))
