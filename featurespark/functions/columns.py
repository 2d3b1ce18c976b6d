"""Column-level helpers shared by the transforms (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace set stripped by TRIM: space, tab, newline, carriage return,
# vertical tab, form feed.
WHITESPACE = " \t\n\r\x0b\x0c"


def col_of(name: str) -> Column:
    """Column by exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ntz_lit(value) -> Column:
    """TIMESTAMP_NTZ literal from a naive datetime / date / text, independent of
    the session time zone (a Python datetime literal would first be read as a
    zoned timestamp)."""
    import datetime as _dt
    if isinstance(value, _dt.datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip(c: Column, lo, hi) -> Column:
    """Clip into [lo, hi]; NULL input stays NULL (GREATEST/LEAST skip NULLs in Spark)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.least(c, hi_c), lo_c))


def as_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Canonical text of a value: integral doubles print without '.0', everything
    else via CAST AS STRING. NULL stays NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        integral = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
        return F.when(integral, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    if isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


def md5_bucket(text: Column, num_buckets: int) -> Column:
    """Stable hash bucket: first 32 bits of md5(text) modulo n; NULL → NULL.

    The same formula runs in DuckDB (``CAST('0x'||substr(md5(s),1,8) AS BIGINT) % n``)."""
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.when(text.isNull(), F.lit(None)).otherwise(F.pmod(h, F.lit(int(num_buckets))))


def md5_int(*parts: Column) -> Column:
    """60 bits of the md5 of the parts' text joined by '|': a draw that other engines can
    repeat (``CAST('0x' || substr(md5(a || '|' || b), 1, 15) AS BIGINT)``)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def short_key(text: Column) -> Column:
    """A text that stands for itself up to 32 characters, else its 128-bit digest; the two
    cannot be equal, a digest has 33 characters."""
    return F.when(F.char_length(text) > 32, F.concat(F.lit("#"), F.md5(text))).otherwise(text)


def btrim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def dtype_of(df, name: str) -> T.DataType:
    return df.schema[name].dataType
