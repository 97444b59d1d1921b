"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text that means "no value" (trimmed cells), then the names a
# CSV reader in the data-frame world also treats as missing.
NA_MARKERS = ["?", "-", "--", "n/a", "N/A", "NA", "na", "null", "NULL", "None", "none", "missing", "Missing", "#N/A", "."]
CSV_NA = ["#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NaN", "nan"]

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

ISO_START = r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"
TIME = "[ H:mm[:ss[.SSSSSS][.SSS]]]"

# The date spellings tried after ISO dates and times (read by a plain cast), in this order.
DATE_FORMATS = [
    f"yyyy/M/d{TIME}",
    f"M/d/yyyy{TIME}",
    "M/d/yyyy h:mm[:ss] a",
    f"d.M.yyyy{TIME}",
    "yyyyMMdd",
    f"d-MMM-yyyy{TIME}",
    f"d MMM yyyy{TIME}",
    f"MMM d, yyyy{TIME}",
    "d MMMM yyyy",
    "MMMM d, yyyy",
]

PERIODS = {"Day": "day", "Week": "week", "Month": "month", "Quarter": "quarter", "Year": "year"}


def q(name: str) -> str:
    """Quote a column name so dots and blanks in it stay literal."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def plain_number(col: Column) -> Column:
    """Text as a double, or null when it is not written as a plain number."""
    text = F.trim(col)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def money_number(col: Column) -> Column:
    """Text as a double after removing dollar signs, commas and percent signs."""
    return plain_number(F.translate(col, "$,%", ""))


def number(df: DataFrame, name: str) -> Column:
    """Any column as a double: numbers are cast, text is read strictly."""
    t = dtype(df, name)
    if is_number(t) or isinstance(t, T.BooleanType):
        value = c(name).cast("double")
        return F.when(~F.isnan(value), value)
    return plain_number(c(name).cast("string"))


def moment(df: DataFrame, name: str) -> Column:
    """Any column as a timestamp; text is tried against ``DATE_FORMATS``."""
    if is_date(dtype(df, name)):
        return c(name).cast("timestamp")
    return read_moment(F.trim(c(name).cast("string")))


def read_moment(text: Column) -> Column:
    """Text as a timestamp: ISO first, then ``DATE_FORMATS``; null when none fits."""
    iso = F.when(text.rlike(ISO_START), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def period_start(col: Column, period: str) -> Column:
    """Start of the day, week (Monday), month, quarter or year."""
    return F.date_trunc(PERIODS[period], col)


def period_label(col: Column, period: str) -> Column:
    """Series label of a period: weeks carry their closing Sunday."""
    start = F.date_trunc(PERIODS[period], col)
    return start + F.expr("INTERVAL 6 DAYS") if period == "Week" else start


def seen_words(col: Column, words: list[str]) -> Column:
    """Which of up to 62 words a column holds, as one integer aggregate (see ``in_mask``)."""
    if len(words) > 62:
        raise ValueError("At most 62 words fit one integer.")
    code = F.lit(None).cast("long")
    for i, w in enumerate(words):
        code = F.when(col == w, F.lit(1 << i).cast("long")).otherwise(code)
    return F.bit_or(code)


def in_mask(mask: int | None, words: list[str]) -> set[str]:
    return {w for i, w in enumerate(words) if (mask or 0) >> i & 1}


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour days from start to end, rounded toward minus infinity."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400 * 10**6)).cast("long")


def as_text(df: DataFrame, name: str) -> Column:
    """A cell as text; a whole number held as a float prints without ``.0``."""
    value = c(name)
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of several key columns."""
    return all_of([a[q(k)].eqNullSafe(b[q(k)]) for k in keys])


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal or equally-missing keys, keeping the left copy of each key."""
    renamed = right.select(
        *[c(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
        *[c(n) for n in right.columns if n not in keys],
    )
    on = all_of([c(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"_r_{i}" for i in range(len(keys))])
