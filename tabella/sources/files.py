"""File and database sources."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabella.functions.scalar import CSV_NA, NA_MARKERS, c, is_text, plain_number, q
from tabella.operators.profile import wide_agg
from tabella.session import new_path
from tabella.sources.records import csv_records, json_records, json_start

SEPARATORS = [",", "\t", ";", "|"]
# Spark reads UTF-8 and ISO-8859-1; windows-1252 differs from the latter in the
# bytes 80-9F only, which are swapped after reading. Five of them are undefined.
WINDOWS = "windows-1252"
CONTROLS = "".join(chr(i) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"
ONE_FIELD = "\u0001"
SAFE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$")


# ------------------------------------------------------------------ delimited text
NOT_A_NAME = re.compile(
    r"\s*(|unnamed:.*|" + "|".join(re.escape(x.lower()) for x in NA_MARKERS) + r"|nan|[+-]?inf(inity)?|[+-]?[\d,]*\.?[\d,]*\d[\d,]*\.?(e[+-]?\d+)?)\s*", re.I
)
DATA_SHARE, DATA_CELLS = 0.4, 2


def header_looks_like_data(names: list[str]) -> bool:
    """Whether a first row holds values: ``DATA_CELLS`` cells or more, and ``DATA_SHARE`` of all, can't be names."""
    values = [x for x in map(str, names) if NOT_A_NAME.fullmatch(x)]
    return len(values) >= max(DATA_CELLS, DATA_SHARE * len(names))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Whole lines as one text column, in the given encoding."""
    return (
        spark.read.option("sep", ONE_FIELD).option("encoding", _charset(encoding)).option("quote", "").option("mode", "PERMISSIVE")
        .schema("line string").csv(path)
    )


def sniff(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether a quoted cell holds a line break), from one parallel pass over the file.

    The encoding is UTF-8, else windows-1252, else ISO-8859-1: the first that reads every byte (the latter two take
    a second pass). A line with an odd number of quotes leaves a quote open.
    """
    open_quote = F.regexp_count("line", F.lit('"')) % 2 == 1
    seen = _lines(spark, path, "UTF-8").agg(F.bool_or(F.col("line").contains("\ufffd")).alias("bad"), F.bool_or(open_quote).alias("open")).first()
    return _other_encoding(spark, path) if seen["bad"] else "UTF-8", bool(seen["open"])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding part of ``sniff``."""
    return sniff(spark, path)[0]


def _other_encoding(spark: SparkSession, path: str) -> str:
    if _lines(spark, path, "ISO-8859-1").where(F.col("line").rlike(UNDEFINED)).isEmpty():
        return WINDOWS
    return "ISO-8859-1"


def _charset(encoding: str) -> str:
    return "ISO-8859-1" if encoding == WINDOWS else encoding


def _decoded(col: Column, encoding: str) -> Column:
    """A cell's text after swapping the bytes windows-1252 uses for signs."""
    return F.translate(col, CONTROLS, CONTROLS.encode("latin-1").decode("cp1252")) if encoding == WINDOWS else col


def detect_separator(line: str) -> str:
    return max(SEPARATORS, key=line.count)


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a number become numbers; one pass decides."""
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not texts:
        return df
    exprs = {}
    for x in texts:
        exprs[f"h:{x}"] = F.count(c(x))
        exprs[f"n:{x}"] = F.count(plain_number(c(x)))
        exprs[f"w:{x}"] = F.count(F.when(F.trim(c(x)).rlike(r"^[+-]?\d+$"), F.trim(c(x)).try_cast("long")))
    got = wide_agg(df, exprs)
    new = {}
    for x in texts:
        if got[f"h:{x}"] and got[f"h:{x}"] == got[f"w:{x}"]:
            new[x] = F.trim(c(x)).try_cast("long")
        elif got[f"h:{x}"] and got[f"h:{x}"] == got[f"n:{x}"]:
            new[x] = plain_number(c(x))
    return df.withColumns(new) if new else df


def read_delimited(spark: SparkSession, path: str, header: bool | None = None, types: bool = True) -> DataFrame:
    """Delimited text: encoding, separator and header are detected from the file.

    A file whose quoted cells hold line breaks is cut into records in parallel (``records.csv_records``).
    """
    encoding, broken = sniff(spark, path)
    first = _lines(spark, path, encoding).where(F.length(F.trim("line")) > 0).limit(1).collect()
    if not first:
        raise ValueError(f"No line of '{path}' holds anything.")
    records = csv_records(spark, path, _charset(encoding)) if broken else None
    line = records.where("first").first()["value"] if broken else first[0]["line"]
    if encoding == WINDOWS:
        line = line.encode("latin-1").decode("cp1252")
    sep = detect_separator(line)
    names = [x or f"Unnamed: {i}" for i, x in enumerate(_split(line, sep))]
    if header is None:
        header = not header_looks_like_data(names)
    names = _unique([x.strip() for x in names]) if header else [f"column_{i + 1}" for i in range(len(names))]
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names])
    if broken:
        rows = records.where(~F.col("first")) if header else records
        df = rows.select(F.from_csv("value", _ddl(schema), {"sep": sep, "escape": '"'}).alias("r")).select("r.*")
    else:
        base = spark.read.option("sep", sep).option("encoding", _charset(encoding)).option("escape", '"')
        df = base.option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    missing = [*NA_MARKERS, *CSV_NA, ""]
    cell = lambda x: F.trim(_decoded(c(x), encoding))
    df = df.select(*[F.when(~cell(x).isin(missing), cell(x)).alias(x) for x in names])
    df = df.dropna("all")
    return infer_numbers(df) if types else df


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def _split(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep))


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for x in names:
        out.append(x if x not in seen else f"{x}.{seen[x]}")
        seen[x] = seen.get(x, 0) + 1
    return out


def set_header(spark: SparkSession, path: str, first_row_is_data: bool) -> DataFrame:
    """Read again with the first row as data, or as names; types are decided anew."""
    return read_delimited(spark, path, header=not first_row_is_data)


# ------------------------------------------------------------------ JSON
def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; lists stay."""

    def walk(prefix: str, col, t: T.DataType):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from walk(f"{prefix}.{f.name}" if prefix else f.name, col.getField(f.name), f.dataType)
        else:
            yield col.alias(prefix)

    return df.select(*[x for f in df.schema.fields for x in walk(f.name, c(f.name), f.dataType)])


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as lines, as one array, or inside one object (the longest list wins).

    Lines are read as they are. An array, and the lists of an object, are cut into records in parallel, however the file is
    broken into lines (``records.json_records``); only its first characters are looked at to tell the forms apart. An
    object of values or of columns is one record by nature and is read whole.
    """
    start = json_start(spark, path)
    if _is_lines(start):
        return flatten(spark.read.json(path))
    records = json_records(spark, path, start)
    if records is None:
        return flatten(_unwrap(spark.read.option("multiLine", True).json(path)))
    folder = new_path(spark, "json-lines")
    records.select(F.regexp_replace("value", "[\r\n]+", " ")).write.text(folder)
    return flatten(spark.read.json(folder))


def _is_lines(start: str) -> bool:
    """Whether a file's first line is a whole object and another one follows."""
    line, _, rest = start.partition("\n")
    try:
        return isinstance(json.loads(line), dict) and rest.lstrip().startswith("{")
    except json.JSONDecodeError:
        return False


def _unwrap(df: DataFrame) -> DataFrame:
    """One object of columns becomes their table; one object of values stays one row."""
    fields = df.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields) and df.limit(2).count() == 1:
        return df.select(F.inline(F.arrays_zip(*[c(f.name) for f in fields])))
    return df


# ------------------------------------------------------------------ columnar, several files, samples
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def union_files(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack tables on the columns they all have, with the name of each source."""
    frames = list(parts.items())
    common = [x for x in frames[0][1].columns if all(x in df.columns for _, df in frames)]
    out = None
    for name, df in frames:
        part = df.select(*[c(x) for x in common]).withColumn("source_file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def reservoir_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their content, the same rows on every run."""
    h = F.xxhash64(F.lit(seed), *[c(x) for x in df.columns])
    total = df.count()
    if total <= n:
        return df
    # Keep a little more than n by hash range, so only that much is ordered.
    share = min(1.0, (n + 6 * n**0.5 + 50) / total)
    limit = int(-(2**63) + share * (2**64 - 1))
    near = df.withColumn("_h", h) if share == 1.0 else df.withColumn("_h", h).where(F.col("_h") <= F.lit(min(limit, 2**63 - 1)))
    if share < 1.0 and near.count() < n:
        near = df.withColumn("_h", h)
    return near.orderBy("_h").limit(n).drop("_h")


# ------------------------------------------------------------------ databases
def one_select(sql: str) -> str:
    """The statement without its closing semicolon; anything but one query is refused.

    Quoted text and comments don't count as parts of the statement's form.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    form = re.fullmatch(r"\s*(select|with)\b[^;]*;?\s*", bare, re.I)
    if form is None:
        raise ValueError("Give a single query that starts with SELECT or WITH.")
    return re.sub(r";\s*$", "", sql.strip())


def jdbc_query(table: str = "", sql: str = "", limit: int | None = None) -> str:
    """What the database is asked: a query as given, or all of a plainly named table, perhaps its first rows only."""
    if not sql.strip() and not SAFE_NAME.match(table or ""):
        raise ValueError(f"'{table}' is no plain table name and no query was given.")
    asked = one_select(sql) if sql.strip() else f"SELECT * FROM {table}"
    return asked if not limit else f"SELECT * FROM ({asked}) AS sub LIMIT {int(limit)}"


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "",
    sql: str = "",
    limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table or one query; ``partition`` = (column, lower, upper, pieces) reads in parallel."""
    source = f"({jdbc_query(table, sql, limit)}) t"
    if partition:
        col, lower, upper, pieces = partition
        return spark.read.jdbc(
            url, source, column=col, lowerBound=lower, upperBound=upper, numPartitions=pieces, properties=properties
        )
    return spark.read.jdbc(url, source, properties=properties)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "fail", properties: dict[str, str] | None = None) -> None:
    """mode: fail, replace or append; rows go in batches of 5,000."""
    from tabella.operators.wrangle import safe_columns

    if not SAFE_NAME.match(table or "") or "." in table:
        raise ValueError(f"'{table}' can't be written: use letters, digits and underscores.")
    modes = {"fail": "error", "replace": "overwrite", "append": "append"}
    safe_columns(df).write.option("batchsize", 5000).jdbc(url, table, mode=modes[mode], properties=properties)
