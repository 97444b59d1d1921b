"""Cleaning: markers, empty rows, numbers in text, yes/no, duplicates, gaps, outliers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabella.functions.ordering import carry
from tabella.functions.quantiles import column_quantiles
from tabella.functions.scalar import (
    NA_MARKERS, any_of, c, dtype, in_mask, is_date, is_number, is_text, is_whole, money_number, moment, seen_words,
)
from tabella.operators.profile import is_code_name, profile_columns, wide_agg
from tabella.operators.wrangle import NEAR_EMPTY, converted
from tabella.session import cheap_to_cache, spool

YES = ["yes", "y", "true", "t"]
NO = ["no", "n", "false", "f"]
STRATEGIES = ("automatic", "mean", "forward", "zero", "drop")
FILLABLE = ("numeric", "categorical")


# ------------------------------------------------------------------ single steps
def normalise_missing(df: DataFrame) -> DataFrame:
    """Trim text; markers, blanks and NaN become null."""

    def cell(f: T.StructField) -> Column:
        if is_text(f.dataType):
            text = F.trim(c(f.name))
            return F.when(~text.isin([*NA_MARKERS, ""]), text).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c(f.name)), c(f.name)).alias(f.name)
        return c(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def stringify_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs left in a cell become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(c(f.name)).alias(f.name) if isinstance(f.dataType, nested) else c(f.name) for f in df.schema.fields]
    )


def drop_empty_rows_cols(df: DataFrame) -> DataFrame:
    """Drop rows with no value at all, then columns with no value at all."""
    have = wide_agg(df, {x: F.count(c(x)) for x in df.columns})
    return df.dropna("all").select(*[c(x) for x in df.columns if have[x]])


def _text_exprs(df: DataFrame, skip: set[str] = frozenset()) -> dict[str, Column]:
    """Number shares and yes/no facts of every text column, as aggregates."""
    exprs: dict[str, Column] = {}
    for f in df.schema.fields:
        x = f.name
        if not is_text(f.dataType) or x in skip:
            continue
        low = F.lower(F.trim(c(x)))
        flag = low.isin([*YES, *NO])
        exprs[f"num:{x}"] = F.lit(0) if is_code_name(x) else F.count(money_number(c(x)))
        exprs[f"yn:{x}"] = F.struct(
            F.count_if(~flag).alias("other"),
            seen_words(low, [*YES, *NO]).alias("words"),
            F.count_if(flag & ~F.trim(c(x)).isin("Yes", "No")).alias("untidy"),
        )
    return exprs


def _numbers_in(got: dict, rows: int) -> list[str]:
    return [k[4:] for k, v in got.items() if k.startswith("num:") and rows and v / rows > 0.5]


def _yes_no_in(got: dict) -> list[str]:
    flags = {k[3:]: v for k, v in got.items() if k.startswith("yn:")}
    return [x for x, f in flags.items() if f["other"] == 0 and f["untidy"] and len(in_mask(f["words"], [*YES, *NO])) >= 2]


def _yes_no_value(df: DataFrame, x: str) -> Column:
    if isinstance(dtype(df, x), T.BooleanType):
        return F.when(c(x), "Yes").when(~c(x), "No")
    low = F.lower(F.trim(c(x)))
    return F.when(low.isin(YES), "Yes").when(low.isin(NO), "No")


def text_to_number(df: DataFrame) -> DataFrame:
    """Text columns where most cells are numbers, after dropping $ , %, become numbers."""
    got = wide_agg(df, {"n": F.count("*"), **_text_exprs(df)})
    names = _numbers_in(got, got["n"])
    return df.withColumns({x: money_number(c(x)) for x in names}) if names else df


def normalise_yes_no(df: DataFrame) -> DataFrame:
    """Columns holding only yes/no spellings (and booleans) become Yes / No."""
    exprs = _text_exprs(df)
    names = _yes_no_in(wide_agg(df, exprs)) if exprs else []
    names += [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({x: _yes_no_value(df, x) for x in names}) if names else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def remove_identifiers(df: DataFrame, profile: dict[str, str] | None = None) -> DataFrame:
    profile = profile or profile_columns(df)
    return df.drop(*[x for x, k in profile.items() if k == "identifier"])


def set_aside_near_empty(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    got = wide_agg(df, {"n": F.count("*"), **{f"h:{x}": F.count(c(x)) for x in df.columns}})
    gone = [x for x in df.columns if x not in keep and got["n"] and 1 - got[f"h:{x}"] / got["n"] >= NEAR_EMPTY]
    return df.drop(*gone)


def parse_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({x: moment(df, x) for x in cols}) if cols else df


# ------------------------------------------------------------------ values to fill with
def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most common value per column, smallest on ties; one job for all columns."""
    if not cols:
        return {}
    cells = F.array(
        *[
            F.struct(
                F.lit(x).alias("col"),
                c(x).cast("string").alias("value"),
                (c(x).cast("double") if is_number(dtype(df, x)) else F.lit(None).cast("double")).alias("as_number"),
            )
            for x in cols
        ]
    )
    counts = (
        df.select(F.inline(cells)).where("value is not null").groupBy("col", "as_number", "value").agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("col").agg(F.min_by("value", F.struct(-F.col("n"), F.col("as_number"), F.col("value"))).alias("value"))
    found = {r["col"]: r["value"] for r in best.collect()}
    return {x: found.get(x) for x in cols}


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Coalesce columns with a value; a whole column takes a fraction as a double."""
    out = {}
    for x, v in values.items():
        if v is None:
            continue
        t = dtype(df, x)
        if is_number(t):
            number_v = float(v)
            whole = is_whole(t) and number_v.is_integer()
            out[x] = F.coalesce(c(x), F.lit(int(number_v)).cast(t)) if whole else F.coalesce(c(x).cast("double"), F.lit(number_v))
        else:
            out[x] = F.coalesce(c(x), F.lit(v).cast(t))
    return df.withColumns(out) if out else df


def _by_kind(profile: dict[str, str], df: DataFrame, *kinds: str) -> list[str]:
    return [x for x, k in profile.items() if k in kinds and x in df.columns]


def gap_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    return wide_agg(df, {x: F.count_if(c(x).isNull()) for x in cols}) if cols else {}


def fill_values(df: DataFrame, profile: dict[str, str], strategy: str = "automatic", gaps: dict | None = None) -> dict[str, object]:
    """The value each column's gaps are filled with."""
    gaps = gap_counts(df, _by_kind(profile, df, *FILLABLE)) if gaps is None else gaps
    nums = [x for x in _by_kind(profile, df, "numeric") if gaps.get(x)]
    cats = [x for x in _by_kind(profile, df, "categorical") if gaps.get(x)]
    values: dict[str, object] = {}
    if strategy == "zero":
        return {**{x: 0.0 for x in nums}, **{x: "Unknown" for x in cats}}
    if strategy == "mean":
        values.update(wide_agg(df, {x: F.avg(c(x)) for x in nums}) if nums else {})
    else:
        values.update({x: v[0] for x, v in column_quantiles(df, {x: [0.5] for x in nums}).items()})
    common = modes(df, cats)
    values.update({x: common[x] if common[x] is not None else "Unknown" for x in cats})
    return values


def _unknown_ok(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """A numeric code column that takes the word Unknown becomes text first."""
    to_text = [x for x, v in values.items() if v == "Unknown" and not is_text(dtype(df, x))]
    return df.withColumns({x: c(x).cast("string") for x in to_text}) if to_text else df


def fill_gaps(
    df: DataFrame, profile: dict[str, str], strategy: str = "automatic", order: str | None = None, tie: str | None = None
) -> DataFrame:
    """Fill (or drop) gaps with one strategy. Dates keep their gaps; text gets ''."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Pick one of {', '.join(STRATEGIES)}.")
    if strategy == "drop":
        return fill_drop_rows(df, profile)
    if strategy == "forward":
        df = fill_forward(df, profile, order, tie)
    values = fill_values(df, profile, strategy)
    df = _fill(_unknown_ok(df, values), values)
    texts = [x for x in _by_kind(profile, df, "text") if is_text(dtype(df, x))]
    return df.fillna("", subset=texts) if texts else df


def fill_automatic(df: DataFrame, profile: dict[str, str]) -> DataFrame:
    return fill_gaps(df, profile, "automatic")


def fill_mean(df: DataFrame, profile: dict[str, str]) -> DataFrame:
    return fill_gaps(df, profile, "mean")


def fill_zero_unknown(df: DataFrame, profile: dict[str, str]) -> DataFrame:
    return fill_gaps(df, profile, "zero")


def fill_forward(df: DataFrame, profile: dict[str, str], order: str | None = None, tie: str | None = None) -> DataFrame:
    """Copy the previous row's value, then the next row's, in the order of a date column."""
    order = order or next(iter(_by_kind(profile, df, "datetime")), None)
    if order is None:
        raise ValueError("Rows have no order of their own: name the column to order by.")
    cols = [x for x, n in gap_counts(df, [x for x in _by_kind(profile, df, *FILLABLE) if x not in (order, tie)]).items() if n]
    if not cols:
        return df
    return carry(carry(df, cols, order, tie), cols, order, tie, backward=True)


def fill_drop_rows(df: DataFrame, profile: dict[str, str]) -> DataFrame:
    out = df.dropna(subset=_by_kind(profile, df, "numeric", "categorical", "datetime"))
    if out.isEmpty():
        raise ValueError("Every row has at least one gap, so dropping rows would leave nothing.")
    return out


def fill_column(df: DataFrame, col: str, method: str, sort_by: str | None = None, tie: str | None = None) -> DataFrame:
    """One column's gaps: forward, backward, median, mean, mode or drop."""
    if method in ("forward", "backward"):
        if sort_by is None:
            raise ValueError("Name the column that orders the rows.")
        return carry(df, [col], sort_by, tie, backward=method == "backward")
    if method == "drop":
        return df.dropna(subset=[col])
    if method == "median":
        return _fill(df, {col: column_quantiles(df, {col: [0.5]})[col][0]})
    if method == "mean":
        return _fill(df, {col: df.agg(F.avg(c(col))).first()[0]})
    if method == "mode":
        return _fill(df, modes(df, [col]))
    raise ValueError(method)


# ------------------------------------------------------------------ outliers
def iqr_limits(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Lower and upper 1.5 x IQR fences; columns without spread are left out."""
    out = {}
    for x, (q1, q3) in column_quantiles(df, {x: [0.25, 0.75] for x in cols}).items():
        if q1 is not None and q3 - q1 != 0:
            out[x] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def outlier_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    limits = iqr_limits(df, cols)
    got = wide_agg(df, {x: F.count_if((c(x) < a) | (c(x) > b)) for x, (a, b) in limits.items()}) if limits else {}
    return {x: got.get(x, 0) for x in cols}


def flag_outliers_iqr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``<column>_outlier`` per column; rows are kept."""
    limits = iqr_limits(df, cols)
    flags = {
        f"{x}_outlier": F.coalesce((c(x) < limits[x][0]) | (c(x) > limits[x][1]), F.lit(False)) if x in limits else F.lit(False)
        for x in cols
    }
    return df.withColumns(flags)


# ------------------------------------------------------------------ the whole run
@dataclass
class Cleaned:
    """A cleaned table and what was done to it."""

    table: DataFrame
    profile: dict[str, str]
    steps: list[tuple[str, str | None, str, int | None, str]]
    outliers: dict[str, int]
    identifiers: list[str]
    rows_in: int
    rows_out: int
    columns_in: int

    def report(self) -> DataFrame:
        """Every change as a row: step, column, action, count, detail."""
        return self.table.sparkSession.createDataFrame(
            self.steps, "step string, column_name string, action string, n long, detail string"
        )

    def metrics(self) -> DataFrame:
        filled = sum(s[3] or 0 for s in self.steps if s[2] in ("filled", "filled forward"))
        row = (self.rows_out, len(self.table.columns), self.rows_in - self.rows_out, filled, sum(self.outliers.values()))
        return self.table.sparkSession.createDataFrame(
            [row], "rows_after long, columns_kept long, rows_removed long, values_filled long, outliers_flagged long"
        )


@dataclass
class _Run:
    steps: list = field(default_factory=list)

    def note(self, step: str, col: str | None, action: str, n: int | None = None, detail: str = "") -> None:
        self.steps.append((step, col, action, n, detail))


def clean_table(
    df: DataFrame,
    missing: str = "automatic",
    overrides: dict[str, str] | None = None,
    order: str | None = None,
    tie: str | None = None,
) -> Cleaned:
    """The full cleaning run, in its fixed order. Only decisions are computed here;
    the table itself stays a lazy DataFrame over the written, de-duplicated stage."""
    if missing not in STRATEGIES:
        raise ValueError(f"Pick one of {', '.join(STRATEGIES)}.")
    run = _Run()
    overrides = {k: v for k, v in (overrides or {}).items() if k in df.columns}
    columns_in = len(df.columns)

    # 1-3. empty rows and columns, numbers in text, yes/no: one pass of facts
    if cheap_to_cache(df):
        df = spool(df, "raw", True)
    filled = any_of([c(x).isNotNull() for x in df.columns])
    have = wide_agg(
        df,
        {"n": F.count("*"), "full": F.count_if(filled), **{f"h:{x}": F.count(c(x)) for x in df.columns}, **_text_exprs(df, set(overrides))},
    )
    rows_in, rows = have["n"], have["full"]
    if rows < rows_in:
        run.note("empty", None, "removed rows", rows_in - rows)
        df = df.dropna("all")
    df = df.select(*[c(x) for x in df.columns if have[f"h:{x}"]])
    change = {x: money_number(c(x)) for x in _numbers_in(have, rows) if x in df.columns}
    for x in change:
        run.note("numbers", x, "text to number")
    flags = [x for x in _yes_no_in(have) if x in df.columns and x not in change]
    flags += [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType) and f.name not in overrides]
    for x in flags:
        change[x] = _yes_no_value(df, x)
        run.note("yes/no", x, "to Yes / No")
    if change:
        df = df.withColumns(change)

    # 4. duplicates: the one full shuffle; later passes read the written stage
    df = spool(df.dropDuplicates(), "distinct")
    distinct = df.count()
    if distinct < rows:
        run.note("duplicates", None, "removed rows", rows - distinct)

    # 5-8. kinds, overrides, identifiers, near-empty columns
    profile = profile_columns(df)
    changes: dict[str, tuple[str, Column]] = {}
    for x, kind in overrides.items():
        if x not in profile or kind == profile[x]:
            continue
        if kind == "identifier":
            profile[x] = "identifier"
        elif kind == "drop column":
            df = df.drop(x)
            del profile[x]
            run.note("override", x, "dropped on request")
        else:
            changes[x] = (kind, converted(df, x, kind))
    cols = [x for x in df.columns if profile[x] != "identifier"]
    exprs = {f"h:{x}": F.count(c(x)) for x in cols}
    exprs.update({f"o:{x}": F.count(col) for x, (_, col) in changes.items()})
    exprs.update({f"d:{x}": F.count(moment(df, x)) for x in cols if profile[x] == "datetime"})
    got = wide_agg(df, exprs) if exprs else {}
    present = {x: got[f"h:{x}"] for x in cols}
    for x, (kind, col) in changes.items():
        kept = got[f"o:{x}"]
        if present.get(x) and kept / distinct < 1 - NEAR_EMPTY:
            run.note("override", x, "refused", present[x] - kept, kind)
            continue
        df = df.withColumn(x, col)
        profile[x] = kind
        run.note("override", x, f"to {kind}", present[x] - kept)
        present[x] = kept
    identifiers = [x for x, k in profile.items() if k == "identifier"]
    for x in identifiers:
        run.note("identifiers", x, "removed", None, "marked" if overrides.get(x) == "identifier" else "nearly all values unique")
    sparse = [x for x in cols if distinct and 1 - present[x] / distinct >= NEAR_EMPTY and x not in overrides]
    for x in sparse:
        run.note("near empty", x, "set aside", distinct - present[x])
    gone = set(identifiers) | set(sparse)
    df = df.drop(*gone)
    profile = {x: k for x, k in profile.items() if x not in gone}

    # 9. dates
    dates = [x for x, k in profile.items() if k == "datetime" and not is_date(dtype(df, x))]
    df = parse_dates(df, dates)
    for x in dates:
        run.note("dates", x, "parsed")
        present[x] = got[f"d:{x}"]

    # 10. gaps
    gaps = {x: distinct - present[x] for x in profile}
    rows_out = distinct
    if missing == "drop":
        df = df.dropna(subset=_by_kind(profile, df, "numeric", "categorical", "datetime"))
        rows_out = df.count()
        if rows_out < distinct:
            run.note("gaps", None, "dropped rows", distinct - rows_out)
        if rows_out == 0:
            raise ValueError("Every row has at least one gap, so dropping rows would leave nothing.")
        left = {x: n for x, n in gap_counts(df, _by_kind(profile, df, "text")).items()}
    else:
        left = dict(gaps)
        if missing == "forward":
            by = next(iter(_by_kind(profile, df, "datetime")), None) or order
            if by is None:
                raise ValueError("Rows have no order of their own: name the column to order by.")
            carried = [x for x in _by_kind(profile, df, *FILLABLE) if gaps[x]]
            if carried:
                tie_col = tie if tie in df.columns else None
                df = carry(carry(df, carried, by, tie_col), carried, by, tie_col, backward=True)
            for x in carried:
                run.note("gaps", x, "filled forward", gaps[x], f"in {by} order")
                left[x] = 0
    values = fill_values(df, profile, "automatic" if missing in ("forward", "drop") else missing, left)
    df = _fill(_unknown_ok(df, values), values)
    texts = [x for x in _by_kind(profile, df, "text") if left.get(x)]
    if texts:
        df = df.fillna("", subset=texts)
    for x in profile:
        if not left.get(x):
            continue
        if profile[x] == "datetime":
            run.note("gaps", x, "left as they are", left[x])
            continue
        shown = "" if profile[x] == "text" else f"{values[x]}"
        run.note("gaps", x, "filled", left[x], shown)
        if profile[x] != "text" and rows_out and gaps[x] / rows_out >= 0.3:
            run.note("gaps", x, "caution: mostly filled", gaps[x])

    # 11. outliers are counted, never removed
    outliers = {x: n for x, n in outlier_counts(df, _by_kind(profile, df, "numeric")).items() if n}
    for x, n in outliers.items():
        run.note("outliers", x, "flagged", n, "1.5 x IQR")
    return Cleaned(df, profile, run.steps, outliers, identifiers, rows_in, rows_out, columns_in)


def clean_full_table(
    df: DataFrame, profile: dict[str, str], identifiers: list[str] = ()
) -> tuple[DataFrame, dict[str, int]]:
    """Rules decided on a sample, applied to every row.

    Whole-number columns stay whole (the median is rounded), duplicates go, gaps
    are filled, outliers are counted against the unfilled values.
    """

    def cell(f: T.StructField) -> Column:
        kind = profile.get(f.name)
        if kind == "numeric" and not is_whole(f.dataType):
            value = money_number(c(f.name)) if is_text(f.dataType) else c(f.name).cast("double")
            return value.alias(f.name)
        return moment(df, f.name).alias(f.name) if kind == "datetime" else c(f.name)

    stage = spool(df.select(*[cell(f) for f in df.schema.fields]).dropDuplicates(), "distinct")
    keep = [x for x in stage.columns if x not in identifiers and x in profile]
    nums = [x for x in keep if profile[x] == "numeric"]
    gaps = gap_counts(stage, keep)
    found = column_quantiles(stage, {x: [0.25, 0.5, 0.75] for x in nums})
    limits = {x: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for x, (q1, _, q3) in found.items() if q1 is not None and q3 > q1}
    outliers = wide_agg(stage, {x: F.count_if((c(x) < a) | (c(x) > b)) for x, (a, b) in limits.items()}) if limits else {}
    common = modes(stage, [x for x in keep if profile[x] == "categorical" and gaps[x]])
    values: dict[str, object] = dict(common)
    for x in nums:
        if gaps[x] and found[x][1] is not None:
            values[x] = float(round(found[x][1])) if is_whole(dtype(stage, x)) else found[x][1]
    return _fill(stage.select(*[c(x) for x in keep]), values), outliers

