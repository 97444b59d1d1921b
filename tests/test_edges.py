"""Small hand-made tables: gaps, ties, empties, odd files, refusals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabella.operators import balls, basket, clean, describe, forecast, grouping, joins, kpi, layers, models, prepare, profile, quality, standardize, stats, text, wrangle
from tabella.session import work_dir
from tabella.sources import awards, files, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clean_is_idempotent_and_full(spark):
    df = spark.createDataFrame(
        [("A1", "$1,200.50", "Yes", "x", None), ("A2", "$3", "y", None, None), ("A4", "5.5", "YES", "x", None)]
        + [("A3", None, "N", "x", None)] * 2 + [(None, None, None, None, None)],
        "rec_id string, amount string, ok string, grp string, empty string",
    )
    done = clean.clean_table(df)
    assert done.table.columns == ["amount", "ok", "grp"] and done.identifiers == ["rec_id"]
    assert sorted(rows(done.table)) == [(3.0, "Yes", "x"), (5.5, "No", "x"), (5.5, "Yes", "x"), (1200.5, "Yes", "x")]
    again = clean.clean_table(done.table)
    assert sorted(rows(again.table)) == sorted(rows(done.table)) and {s[0] for s in again.steps} <= {"outliers"}
    assert done.metrics().first()["rows_removed"] == 2


def test_clean_overrides(spark):
    df = spark.createDataFrame([(i, f"w{i % 3}", "5" if i % 2 else "six") for i in range(40)], "n long, code string, mixed string")
    done = clean.clean_table(df, overrides={"mixed": "numeric", "n": "identifier", "code": "numeric"})
    assert done.identifiers == ["n"] and done.profile["mixed"] == "numeric"
    assert ("override", "code", "refused", 40, "numeric") in done.steps
    with pytest.raises(ValueError):
        clean.clean_table(df, missing="guess")


def test_drop_strategy_refuses_to_leave_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        clean.fill_drop_rows(df, {"a": "numeric", "b": "numeric"})


def test_modes_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("b", 10), ("a", 9), (None, None)], "t string, n int")
    assert clean.modes(df, ["t", "n"]) == {"t": "a", "n": "9"}


def test_outliers_without_spread(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(99.0,)], "v double")
    assert clean.outlier_counts(df, ["v"]) == {"v": 0}


def test_yes_no_needs_two_spellings(spark):
    df = spark.createDataFrame([("y", "Yes", True), ("y", "No", False)], "one string, tidy string, flag boolean")
    assert rows(clean.normalise_yes_no(df)) == [("y", "Yes", "Yes"), ("y", "No", "No")]


def test_profile_rules(spark):
    df = spark.createDataFrame(
        [(i, 10000 + i % 7, f"2024-01-{1 + i % 28:02d}", f"text number {i // 2}", "may") for i in range(100)],
        "user_id long, zip long, day string, body string, month string",
    )
    assert profile.profile_columns(df) == {"user_id": "identifier", "zip": "categorical", "day": "datetime", "body": "text", "month": "categorical"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.missing_table(df, True).count() == 2
    assert quality.gate_status(quality.quality_gates(df)).first()[0] == "FAIL"
    assert describe.summary_stats(df, "a").where("measure = 'mean'").first()["value"] is None
    assert basket.basket_summary(df, "a", "b").first()["orders"] == 0


def test_group_keeps_missing_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("x", 3.0)], "k string, v double")
    got = {r["k"]: (r["rows_in_group"], r["v_sum"], r["v_std"]) for r in grouping.group_summary(df, ["k"], ["v"], ["sum", "std"]).collect()}
    assert got == {None: (2, 1.0, None), "x": (1, 3.0, None)}


def test_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("1 ", "p"), (None, "q"), ("3", "r")], "k string, v string")
    b = spark.createDataFrame([(1.0, "s"), (None, "t"), (1.0, "u")], "k double, v string")
    out = joins.join_tables(a, b, ["k"], ["k"], "outer", match_missing=True)
    assert out.columns == ["k", "v", "v_2"]
    assert sorted(map(str, rows(out))) == sorted(map(str, [("1", "p", "s"), ("1", "p", "u"), (None, "q", "t"), ("3", "r", None)]))
    info = joins.join_report(a, b, ["k"], ["k"], match_missing=True).first()
    assert (info["matched"], info["left_only"], info["right_only"], info["duplicate_right_keys"]) == (3, 1, 0, 1)


@pytest.mark.parametrize("sep", [";", "\t", "|", ","])
def test_delimited_files(spark, tmp_path, sep):
    path = tmp_path / "t.txt"
    path.write_bytes(sep.join(["id", "name", "price"]).encode() + b"\n" + sep.join(["1", "caf\xe9 \u20ac", "2.5"]).encode("cp1252") + b"\n" + sep.join(["2", "N/A", "3"]).encode() + b"\n")
    assert rows(files.read_delimited(spark, str(path))) == [(1, "café €", 2.5), (2, None, 3.0)]


def test_headerless_and_quoted(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('1,2,"a, b"\n3,?,c\n')
    assert rows(files.read_delimited(spark, str(path))) == [(1, 2, "a, b"), (3, None, "c")]
    assert files.set_header(spark, str(path), False).columns == ["1", "2", "a, b"]
    assert not files.header_looks_like_data(["a", "b", "3"])


def test_json_shapes(spark, tmp_path):
    one, many, lines = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    one.write_text('{"meta": [{"x": 1}], "results": [{"id": 1, "v": {"n": "p"}}, {"id": 2, "v": {"n": null}}]}')
    many.write_text('[{"id": 1, "tags": [1, 2]},\n {"id": 2, "tags": []}]')
    lines.write_text('{"id": 1}\n{"id": 2}\n')
    got = files.read_json_records(spark, str(one))
    assert got.columns == ["id", "v.n"] and rows(got) == [(1, "p"), (2, None)]
    assert rows(clean.stringify_nested(files.read_json_records(spark, str(many)))) == [(1, "[1,2]"), (2, "[]")]
    assert files.read_json_records(spark, str(lines)).count() == 2


def test_jdbc_text_is_guarded():
    assert files.jdbc_query("sales.orders") == "SELECT * FROM sales.orders"
    assert files.jdbc_query(sql="select 1;", limit=5) == "SELECT * FROM (select 1) AS sub LIMIT 5"
    for bad in ({"table": "x; drop table y"}, {"sql": "delete from x"}, {"sql": "select 1; select 2"}):
        with pytest.raises(ValueError):
            files.jdbc_query(**bad)


def test_formula_cells(spark):
    df = spark.createDataFrame([("=1+1",), ("-12.5",), ("-1,200",), ("@x",), ("ok",), (None,)], "`+c` string")
    out = wrangle.escape_formulas(df)
    assert out.columns == ["'+c"] and [r[0] for r in out.collect()] == ["'=1+1", "-12.5", "-1,200", "'@x", "ok", None]


def test_generated_awards(spark):
    df = awards.generate_awards(spark, 20_000)
    assert df.count() > 20_000 and df.select("award_id").distinct().count() == 20_000
    gap = df.agg(F.avg(F.col("materials_cost").isNull().cast("int"))).first()[0]
    assert 0.02 < gap < 0.04
    done = clean.clean_table(df)
    assert "award_id" in done.identifiers and done.profile["total_cost"] == "numeric" and done.profile["naics_code"] == "categorical"


def test_slice_quota():
    assert awards.share_quota([5, 100, 100], 60) == [5, 28, 27]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "n int, t string")
    c_ = spark.createDataFrame([(2, None), (1, "y")], "n int, t string")
    mark = lambda d: quality.fingerprint(d).first()[0]
    assert mark(a) == mark(b) != mark(c_)


def test_partitioned_read_equals_plain(spark, small_data):
    df = spark.read.parquet(f"{small_data}/orders.parquet")
    path = sinks.write_partitioned(df, ["o_orderstatus"], f"{work_dir(spark)}/t-{np.random.randint(1 << 30)}", "gzip")
    back = spark.read.parquet(path)
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == df.count()
    plan = back.where("o_orderstatus = 'F'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan


def test_sql_guard(spark):
    t = {"silver": spark.range(3)}
    assert layers.sql_on_layers(t, "with x as (select id from silver) select count(*) n from x").first()[0] == 3
    with pytest.raises(ValueError):
        layers.sql_on_layers(t, "drop table silver")


def test_run_stops_at_failed_gate(spark, tmp_path):
    raw = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, t string")
    run = layers.run_config({"schema": {"columns": {"gone": "text"}}}, raw, str(tmp_path))
    assert run["log"]["status"] == "stopped at quality gate" and run["silver"] is None
    assert spark.read.parquet(f"{tmp_path}/run_log").count() == 1


def test_week_labels(spark):
    df = spark.createDataFrame([("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",)], "d string")
    from tabella.functions.scalar import moment, period_label, period_start

    got = df.select(F.date_format(period_start(moment(df, "d"), "Week"), "MM-dd"), F.date_format(period_label(moment(df, "d"), "Week"), "MM-dd"))
    assert rows(got) == [("01-01", "01-07"), ("01-08", "01-14")]


def test_series_gaps(spark):
    df = spark.createDataFrame([("2024-01-01", 10.0), ("2024-03-01", 30.0), ("2024-03-15", 50.0)], "d string, v double")
    mean = forecast.regular_series(df, "d", "v", "Month", "mean", min_periods=3)
    total = forecast.regular_series(df, "d", "v", "Month", "sum", min_periods=3)
    assert [r["value"] for r in mean.orderBy("t").collect()] == [10.0, 25.0, 40.0]
    assert [r["value"] for r in total.orderBy("t").collect()] == [10.0, 0.0, 80.0]
    assert forecast.regular_series(df, "d", "v", "Month").isEmpty()


def test_smoothing_follows_trend_and_season():
    t = np.arange(60)
    y = 100 + 2 * t
    ahead = forecast.smooth(y.astype(float), 3)
    assert np.all(np.abs(ahead - (100 + 2 * np.arange(60, 63))) < 6)
    y = 50 + 10 * np.sin(2 * np.pi * t / 12)
    ahead = forecast.smooth(y, 12, 12)
    assert np.abs(ahead - (50 + 10 * np.sin(2 * np.pi * np.arange(60, 72) / 12))).max() < 1.5


def test_step_and_planted_reading(spark):
    rng = np.random.default_rng(3)
    data = []
    for s in "ABCD":
        for i in range(40):
            v = 10 ** (2 + 0.05 * rng.standard_normal() + (0.8 if s == "B" and i >= 28 else 0))
            data.append((s, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=7 * i + (30 if s == "C" and i > 30 else 0))).to_pydatetime(), v * (1000 if s == "A" and i == 10 else 1)))
    df = spark.createDataFrame(data, "site string, id long, at timestamp, value double")
    out = standardize.standardize(df, "site", "at", "value", tie="id")
    flagged = [(r["site"], r["id"]) for r in out.rows.where("flag_outlier").collect()]
    assert ("A", 10) in flagged
    steps = {r["series"]: r["step_date"] for r in out.quality.where("step_date is not null").collect()}
    assert "B" in steps and abs((steps["B"] - pd.Timestamp("2024-07-15").to_pydatetime()).days) <= 14
    assert rows(out.rows.where("flag_gap_before").select("site", "id")) == [("C", 31)]
    short = standardize.standardize(df.where("id < 13"), "site", "at", "value", tie="id")
    assert short.quality.where("step_date is not null").isEmpty()


def test_basket_rules_against_counting(spark):
    orders = [(o, i) for o in range(30) for i in ("a", "b", "c") if (o * 7 + ord(i)) % (2 + ord(i) - 97) == 0] + [(0, "a"), (99, "z")]
    df = spark.createDataFrame(orders, "o long, i string")
    got = {(r["item"], r["also"]): r["orders_with_both"] for r in basket.basket_rules(df, "o", "i", min_orders=1).collect()}
    sets = {}
    for o, i in orders:
        sets.setdefault(o, set()).add(i)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        basket.basket_rules(df.where("o < 5"), "o", "i")


def test_churn_trend_leaves_recent_periods_out(spark):
    df = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-03-01"), ("b", "2024-01-20"), ("b", "2024-01-25"), ("c", "2024-06-30")], "c string, d string")
    got = rows(kpi.churn_trend(df, "c", "d", 60).withColumn("period", F.date_format("period", "yyyy-MM")))
    assert got == [("2024-01", 2, 1, 50.0), ("2024-03", 1, 1, 100.0)]


def test_tests_known_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 9.0)], "g string, v double")
    r = stats.welch_t_test(df, "v", "g").first()
    assert math.isclose(r["statistic"], -1.6906, abs_tol=1e-3) and 0.10 < r["p_value"] < 0.2
    with pytest.raises(ValueError):
        stats.one_way_anova(df, "v", "g")
    one = spark.createDataFrame([("a", "x")] * 9 + [("b", "y")] * 8, "g string, h string")
    # n(|ad - bc| - n/2)^2 / (row and column totals)
    assert math.isclose(stats.chi_square_independence(one, "g", "h").first()["statistic"], 17 * (72 - 8.5) ** 2 / (9 * 8 * 9 * 8))
    assert stats.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0)], "x double, y double"), "x", "y") == pytest.approx(1.0)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 3, 4)], "v double")
    got = [(r["low"], r["high"], r["n"]) for r in describe.bin_equal_width(df, "v", 4).orderBy("bin").collect()]
    assert got == [(0.0, 1.0, 3), (1.0, 2.0, 1), (2.0, 3.0, 1), (3.0, 4.0, 1)]
    assert describe.bin_equal_width(spark.createDataFrame([(5.0,)] * 3, "v double"), "v").agg(F.sum("n")).first()[0] == 3


def test_transforms_refuse_bad_signs(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,)], "v double")
    for f in (prepare.transform_log, prepare.transform_sqrt, prepare.box_cox):
        with pytest.raises(ValueError):
            f(df, "v")
    same = prepare.rescale_zscore(spark.createDataFrame([(3.0,), (3.0,)], "v double"), ["v"])
    assert rows(same) == [(0.0,), (0.0,)]


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "Great great don't stop"), (2, "  "), (3, None), (4, "bad, BAD thing")], "id long, t string")
    lexicon = spark.createDataFrame([("great", 3.0), ("bad", -2.0)], "word string, valence double")
    got = {r["id"]: (r["sentiment"], r["word_count"]) for r in text.lexicon_sentiment(df, "id", "t", lexicon).collect()}
    assert got == {1: ("Positive", 4), 2: ("No text", 0), 3: ("No text", 0), 4: ("Negative", 3)}
    assert rows(text.word_counts(df, "t", 2)) == [("bad", 2), ("great", 2)]


def test_isolation_finds_planted_rows(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((400, 2)))] + [(1000, 12.0, -12.0), (1001, -15.0, 9.0)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    out = models.isolation_forest(df, {"a": "numeric", "b": "numeric"}, 0.02, trees=50)
    flagged = {r["id"] for r in out.where("is_anomaly").collect()}
    assert {1000, 1001} <= flagged and len(flagged) <= 12 and out.count() == 402


def test_boruta_and_importance_find_the_signal(spark):
    rng = np.random.default_rng(2)
    data = [(float(3 * s + 0.1 * e), float(s), float(n)) for s, e, n in rng.standard_normal((600, 3))]
    df = spark.createDataFrame(data, "y double, signal double, noise double")
    got = {r["column_name"]: r["decision"] for r in models.boruta_select(df, "y", ["signal", "noise"], False, rounds=8, trees=10).collect()}
    assert got["signal"] == "Confirmed" and got["noise"] != "Confirmed"
    top = models.model_importance(df, "y", ["signal", "noise"], False, trees=10, repeats=1).first()
    assert top["column_name"] == "signal" and top["permutation_drop"] > 0.3


def test_knn_exact(spark):
    train = spark.createDataFrame([(i, float(i), "lo" if i < 50 else "hi") for i in range(100)], "id long, x double, y string")
    test = spark.createDataFrame([(1000, 3.2, "?"), (1001, 96.4, "?")], "id long, x double, y string")
    assert dict(rows(models.knn_predict(train, test, "id", "y", ["x"], True))) == {1000: "lo", 1001: "hi"}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("p", 0.9), ("p", 0.5), ("n", 0.5), ("n", 0.1)], "y string, s double")
    assert models.roc_auc(df, "y", "s", "p") == pytest.approx(0.875)


@pytest.mark.parametrize(
    "written",
    ["1/5/2024", "2024-1-5", "2024-01-05 10:11", "2024-01-05 10:11:12.345", "2024-01-05T10:11:12Z", "Jan 5, 2024", "05-Jan-2024", "1/5/2024 13:00", "5.1.2024", "20240105", "January 5, 2024", "1/5/2024 1:00 PM"],
)
def test_common_date_spellings(spark, written):
    df = clean.parse_dates(spark.createDataFrame([(written,)], "d string"), ["d"])
    assert str(df.first()["d"])[:10] == "2024-01-05"


def test_numbers_and_words_are_no_dates(spark):
    df = clean.parse_dates(spark.createDataFrame([("2024",), ("12",), ("soon",), ("2024-13-01",), ("",)], "d string"), ["d"])
    assert {r["d"] for r in df.collect()} == {None}


def test_safe_columns_never_repeat(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a b", "a-b", "a_b_2", "A B"])
    names = wrangle.safe_columns(df).columns
    assert len({n.lower() for n in names}) == 4 and names[0] == "a_b"


def test_missing_keys_have_no_partner_unless_asked(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 7), (None, 8), ("x", 9)], "k string, b int")
    assert sorted(rows(joins.join_tables(a, b, ["k"], ["k"]).select("a", "b")), key=str) == [(1, None), (2, 9)]
    assert sorted(rows(joins.join_tables(a, b, ["k"], ["k"], match_missing=True).select("a", "b"))) == [(1, 7), (1, 8), (2, 9)]
    assert joins.join_report(a, b, ["k"], ["k"]).first()["result_rows"] == 2
    assert joins.join_report(a, b, ["k"], ["k"], match_missing=True).first()["result_rows"] == 3


def test_many_levels_are_kept(spark):
    df = spark.createDataFrame([(float(i), f"v{i % 60:02d}") for i in range(600)], "n double, c string")
    kinds = {"n": "numeric", "c": "categorical"}
    made = models.cluster_features(df, kinds, categories=True)
    assert made.categories == ["c"] and made.table.first()["features"].size == 61
    out, names, skipped = models.encode_features(df, "n", ["c"], kinds)
    assert names == ["c"] and not skipped and out.select("c").distinct().count() == 60
    assert models.table_prep(df, ["n"], ["c"])(df).first()["features"].size == 61
    assert stats.drivers(df, "n", ["c"], kinds).count() == 1


def test_knn_is_exact_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(balls, "BALL_ROWS", 40)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 2))
    x[:250, 0] = 1.0  # a hot strip
    y = rng.standard_normal(700)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    got = dict(rows(models.knn_predict(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), "id", "y", ["a", "b"], False)))
    known = np.array([i % 3 != 0 for i in range(700)])
    z = (x - x[known].mean(axis=0)) / x[known].std(axis=0)
    for i in np.flatnonzero(~known):
        near = np.argsort(((z[known] - z[i]) ** 2).sum(axis=1))[:5]
        assert got[i] == pytest.approx(y[known][near].mean())


def test_distinct_rows_tell_gaps_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "x string, y string")
    assert quality.distinct_rows(df) == 3
