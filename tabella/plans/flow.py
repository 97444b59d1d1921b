"""Queries over sources, sinks, joins, gates, personal data, layers and streams."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from tabella.operators import joins, layers, quality, profile
from tabella.operators.clean import clean_table
from tabella.plans.inputs import CLEAN_SQL, LOADED_SQL, day_text, gap_orders, loaded_orders, messy_orders
from tabella.plans.registry import query
from tabella.session import load, new_path, split_count
from tabella.sources import awards, files, sinks
from tabella.streaming import gold, streams


# ------------------------------------------------------------------ sources
@query(
    "read_delimited",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark, d):
    df = load(spark, d, "customer")
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_mktsegment"))
    path = sinks.write_csv(df.withColumn("c_mktsegment", seg), new_path(spark, "csv"), sep=";")
    return files.read_delimited(spark, path)


@query("read_delimited_line_breaks", "SELECT p_partkey, p_brand || chr(10) || 'size \"' || p_size || '\", ' || p_type AS note FROM part")
def _(spark, d):
    note = F.concat(F.col("p_brand"), F.lit('\nsize "'), F.col("p_size"), F.lit('", '), F.col("p_type"))
    path = sinks.write_csv(load(spark, d, "part").select("p_partkey", note.alias("note")), new_path(spark, "breaks"))
    return files.read_delimited(spark, path)


@query("detect_header", "SELECT s_suppkey AS column_1, s_nationkey AS column_2, s_acctbal AS column_3 FROM supplier")
def _(spark, d):
    path = new_path(spark, "noheader")
    load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.option("sep", "|").csv(path)
    return files.read_delimited(spark, path)


@query("set_header", "SELECT CAST(p_partkey AS VARCHAR) AS column_1, p_brand AS column_2, CAST(p_size AS VARCHAR) AS column_3 FROM part UNION ALL SELECT 'p_partkey', 'p_brand', 'p_size'")
def _(spark, d):
    path = new_path(spark, "header")
    load(spark, d, "part").select("p_partkey", "p_brand", "p_size").coalesce(1).write.option("header", True).csv(path)
    return files.set_header(spark, path, first_row_is_data=True)


@query(
    "read_json_records",
    'SELECT c_custkey AS id, c_name AS "who.name", c_acctbal AS "who.money.balance", c_mktsegment AS segment FROM customer',
)
def _(spark, d):
    df = load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("money")).alias("who"),
        F.col("c_mktsegment").alias("segment"),
    )
    return files.read_json_records(spark, sinks.write_json(df, new_path(spark, "json")))


def _as_arrays(records):
    """Every part file of a text table as one JSON array, its objects over several lines."""

    def run(batches):
        lead = "["
        for batch in batches:
            if len(batch):
                first, *rest = [row.replace(",", ",\n", 1) for row in batch["value"]]
                yield pd.DataFrame({"value": [lead + first, *["," + row for row in rest]]})
                lead = ","
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    return records.mapInPandas(run, "value string")


@query(
    "read_json_array",
    """SELECT p_partkey AS id, p_brand || ' "}' || p_size || '{' AS "what.name", p_type AS "what.kind.type", p_retailprice AS price FROM part""",
)
def _(spark, d):
    name = F.concat("p_brand", F.lit(' "}'), "p_size", F.lit("{"))
    one = F.struct(F.col("p_partkey").alias("id"), F.struct(name.alias("name"), F.struct(F.col("p_type").alias("type")).alias("kind")).alias("what"), F.col("p_retailprice").alias("price"))
    path = new_path(spark, "array")
    _as_arrays(load(spark, d, "part").select(F.to_json(one).alias("value"))).write.text(path)
    return files.read_json_records(spark, path)


@query("read_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return files.read_parquet(spark, sinks.write_parquet(df, new_path(spark, "parquet"), "zstd"))


@query("read_orc", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return files.read_orc(spark, sinks.write_orc(df, new_path(spark, "orc")))


@query("count_rows", "SELECT count(*) AS rows FROM lineitem")
def _(spark, d):
    return files.count_rows(load(spark, d, "lineitem"))


@query(
    "reservoir_sample",
    "SELECT least(count(*), 1000) AS rows, least(count(*), 1000) AS different_keys, 0 AS strange_rows, true AS same_again, true AS follows_the_table FROM orders",
)
def _(spark, d):
    """The sample's size, that its rows are the table's, that it repeats, and that its mean lies within six standard errors."""
    o = load(spark, d, "orders")
    got = files.reservoir_sample(o, 1000)
    again = files.reservoir_sample(o.repartition(3), 1000)
    whole = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")).first()
    strange = got.join(o, o.columns, "left_anti").count()
    same = got.select("o_orderkey").exceptAll(again.select("o_orderkey")).isEmpty()
    close = F.abs(F.avg("o_totalprice") - F.lit(whole["m"])) <= F.lit(6 * whole["s"]) / F.sqrt(F.count("*"))
    return got.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("different_keys"), F.lit(strange).alias("strange_rows"), F.lit(same).alias("same_again"), close.alias("follows_the_table"))


@query(
    "union_files",
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, 'customers' AS source_file FROM customer
       UNION ALL SELECT s_nationkey, s_acctbal, 'suppliers' FROM supplier""",
)
def _(spark, d):
    cust = load(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    supp = load(spark, d, "supplier").select("s_name", F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return files.union_files({"customers": cust, "suppliers": supp})


# ------------------------------------------------------------------ award records
AWARDS_SQL = """
awards AS (
  SELECT 'A' || o_orderkey AS award_id, 'Customer ' || o_custkey AS recipient_name, o_orderdate AS start_date,
    CAST(CAST(o_orderdate AS DATE) + (CAST(day(o_orderdate) AS INTEGER) - 5) AS TIMESTAMP) AS end_date, o_totalprice AS award_amount,
    o_orderpriority AS awarding_agency, CASE WHEN o_orderstatus = 'P' THEN 'Other' ELSE o_orderstatus END AS place_of_performance_state,
    CAST(o_custkey AS VARCHAR) AS naics_code, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'group ' || o_orderstatus END AS naics_description,
    o_orderstatus AS psc_code, CAST(day(o_orderdate) - 5 AS BIGINT) AS duration_days
  FROM orders)
"""


def _award_pages(spark, d):
    """API-shaped pages of at most 100 awards, written as JSON lines and read back."""
    o = load(spark, d, "orders")
    as_object = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("code"), F.concat(F.lit("group "), "o_orderstatus").alias("description")))
    naics = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey").cast("string")).otherwise(as_object)
    award = F.struct(
        F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("Award ID"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("Recipient Name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Start Date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), F.day("o_orderdate") - 5), "yyyy-MM-dd").alias("End Date"),
        F.col("o_totalprice").alias("Award Amount"),
        F.col("o_orderpriority").alias("Awarding Agency"),
        naics.alias("NAICS"),
        F.struct(F.col("o_orderstatus").alias("code"), F.lit(None).cast("string").alias("description")).alias("PSC"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("Place of Performance State Code"),
    )
    page = F.floor(F.col("o_orderkey") / 100)
    pages = o.select(page.alias("page"), award.alias("a")).groupBy("page").agg(F.collect_list("a").alias("results")).drop("page")
    path = new_path(spark, "awards")
    pages.write.option("ignoreNullFields", False).json(path)
    return spark.read.json(path)


@query(
    "flatten_awards",
    f"""WITH {AWARDS_SQL} SELECT award_id, recipient_name, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date,
      award_amount, awarding_agency, place_of_performance_state, naics_code, naics_description, psc_code, duration_days FROM awards""",
)
def _(spark, d):
    out = awards.flatten_awards(_award_pages(spark, d))
    return out.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in ("start_date", "end_date")})


@query(
    "check_date_problems",
    f"""WITH {AWARDS_SQL} SELECT count(*) FILTER (duration_days < 0) AS end_before_start,
      count(*) FILTER (start_date > TIMESTAMP '1998-01-01') AS future_start, count(*) FILTER (duration_days = 0) AS same_day FROM awards""",
)
def _(spark, d):
    return awards.check_date_problems(awards.flatten_awards(_award_pages(spark, d)), "1998-01-01")[1]


@query(
    "dedupe_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(spark, d):
    df = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return awards.dedupe_by_key(df, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "sample_by_time_slice",
    """WITH s AS (SELECT *, CASE """
    + " ".join(f"WHEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) < {round(1461 * (i + 1) / 12)} THEN {i}" for i in range(12))
    + """ END AS k FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'),
      r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM s)
      SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM r WHERE rn <= 10""",
)
def _(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = awards.sample_by_time_slice(df, "o_orderdate", "o_orderkey", 120, date(1995, 1, 1), date(1998, 12, 31))
    return out.select("o_orderkey", day_text("o_orderdate"))


# ------------------------------------------------------------------ sinks and layout
@query("write_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    path = sinks.write_csv(load(spark, d, "nation"), new_path(spark, "out"))
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(path)


@query("write_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return spark.read.schema(df.schema).json(sinks.write_json(df, new_path(spark, "out")))


@query("write_orc", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    df = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return spark.read.orc(sinks.write_orc(df, new_path(spark, "out")))


@query("write_parquet", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def _(spark, d):
    df = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return spark.read.parquet(sinks.write_parquet(df, new_path(spark, "out"), "gzip"))


@query(
    "codec_sizes",
    "SELECT format, codec, count(*) > 0 AS has_size, format = 'CSV' OR count(*) < 100 AS as_large_as_csv FROM orders, (VALUES ('CSV', 'none'), "
    + ", ".join(f"('Parquet', '{x}')" for x in sinks.CODECS)
    + ") f(format, codec) GROUP BY 1, 2",
)
def _(spark, d):
    sizes = sinks.codec_sizes(load(spark, d, "orders"))
    return sizes.select("format", "codec", (F.col("size_kb") > 0).alias("has_size"), (F.col("pct_of_csv") >= 100).alias("as_large_as_csv"))


@query(
    "partition_advice",
    """WITH f AS (SELECT count(*) AS folders_of_combination FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate FROM orders))
    SELECT column_name, distinct_values, round(n / distinct_values, 1) AS rows_per_value,
      CASE WHEN distinct_values <= 1 THEN 'one value' WHEN distinct_values > 500 THEN 'too many values' WHEN n / distinct_values < 100 THEN 'few rows per folder' ELSE 'good' END AS advice,
      folders_of_combination FROM (
      SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS distinct_values, count(*) AS n FROM orders
      UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders
      UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), count(*) FROM orders), f""",
)
def _(spark, d):
    return sinks.partition_advice(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderdate"])


def _event_folders(spark, d):
    df = load(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sinks.write_partitioned(df, ["day"], new_path(spark, "events"), "zstd")


@query("write_partitioned", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    return spark.read.schema("event_id long, event_type string, day string").parquet(_event_folders(spark, d))


@query(
    "partition_pruning",
    """SELECT 'all' AS read, count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS files FROM events
       UNION ALL SELECT 'part', count(*), 1 FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'""",
)
def _(spark, d):
    path = _event_folders(spark, d)
    return sinks.partition_pruning(spark, path, "day", date(2024, 1, 10)).drop("seconds")


# ------------------------------------------------------------------ gates and contracts
GATE_PROFILE = {"price_text": "numeric", "order_date": "datetime", "status": "categorical", "net_amount": "numeric"}


def _gated(spark, d):
    raw = loaded_orders(spark, d).drop("blank", "remark")
    return raw.withColumn("net_amount", F.col("customer_code") - 100)


@query(
    "quality_gates",
    f"""WITH {LOADED_SQL}, g AS (SELECT order_id, customer_code, status, price_text, urgent, order_date, note, customer_code - 100 AS net_amount FROM loaded),
     f AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS k, 1 - count(note) / count(*) AS note_gap,
       count(*) FILTER (net_amount < 0) AS neg, count(*) FILTER (CAST(order_date AS DATE) > DATE '1998-06-02') AS fut FROM g)
     SELECT 'table is not empty' AS check_name, 'PASS' AS result, 'ok' AS detail, n FROM f
     UNION ALL SELECT 'column names differ', 'PASS', 'ok', NULL
     UNION ALL SELECT 'every column is named', 'PASS', 'ok', NULL
     UNION ALL SELECT 'schema columns are all there', 'FAIL', 'region', NULL
     UNION ALL SELECT 'no columns beyond the schema', 'WARN', 'order_id, customer_code, urgent, order_date, note, net_amount', NULL
     UNION ALL SELECT 'columns have the kinds of the schema', 'WARN', 'price_text: numeric, not text', NULL
     UNION ALL SELECT 'as many rows as the schema asks', CASE WHEN n >= 10 THEN 'PASS' ELSE 'FAIL' END, 'ok', n FROM f
     UNION ALL SELECT 'no column is nearly empty', CASE WHEN note_gap >= 0.8 THEN 'FAIL' ELSE 'PASS' END, 'note ' || CAST(round(100 * note_gap) AS INTEGER) || ' %', NULL FROM f
     UNION ALL SELECT 'no column has many gaps', 'PASS', 'ok', NULL
     UNION ALL SELECT 'rows differ from each other', CASE WHEN (n - k) / n > 0.05 THEN 'WARN' ELSE 'PASS' END, printf('%.1f', 100.0 * (n - k) / n) || ' % repeat another row', n - k FROM f
     UNION ALL SELECT 'net_amount: no value is below zero', 'WARN', neg || ' values', neg FROM f
     UNION ALL SELECT 'order_date: no day is after today', 'WARN', fut || ' values', fut FROM f""",
)
def _(spark, d):
    schema = {"columns": {"status": "categorical", "price_text": "text", "region": "text"}, "rows_min": 10}
    return quality.quality_gates(_gated(spark, d), GATE_PROFILE, schema, today="1998-06-01")


@query(
    "gate_status",
    f"""WITH {LOADED_SQL} SELECT 'orders' AS tested, CASE WHEN 1 - count(note) / count(*) >= 0.8 THEN 'FAIL' ELSE 'PASS' END AS status FROM loaded
       UNION ALL SELECT 'customer', CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'WARN' ELSE 'PASS' END FROM customer
       UNION ALL SELECT 'nation', CASE WHEN count(*) > 0 AND count(*) = count(n_name) AND count(*) = count(DISTINCT n_nationkey) THEN 'PASS' ELSE 'WARN' END FROM nation""",
)
def _(spark, d):
    customer = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"))
    tested = {
        "orders": quality.quality_gates(_gated(spark, d), GATE_PROFILE, today="1998-06-01"),
        "customer": quality.quality_gates(customer, {"c_custkey": "identifier", "amount": "numeric"}),
        "nation": quality.quality_gates(load(spark, d, "nation").select("n_nationkey", "n_name"), {"n_nationkey": "identifier", "n_name": "categorical"}),
    }
    parts = [quality.gate_status(checks).select(F.lit(name).alias("tested"), "status") for name, checks in tested.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("schema_contract", "SELECT column_name, kind, (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM orders) AS rows_min FROM (VALUES ('o_orderkey','numeric'), ('o_orderdate','datetime'), ('o_orderpriority','categorical'), ('price','numeric'), ('status','categorical')) t(column_name, kind)")
def _(spark, d):
    df = gap_orders(spark, d)
    return quality.contract_table(df, profile.profile_columns(df))


@query("fingerprint", "SELECT count(*) AS row_count, true AS same_in_any_order, true AS other_after_an_edit, true AS other_after_a_rename FROM lineitem")
def _(spark, d):
    """The code stays when rows move, and changes with one cell or one name."""
    li = load(spark, d, "lineitem")
    first = li.agg(F.min("l_orderkey")).first()[0]
    edited = li.withColumn("l_quantity", F.col("l_quantity") + ((F.col("l_orderkey") == first) & (F.col("l_linenumber") == 1)).cast("int"))
    code = lambda df: quality.fingerprint(df).first()["fingerprint"]
    moved, other, renamed = code(li.repartition(max(5, split_count(li)))), code(edited), code(li.withColumnRenamed("l_tax", "tax"))
    mark = F.col("fingerprint")
    return quality.fingerprint(li).select("row_count", (mark == moved).alias("same_in_any_order"), (mark != other).alias("other_after_an_edit"), (mark != renamed).alias("other_after_a_rename"))


# ------------------------------------------------------------------ personal data
def _people(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(
        k,
        F.col("c_name").alias("customer_name"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.org")).alias("mail"),
        F.format_string("(555) 123-%04d", F.pmod(k, F.lit(10000))).alias("reach"),
        F.format_string("%03d-12-%04d", F.pmod(k, F.lit(900)), F.pmod(k, F.lit(10000))).alias("tax_no"),
        F.col("c_mktsegment").alias("product_name"),
    )


PEOPLE_SQL = """people AS (SELECT c_custkey, c_name AS customer_name, lower(replace(c_name, '#', '.')) || '@example.org' AS mail,
  printf('(555) 123-%04d', c_custkey % 10000) AS reach, printf('%03d-12-%04d', c_custkey % 900, c_custkey % 10000) AS tax_no, c_mktsegment AS product_name FROM customer)"""


@query(
    "detect_pii",
    rf"""WITH {PEOPLE_SQL}, s AS (SELECT avg(CAST(regexp_full_match(mail, '[\w.+-]+@[\w-]+\.[\w.-]+') AS INT)) AS mail,
      avg(CAST(regexp_full_match(reach, '\+?1?[\s.-]?\(?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{4}}') AS INT)) AS reach,
      avg(CAST(regexp_full_match(tax_no, '\d{{3}}-\d{{2}}-\d{{4}}') AS INT)) AS tax_no FROM people)
     SELECT 'mail' AS column_name, 'email' AS kind FROM s WHERE mail >= 0.8 UNION ALL SELECT 'reach', 'phone' FROM s WHERE reach >= 0.8
     UNION ALL SELECT 'tax_no', 'SSN' FROM s WHERE tax_no >= 0.8 UNION ALL SELECT 'customer_name', 'name'""",
)
def _(spark, d):
    return quality.pii_table(_people(spark, d))


@query(
    "mask_pii",
    f"""WITH {PEOPLE_SQL} SELECT c_custkey, 'id_' || substr(sha256('pepper' || customer_name), 1, 12) AS customer_name,
      'id_' || substr(sha256('pepper' || mail), 1, 12) AS mail, repeat('•', greatest(length(reach) - 4, 0)) || right(reach, 4) AS reach, product_name FROM people""",
)
def _(spark, d):
    df = quality.mask_pii(_people(spark, d), ["customer_name", "mail"], "hash", "pepper")
    return quality.mask_pii(quality.mask_pii(df, ["reach"], "mask"), ["tax_no"], "drop")


# ------------------------------------------------------------------ joins
def _sides(spark, d):
    """Orders with some missing customer keys (text, padded), and customers by number."""
    o = load(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.day("o_orderdate") != 13, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("cust"),
        F.col("o_totalprice").alias("amount"),
    )
    cu = load(spark, d, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("c_custkey"), F.col("c_acctbal").alias("amount")
    )
    return o, cu


SIDES_SQL = """
o AS (SELECT o_orderkey, CASE WHEN day(o_orderdate) <> 13 THEN trim(' ' || o_custkey) END AS cust, o_totalprice AS amount FROM orders),
cu AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey AS VARCHAR) END AS k, c_acctbal AS amount FROM customer)
"""


@query(
    "join_tables",
    f"""WITH {SIDES_SQL} SELECT o.o_orderkey, o.cust, o.amount, cu.k AS c_custkey, cu.amount AS amount_2 FROM o FULL JOIN cu ON o.cust = cu.k""",
)
def _(spark, d):
    o, cu = _sides(spark, d)
    return joins.join_tables(o, cu, ["cust"], ["c_custkey"], "outer")


@query(
    "join_tables_match_missing",
    """WITH r AS (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation), s AS (SELECT nullif(r_regionkey, 2) AS k, r_name FROM region)
       SELECT CAST(r.k AS VARCHAR) AS k, n_name, r_name FROM r LEFT JOIN s ON r.k IS NOT DISTINCT FROM s.k""",
)
def _(spark, d):
    left = load(spark, d, "nation").selectExpr("nullif(n_regionkey, 2) AS k", "n_name")
    right = load(spark, d, "region").selectExpr("nullif(r_regionkey, 2) AS k", "r_name")
    return joins.join_tables(left, right, ["k"], ["k"], match_missing=True)


@query(
    "join_tables_left",
    """SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_acctbal, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, n_regionkey
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, d):
    return joins.join_tables(load(spark, d, "supplier"), load(spark, d, "nation"), ["s_nationkey"], ["n_nationkey"])


@query(
    "join_report",
    f"""WITH {SIDES_SQL}, j AS (SELECT o.o_orderkey IS NOT NULL AS l, cu.amount IS NOT NULL AS r FROM o FULL JOIN cu ON o.cust = cu.k)
      SELECT (SELECT count(*) FROM o) AS left_rows, (SELECT count(*) FROM cu) AS right_rows, count(*) AS result_rows, count(*) FILTER (l AND r) AS matched,
      count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only,
      (SELECT count(*) FROM cu) - (SELECT count(*) FROM (SELECT DISTINCT k FROM cu)) AS duplicate_right_keys FROM j""",
)
def _(spark, d):
    o, cu = _sides(spark, d)
    return joins.join_report(o, cu, ["cust"], ["c_custkey"], "outer")


# ------------------------------------------------------------------ layers
CONFIG = {
    "name": "orders",
    "schema": {"columns": {"status": "categorical", "price_text": "numeric"}, "rows_min": 100},
    "pii": {"remark": "name"},
    "pii_salt": "pepper",
    "stop_on_fail": False,
    "today": "1999-12-31",
    "gold": {"by": ["status", "urgent"], "values": ["price_text"], "funcs": ["sum", "median"]},
}


@query(
    "run_config",
    f"""WITH {CLEAN_SQL} SELECT status, urgent, count(*) AS rows_in_group, round(sum(price_text), 3) AS price_text_sum, round(median(price_text), 3) AS price_text_median
       FROM cleaned GROUP BY ALL""",
)
def _(spark, d):
    return layers.run_config(CONFIG, loaded_orders(spark, d), new_path(spark, "layers"), "orders")["gold"]


@query("append_run_log", f"WITH {CLEAN_SQL} SELECT (SELECT count(*) FROM loaded) AS rows_in, 'FAIL' AS gate, 'ok' AS status, (SELECT count(*) FROM cleaned) AS rows_silver, 6 AS rows_gold")
def _(spark, d):
    out = new_path(spark, "layers")
    layers.run_config(CONFIG, loaded_orders(spark, d), out, "orders")
    return spark.read.parquet(f"{out}/run_log").select("rows_in", "gate", "status", "rows_silver", "rows_gold")


@query("write_layers", f"""WITH {CLEAN_SQL} SELECT customer_code, status, price_text, urgent, order_date, 'id_' || substr(sha256('pepper' || remark), 1, 12) AS remark FROM cleaned""")
def _(spark, d):
    run = layers.run_config(CONFIG, loaded_orders(spark, d), new_path(spark, "layers"), "orders")
    return run["silver"].withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "sql_on_layers",
    f"WITH {CLEAN_SQL} SELECT urgent, count(*) AS n, max(price_text) AS top FROM cleaned GROUP BY urgent",
)
def _(spark, d):
    silver = clean_table(loaded_orders(spark, d)).table
    return layers.sql_on_layers({"bronze": messy_orders(spark, d), "silver": silver}, "SELECT urgent, count(*) AS n, max(price_text) AS top FROM silver GROUP BY urgent;")


@query(
    "lineage_table",
    f"""WITH {CLEAN_SQL} SELECT 'bronze' AS layer, 'orders' AS built_from, count(*) AS rows, 9 AS columns, 'loaded as received' AS how FROM loaded
       UNION ALL SELECT 'silver', 'bronze', count(*), 6, '11 cleaning steps; masked remark' FROM cleaned
       UNION ALL SELECT 'gold', 'silver', count(DISTINCT status), 3, 'grouped by status' FROM cleaned""",
)
def _(spark, d):
    from tabella.operators.grouping import group_summary

    raw = loaded_orders(spark, d)
    done = clean_table(raw)
    gold = group_summary(done.table, ["status"], ["price_text"], ["sum"])
    tables, rows = {"bronze": raw, "silver": done.table, "gold": gold}, {}
    layers.write_layers(tables, new_path(spark, "lineage"), quality.quality_gates(raw, done.profile), {}, rows)
    return layers.lineage_table(tables, "orders", len(done.steps), ["remark"], ["status"], rows)


@query(
    "reproducibility_record",
    f"""WITH {CLEAN_SQL} SELECT 'orders' AS source, (SELECT count(*) FROM loaded) AS input_rows, 9 AS input_columns, 64 AS code_length, '{{"missing": "automatic"}}' AS settings,
       (SELECT count(*) FROM cleaned) AS output_rows""",
)
def _(spark, d):
    raw = loaded_orders(spark, d)
    made = layers.reproducibility_record(raw, clean_table(raw), "orders", {"missing": "automatic"})
    return made.select("source", "input_rows", "input_columns", F.length("input_fingerprint").alias("code_length"), "settings", "output_rows")


@query(
    "spark_job_from_config",
    """WITH t AS (SELECT DISTINCT o_orderdate, o_totalprice, o_orderstatus FROM orders)
       SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day,
       min(o_totalprice) AS o_totalprice_min, round(avg(o_totalprice), 6) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max,
       CASE grouping(year(o_orderdate), strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')) WHEN 3 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS level
       FROM t GROUP BY GROUPING SETS ((year(o_orderdate)), (year(o_orderdate), strftime(o_orderdate, '%m')),
         (year(o_orderdate), strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')))""",
)
def _(spark, d):
    df = load(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus")
    out = layers.partitioned_job(df, "o_orderdate", ["year", "month"], new_path(spark, "job"), {"o_totalprice": "numeric"})
    return out.withColumn("o_totalprice_mean", F.round("o_totalprice_mean", 6))


# ------------------------------------------------------------------ streams
def _event_files(spark, d):
    """Events as several files of one folder, oldest first, the last file late and repeated."""
    e = load(spark, d, "events")
    path = new_path(spark, "stream-in")
    first = e.where("ts < '2024-01-16'")
    rest = e.where("ts >= '2024-01-16'")
    first.coalesce(1).write.parquet(path)
    rest.coalesce(1).write.mode("append").parquet(path)
    return path, e.schema


@query("stream_config_run", "SELECT event_id, 'id_' || substr(sha256('s' || user_id), 1, 12) AS user_id, event_type, value FROM events")
def _(spark, d):
    path, schema = _event_files(spark, d)
    out = new_path(spark, "stream-out")
    kinds = {"event_id": "numeric", "user_id": "categorical", "event_type": "categorical", "value": "numeric", "props": "identifier"}
    stream = streams.file_stream(spark, path, schema, max_files=1).drop("ts")
    streams.stream_layers(stream, kinds, {"value": 0.0}, out, new_path(spark, "chk"), ["user_id"], salt="s")
    return spark.read.parquet(f"{out}/silver").select(F.col("event_id").cast("long"), "user_id", "event_type", "value")


@query(
    "stream_gold",
    """SELECT event_type, count(*) AS rows_in_group, round(sum(coalesce(value, 0)), 3) AS value_sum, round(avg(coalesce(value, 0)), 3) AS value_mean, count(*) AS value_count,
       round(min(coalesce(value, 0)), 3) AS value_min, round(max(coalesce(value, 0)), 3) AS value_max FROM events GROUP BY 1""",
)
def _(spark, d):
    path, schema = _event_files(spark, d)
    out = new_path(spark, "stream-out")
    kinds = {"event_id": "numeric", "user_id": "categorical", "event_type": "categorical", "value": "numeric", "props": "identifier"}
    wanted = gold.Gold(["event_type"], ["value"], ["sum", "mean", "count", "min", "max"])
    streams.stream_layers(streams.file_stream(spark, path, schema, max_files=1).drop("ts"), kinds, {"value": 0.0}, out, new_path(spark, "chk"), gold=wanted)
    return gold.gold_table(spark, f"{out}/gold_state", wanted)


@query("stream_run_log", "SELECT 'silver' AS layer, count(*) AS rows, 2 AS batches FROM events")
def _(spark, d):
    path, schema = _event_files(spark, d)
    out = new_path(spark, "stream-out")
    kinds = {"event_id": "numeric", "user_id": "categorical", "event_type": "categorical", "value": "numeric", "props": "identifier"}
    streams.stream_layers(streams.file_stream(spark, path, schema, max_files=1).drop("ts"), kinds, {}, out, new_path(spark, "chk"))
    return spark.read.parquet(f"{out}/run_log").groupBy("layer").agg(F.sum("rows").alias("rows"), F.countDistinct("batch").cast("int").alias("batches"))


@query(
    "stream_kpi_trend",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS rows
       FROM events GROUP BY ALL HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def _(spark, d):
    path, schema = _event_files(spark, d)
    out = new_path(spark, "stream-out")
    stream = streams.file_stream(spark, path, schema, max_files=1)
    streams.to_parquet(streams.stream_kpi_trend(stream, "ts", "value", ["event_type"]), out, new_path(spark, "chk"))
    df = spark.read.parquet(out)
    return df.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "rows")


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def _(spark, d):
    e = load(spark, d, "events")
    path = new_path(spark, "stream-in")
    # Every error event arrives twice, in the same file.
    e.unionByName(e.where("event_type = 'error'")).coalesce(1).write.parquet(path)
    out = new_path(spark, "stream-out")
    stream = streams.stream_dedupe(streams.file_stream(spark, path, e.schema), "ts", "event_id")
    streams.to_parquet(stream.select("event_id", "user_id", "event_type"), out, new_path(spark, "chk"))
    return spark.read.parquet(out)


