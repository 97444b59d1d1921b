"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabella.llm import ann_search, cascade, centroids, exact_search, language, licenses, mixing, neardup, packing, phrases, pseudonyms, secrets, toxicity
from tabella.llm.common import crc_fold
from tabella.session import load

#: For the registered query only; real runs pass a secret of their own.
PSEUDONYM_KEY = "registered query, not a secret"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 20
"""

QUALITY = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as materialized (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t
), lines as (select rid, unnest(string_split(text, chr(10))) as line from t
), l as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
    count(*) filter (regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09\x0B-\x0D]*$')) as n_cut_lines,
    count(*) filter (regexp_matches(line, '^[\x20\x09\x0B-\x0D]*[-*\x{2022}]')) as n_bullet_lines
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), windows as (
  select rid, i, w[i : i + 7] as eight from w, unnest(range(1, len(w) - 6)) as r(i)
), covered as (
  select rid, count(distinct place) as n_repeat_words
  from (select rid, i, count(*) over (partition by rid, eight) as n from windows), unnest(range(i, i + 8)) as c(place) where n > 1 group by rid
), top as (
  select rid, max(n) as n_top_word from (select rid, word, count(*) as n from (select rid, unnest(w) as word from w) group by rid, word) group by rid
), m as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as n_letter_words, coalesce(n_lines, 0) as n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutters, coalesce(n_top_word, 0) as n_top_word,
    coalesce(n_cut_lines, 0) as n_cut_lines, coalesce(n_bullet_lines, 0) as n_bullet_lines
  from w left join l using (rid) left join covered using (rid) left join top using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 10 * n_letter_words < 7 * n_words or 100 * n_stutters > 25 * n_words or 100 * n_top_word > 35 * n_words
    or 100 * n_dup_lines > 50 * n_lines or 100 * n_cut_lines > 50 * n_lines or 100 * n_bullet_lines > 90 * n_lines) as kept
from m
"""

PHRASES = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d
), w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), g as materialized (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as a
  from w, unnest(range(1, 5)) as t(k), unnest(range(1, len(w) - k + 2)) as s(i) group by all
), f as materialized (select *, string_split(phrase, ' ') as ws from g where k > 1 and a >= 30
), cuts as (
  select f.lang, f.phrase, f.a, c, l.a as l, r.a as r, ((2000000::hugeint * f.a) // (l.a + r.a)::hugeint)::bigint as score
  from f, unnest(range(1, k)) as t(c)
  join g l on l.lang = f.lang and l.phrase = array_to_string(f.ws[1:c], ' ')
  join g r on r.lang = f.lang and r.phrase = array_to_string(f.ws[c + 1 : f.k], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1
), inside as (
  select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(a) as a
  from f, unnest(range(2, k)) as t(m), unnest(range(1, k - m + 2)) as s(i) group by all
), left_over as (
  select o.* from lowest o left join inside s on s.lang = o.lang and s.phrase = o.phrase where s.a is null or 100 * s.a < 80 * o.a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over
), totals as (select lang, sum(a)::bigint as n from g where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def _lloyd_sql(rounds: int) -> str:
    """Rounds of assignment and exact floor means, one after another."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i])))::bigint"
    steps = [
        """with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id::varchar), e) - 1 as j, e as c from v qualify j < 40
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select rid, any_value(vec_id) as vec_id, any_value(e) as e, arg_min(j, d * 64 + j) as j, min(d) as d
  from (select v.rid, v.vec_id, v.e, c.j, {square} as d from v cross join c{i} c) group by rid
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
  select c.j, coalesce(m.c, c.c) as c from c{i} c left join (
    select j, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as c
    from (select j, i, sum(e[i])::bigint as s, count(*) as n from a{i}, unnest(range(1, 65)) as t(i) group by j, i) group by j
  ) m on c.j = m.j
)""")
    return ", ".join(steps) + f"""
select vec_id, a.j::integer as cluster, d as distance, sum(d) over (partition by a.j)::bigint as cluster_inertia,
  sum(d) over ()::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.j = c.j
"""


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@_query("op6_minhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = neardup.near_duplicates(load(spark, folder, "documents"), how=neardup.Similar(words=3, percent=85))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@_query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    held = crc_fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, load(spark, folder, "labels"), learn=lambda id: crc_fold(id, 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    model = language.fit(docs, learn=lambda id: crc_fold(id, 4) != 2)
    out = language.identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), (crc_fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@_query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@_query("op5_mix_sources")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def _when_kind(kind: str):
    return lambda span: F.when(span["kind"] == kind, 1)


@_query("op10_pii_pseudonyms")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY, spans="spans")
    counts = [F.size(F.array_compact(F.transform("spans", _when_kind(k)))).alias(f"n_{k}") for k in pseudonyms.KINDS]
    return out.select("doc_id", "text", *counts)


@_query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_compact(F.transform("spans", _when_kind(k)))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@_query("op7_exact_top_k", TOP_K)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.exact_top_k(load(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@_query("op9_approximate_neighbours")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ann_search.nearest(load(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@_query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan_licences(files, id="doc_id").withColumnRenamed("id", "doc_id")


@_query("op13_centroid_clustering", _lloyd_sql(5))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(load(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@_query("op12_quality_rules", QUALITY)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    out = cascade.screen(docs, cascade.plan(docs), measures=cascade.BASE)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(F.col("id").alias("doc_id"), *cascade.BASE, base_failed.alias("base_failed"), "kept")


@_query("op11_phrase_mining", PHRASES)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(load(spark, folder, "documents"))
