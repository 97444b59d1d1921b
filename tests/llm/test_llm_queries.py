"""The registered queries of this folder and the pipeline over whole small tables."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import database, difference
from tabella.llm import pseudonyms, queries, toxicity
from tabella.llm.neardup import Similar
from tabella.session import load
from test_neardup import brute

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert names["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, MIDDLE), database(MIDDLE), queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_or_more_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if "doc_id" in got.columns:
        docs = load(spark, SMALL, "documents")
        assert got.select("doc_id").distinct().count() == docs.count()
        assert name.startswith("op3_") or got.count() == docs.count()


def test_op6_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, SMALL, "documents").collect()]
    got = queries.op6(spark, SMALL)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(docs, 3, 85)


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of what it decides."""
    docs = load(spark, SMALL, "documents").cache()
    want = {r["doc_id"]: r for r in docs.collect()}

    model = toxicity.fit(docs, load(spark, SMALL, "labels"))
    reader = toxicity.Reader(model)
    want = {i: r["text"] for i, r in want.items() if reader.score(r["text"] or "") < 0.5}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "pii_pseudonyms", "mix_sources", "best_fit_packing"]
    kept = stage["toxicity"](spark, docs, SMALL).cache()
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want

    groups = brute(list(want.items()), 5, 80)
    want = {i: t for i, t in want.items() if groups[i][2]}
    kept = stage["minhash_near_dedup"](spark, kept, SMALL).cache()
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want

    key = pseudonyms.Permutation(corpus_pipeline.PSEUDONYM_KEY.encode())
    want = {i: pseudonyms.replace(t or "", key)[0] for i, t in want.items()}
    kept = stage["pii_pseudonyms"](spark, kept, SMALL).cache()
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    kept = stage["mix_sources"](spark, kept, SMALL).cache()
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want

    packed = stage["best_fit_packing"](spark, kept, SMALL).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in sizes} == sizes
    run = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(str, run)) == sorted(map(str, packed))


def test_other_target_weights_change_the_packed_sequences(spark, monkeypatch):
    def bins():
        return {(r["doc_id"], r["piece"]): (r["bin"], r["offset"]) for r in corpus_pipeline.run(spark, SMALL).collect()}

    sources = [r[0] for r in load(spark, SMALL, "documents").select("source").distinct().orderBy("source").collect()]
    monkeypatch.setattr(corpus_pipeline, "MIX_BLOCK", 5)
    usual = bins()
    monkeypatch.setattr(corpus_pipeline, "MIX_WEIGHTS", {s: 4.0**i for i, s in enumerate(sources) if s is not None})
    other = bins()
    assert usual.keys() == other.keys() and usual != other


def test_stages_take_odd_and_empty_tables(spark, messy, none):
    for docs in (messy, none):
        for i, (name, f) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = f(spark, docs, SMALL).cache()
            assert docs.columns == before.columns or i == len(corpus_pipeline.STAGES) - 1, name
        assert (docs.count() > 0) == (before.count() > 0)


def test_near_duplicates_take_five_words_and_four_fifths():
    assert Similar() == Similar(5, 80)
