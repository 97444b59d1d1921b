import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import prose
from tabella.llm import language, licenses, pseudonyms, secrets, toxicity
from tabella.llm.common import crc_fold

# licence scan


def cosine(words, template):
    """Plain TF-IDF cosine over dictionaries."""
    bags = [Counter(licenses.WORD.findall(t.lower())) for ts in licenses.TEMPLATES.values() for t in ts]
    df = Counter(w for b in bags for w in b)
    weigh = lambda b: {w: n * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, n in b.items()}
    a, b = weigh(Counter(words)), weigh(Counter(licenses.WORD.findall(template.lower())))
    return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_licence_cosine_and_skipped_texts():
    m = licenses.Matcher(licenses.TEMPLATES, 0.6)
    rng = random.Random(1)
    pool = [w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.WORD.findall(t.lower())] + ["quiet", "river"]
    for _ in range(400):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        want = max(cosine(words, t) for ts in licenses.TEMPLATES.values() for t in ts)
        got, name = m.best(words)
        assert abs(got - want) < 1e-9 or (got == 0 and want < 0.6)
    for name, texts in licenses.TEMPLATES.items():
        assert all(m.best(licenses.WORD.findall(t.lower()))[1] == name for t in texts)


def test_licences_pass_down_to_the_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][0]
    rows = [
        ("a/LICENSE", mit, "MIT", "file", None), ("a/x.py", "code\nwords", "MIT", "inherited", "a"), ("a/b/c/y.py", None, "MIT", "inherited", "a"),
        ("a/b/COPYING", gpl, "GPL-3.0", "file", None), ("a/b/z.py", "", "GPL-3.0", "inherited", "a/b"), ("a/bc/z.py", "", "MIT", "inherited", "a"),
        ("a/b/own.py", "river stone\n# Licensed under the Apache License, Version 2.0.\ncloud", "Apache-2.0", "notice", None), ("d/e.py", "quiet", None, None, None),
        ("top.txt", "quiet", None, None, None), (None, "quiet", None, None, None), ("a/x.py", "code\nwords", "MIT", "inherited", "a"), ("f/LICENSE", "no licence here", None, None, None), ("f/g.txt", None, None, None, None),
    ]
    files = spark.createDataFrame([(p, t, "l", 1.0, "d", "s") for p, t, *_ in rows], "path string, text string, licence string, cosine double, directory string, up string")
    got = licenses.scan_licences(files).collect()
    # a/b/c/y.py lies below a/b, which has its own licence
    want = [(p, "GPL-3.0", "inherited", "a/b") if p == "a/b/c/y.py" else (p, n, f, d) for p, _, n, f, d in rows]
    assert sorted((str(r["path"]), str(r["licence"]), str(r["found"]), str(r["from_directory"])) for r in got) == sorted(tuple(map(str, w)) for w in want)
    assert {r["line"] for r in got if r["path"] == "a/b/own.py"} == {1}
    assert licenses.scan_licences(files.limit(0)).count() == 0


# language


def test_language_on_held_out_rows_and_odd_rows(spark, messy, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, learn=lambda id: crc_fold(id, 4) != 2)
    got = language.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").filter(crc_fold(F.col("id"), 4) == 2).filter("lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    odd = {r["id"]: r for r in language.identify(messy, model).collect()}
    assert language.identify(messy, model).count() == messy.count()
    for i in (3, 4, 10):
        assert odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["ambiguous"]
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("und", *model.languages) for r in odd.values())
    assert language.identify(none, model).count() == 0
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(messy, empty).collect()} == {"und"}
    one = language.fit(messy.filter("lang = 'fr'"))
    assert {r["lang_pred"] for r in language.identify(messy, one).collect()} == {"fr", "und"}


def test_codebooks_keep_their_distance():
    for n in (2, 3, 5, 8, 30, 100):
        book = language.codebook(n)
        far = [(a != b).sum() for a, b in itertools.combinations(book, 2)]
        assert book.shape[0] == n and min(far) >= 1 and (n < 6 or min(far) >= 6)
        assert not (np.abs(book.sum(axis=0)) == n).any()


def test_decoding_mends_wrong_bits():
    book = language.codebook(12)
    model = language.Model([str(i) for i in range(12)], book, trust=np.ones(book.shape[1]))
    rng = np.random.default_rng(0)
    most = int(min((a != b).sum() for a, b in itertools.combinations(book, 2)) - 1) // 2
    for i in range(12):
        margins = 3 * book[i].copy()
        margins[rng.choice(len(margins), most, replace=False)] *= -1
        assert language.decode(margins[None], model)[0][0] == i


def test_shares_equal_plain_counting():
    texts = ["Río río 42!", "", "a", "b  c"]
    for first, x, size in language.shares(pa.array(texts), 64):
        assert first == 0 and x.shape == (4, 64) and size.tolist() == [len("río río".encode()), 0, 1, 3]
        assert np.allclose((x**2).sum(axis=1), [1, 0, 1, 1], atol=1e-5)


# secrets


def plain_base(text):
    """The contract's patterns word for word."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["password", "PassWD", "toKen", "api_key", "apikey", "secret", "=", ": ", " ", '"', "'", "abc", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "é", "\n", ".", "ſecret", "toKen", "z9"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def secret_model(spark):
    return secrets.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_finds_values_behind_unknown_names(spark, secret_model, messy, none):
    rng = random.Random(2)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = [(i, f"é river {prose(i, 8)} pwd = \"{value(18)}\" {prose(i + 50, 8)}") for i in range(30)]
    got = secrets.find_secrets(spark.createDataFrame(planted, "doc_id long, text string"), secret_model).collect()
    found = 0
    for r in got:
        text = planted[r["id"]][1]
        found += any(text[s["start"] : s["end"]] == text.split('"')[1] for s in r["spans"] if s["kind"] == "crf")
    assert found >= 20
    clean = [(i, re.sub(r"\d", "", prose(i, 40))) for i in range(200)]
    assert secrets.find_secrets(spark.createDataFrame(clean, "doc_id long, text string"), secret_model).filter("size(spans) > 0").count() <= 2
    odd = secrets.find_secrets(messy, secret_model)
    assert odd.count() == messy.count() and odd.filter("id in (3, 4) and size(spans) > 0").count() == 0
    assert secrets.find_secrets(none, secret_model).count() == 0 and secrets.fit(none) is None
    assert secrets.find_secrets(messy, None).count() == messy.count()


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    steps = rng.standard_normal((3, 3))
    steps[secrets.O, secrets.I] = secrets.NEVER
    sizes = [1, 5, 2, 6, 1, 3]
    emit = rng.standard_normal((sum(sizes), 3)) * 2
    got = secrets.viterbi(emit, np.repeat(np.arange(len(sizes)), sizes), steps)
    at = 0
    for n in sizes:
        def score(path):
            return (secrets.NEVER if path[0] == secrets.I else 0) + sum(emit[at + t, x] for t, x in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tuple(got[at : at + n]) == best
        at += n


def test_query_digests_equal_brute_force(spark):
    from tabella.llm import queries

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op4(spark, "/root/testdata/sf0.01").collect():
        base = plain_base(docs[r["doc_id"]])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() == secrets.digest(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, *_ in base) for x in ("assign", "access", "hex")]
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_plain_distances():
    rng = random.Random(3)
    terms = ["scum", "idiot", "moron", "worthless", "trash", "trasher", "abcabcabcabc"]
    stems = ["lowe", "veju"]
    auto = toxicity.Automaton(terms, stems)
    for _ in range(4000):
        w = list(rng.choice(terms + stems + ["lowely", "river"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", *"abcdeimorst"])
        word = "".join(w)
        want = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= toxicity.edits(t)]
        want += [(0, len(terms) + i) for i, s in enumerate(stems) if word.startswith(s)]
        got = auto.find(word)
        assert (got is None) == (not want) and (got is None or got == min(want))


@pytest.fixture(scope="module")
def insults(spark):
    bad = ["idiot", "scumbag", "worthless", "vermin"]
    rows, marks = [], []
    for i in range(400):
        rng = random.Random(i)
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        elif i % 4 == 1:
            at = rng.randint(5, 50)
            words[at:at] = ["she", "said", f'"{rng.choice(bad)}"', "was", "a", "word"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_tells_abuse_from_quotation_and_reads_misspellings(spark, insults, messy, none):
    docs, labels = insults
    model = toxicity.fit(docs, labels, learn=lambda id: crc_fold(id, 5) != 0)
    assert {"idiot", "scumbag", "worthless", "vermin"} <= {t for t, _ in model.terms} | {t for t, _ in model.stems} | {w for w in ("idiot", "scumbag", "worthless", "vermin") if any(w.startswith(s) for s, _ in model.stems)}
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(crc_fold(F.col("doc_id"), 5) == 0).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored]) > 0.95
    tests = [(0, "the river you idoit worthles scumbagg vermn you"), (1, "river stone cloud"), (2, None), (3, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.5 and max(got[1], got[2], got[3]) < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.drop_toxic(messy, model).columns == messy.columns
    assert toxicity.drop_toxic(messy, model).count() == messy.count() and toxicity.drop_toxic(none, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.drop_toxic(docs, blank).count() == 400
    assert toxicity.drop_toxic(docs, toxicity.fit(none.select("doc_id", "text"), labels)).count() == 400


# pseudonyms


def test_permutations_are_whole_and_undone():
    p = pseudonyms.Permutation(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(p.apply(i, n, "x") for i in range(n)) == list(range(n))
        assert all(p.undo(p.apply(i, n, "x"), n, "x") == i for i in range(n))
    for n in (10**9, 10**18, 2**32):
        assert all(p.undo(p.apply(i, n, "y"), n, "y") == i < n for i in random.Random(n).sample(range(n), 50))
    assert pseudonyms.Permutation(b"a").apply(5, 10**9, "x") != pseudonyms.Permutation(b"b").apply(5, 10**9, "x")


def a_card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + str(pseudonyms.luhn(body))


def test_values_stay_valid_linked_and_reversible():
    rng = random.Random(8)
    p = pseudonyms.Permutation(b"key")
    for _ in range(300):
        card = a_card(rng, rng.choice([13, 16, 19]))
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4)) if len(card) == 16 else card
        values = [
            card, spaced, ".".join(str(rng.randint(0, 255)) for _ in range(4)), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}", f"ab.c{rng.randint(0, 99)}@mail.example.com",
            f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 12):02d}/{rng.randint(13, 28)}/2001", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        ]
        text = " é ; ".join(values)
        new, spans = pseudonyms.replace(text, p)
        assert [text[s:e] for _, s, e in spans] == values
        assert pseudonyms.replace(new, p, back=True)[0] == text
        again, spans2 = pseudonyms.replace(new, p)
        assert [k for k, _, _ in spans2] == [k for k, _, _ in spans]
        alone = [pseudonyms.replace(v, p)[0] for v in values]
        assert new == " é ; ".join(alone)
        if len(card) == 16:
            assert alone[0] == alone[1].replace(" ", "") and pseudonyms.luhn(alone[0][:-1]) == int(alone[0][-1])
    iban = "DE89 3704 0044 0532 0130 00"
    new = pseudonyms.replace(iban, p)[0]
    assert new != iban and pseudonyms._mod97(new.replace(" ", "")[4:] + new[:4]) == 1 and pseudonyms.replace(new, p, back=True)[0] == iban


def test_values_with_other_words_around_them():
    """What follows or precedes a value may look like a group of it; pseudonyms stay linked and can be undone."""
    p = pseudonyms.Permutation(b"key")
    rng = random.Random(5)
    iban = lambda country, body: f"{country}{98 - pseudonyms._mod97(body + country + '00'):02d}{body}"
    fours = lambda v: " ".join(v[i : i + 4] for i in range(0, len(v), 4))
    cases = []
    for _ in range(300):
        card = fours(a_card(rng))
        cases += [(card, "", tail) for tail in (" 12/25", f" {rng.randint(100, 999)}", " 5 items")] + [(card.replace(" ", "-"), "", "-123")]
        at, be, es = iban("AT", f"{rng.randrange(10**16):016d}"), iban("BE", f"{rng.randrange(10**12):012d}"), iban("ES", f"{rng.randrange(10**20):020d}")
        cases += [(at, "", " BIC"), (at, "IBAN ", " BANK BIC"), (fours(be), "", " EUR 500"), (fours(es), "", " BIC")]
        cases += [(f"+33 1 {rng.randint(10, 99)} 45 67 89", "", ""), (f"+61 4 {rng.randint(1000, 9999)} 5678", "", ";"), (f"+49 301 2345 {rng.randint(1000, 9999)}", "", " 0123")]
    for value, before, after in cases:
        text = f"x {before}{value}{after}"
        new, spans = pseudonyms.replace(text, p)
        assert [text[s:e] for _, s, e in spans] == [value] and value not in new
        assert new == f"x {before}{pseudonyms.replace(value, p)[0]}{after}"
        assert pseudonyms.replace(new, p, back=True)[0] == text
    for _ in range(300):  # a group in front
        for word, value in ((rng.choice(["2021", "1999"]), fours(a_card(rng))), ("AB12", fours(iban("ES", f"{rng.randrange(10**20):020d}")))):
            new, spans = pseudonyms.replace(f"{word} {value}", p)
            assert spans and value not in new and pseudonyms.replace(new, p, back=True)[0] == f"{word} {value}"


def test_invalid_values_stay():
    p = pseudonyms.Permutation(b"key")
    for text in ("", "no numbers", "4111111111111112 is no card", "2023-02-30", "300.1.1.1", "000-12-3456", "version 1.2.3", "year 2020"):
        assert pseudonyms.replace(text, p) == (text, [])


@pytest.mark.parametrize("text", ["", "²", "½ Ⅷ ①", "12 ٣ १", "!? _ -", "\U0001f600"])
def test_texts_of_numerals_have_no_language(spark, text):
    model = language.Model(["de", "en"], language.codebook(2), np.ones((language.Settings().features, 1)), np.zeros(1), np.ones(1))
    assert not any(c.isalpha() for c in text)
    docs = spark.createDataFrame([(1, text), (2, text + " ß")], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] in ("de", "en") and got[2][1] > 0


def test_many_languages_share_one_sample(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3} " * 5, f"l{i % 600:03d}") for i in range(2400)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), how=language.Settings(per_language=2, sample=900, features=64, rounds=3))
    assert len(model.languages) == 600 and model.codes.shape[0] == 600


@pytest.mark.parametrize("run", ["a", "1", "1.", "1-", "a@", "+", "+1 ", "a.", "A1", "12/", "(", "1 ", "aA1."])
def test_long_unbroken_runs_take_linear_time(run):
    p = pseudonyms.Permutation(b"key")
    text = run * (1_000_000 // len(run)) + " 1 bob@example.com"
    begun = time.perf_counter()
    new, spans = pseudonyms.replace(text, p)
    assert time.perf_counter() - begun < 5
    assert spans[-1][0] == "email" and "bob@" not in new


def test_many_values_in_one_text_take_linear_time():
    p = pseudonyms.Permutation(b"key")
    text = "on 2001-01-13 " * 40_000
    begun = time.perf_counter()
    new, spans = pseudonyms.replace(text, p)
    assert time.perf_counter() - begun < 20 and len(spans) == 40_000 and len(set(new.split()[1::2])) == 1


@pytest.mark.parametrize("year,month,day", [(2001, 1, 13), (2001, 1, 12), (1999, 12, 31), (2024, 2, 29), (2024, 5, 1)])
def test_one_date_has_one_pseudonym_in_all_notations(year, month, day):
    p = pseudonyms.Permutation(b"key")
    iso = pseudonyms.replace(f"{year}-{month:02d}-{day:02d}", p)[0]
    y, m, d = iso.split("-")
    assert iso != f"{year}-{month:02d}-{day:02d}" and (int(d) > 12) == (day > 12)
    for mark in "/.-":
        day_first = f"{day:02d}{mark}{month:02d}{mark}{year}"
        assert pseudonyms.replace(day_first, p)[0] == mark.join((d, m, y)) and pseudonyms.replace(mark.join((d, m, y)), p, back=True)[0] == day_first
        if day > 12:
            month_first = f"{month:02d}{mark}{day:02d}{mark}{year}"
            assert pseudonyms.replace(month_first, p)[0] == mark.join((m, d, y)) and pseudonyms.replace(mark.join((m, d, y)), p, back=True)[0] == month_first
    assert pseudonyms.replace(f"{year}/{month:02d}/{day:02d}", p)[0] == f"{y}/{m}/{d}"


def test_addresses_that_differ_in_case_are_linked():
    p = pseudonyms.Permutation(b"key")
    low, high = (pseudonyms.replace(x, p)[0] for x in ("bob.smith7@x.com", "Bob.SMITH7@X.com"))
    assert low.lower() == high.lower() and low != high and not low.startswith("bob.smith7")
    assert pseudonyms.replace(high, p, back=True)[0] == "Bob.SMITH7@X.com"


def test_a_phone_with_its_country_code_is_no_card():
    p = pseudonyms.Permutation(b"key")
    for n in range(4915112345670, 4915112345680):
        new, spans = pseudonyms.replace(f"call +{n}", p)
        assert spans[0][0] == "phone" and pseudonyms.replace(new, p, back=True)[0] == f"call +{n}"


def test_pseudonyms_keep_all_columns(messy, none, spark):
    out = pseudonyms.pseudonymize(messy, "key")
    assert out.columns == messy.columns and sorted(map(str, out.collect())) == sorted(map(str, messy.collect()))
    rows = spark.createDataFrame([(1, f"call +1 (212) 555-0100 {prose(1, 20_000)} +1 (212) 555-0100"), (2, "at +1 (212) 555-0100.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(rows, "key", spans="spans").collect()}
    assert len(got[1]["spans"]) == 2 and got[2]["text"][3:20] == got[1]["text"][5:22] == got[1]["text"][-17:] != "+1 (212) 555-0100"
    assert pseudonyms.pseudonymize(none, "key").count() == 0
