"""Records cut in parallel equal those of one sequential reader, wherever the byte ranges fall."""

import csv
import io
import json
import random

import pytest

from tabella.sources import files, records


@pytest.fixture(params=[400, 1 << 20])
def ranges(spark, request):
    """Byte ranges so small that records, quotes and strings cross several of them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(seed, n):
    rng = random.Random(seed)
    some = ["plain", 'a "quoted" word', "two\nlines", "a,b", "\n\n", 'ends in "quote"', "", "é\nü", '"', '""\n"', "long " * 20 + "\n" + "x" * 90]
    return [[str(i), rng.choice(some), rng.choice(some)] for i in range(n)]


def written(rows, header, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(([["id", "name", "no\nte"]] if header else []) + rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records(spark, ranges, tmp_path, end):
    rows = cells(1, 40)
    for name, part in (("a.csv", rows[:30]), ("b.csv", rows[30:])):
        (tmp_path / name).write_bytes(written(part, True, end).encode())
    got = records.csv_records(spark, str(tmp_path)).collect()
    read = [next(csv.reader([r["value"]], lineterminator=end)) if "\n" not in r["value"] else next(csv.reader(io.StringIO(r["value"]))) for r in got]
    heads = [x for r, x in zip(got, read) if r["first"]]
    assert heads == [["id", "name", "no\nte"]] * 2
    assert sorted(x for r, x in zip(got, read) if not r["first"]) == sorted(rows)


def test_delimited_with_line_breaks(spark, ranges, tmp_path):
    rows = cells(2, 30)
    path = tmp_path / "t.csv"
    path.write_text(written(rows, True), newline="")
    df = files.read_delimited(spark, str(path), types=False)
    assert df.columns == ["id", "name", "no\nte"]
    want = [tuple((v.strip(" ") or None) if v.strip(" ") not in files.NA_MARKERS else None for v in r) for r in rows]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want, key=lambda r: r[0]) or sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_many_tasks_read_one_file_with_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(written(cells(3, 4000), True), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = records._pieces(spark, str(path), "\n", "UTF-8")
        assert pieces.rdd.getNumPartitions() > 8
        assert records.csv_records(spark, str(path)).count() == 4001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_windows_text_with_line_breaks(spark, ranges, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('id,note\n1,"caf\xe9\n€"\n2,x\n'.encode("cp1252"))
    assert sorted(tuple(r) for r in files.read_delimited(spark, str(path)).collect()) == [(1, "café\n€"), (2, "x")]


def objects(seed, n):
    rng = random.Random(seed)
    texts = ["p", 'q"uote', "br}ace{", "back\\slash", '\\"', "[{", "end\\\\", "é{ü}", ""]
    return [{"id": i, "t": rng.choice(texts), "deep": {"a": {"b": rng.choice(texts)}, "l": [{"x": 1}, {"x": rng.choice(texts)}]}} if i % 3 else {"id": i, "t": rng.choice(texts)} for i in range(n)]


def same(got, want):
    parsed = [json.loads(r["value"]) for r in got.collect()]
    assert sorted(parsed, key=lambda o: o["id"]) == want


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_lines_and_object(spark, ranges, tmp_path, indent):
    want = objects(4, 20)
    array, behind, wrapped = tmp_path / "array.json", tmp_path / "behind.json", tmp_path / "wrapped.json"
    array.write_text(json.dumps(want, indent=indent, ensure_ascii=False) + "\n")
    behind.write_text("\n".join(json.dumps(o, indent=indent) for o in want))
    around = {"n": 3, "meta": {"id": "me{ta", "l": [1]}, "few": [{"id": -1}, {"id": -2}], "results": want, "tags": ["a", "}"], "tail": {"z": 1}}
    wrapped.write_text(json.dumps(around, indent=indent))
    for path in (array, behind, wrapped):
        same(records.json_records(spark, str(path), records.json_start(spark, str(path))), want)


def test_json_read_as_tables(spark, ranges, tmp_path):
    one, columns, single, empty = (tmp_path / f"{n}.json" for n in ("one", "columns", "single", "empty"))
    one.write_text(json.dumps({"a": [{"id": 1}], "b": [{"id": 1, "v": {"w": "x"}}, {"id": 2, "v": {"w": None}}]}))
    columns.write_text('{"id": [1, 2], "w": ["x", "y"]}')
    single.write_text('{\n "id": 7,\n "w": {"x": 1}\n}')
    empty.write_text("[]")
    assert sorted(tuple(r) for r in files.read_json_records(spark, str(one)).collect()) == [(1, "x"), (2, None)]
    assert sorted(tuple(r) for r in files.read_json_records(spark, str(columns)).collect()) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in files.read_json_records(spark, str(single)).collect()] == [(7, 1)]
    assert records.json_records(spark, str(empty), "[]").count() == 0


def test_only_the_start_of_a_file_reaches_the_driver(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text("[" + ",".join('{"id": %d, "t": "%s"}' % (i, "y" * 9_000) for i in range(400)) + "]")
    assert len(records.json_start(spark, str(path), 20, 100)) <= 20 * 101
    assert files.read_json_records(spark, str(path)).count() == 400
