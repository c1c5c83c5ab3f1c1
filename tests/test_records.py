"""Records over line ends, with ranges of a few bytes, against the csv and json modules."""

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import StructType

from tallyframe.sources import readers, records


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "499", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(tmp_path, name, rows, end="\n", bom=False):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if bom else b"") + out.getvalue().encode())


def made_rows(seed, count=60):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["plain", "with, comma", 'a "quoted" word', "line one\nline two", "\n\n", 'ends"\n', "é\n漢", "x" * rng.randint(1, 150)])
    return [[str(i), cell(), cell()] for i in range(count)]


@pytest.mark.parametrize("end, bom", [("\n", False), ("\r\n", True)])
def test_quoted_line_ends_in_files_that_split(spark, tmp_path, small_ranges, end, bom):
    files = {f"f{n}.csv": made_rows(n) for n in range(3)}
    for n, (name, rows) in enumerate(files.items()):
        written(tmp_path, name, [["id", "a.b", "c"]] + [[str(1000 * n + int(r[0])), *r[1:]] for r in rows], end, bom)
    df = readers.read_csv_table(spark, str(tmp_path))
    assert df.columns == ["id", "a.b", "c"] and df.dtypes[0] == ("id", "bigint")
    got = {r[0]: (r[1], r[2]) for r in df.collect()}
    clean = lambda v: v.strip(" ") or None
    assert got == {1000 * n + int(r[0]): (clean(r[1]), clean(r[2])) for n, rows in enumerate(files.values()) for r in rows}
    assert records.has_open_lines(spark, str(tmp_path))
    assert records.delimited_records(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_both_readers_agree_where_lines_are_records(spark, tmp_path):
    rows = [["id", "a", "when"], ["1", 'say "hi", you', "2024-01-01"], ["2", "", "2024-01-02"], ["3", "n/a", ""], ["4", 'five" pipe', "x"]]
    (tmp_path / "t.csv").write_text('id,a,when\n1,"say ""hi"", you",2024-01-01\n2,,2024-01-02\n\n3,n/a,\n4,five" pipe,x\n')
    path = str(tmp_path / "t.csv")
    assert not records.has_open_lines(spark, path)
    plain = readers.read_csv_table(spark, path).collect()
    cut = readers._read_records(spark, path, None, {"encoding": "UTF-8", "escape": '"', "multiLine": False}).collect()
    assert [tuple(r) for r in cut] == [(r[0], r[1] or None, r[2] or None) for r in rows[1:]]
    assert [(r.id, r.a) for r in plain] == [(1, 'say "hi", you'), (2, None), (3, None), (4, 'five" pipe')]


def test_open_quotes_and_headers_are_errors(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n' + "x,y\n" * 90)
    with pytest.raises(ValueError, match="not closed"):
        readers.read_csv_table(spark, str(tmp_path / "open.csv"))
    written(tmp_path, "one.csv", [["a", "b"], ["1", "x\ny"]])
    written(tmp_path, "two.csv", [["a", "c"], ["1", "x\ny"]])
    with pytest.raises(ValueError, match="headers"):
        readers.read_csv_table(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    written(tmp_path, "schema.csv", [["a", "b"], ["1", "x\ny"]])
    assert [tuple(r) for r in readers.read_csv_table(spark, str(tmp_path / "schema.csv"), StructType.fromDDL("a int, b string")).collect()] == [(1, "x\ny")]


@given(st.lists(st.lists(st.text(st.sampled_from('ab",\n '), max_size=6), min_size=2, max_size=3), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_line_states(rows):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    inside, found = False, 0
    for line in out.getvalue().split("\n")[:-1]:
        inside = records.line_state(line, inside)
        found += not inside
    assert found == len(rows) and not inside


def objects(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a}b{", 'quote " and \\', "]", "[{", "é\n", "", "x" * rng.randint(1, 120)])
    return [{"id": i, "t": text(), "in": {"k": [{"d": text()}, {}], "n": None}} for i in range(40)]


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_of_records(spark, tmp_path, small_ranges, indent):
    files = [objects(n) for n in range(3)] + [[]]
    for n, rows in enumerate(files):
        (tmp_path / f"{n}.json").write_text(("﻿" if n == 1 else "") + json.dumps(rows, indent=indent, ensure_ascii=n == 0) + "\n" * n)
    got = [json.loads(r.text) for r in records.listed_objects(spark, str(tmp_path)).collect()]
    key = lambda o: (o["id"], json.dumps(o, sort_keys=True))
    assert sorted(got, key=key) == sorted((o for rows in files for o in rows), key=key)
    df = readers.read_json_records(spark, str(tmp_path))
    assert df.count() == 120 and dict(df.dtypes)["id"] == "bigint"
    typed = readers.read_json_records(spark, str(tmp_path), StructType.fromDDL("id int, t string"))
    assert sorted((r.id, r.t) for r in typed.collect()) == sorted((o["id"], o["t"]) for rows in files for o in rows)


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": "x}]', '[[{"a": 1}]]'])
def test_other_json_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not a list of records|not a record"):
        readers.read_json_records(spark, str(tmp_path / "bad.json")).collect()


def test_records_are_cut_once(spark, tmp_path):
    written(tmp_path, "t.csv", [["a", "b"], *made_rows(4)[:0], ["1", "x\ny"], ["2", "z"]])
    cut, _ = records._records(spark, str(tmp_path / "t.csv"), records._Lines())
    assert "MapInArrow" not in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.first, r.text) for r in cut.collect()) == [(False, '1,"x\ny"'), (False, "2,z"), (True, "a,b")]
