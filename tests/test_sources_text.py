import os
import tempfile

import pytest

from tallyframe.operators import charts, text_tables
from tallyframe.plans.request import analyze
from tallyframe.sources import readers, stores


def write(name, content):
    path = os.path.join(tempfile.mkdtemp(prefix="tallyframe-test-"), name)
    with open(path, "wb") as file:
        file.write(content)
    return path


def test_csv_types_and_missing_cells(spark, rows):
    path = write("t.csv", "﻿id,whole,part,word,flag,gap\n1,5.0,1.5,a,True,\n2,,2,N/A,False,\n3,7.0,x,b,true,\n".encode())
    df = readers.read_table(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "whole": "bigint", "part": "string", "word": "string", "flag": "boolean", "gap": "string"}
    assert [r["whole"] for r in rows(df, "id")] == [5, None, 7] and [r["word"] for r in rows(df, "id")] == ["a", None, "b"]


def test_json_list(spark, rows):
    path = write("t.json", b'[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]')
    assert [r["a"] for r in rows(readers.read_table(spark, path), "b")] == [1, None]


def test_unknown_format_raises(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/tmp/table.docx")


def test_large_integers_stay_exact(spark, rows):
    df = spark.createDataFrame([("9007199254740993",), ("2",)], "n string")
    assert sorted(r["n"] for r in rows(readers.coerce_text_columns(df))) == [2, 9007199254740993]


def test_segments(spark, rows):
    df = spark.createDataFrame([(1, "1. What  is X;\n- show Y\n\n b) list z ")], "id int, t string")
    assert [r["segment"] for r in rows(text_tables.split_segments(df, "t", ["id"]), "segment_number")] == ["What is X", "show Y", "list z"]


def test_scope_applies_after_the_kept_turns(spark, rows):
    df = spark.sql("SELECT 1 AS c, id AS t, IF(id < 7, 'a', 'b') AS s FROM range(10)")
    got = rows(text_tables.conversation_context(df, "c", "t", same_scope=df.s == "a"), "t")
    assert [r["t"] for r in got] == [4, 5, 6]


def brute_match(texts, items):
    import re

    from tallyframe.functions.fixed_values import MATCH_STOP_WORDS
    words = lambda t: {w for w in re.split(r"[^a-z0-9]+", t.lower()) if w and w not in MATCH_STOP_WORDS}
    out = set()
    for k, t in texts:
        scores = {}
        for i, c in items:
            a, b = words(t), words(c)
            if a & b:
                scores[i] = len(a & b) / len(a | b)
        best = max(scores.values(), default=0)
        if best >= 0.2:
            out |= {(k, i, round(s, 9)) for i, s in scores.items() if s >= best * 0.8}
    return out


def test_fuzzy_match_is_complete(spark):
    import random
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    def phrase(low, high):
        # One word is in nearly every text.
        return " ".join(["common", *rng.choices(vocabulary, k=rng.randint(low, high)), "the"])
    texts = [(i, phrase(0, 9)) for i in range(120)] + [(1000 + i, "common w1 w2") for i in range(60)]
    items = [(i, phrase(1, 6)) for i in range(30)]
    got = text_tables.fuzzy_catalogue_match(
        spark.createDataFrame(texts, "k int, t string"), "t", ["k"], spark.createDataFrame(items, "i int, d string"), "i", "d"
    ).collect()
    assert {(r.k, r.i, round(r.score, 9)) for r in got} == brute_match(texts, items)


@pytest.fixture(scope="module")
def table(spark):
    return spark.sql("SELECT id % 3 AS g, id AS v, id * 2 AS w, date_add(DATE '2024-01-01', CAST(id AS INT)) AS d FROM range(60)")


@pytest.mark.parametrize("request_", [
    {"operation": "guess"}, {"operation": "total"}, {"operation": "total", "metrics": ["nope"]},
    {"operation": "correlation", "metrics": ["v"]}, {"operation": "top", "metrics": ["v"]},
    {"operation": "total", "metrics": ["v"], "ranking_levels": [("g", 1), ("v", 1)]},
    {"operation": "total", "metrics": ["v"], "granularity": "month"}, {"operation": "total", "metrics": ["v"], "grup_by": ["g"]},
    {"operation": "distinct_count"},
])
def test_bad_requests_raise(table, request_):
    with pytest.raises(ValueError):
        analyze(table, request_)


@pytest.mark.parametrize("request_,count", [
    ({"operation": "total", "metrics": ["v", "w"]}, 1),
    ({"operation": "average", "metrics": ["v"], "group_by": ["g"]}, 3),
    ({"operation": "maximum", "metrics": ["v"], "granularity": "month", "date_column": "d"}, 2),
    ({"operation": "total", "metrics": ["v"], "group_by": ["g"], "granularity": "month", "date_column": "d"}, 6),
    ({"operation": "trend", "metrics": ["v"], "date_column": "d", "granularity": "week"}, 9),
    ({"operation": "compare", "metrics": ["v", "w"], "date_column": "d"}, 2),
    ({"operation": "top", "metrics": ["v"], "group_by": ["g"], "top_n": 2}, 2),
    ({"operation": "distinct_count", "field": "g"}, 1),
    ({"operation": "unique_entities", "field": "v", "group_by": ["g"]}, 3),
    ({"operation": "correlation", "metrics": ["v", "w"]}, 1),
    ({"operation": "forecast", "metrics": ["v"], "date_column": "d", "granularity": "day", "horizon": 3}, 3),
    ({"operation": "total", "metrics": ["v"], "group_by": ["g"], "filters": {"g": [0, 1]}}, 2),
])
def test_requests(table, request_, count):
    assert analyze(table, request_).count() == count


def test_writers_that_meet_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/log"
    run = lambda n: spark.sql(f"SELECT 'f' AS fingerprint, 'm' AS metric_key, 'day' AS granularity, {n} AS who")
    with ThreadPoolExecutor(4) as pool:
        places = list(pool.map(lambda n: stores.append_runs(run(n), path), range(8)))
    assert sorted(places) == list(range(1, 9))
    got = {r.who: r.version for r in stores.read_runs(spark, path).collect()}
    assert got == dict(enumerate(places))
    run(99).write.parquet(f"{path}/runs/run-0123")  # a writer that was lost before its commit
    assert stores.read_runs(spark, path).count() == 8
    other = run(5).selectExpr("fingerprint", "'other' AS metric_key", "granularity", "who")
    assert stores.append_runs(other, path) == 9
    assert [r.version for r in stores.read_runs(spark, path).where("metric_key = 'other'").collect()] == [1]


def test_points_left_out_of_a_scatter(spark):
    df = spark.sql("SELECT id AS `k.id`, IF(id % 5 = 0, NULL, id * 1.0D) AS x, -id AS y FROM range(50)")
    got = charts.scatter_sample(df, ["x", "y"], ["k.id"], points=15)
    assert got.columns == ["k.id", "x", "y", "left_out"] and {r.left_out for r in got.collect()} == {25} and got.count() == 15
    assert got.orderBy("x").collect() == charts.scatter_sample(df.repartition(7), ["x", "y"], ["k.id"], points=15).orderBy("x").collect()
    assert {r.left_out for r in charts.scatter_sample(df, ["x", "y"], ["k.id"]).collect()} == {0}
