"""Release steps, graphs and similarity on small cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.similarity import bootstrap, output_similarity
from quarrymill.operators import graphs, release


def one(spark, column, rows, schema):
    return [r.x for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_scalars(spark):
    assert one(spark, release.lookup(F.col("k"), {"a": "1"}, "tier"), [("a",)], "k string") == ["1"]
    with pytest.raises(Exception, match="no tier for b"):
        one(spark, release.lookup(F.col("k"), {"a": "1"}, "tier"), [("b",)], "k string")
    prompt = release.operations_prompt(F.col("e"), F.col("o"), F.col("t"))
    assert one(spark, prompt, [("Note", {"delete": "d", "create": "c"}, None)], "e string, o map<string,string>, t string") == ["Write handlers for Note\n- create: c\n- delete: d"]
    assert one(spark, release.sections(F.col("a"), F.col("b")), [("x \n", "\n y ")], "a string, b string") == ["x\n\ny"]
    assert one(spark, F.concat(release.head(F.col("a"), 2), release.tail(F.col("a"), 2)), [("abcdé",)], "a string") == ["abdé"]
    assert one(spark, release.task_of(F.col("a"), {"fn-complete": "complete"}, "translate"), [("fn-complete-1",), ("x",)], "a string") == ["complete", "translate"]
    step, scope = release.decoded_step(F.col("s"))
    assert one(spark, F.concat_ws("/", step, scope), [(1_000_120,), (500_120,), (7,)], "s long") == ["120/last", "120/best", "7/snapshot"]
    flags = release.static_features(F.col("c"))
    assert one(spark, F.concat_ws(",", *[F.when(v, k) for k, v in flags.items()]), [("def f(a: int | str) -> int { return lambda x; }",)], "c string") == ["return_type,union_type,lambda_"]
    lengths = release.answer_lengths(F.col("g"), F.col("e"))
    assert one(spark, F.concat_ws(",", *lengths.values()), [("```a```", "a")], "g string, e string") == ["7,1,true"]


def test_frames(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, n int")
    assert release.bounded_slice(df, "k", [F.col("n").desc()], 2).count() == 3
    assert sorted(r.n for r in release.weighted(df.where("k = 'a'"), F.col("n")).collect()) == [1, 2, 2, 3, 3, 3, 4, 4, 4, 4]
    assert release.grid(df.select("k").distinct(), df.select("n").where("n < 2")).count() == 4
    with pytest.raises(ValueError):
        release.grid(spark.range(200), spark.range(200))
    assert release.same_keys(df, df.where("n <> 3"), "k") and not release.same_keys(df, df.where("k = 'a'"), "k")
    assert [tuple(r) for r in release.numeric_ids(spark.createDataFrame([("s", "1"), ("s", "x")], "k string, i string"), "k", "i").collect()] == [("s", 1, 2)]


def test_graphs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "d"), ("g", "zz")], "node string, needs string")
    assert {r.node: r.layer for r in graphs.layers(nodes, edges).collect()} == {"a": 0, "g": 0, "b": 1, "c": 2, "d": -1, "e": -1, "f": -1}
    links = [("s1", "t1"), ("s1", "t2"), ("s2", "t1")]
    rank, near = dict.fromkeys(["s1", "s2", "t1", "t2"], 1.0), {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for _ in range(10):
        rank = {v: 0.15 + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in rank}
    got = {r.node: r["rank"] for r in graphs.pagerank(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == pytest.approx(rank)


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), (None, "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(output_similarity("a", "b")).collect()] == [0.6667, 1.0, 0.0]
    mean, low, high = bootstrap([1.0, 0.0, 1.0, 1.0] * 25)
    assert low < mean == 0.75 < high
