"""Toxicity: held-out accuracy, folds, and edges."""

import zlib

import duckdb
import numpy as np

from quarrymill.llm import toxicity


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, d).collect()
    label = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    right = sum(p and t for p, t in held)
    assert right / sum(t for _, t in held) > 0.9 and right / sum(p for p, _ in held) > 0.9


def test_learns_nothing_from_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.kept_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.scored(docs, toxicity.trained(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "you fool", 1.0), (3, "a " * 100_000, 1.0), (3, "B!", 1.0)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1), (1, 1), (2, None), (None, 1), (99, 0)], [(i, i % 2) for i in range(4)]):
        model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = toxicity.scored(docs, model).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    p = np.interp(x, at, value)
    for low in (0.1, 0.4, 0.7):
        own = (p >= low) & (p < low + 0.2)
        assert abs(y[own].mean() - p[own].mean()) < 0.05


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    edges = [np.quantile(x[:, j], np.linspace(0.02, 0.98, 40)) for j in range(3)]
    trees, start = toxicity.boosted(toxicity.binned(x, edges), y, 41)
    assert ((toxicity.margins(toxicity.binned(x, edges), trees, start) > 0) == y).mean() > 0.95


def test_features_of_whole_texts():
    """Different hits after many of one kind count, and the second person counts without any."""
    seen = toxicity.Seen({"=bad": 3.0, "=worse": 3.0})
    one, two = toxicity.features("bad " * 250, seen), toxicity.features("bad " * 250 + "worse", seen)
    assert (one[5], two[5]) == (1, 2)
    assert toxicity.features("you and your friends", seen)[6] == 0.5


def test_scores_equal_a_plain_walk():
    """Binning, trees and calibration against plain loops over the same model."""
    rng = np.random.default_rng(0)
    x = rng.random((400, toxicity.WIDTH)).round(2)
    y = (x[:, 0] + 0.3 * rng.random(400) > 0.6).astype(float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.995, 40))) for j in range(toxicity.WIDTH)]
    trees, start = toxicity.boosted(toxicity.binned(x, edges), y, 41, rounds=12)
    margin = toxicity.margins(toxicity.binned(x, edges), trees, start)
    raw, calibrated = toxicity.isotonic(margin, y)
    model = toxicity.Model({}, edges, trees, start, raw, calibrated)
    got = toxicity.scores(x, model)
    for row, value in zip(x[:60], got[:60]):
        bins = [sum(e < v for e in edge) for v, edge in zip(row, edges)]
        total = start
        for tree in trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + (1 if bins[tree.feature[node]] <= tree.upto[node] else 2)
            total += tree.value[node - len(tree.feature)]
        k = int(np.searchsorted(raw, total))
        if k == 0 or k == len(raw):
            level = calibrated[min(k, len(raw) - 1)]
        else:
            low, high = raw[k - 1], raw[k]
            level = calibrated[k - 1] + (calibrated[k] - calibrated[k - 1]) * ((total - low) / (high - low) if high > low else 1)
        assert abs(value - (0.999 * min(max(level, 0), 1) + 0.001 / (1 + np.exp(-total)))) < 1e-9
    order = np.argsort(margin)
    assert (np.diff(got[order]) >= -1e-12).all() and got.min() >= 0 and got.max() <= 1


def test_long_words_and_clashing_names(spark):
    word = "schimpf" * 9
    rows = [(i, (word if i % 2 else "gut") + " text " * 5, 7, 0.5) for i in range(120)] + [(500, None, 1, None), (500, "", 1, None), (None, "x", 2, None), (501, "y " * 200_000, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    assert "=" + word in model.lexicon
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and out[0].__fields__ == ["doc_id", "score"]
    empty = toxicity.scored(docs.where("false"), toxicity.trained(docs.where("false"), labels))
    assert empty.count() == 0
