"""Shards: exact sizes, gapless slots, uniform draws, and the same result however the input is cut up."""

import zlib
from collections import Counter

import numpy as np

from quarrymill.llm import sharding


def laws(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query(spark, sf):
    rows = sharding.op4_sharding(spark, sf).collect()
    laws(rows, 8)
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in text.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_many_parts_and_any_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 100)
    df = spark.range(5003).selectExpr("id as doc_id", "concat('t', id) as text", "1 as shard", "2 as part", "3 as h0")
    a = sharding.shuffled(df, 8)
    rows = a.collect()
    laws(rows, 8)
    assert a.columns == ["doc_id", "text", "part", "h0", "shard", "slot"]
    again = sharding.shuffled(df.repartition(13), 8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # neighbours in the input are no likelier to share a shard than chance has it
    shard = dict((r.doc_id, r.shard) for r in rows)
    same = sum(shard[i] == shard[i + 1] for i in range(5002)) / 5002
    assert abs(same - 1 / 8) < 0.02


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (None, ""), (None, "x"), (2, "y" * 100_000)], "doc_id long, text string")
    rows = sharding.shuffled(df, 4).collect()
    laws(rows, 4)
    assert len(rows) == 6
    assert sharding.shuffled(df.where("false"), 4).count() == 0


def test_hypergeometric():
    rng = np.random.default_rng(1)
    own = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(40_000))
    theirs = Counter(np.random.default_rng(2).hypergeometric(6, 9, 5, 40_000).tolist())
    assert all(abs(own[k] - theirs[k]) < 600 for k in range(6))
    big = [sharding.hypergeometric(rng, 10**11, 7 * 10**11, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 125_000) < 100 and 200 < np.std(big) < 480


def test_matrix():
    rows, rng = [7, 0, 100, 13, 1], np.random.default_rng(3)
    free = sharding.shard_sizes(sum(rows), 8, rng)
    m = sharding.communication(rows, free, rng)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == free and max(free) - min(free) <= 1 and m.min() >= 0


def test_matrix_in_groups(spark):
    """Two levels give the margins of one, and the draws of one: a cell's mean and spread are the hypergeometric's."""
    rows = {p: 10 + p % 5 for p in range(40)}
    cells = []
    for seed in range(60):
        rng = np.random.default_rng(seed)
        groups = [sum(rows[p] for p in range(g, g + 8)) for g in range(0, 40, 8)]
        totals = sharding.communication(groups, sharding.shard_sizes(sum(rows.values()), 4, rng), rng)
        own = [sharding.communication([rows[p] for p in range(g, g + 8)], totals[g // 8].tolist(), np.random.default_rng([seed, g])) for g in range(0, 40, 8)]
        m = np.concatenate(own)
        assert m.sum(axis=1).tolist() == list(rows.values()) and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
        cells += m[[p for p in rows if rows[p] == 12]].ravel().tolist()
    assert abs(np.mean(cells) - 3) < 0.1 and abs(np.var(cells) - 12 * 0.25 * 0.75) < 0.2
    count = spark.createDataFrame(list(rows.items()), "part long, n long")
    upto = {r.part: r.upto for r in sharding.bounds(count, 4, 5, group=8).collect()}
    assert set(upto) == set(rows) and all(sorted(u) == u and len(u) == 3 and u[-1] <= rows[p] for p, u in upto.items())
