"""SimHash near-duplicates against brute force."""

import re

import duckdb
import numpy as np
import xxhash

from quarrymill.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows, reach=3):
    """doc_id -> (hex, component) by comparing all rows with all rows."""
    fps = {t: plain(t) for _, t in rows}
    ids, f = [i for i, _ in rows], np.array([fps[t] for _, t in rows], np.uint64)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[i] ^ f) <= reach)[0].tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min([y for y in (least.get(r), x) if y is not None], default=None)
    return sorted(((ids[i], f"{int(f[i]):016x}", least[find(i)]) for i in range(len(ids))), key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = sorted(map(tuple, simhash.op1_simhash(spark, d).collect()), key=str)
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "É é"), (8, "x " * 50_000), (8, "x " * 50_000), (None, "one")]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, fp int, u string")
    got = sorted([(r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in simhash.near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    ball = np.array([sum(1 << int(b) for b in rng.choice(64, 4)) for _ in range(600)], np.uint64)
    points = np.unique(np.concatenate([base, near, ball]))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    want = simhash.components(len(points), a, b)
    assert np.array_equal(simhash.linked(points, 3), want)


def test_shards_meet(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, 4000)
    points = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 62, 4000))]))
    df = spark.createDataFrame([(int(x),) for x in points], "fp long")
    got = simhash.connected(simhash.links(df, shard=500, sample=600)).groupBy("root").count().where("count > 1").count()
    u = points.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    label = simhash.components(len(u), a, b)
    assert got == (np.bincount(label) > 1).sum()
