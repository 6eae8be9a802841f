"""The pipeline's near copies against brute-force Jaccard."""

import random

import numpy as np

import corpus_pipeline
from quarrymill.llm import minhash
from quarrymill.operators import near
from quarrymill.operators.graphs import components


def brute(rows):
    """What stays of (doc_id, text): the least of each component of pairs at 0.8 or more, all compared with all."""
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split()) for i, t in rows}
    left, out = set(sets), set()
    while left:
        group = todo = {min(left)}
        while todo:
            todo = {j for j in left - group if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in todo)}
            group = group | todo
        out.add(min(group))
        left -= group
    return out


def test_equals_brute(spark, sf):
    rnd = random.Random(5)
    names = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):  # copies with one to five words changed, on either side of 0.8
        words = rnd.choices(names, k=rnd.randint(30, 300))
        for _ in range(5):
            copy = list(words)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(names)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one  two"), (904, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, sf).collect()}
    assert got == want and len(want) < 180


def test_bucket_of_unlike(spark):
    sets = [minhash.shingles(t) for t in (b"a b c d e f", b"A b  c d e f", b"a b", b"")]
    assert minhash.similarity(sets[0], sets[1]) == 1.0 and minhash.similarity(sets[0], sets[2]) == 0.0 and len(sets[3]) == 0
    assert minhash.bands(sets[0]) == minhash.bands(sets[1]) != minhash.bands(sets[2])


def test_signs_before_sets(spark, monkeypatch):
    """Texts that share a passage, and so buckets, but are unlike, are told apart without their sets; nearer ones are compared."""
    rnd, seen = random.Random(7), []
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rnd.randrange(10**6)}" for _ in range(56)])) for i in range(80)]  # Jaccard about a third
    rows += [(80, rows[3][1] + " more"), (81, rows[5][1] + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    exact = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or exact(pairs, *rest))
    got = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert {i: c for i, c in got.items() if i != c} == {80: 3, 81: 5}
    assert 2 <= sum(seen) < 40


def test_simhash_decides(spark, sf, monkeypatch):
    """Pairs whose SimHashes differ in more bits than the bound are not linked; the bound lets all pairs at the threshold pass."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s t u")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, sf).collect()} == {1}
    bits, ends = near.bounds(0.8)
    rng = np.random.default_rng(3)
    for n in (5, 10, 25, 60, 200):
        for _ in range(150):
            u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            k = n // 5
            x = rng.integers(0, k + 1)
            a, b = np.sort(np.delete(u, range(x))), np.sort(np.delete(u, range(x, k)))
            s, t = (np.array(near.signs(y, near.minima(y)), np.int64).view(np.uint64) for y in (a, b))
            d = s[2:] ^ t[2:]
            d = (d | d >> np.uint64(1) | d >> np.uint64(2) | d >> np.uint64(3)) & np.uint64(0x1111111111111111)
            assert near.similarity(a, b) >= 0.8 and np.bitwise_count(s[1] ^ t[1]) <= bits and np.bitwise_count(d).sum() <= ends
    monkeypatch.setattr(near, "bounds", lambda least: (-1, ends))
    assert {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, sf).collect()} == {1, 2}


def test_small_rounds_are_small(spark, monkeypatch):
    """Rounds over few rows take few tasks, however many partitions a shuffle has, and find what rounds over all tasks find."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rnd.randrange(10**6)}" for _ in range(40)])) for i in range(60)]  # unlike, in many of each other's buckets
    for i in range(20):
        words = rows[i][1].split()
        words[rnd.randrange(65, 100)] = "x"
        rows.append((60 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    context, found, tasks = spark.sparkContext, [], []
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for few in (True, False):
            if not few:
                for name in ("FEW_ROWS", "FEW_SETS", "FEW_PAIRS", "FEW_LINKS"):
                    monkeypatch.setattr(near, name, 0, raising=False)
            context.setJobGroup(f"small rounds {few}", "")
            found.append({r.doc_id: r.component_id for r in near.near_copies(docs).collect()})
            track = context.statusTracker()
            stages = {s for j in track.getJobIdsForGroup(f"small rounds {few}") for s in track.getJobInfo(j).stageIds}
            tasks.append(sum(i.numTasks for i in map(track.getStageInfo, stages) if i and i.numCompletedTasks))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in were.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and {i for i, c in found[0].items() if i == c} == brute(rows)
    assert tasks[0] < 0.5 * tasks[1], tasks


def test_few_links_in_one_task(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(7, 7)]
    frame = spark.createDataFrame(links, "u long, v long").repartition(3)
    many, few = ({tuple(r) for r in components(frame, few=n).collect()} for n in (0, 1000))
    assert many == few and len(many) > 100
    assert components(frame.where("false"), few=1000).count() == 0


def test_unlike_copies_of_one_text(spark, monkeypatch):
    """Copies of one text that are at 0.5 to 0.8 to each other are told apart by their odd sketches; few of their sets are compared."""
    rnd, seen = random.Random(13), []
    base = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rnd.sample(range(150), rnd.randint(4, 7)):
            words[at] = f"w{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(160 + i, rows[i][1] + " more") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    exact = near.confirmed
    monkeypatch.setattr(near, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or exact(pairs, *rest))
    got = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert all(got[160 + i] == got[i] for i in range(10)) and {i for i, c in got.items() if i == c} == brute(rows)
    assert sum(seen) < 200, seen


def test_odd_sketches_lose_no_pair(spark):
    """Pairs at the threshold are open whatever their sizes, sketches of two lengths included; pairs a little below are mostly not."""
    rng = np.random.default_rng(17)
    pairs = []
    for n in (1, 5, 9, 146, 1100, 1280, 2300, 9000):  # at 1280 and 2300 the smaller set's sketch is half as long
        for below in (False, True):
            for _ in range(5):
                u = rng.integers(0, 1 << 64, n, dtype=np.uint64)
                k = int(n * (0.28 if below else 0.2))
                x = int(rng.integers(0, k + 1)) if below or n not in (1280, 2300) else k
                a, b = np.sort(np.delete(u, range(x))), np.sort(np.delete(u, range(x, k)))
                pairs.append((*(near.signs(y, near.minima(y)) + near.odd(y) for y in (a, b)), near.similarity(a, b) >= 0.8))
    assert any(len(a) != len(b) for a, b, _ in pairs)
    found = spark.createDataFrame(pairs, "a array<long>, b array<long>, near boolean").select("near", near.alike(0.8).alias("open"), near.unshared().alias("n")).collect()
    assert all(r.open for r in found if r.near) and all(r.open == s.open for r, s in zip(found, spark.createDataFrame([(b, a, n) for a, b, n in pairs], "a array<long>, b array<long>, near boolean").select(near.alike(0.8).alias("open")).collect()))
    assert sum(r.open for r in found if not r.near) < 0.2 * sum(not r.near for r in found)
