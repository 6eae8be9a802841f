"""Operators that number, rank, link or add up whole tables, against plain Python."""

import math
import statistics
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill import plans
from quarrymill.functions import stats
from quarrymill.operators import dedup, gates, graphs, near, nearest, release, spectrum, split


def test_cumulated_and_shuffled(spark):
    rows = [(i, (i * 37) % 11, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k long, w long").repartition(7)
    got = {r.i: r.before for r in split.cumulated(df, ["k", "i"], "w").collect()}
    total, want = 0, {}
    for i, k, w in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += w
    assert got == want
    order = split.shuffled(df, "i").collect()
    assert sorted(r.position for r in order) == list(range(200)) and order[0].__fields__[:3] == ["i", "k", "w"]
    assert {r.i: r.position for r in order} == {r.i: r.position for r in split.shuffled(df.repartition(3), "i").collect()}
    assert split.cumulated(df.where("false"), ["i"]).count() == 0


def test_stratified_in_ranges(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, i % 2) for i in range(900)], "k long, a string, b int")
    whole, ranged = ({r.k: r.split for r in split.stratified(df, "k", ["a", "b"], rows=n).collect()} for n in (10**6, 30))
    assert whole == ranged and len(whole) == 900
    sizes = {}
    for i in range(900):
        sizes.setdefault((i % 3 > 0, i % 2), []).append(whole[i])
    assert all(s.count("train") == round(0.9 * len(s)) for s in sizes.values())


def test_stratified_equals_sql(spark, tmp_path):
    sizes = [70, 150, 190, 5, 15, 25, 10, 30, 1, 2]  # the first three times 0.95 are just above a half
    rows = [(1000 * k + i, f"l{k % 3}" if k else None, f"s{k}") for k, n in enumerate(sizes) for i in range(n)] + [(None, "l1", "s1")] * 3
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.SQL["q_split_stratified"]).fetchall()
    got = plans.QUERIES["q_split_stratified"](spark, str(tmp_path)).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_medians(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 101)] + [("b", float(x)) for x in rng.random(50)] + [(None, 1.0), (None, 4.0), ("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", None, "d")}
    assert {r.g: r.median for r in stats.medians(df, "g", "v").collect()} == pytest.approx(want)


def test_mcnemar_of_many_pairs(spark):
    cases = [(0, 0), (3, 9), (19, 2), (600, 640), (5000, 5300), (1_000_000, 1_002_000), (12, 12), (0, 40)]
    df = spark.createDataFrame(cases, "b long, c long")

    def exact(b, c):
        if b + c > 20_000:  # twice the normal tail with continuity
            return math.erfc((abs(b - c) - 1) / math.sqrt(b + c) / math.sqrt(2))
        return float(min(Fraction(1), Fraction(2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))) if b + c else 1.0
    for r in df.select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        assert math.isclose(r.p, exact(r.b, r.c), rel_tol=1e-9 if r.b + r.c < 20_000 else 1e-3), (r.b, r.c)


def test_snr_by_group(spark):
    rng = np.random.default_rng(4)
    groups = {"tall": rng.normal(size=(300, 8)) + 5 * np.outer(rng.normal(size=300), rng.normal(size=8)), "flat": rng.normal(size=(3, 8)), "same": np.ones((4, 8))}
    rows = [(g, [float(x) for x in v]) for g, m in groups.items() for v in m] + [("tall", None)]
    got = {r.g: r for r in spectrum.snr_by_group(spark.createDataFrame(rows, "label string, e array<double>").repartition(6), "label", "e").collect()}
    for g, m in groups.items():
        value, count, edge = spectrum.snr(m)
        assert got[g].snr == pytest.approx(value, rel=1e-6, abs=1e-9) and got[g].n_signal == count and got[g].edge == pytest.approx(edge, abs=1e-9)


def test_layer_ranks_and_baseline(spark):
    rows = [(layer, m, float((layer * 7 + len(m)) % 5)) for layer in range(10) for m in ("q", "kk")]
    ranks = spectrum.layer_ranks(spark.createDataFrame(rows, "layer long, m string, v double"), "layer", "m", "v", 4)
    got = {r.layer: r for r in ranks.collect()}
    z = {}
    for m in ("q", "kk"):
        own = [v for _, n, v in rows if n == m]
        z[m] = (np.mean(own), np.std(own))
    score = {layer: np.mean([(v - z[m][0]) / z[m][1] for la, m, v in rows if la == layer]) for layer in range(10)}
    order = sorted(range(10), key=lambda la: (-round(score[la], 9), la))
    assert [la for la, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == order
    assert all(got[la].tie_next == (k + 1 < 10 and round(score[la], 9) == round(score[order[k + 1]], 9)) for k, la in enumerate(order))
    base = spectrum.compared(ranks, "layer", spark.createDataFrame([(order[0],), (order[9],)], "b long")).first()
    assert tuple(base) == (4, 1, False)


def test_components_and_layers(spark):
    links = [(i, i + 1) for i in range(1, 300, 2)] + [(i, i + 2) for i in range(1000, 1100, 2)] + [(5, 5)]
    found = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(found[i] == i - (i % 2 == 0) for i in range(1, 301)) and all(found[i] == 1000 for i in range(1000, 1102, 2))
    depth = 40  # more than the frames that one plan holds
    nodes = spark.createDataFrame([(i,) for i in range(depth + 3)], "node long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, depth)] + [(depth, depth + 1), (depth + 1, depth), (depth + 2, depth), (0, 999)], "node long, needs long")
    assert {r.node: r.layer for r in graphs.layers(nodes, edges).collect()} == {**{i: i for i in range(depth)}, depth: -1, depth + 1: -1, depth + 2: -1}


def test_greedy_in_many_rounds(spark):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(60)]  # each row shares a key with the one before
    seen_a, seen_b, want = set(), set(), []
    for o, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(o)
    assert sorted(r.o for r in dedup.greedy_two_keys(spark.createDataFrame(rows, "o long, a string, b string"), "o", "a", "b").collect()) == want
    first = dedup.keep_first(spark.createDataFrame(rows, "o long, a string, b string"), [F.col("a")], -F.col("o")).collect()
    assert {r.a: r.o for r in first} == {a: o for o, a, _ in rows}


def test_clusters_keep_the_best(spark, sf):
    rows = duckdb.sql(f"select doc_id, text, n_chars from '{sf}/documents.parquet'").fetchall()
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.encode().lower().split()) for i, t, _ in rows}
    size, root = {i: n for i, _, n in rows}, {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and (len(sets[i] & sets[j]) > 0.85 * len(sets[i] | sets[j]) or not (sets[i] or sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: (r.cluster, r.kept) for r in plans.QUERIES["q_minhash_clusters"](spark, sf).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: top(i) for i in sets}
    for cluster in set(map(top, sets)):
        members = [i for i in sets if top(i) == cluster]
        assert [i for i in members if got[i][1]] == [min(members, key=lambda i: (-size[i], i))]
    files = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, None)], "project string, n int, text string")
    assert {r.project: r.text for r in near.projects(files, "project", "n", "text").collect()} == {"p": "a\nb", "q": ""}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None)], "i long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    got = {r.i: r.s for r in nearest.nearest(df.where("i % 3 = 0"), df, "i", "v").collect()}
    assert got == pytest.approx({i: s[i].max() for i in range(0, 90, 3)})


def test_release_steps(spark):
    df = spark.createDataFrame([(i, f"{i}" * 20) for i in range(40)], "i long, t string")
    parts = [df.where("i < 30"), df.where("i >= 30")]
    assert split.disjoint_union(parts, df, "i").isEmpty() and release.sizes_differ(parts, df).isEmpty()
    assert split.disjoint_union([df, df.where("i = 1")], df, "i").count() == 1 and not release.sizes_differ([df, df.where("i = 1")], df).isEmpty()
    found = release.checks({"few": release.too_few(df, 99), "zero": release.all_zero(df.select(F.lit("x").alias("a"), F.lit(0).alias("v")), "a", "v"), "fine": release.too_few(df, 1)})
    assert {r.check_name: r.bad for r in found.collect()} == {"few": 1, "zero": 1, "fine": 0}
    with pytest.raises(Exception, match="few does not hold|zero does not hold"):
        release.refused(found).collect()
    marked = [r.x for r in df.select(release.fim(F.col("t"), F.lit(3), F.lit(5), F.col("i")).alias("x"), "t").collect()]
    assert 5 < sum(x.startswith("<PRE>") for x in marked) < 35
    assert "<PRE>111<SUF>" + "1" * 15 + "<MID>11" in marked or "1" * 20 in marked
    own = release.documented(F.col("t"))
    code = spark.createDataFrame([('def f() {\n """Adds two numbers."""\n return 1;\n}',), ("def g() {\n return;\n}",), ("# says what it does\nx",)], "t string")
    assert [(r.returns, r.docstring) for r in code.select(*[c.alias(n) for n, c in own.items()]).collect()] == [(True, True), (False, False), (False, True)]


def test_named_gates(spark):
    df = spark.createDataFrame([("a # x", "a", None), ("a", " ", "MIT"), (None, "b", "gpl"), ("a", "b", " mit ")], "s string, t string, l string")
    s, t = F.col("s"), F.col("t")
    out = gates.gated(df, [gates.null_source_field(s, t), gates.chosen_equals_rejected(s, t), gates.empty_source_or_target(s, t), gates.license_not_permissive(F.col("l"), ["mit"]), gates.below_test_count_cutoff(F.lit(None).cast("int"), 1)]).collect()
    assert [r.reject_reason for r in out] == ["chosen_equals_rejected", "empty_source_or_target", "null_source_field", "below_test_count_cutoff"]
    assert [r.g for r in df.select(gates.code_graded(F.col("l"), ("MIT",)).alias("g")).collect()] == [False, True, False, False]


def test_composite_reward(spark):
    row = spark.createDataFrame([(True, False, True, 0.5)], "c boolean, r boolean, m boolean, i double").select(stats.composite_reward(*map(F.col, "crmi")).alias("x")).first()
    assert math.isclose(row.x, 0.65)
