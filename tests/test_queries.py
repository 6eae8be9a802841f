"""Every query against its SQL in DuckDB, and the laws of those without SQL."""

import duckdb
import pytest

from quarrymill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def tables(request):
    d, con = f"/root/testdata/{request.param}", duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, con


def rows(found):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, tables, name):
    d, duck = tables
    df = plans.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    sql = f"select {quoted} from ({plans.SQL[name]})"
    assert len(duck.execute(f"select * from ({plans.SQL[name]}) limit 0").description) == len(columns)
    assert rows(df.select(*columns).collect()) == rows(duck.execute(sql).fetchall())


def test_greedy_equals_a_loop(spark, sf):
    import hashlib
    import re

    seen_a, seen_b, want = set(), set(), []
    ws = "[" + "\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + "]+"
    for i, text, source, n in sorted(duckdb.sql(f"select doc_id, text, source, n_chars from '{sf}/documents.parquet'").fetchall()):
        a, b = f"{source}/{n}", hashlib.sha1(re.sub(ws, " ", re.sub("#[^\n]*", "", text)).strip(" ").encode()).hexdigest()
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(i)
    assert sorted(r[0] for r in plans.QUERIES["q_dedup_greedy_or"](spark, sf).collect()) == want


def test_funnel_closes(spark, sf):
    from pyspark.sql import functions as F

    totals = plans.QUERIES["q_curation_funnel"](spark, sf).groupBy("stage").agg(F.sum("delta").alias("t")).collect()
    assert totals and all(r.t == 0 for r in totals)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
