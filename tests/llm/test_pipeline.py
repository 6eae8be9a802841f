"""The pipeline's stages against their operators, and its law as a whole."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill import base
from quarrymill.llm.pii import base_spans
from tests.llm.test_packing import whole
from tests.llm.test_minhash import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage keeps, written and read again."""
    d, out = "/root/testdata/sf0.01", tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        found.append(docs)
    return found


def test_stages(spark, steps):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert all(s.columns == docs.columns for s in steps[:-1])
    label = {i: (q, t) for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{d}/labels.parquet'").fetchall()}
    good, clean, one, masked = [{r.doc_id: r.text for r in s.collect()} for s in steps[:-1]]
    whole_ = {r.doc_id: r.text for r in docs.collect()}
    assert set(one) <= set(clean) <= set(good) <= set(whole_) and all(whole_[i] == t for i, t in one.items())
    assert sum(label[i][0] for i in label if i in good) > 0.97 * sum(q for q, _ in label.values())
    assert sum(label[i][1] for i in label if i in clean) < 0.25 * sum(label[i][1] for i in label if i in good)
    assert set(one) == brute(sorted(clean.items()))
    assert set(masked) == set(one) and not any(base_spans(t) for t in masked.values())
    assert any(masked[i] != one[i] for i in one) and all(masked[i] == one[i] for i in one if not base_spans(one[i]))
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    pieces = steps[4].collect()
    assert {r.doc_id for r in pieces} == set(masked)
    whole(pieces)


def test_little_is_held_at_once(spark, sf):
    """After any stage was asked for, rows go to Python in small batches, and kept tables have small row groups."""
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = spark.range(6000, numPartitions=1).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f" {k}")), 256) for k in range(100)]).alias("text"))  # 38 MB
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, sf)
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sizes) == 6000 and max(r.size for r in sizes) < 2 * base.BATCH
    table = base.kept(wide)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    assert table.count() == 6000 and all(m.row_group(i).total_byte_size < 2 * base.GROUP for m in groups for i in range(m.num_row_groups))


def test_one_id_and_different_texts(spark, sf):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 2), (1, a, "en", "t", 3), (2, a + " ", "en", "s", 4), (3, b, "en", "s", 5), (None, a, "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, a), (1, a), (1, b)] and out[0].__fields__ == docs.columns


def test_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "x", "en", "s", 1), (None, None, None, None, None), (7, "y " * 30_000, "xx", "s", 60_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.where("false")):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        n = out.count()
        assert n >= 3 if rows is docs else n == 0
