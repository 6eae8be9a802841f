"""Sources, sinks and streams on files written here."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarrymill.sources import files
from quarrymill.streaming import watch

ROW = StructType([StructField("id", LongType()), StructField("text", StringType())])


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "text": "x"}\n\n{"id": 2, "text": " "}\n{"id": 3\n{"text": "y"}\n')
    rows, bad = files.read_tolerant(spark, str(path), ROW, ["id", "text"])
    assert [tuple(r) for r in rows.collect()] == [(1, "x")]
    assert sorted((r.line, r.why) for r in bad.collect()) == [('{"id": 2, "text": " "}', "no text"), ('{"id": 3', "not JSON"), ('{"text": "y"}', "no id")]
    assert sorted(str(r.id) for r in files.read_live(spark, str(path), ROW).collect()) == ["1", "2", "None"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), ROW).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], ROW)
    out = str(tmp_path / "out")
    files.write_jsonl(df, out, ["id"])
    with pytest.raises(Exception):
        files.write_jsonl(df, out, ["id"])
    files.write_jsonl(df, out, ["id"], force=True)
    with pytest.raises(ValueError):
        files.write_jsonl(df.where("false"), out, ["id"], force=True)
    more = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], ROW)
    assert files.append_new(more, out, "id", ROW) == 1 and files.append_new(more, out, "id", ROW) == 0
    assert sorted(r.id for r in files.read_jsonl(spark, out, ROW).collect()) == [1, 2, 3]
    assert files.append_new(more, str(tmp_path / "new"), "id", ROW) == 2
    assert files.replace_if_changed(spark, out, str(tmp_path / "kept"), F.col("id") < 3, ROW) == 1
    assert files.replace_if_changed(spark, out, str(tmp_path / "none"), F.col("id") < 9, ROW) == 0 and not (tmp_path / "none").exists()
    files.write_split(df.withColumn("split", F.when(F.col("id") == 1, "train").otherwise("valid")), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=valid"]
    counts = spark.createDataFrame([("b", "x", 2), ("a", "y", 1)], "k string, l string, n long")
    assert json.loads(files.stats_json(counts, ["k", "l"], "n").first().stats) == {"a/y": 1, "b/x": 2}
    assert files.markdown(df.orderBy("id")) == "| id | text |\n| --- | --- |\n| 1 | a |\n| 2 | b |"


def test_objects_ids_logs(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / f"o{k}.json").write_text(json.dumps({"id": k, "text": "t"}, indent=1))
    got = files.read_objects(spark, f"{tmp_path}/d*/*.json", ROW).collect()
    assert sorted((r.id, r.dir, r.stem) for r in got) == [(1, "d1", "o1"), (2, "d2", "o2")]
    (tmp_path / "ids").write_text("5\n\n x\n 7 \n")
    assert sorted(r.id for r in files.read_ids(spark, f"{tmp_path}/ids").collect()) == [5, 7]
    (tmp_path / "l.log").write_bytes(b"\x1b[1mone\x1b[0m\n\xff two\n")
    assert [(r.ord, r.line) for r in files.read_log(spark, f"{tmp_path}/l.log").orderBy("ord").collect()] == [(0, "one"), (1, "\ufffd two")]
    import hashlib

    ok = files.pinned(spark, [f"{tmp_path}/ids"], {"ids": hashlib.sha256((tmp_path / "ids").read_bytes()).hexdigest(), "gone": "0"}).collect()
    assert sorted((r.name, r.ok) for r in ok) == [("gone", False), ("ids", True)]


def test_tensors(spark, tmp_path):
    values = {"model.layers.3.mlp.experts.1.up_proj.weight": ("F32", np.array([1.5, -2], "<f4")), "model.layers.0.self_attn.q_proj.weight": ("BF16", (np.array([1.0, 3.0], "<f4").view("<u4") >> 16).astype("<u2"))}
    header, body = {"__metadata__": {"a": "b"}}, b""
    for name, (kind, v) in values.items():
        header[name] = {"dtype": kind, "shape": [2], "data_offsets": [len(body), len(body) + v.nbytes]}
        body += v.tobytes()
    head = json.dumps(header).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + body)
    got = {r.name: r for r in files.read_tensors(spark, f"{tmp_path}/*.safetensors").collect()}
    a, b = got["model.layers.3.mlp.experts.1.up_proj.weight"], got["model.layers.0.self_attn.q_proj.weight"]
    assert (a.layer, a.module, a.expert, list(a["values"])) == (3, "mlp.experts.up_proj", 1, [1.5, -2.0])
    assert (b.layer, b.module, b.expert, list(b["values"])) == (0, "self_attn.q_proj", None, [1.0, 3.0])


def test_tensor_names(spark):
    names = ["model.layers.7.mlp.gate.weight", "model.layers.7.mlp.experts.12.down_proj.weight", "model.layers.7.input_layernorm.weight", "lm_head.weight", "model.layers.x.mlp.gate.weight", "model.layers.7.mlp.experts.1.gate.weight"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumns(files.tensor_place("name"))
    assert [(r.layer, r.module, r.expert) for r in df.collect()] == [(7, "mlp.gate", None), (7, "mlp.experts.down_proj", 12), *[(None, None, None)] * 4]


def test_backup_markers_and_pins(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a long")
    p = f"{tmp_path}/rows"
    spark.range(5).select(F.col("id").alias("a")).write.json(p)
    assert files.rewrite_with_backup(spark, p, F.col("a") >= 0, schema, f"{p}.bak") == 0 and not (tmp_path / "rows.bak").exists()
    assert files.rewrite_with_backup(spark, p, F.col("a") > 2, schema, f"{p}.bak") == 3
    assert spark.read.json(p).count() == 2 and spark.read.json(f"{p}.bak").count() == 5
    with pytest.raises(FileExistsError):
        files.rewrite_with_backup(spark, p, F.col("a") > 3, schema, f"{p}.bak")
    files.truncated(spark, p)
    assert not (tmp_path / "rows").exists()
    mark = f"{tmp_path}/mark.json"
    assert files.resume_step(spark, mark) == 0
    for step in (3, 7):
        files.mark_progress(spark, mark, step)
        assert files.resume_step(spark, mark) == step
    (tmp_path / "pinned.txt").write_text("x")
    files.refuse_unless_pinned(spark, [f"{tmp_path}/pinned.txt"], {"pinned.txt": hashlib.sha256(b"x").hexdigest()})
    with pytest.raises(ValueError, match="pinned.txt"):
        files.refuse_unless_pinned(spark, [f"{tmp_path}/pinned.txt"], {"pinned.txt": "0"})


def test_next_size():
    from quarrymill.streaming.watch import next_size

    assert [next_size(9, "CUDA out of memory", 0), next_size(9, "other", 4), next_size(9, "", 5), next_size(1, "MemoryError", 1)] == [6, 9, None, None]


def test_read_csv(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "c.csv").write_text("step,rate\n1,0.5\n2,\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c.csv", StructType.fromDDL("step long, rate double")).collect()] == [(1, 0.5), (2, None)]


def drained(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_window_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    # a last row far ahead moves the watermark past every window
    events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = sorted(map(tuple, drained(watch.tumbling(stream, late="40 days"), "windows").collect()))
    from quarrymill.plans import QUERIES

    want = sorted(map(tuple, QUERIES["q_stream_window_counts"](spark, sf).select("start", "event_type", "n", "total").collect()))
    assert got == want


def test_gate_stream_equals_batch(spark, tmp_path):
    from quarrymill.operators import curves

    rows = [("a", i, v) for i, v in enumerate([10.0, 9.0, 4.0, 4.5, 8.0, 3.0, 2.0])] + [("b", 0, 1.0), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = sorted((r.run, r.step, r.best, r.fires) for r in drained(watch.collapse_gate(stream, 0.0, 0.5), "gate").collect())
    batch = curves.running_best(curves.streak_gate(df, "value", ["run"], "step", 0.0, 0.5), "value", ["run"], "step")
    assert got == sorted((r.run, r.step, r.best, r.fires) for r in batch.collect())
