"""Sources and sinks: JSONL strict and tolerant, single documents, logs, binary tensors, guarded and resumable writes."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A1: one JSON object a line, blank lines skipped; a malformed line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): bad has the raw line and why: not JSON, or a required field null or blank. No line is lost."""
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    kinds = {f.name: f.dataType for f in schema.fields}
    missing = [F.when(F.col(f"r.{c}").isNull() | ((F.trim(f"r.{c}") == "") if isinstance(kinds[c], StringType) else F.lit(False)), f"no {c}") for c in required]
    why = F.coalesce(F.when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), "not JSON"), *missing) if missing else F.when(F.col("r._corrupt_record").isNotNull(), "not JSON")
    checked = parsed.withColumn("why", why)
    return checked.where("why is null").select(*[F.col(f"r.{f.name}") for f in schema.fields]), checked.where("why is not null").select(F.col("value").alias("line"), "why")


def read_live(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A3: lines that open an object, of a file that may end in part of a line; what can't be read is skipped."""
    rows = spark.read.text(path).where(F.col("value").startswith("{")).select(F.from_json("value", schema).alias("r"))
    return rows.where(F.coalesce(*[F.col(f"r.{f.name}").cast("string") for f in schema.fields]).isNotNull()).select("r.*")


def read_objects(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """One object a file, with its path and its place among the sorted paths' names as columns."""
    own = spark.read.schema(schema).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("path"))
    return own.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).withColumn("dir", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A5: one integer a line; others are left out."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).where("id is not null")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A7."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of log files without colour codes; undecodable bytes are replaced. A file is numbered as a whole,
    so it must fit a task, as logs do."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = data.decode("utf-8", "replace").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "ord", "line"])

    return files.mapInArrow(run, "file string, ord long, line string").withColumn("line", F.regexp_replace("line", r"\x1b\[[0-9;]*m", ""))


def header(read: Callable[[int, int], bytes]) -> dict[str, tuple[str, list[int], int, int]]:
    """Type, shape, start and end of each tensor by name: 8 bytes of header length, JSON, then the values. read(start, end)."""
    size = struct.unpack("<Q", read(0, 8))[0]
    own = json.loads(read(8, 8 + size))
    return {name: (x["dtype"], x["shape"], 8 + size + x["data_offsets"][0], 8 + size + x["data_offsets"][1]) for name, x in own.items() if name != "__metadata__"}


def values(kind: str, raw: bytes) -> np.ndarray:
    """Single-precision values of a stored tensor."""
    # fixed values: how each type is stored
    kinds = {"F32": "<f4", "F16": "<f2", "F64": "<f8", "BF16": "<u2"}
    own = np.frombuffer(raw, kinds[kind])
    return (own.astype("<u4") << 16).view("<f4") if kind == "BF16" else own.astype(np.float32)


def read_tensors(spark: SparkSession, glob: str) -> DataFrame:
    """(path, name, dtype, shape, values, layer, module, expert) of tensor files. A task reads a file's header and then one
    tensor at a time by its place, never the file; other types than floats are left out."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length").repartition("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    read = lambda a, z, f=f: f.read_at(z - a, a)
                    for name, (kind, shape, a, z) in header(read).items():
                        if kind in ("F32", "F16", "F64", "BF16"):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([kind]), pa.array([shape], pa.list_(pa.int64())), pa.array([values(kind, read(a, z))], pa.list_(pa.float32()))], ["path", "name", "dtype", "shape", "values"])

    own = files.mapInArrow(run, "path string, name string, dtype string, shape array<long>, values array<float>")
    return own.withColumns(tensor_place("name"))


#: How tensors of a layer are named, modules that are one matrix, and those of which each expert has one.
LAYER, EXPERT = r"^model\.layers\.(\d+)\.(.+)\.weight$", r"^mlp\.experts\.(\d+)\.(gate_proj|up_proj|down_proj)$"
DENSE = ("self_attn.q_proj", "self_attn.k_proj", "self_attn.v_proj", "self_attn.o_proj", "mlp.gate")


def tensor_place(name: str) -> dict[str, F.Column]:
    """Layer, module and expert of a tensor by its name. All experts' matrices of a kind are one module; names of no known
    module have nulls."""
    suffix = F.regexp_extract(name, LAYER, 2)
    kind = F.regexp_extract(suffix, EXPERT, 2)
    module = F.when(suffix.isin(*DENSE), suffix).when(kind != "", F.concat(F.lit("mlp.experts."), kind))
    return {"layer": F.when(module.isNotNull(), F.regexp_extract(name, LAYER, 1).try_cast("int")), "module": module, "expert": F.when(kind != "", F.regexp_extract(suffix, EXPERT, 1).try_cast("int"))}


def pinned(spark: SparkSession, paths: list[str], sha256: dict[str, str]) -> DataFrame:
    """(path, ok) of files whose content must have a known hash, by file name."""
    want = spark.createDataFrame(list(sha256.items()), "name string, want string")
    own = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("have"))
    return want.join(own, "name", "left").select("name", (F.coalesce("have", F.lit("")) == F.col("want")).alias("ok"))


def refuse_unless_pinned(spark: SparkSession, paths: list[str], sha256: dict[str, str]) -> None:
    """A10: an error that names the files whose content isn't what was pinned."""
    if bad := sorted(r.name for r in pinned(spark, paths, sha256).where("not ok").collect()):
        raise ValueError(f"not the pinned content: {bad}")


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop has them."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def truncated(spark: SparkSession, path: str) -> None:
    """At the start of a sweep, nothing is left of an earlier one under the path."""
    own, system = _place(spark, path)
    system.delete(own, True)


def rewrite_with_backup(spark: SparkSession, path: str, keep: F.Column, schema: StructType, backup: str) -> int:
    """Only rows that are kept stay under the path, and the old copy under the backup's, which mustn't exist; nothing is written
    if all rows are kept. Returns how many were dropped."""
    dropped = spark.read.schema(schema).json(path).where(~F.coalesce(keep, F.lit(False))).count()
    if dropped:
        old, system = _place(spark, path)
        new, _ = _place(spark, backup)
        if system.exists(new) or not system.rename(old, new):
            raise FileExistsError(backup)
        spark.read.schema(schema).json(backup).where(keep).write.mode("errorifexists").json(path)
    return dropped


def mark_progress(spark: SparkSession, path: str, step: int) -> None:
    """M3: a durable marker of the steps that are done: written beside, then renamed, so a reader sees the old or the new one."""
    own, system = _place(spark, path)
    beside, _ = _place(spark, f"{path}.next")
    out = system.create(beside, True)
    out.write(json.dumps({"step": step}).encode())
    out.close()
    system.delete(own, False)
    system.rename(beside, own)


def resume_step(spark: SparkSession, path: str) -> int:
    """M3: where to go on: the marker's step, that of one whose renaming was cut short, else 0."""
    for p in (path, f"{path}.next"):
        own, system = _place(spark, p)
        if system.exists(own):
            found = spark.read.text(p).first()
            if found:
                return int(json.loads(found[0])["step"])
    return 0


def write_jsonl(df: DataFrame, path: str, order: list[str], force: bool = False) -> None:
    """Ordered JSON lines under a path that mustn't exist unless forced; nothing is written of no rows."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.orderBy(*order).write.mode("overwrite" if force else "errorifexists").json(path)


def append_new(df: DataFrame, path: str, key: str, schema: StructType) -> int:
    """Appends rows whose key isn't there yet; returns how many. Reading ends before writing begins."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.join(spark.read.schema(schema).json(path).select(key), key, "left_anti") if there else df
    new = new.dropDuplicates([key])
    n = new.count()
    new.write.mode("append").json(path)
    return n


def replace_if_changed(spark: SparkSession, old: str, new: str, keep: F.Column, schema: StructType) -> int:
    """Rows of `old` that are kept go to the new path, only if some are not; returns how many were dropped. The input
    is never written to."""
    rows = spark.read.schema(schema).json(old)
    dropped = rows.where(~F.coalesce(keep, F.lit(False))).count()
    if dropped:
        rows.where(keep).write.mode("errorifexists").json(new)
    return dropped


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """A directory for each part."""
    df.write.mode("errorifexists").partitionBy(column).json(path)


def stats_json(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters as one row of JSON with sorted keys. Counts by few keys; not for whole tables."""
    pairs = F.array_sort(F.collect_list(F.struct(F.concat_ws("/", *keys).alias("k"), F.col(value).alias("v"))))
    return counts.agg(F.to_json(F.map_from_entries(pairs)).alias("stats"))


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A small result as a table in Markdown; an error if it isn't small."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"over {rows} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
