"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, released, table

#: Labelled rows used for fitting, at most; folds of those rows.
SAMPLE, FOLDS = 9_000, 4
#: Words of the second person in the languages of the tables.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen deinem deiner euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[A-Za-z][*@$#!0-9]+[A-Za-z]")
SPACED = re.compile(r"\b[A-Za-z](?:[ .\-_][A-Za-z]\b){3,}")
REPEATED = re.compile(r"([A-Za-z!?])\1{2,}")
THRESHOLD = 0.7


def units(word: str) -> list[str]:
    """What a word may be known by: itself, and its beginnings of 4 to 7 letters."""
    return ["=" + word, *[word[:k] for k in range(4, min(7, len(word)) + 1)]]


def kept_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


class Seen(dict):
    """Words to (weight, second person) under a lexicon; of bounded size."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = weight
        return weight


WIDTH = 16


def features(text: str, seen: Seen) -> np.ndarray:
    """Rates, all finite and defined for an empty text: lexicon weight, hits and different hits, second person and how near it
    is to hits, capitals, punctuation by kind, digits, masked and spaced-out letters, repeated letters and words, lengths."""
    words = WORD.findall(text.lower())
    n, data = max(1, len(words)), np.frombuffer(text.encode(), np.uint8)
    weight = np.fromiter(map(seen.__getitem__, words), float, len(words))
    hits = np.nonzero(weight)[0]
    second = np.array([i for i, w in enumerate(words) if w in SECOND], np.int64)
    near = 0
    if len(hits) and len(second):
        k = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hits), np.abs(second[np.maximum(k - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    count = np.bincount(data, minlength=256)
    size, letters = max(1, len(data)), max(1, int(count[65:91].sum() + count[97:123].sum()))
    marks = int(count[33] + count[63])
    return np.array([
        weight.sum() / n, weight.max(initial=0.0), np.sort(weight)[-3:].sum(), len(hits) / n, min(len(hits), 20), min(len({words[i] for i in hits.tolist()}), 20),
        len(second) / n, near / n, count[65:91].sum() / letters, marks / size, (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / size,
        count[48:58].sum() / size, len(MASKED.findall(text)) / n, len(SPACED.findall(text)) / n, len(REPEATED.findall(text)) / n, len(set(words)) / n,
    ])


class Tree(NamedTuple):
    """A complete tree of some depth, by level: the feature and the greatest bin that goes left; then the leaves' values."""

    feature: np.ndarray
    upto: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    lexicon: dict[str, float]
    edges: list[np.ndarray]
    trees: list[Tree]
    start: float
    raw: np.ndarray
    calibrated: np.ndarray


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def leaf_of(bins: np.ndarray, tree: Tree) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    at = np.arange(len(bins))
    for _ in range(len(tree.value).bit_length() - 1):
        node = 2 * node + 1 + (bins[at, tree.feature[node]] > tree.upto[node])
    return node - len(tree.feature)


def boosted(bins: np.ndarray, y: np.ndarray, wide: int, rounds: int = 90, depth: int = 3, rate: float = 0.15, ridge: float = 2.0) -> tuple[list[Tree], float]:
    """Newton boosting of the logistic loss with histograms of gradients."""
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = (1 << depth) - 1
        feature, upto, node = np.zeros(inner, np.int64), np.full(inner, wide), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            for j in range(bins.shape[1]):
                cell = (node - first) * wide + bins[:, j]
                gs = np.cumsum(np.bincount(cell, g, many * wide).reshape(many, wide), axis=1)
                hs = np.cumsum(np.bincount(cell, h, many * wide).reshape(many, wide), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1.0) | (ht - hs < 1.0)] = 0.0
                at = gain.argmax(axis=1)
                better = gain[np.arange(many), at] > best
                best[better] = gain[np.arange(many), at][better]
                feature[first : first + many][better], upto[first : first + many][better] = j, at[better]
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > upto[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin = margin + value[leaf]
        trees.append(Tree(feature, upto, value))
    return trees, start


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the ends and values of its blocks, each value drawn to one half by one imagined row."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, least and greatest x
    for v, t in zip(x[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    at = np.array([e for b in blocks for e in b[2:]])
    value = np.maximum.accumulate(np.array([v for s, n, _, _ in blocks for v in [(s + 0.5) / (n + 1)] * 2]))
    return at, value


def margins(bins: np.ndarray, trees: list[Tree], start: float) -> np.ndarray:
    out = np.full(len(bins), start)
    for t in trees:
        out += t.value[leaf_of(bins, t)]
    return out


def scores(x: np.ndarray, model: Model) -> np.ndarray:
    m = margins(binned(x, model.edges), model.trees, model.start)
    if not len(model.raw):
        return 1 / (1 + np.exp(-m))
    # a hair of the raw margin keeps the order within a block
    return np.clip(np.interp(m, model.raw, model.calibrated), 0.0, 1.0) * 0.999 + 0.001 / (1 + np.exp(-m))


def _lexicon(counts: dict[str, np.ndarray], rows: np.ndarray, without: int | None) -> dict[str, float]:
    """Units to weights, log odds ratios, from (fold, label) counts of documents; one fold may be left out."""
    use = [f for f in range(FOLDS) if f != without]
    clean, toxic = rows[use].sum(axis=0)
    out = {}
    for unit, c in counts.items():
        n0, n1 = c[use].sum(axis=0)
        odds = float(np.log((n1 + 0.25) / (toxic + 1) / ((n0 + 0.25) / (clean + 1))))
        if n1 >= 3 and odds > 2.0:
            out[unit] = min(odds, 6.0)
    return out


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most about `sample` labelled rows, chosen by a hash of their id, none of which is kept out.

    Executors count the lexicon's units by fold and label, then give each row's features under the lexicon of the other
    folds; the driver gets the units that at least three toxic rows of the sample hold and `sample` rows of 16 numbers, boosts
    trees on all folds but one and calibrates on that one. Labels without text, null labels and repeated labels (the greatest
    counts) do no harm; without any rows of both labels, as of an empty table, the score is a constant. Texts of any length
    count as a whole, words of any length too. Only the columns named here are read, so other names cannot clash.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic is not null").where(~kept_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    hashed = F.xxhash64(F.lit(2), "doc_id")
    usable = usable.where(F.pmod(hashed, F.lit(max(1, n))) < sample).withColumn("fold", F.pmod(F.shiftright(hashed, 20), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(usable.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("fold", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        total = np.zeros((FOLDS, 2), np.int64)
        for b in batches:
            for fold, toxic, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                total[fold, toxic] += 1
                for u in {u for w in set(WORD.findall((text or "").lower())) for u in units(w)}:
                    if u not in found:
                        found[u] = np.zeros((FOLDS, 2), np.int64)
                    found[u][fold, toxic] += 1
                if len(found) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([c.ravel().tolist() for c in found.values()])], ["unit", "n"])
                    found = {}
        found[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([c.ravel().tolist() for c in found.values()])], ["unit", "n"])

    cells = range(2 * FOLDS)
    counted = rows.mapInArrow(count, "unit string, n array<long>").groupBy("unit").agg(*[F.sum(F.col("n")[i]).alias(f"c{i}") for i in cells])
    clean, toxic = [sum((F.col(f"c{i}") for i in cells if i % 2 == t), F.lit(0)) for t in (0, 1)]
    strong = counted.where((F.col("unit") == "") | ((toxic >= 3) & (toxic * 2 > clean)))
    counts = {r[0]: np.array(r[1 : 1 + 2 * FOLDS], np.int64).reshape(FOLDS, 2) for r in strong.collect()}
    total = counts.pop("", np.zeros((FOLDS, 2), np.int64))
    whole = _lexicon(counts, total, None)
    others = [_lexicon(counts, total, f) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Seen(x) for x in others]
        for b in batches:
            x = [[*features(text or "", seen[fold]).tolist(), float(fold), float(toxic)] for fold, toxic, text in zip(*[b.column(i).to_pylist() for i in range(3)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], ["x"])

    data = np.array([r[0] for r in rows.mapInArrow(measure, "x array<double>").collect()], float).reshape(-1, WIDTH + 2)
    data = data[np.lexsort(data.T)]  # the order in which rows came plays no part
    x, fold, y = data[:, :WIDTH], data[:, -2], data[:, -1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.995, 40))) if len(x) else np.zeros(0) for j in range(WIDTH)]
    if len(set(y.tolist())) < 2:
        return Model(whole, edges, [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), np.zeros(0), np.zeros(0))
    bins, wide = binned(x, edges), max(len(e) for e in edges) + 1
    own = fold != 0
    trees, start = boosted(bins[own], y[own], wide) if len(set(y[own].tolist())) > 1 else boosted(bins, y, wide)
    raw, calibrated = isotonic(margins(bins[~own], trees, start), y[~own]) if len(set(y[~own].tolist())) > 1 else (np.zeros(0), np.zeros(0))
    return Model(whole, edges, trees, start, raw, calibrated)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, repeated ones too; a null text is empty, an empty one has a score like any other. Texts are
    measured whole; an empty table gives no rows; columns other than the two named are not read."""
    arrow = arrow_schema(docs.sparkSession, "doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(model.lexicon)
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            x = np.array([features(t or "", seen) for t in b.column(1).to_pylist()], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(x, model), pa.float64())], schema=arrow)
        released()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score; see trained and scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", kept_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
