"""Best-fit packing of token sequences, with exact complements found by their sums."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.base import cut, mapped, remembered, table, utf8

#: Rows of one length that one task numbers.
RUN = 1_000_000


#: Lower-case chunks that surely fall into runs of letters, single digits and runs of signs; others are encoded whole.
LETTERS = "a-zß-öø-ÿ"
SIMPLE = re.compile(rf"[{LETTERS}!-&(-@\[-`{{-~]+")
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


#: A sign at the end of a chunk, after a letter: a token of its own wherever it stands.
CLOSING = re.compile(rb"[,.!?;:](?<=[a-z].)(?=[ \t\n\r\f\v]|\Z)")  # the sign first, so that letters are skipped fast
#: Texts, and bytes of them, whose chunks are looked up at a time.
TEXTS, BYTES = 512, 1 << 19


class Recent:
    """Keys to values in two generations: the older one goes when the younger is full, but for what was asked for meanwhile."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def missing(self, keys: set) -> set:
        """Those of the keys that have no value; the others are young afterwards."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        absent = [k for k in keys if k not in young]
        back = [k for k in absent if k in old]
        young.update(zip(back, map(old.__getitem__, back)))
        return set(absent).difference(back)


class Words:
    """Texts to the little-endian bytes of their ids, with memories of bounded size for chunks between blanks and for runs.

    The vocabulary drops white space and folds case, so no id depends on more than a chunk, nor in simple chunks on more than
    a run. A chunk that holds a special token's string keeps its case and is encoded whole. New runs are encoded many at a
    time; each ends with a token that ends a word.
    """

    def __init__(self, path: str, chunks: int = 150_000, runs: int = 150_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [a.content.lower() for a in self.tokenizer.get_added_tokens_decoder().values()]  # found in a text before its case is folded
        self.whole: set[bytes] = set()  # chunks met lately that hold one
        self.chunks, self.runs = Recent(chunks), Recent(runs)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, line: str, n: int) -> list[bytes]:
        """Ids of n runs with blanks between them, encoded together; each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = np.nonzero(self.last[ids])[0] + 1
        if len(ends) != n:
            return [self._whole(r) for r in line.split(" ")]
        raw, at = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _learn(self, chunks: set[bytes]) -> None:
        cut_up: dict[bytes, list[str]] = {}
        young = self.chunks.young  # missing() was asked for these chunks just now
        letters = [c for c in chunks if c.isalpha()]  # ASCII letters only: one run
        for i in range(0, len(letters), 4096):
            part = letters[i : i + 4096]
            young.update(zip(part, self._many(b" ".join(part).decode(), len(part))))
        for c in chunks.difference(letters):
            text = c.decode()
            if c not in self.whole and SIMPLE.fullmatch(low := text.lower()):
                cut_up[c] = RUNS.findall(low)
            else:
                young[c] = self._whole(text)
        new = list(self.runs.missing({r for runs in cut_up.values() for r in runs}))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.runs.young.update(zip(part, self._many(" ".join(part), len(part))))
        known = self.runs.young
        for c, runs in cut_up.items():
            young[c] = b"".join([known[r] for r in runs])

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of whole texts, of which a few, or a part of a long one, are looked up at a time."""
        at = held = 0
        for i, t in enumerate(texts, 1):
            held += len(t)
            if i == len(texts) or i - at == TEXTS or held + len(texts[i]) > BYTES:
                if len(self.whole) > 10_000:
                    self.whole.clear()
                yield from self._some([self._cut(t) for t in texts[at:i]])
                at, held = i, 0

    def _cut(self, text: bytes) -> list[bytes]:
        """Chunks between blanks, closing signs apart, in lower case but for those that hold a special token or would then."""
        low, special = text.lower(), [s.encode() for s in self.special]
        if any(s in low for s in special):
            chunks = text.split()
            self.whole.update(c for c in chunks if any(s in c.lower() for s in special))
            return [c if c in self.whole else c.lower() for c in chunks]
        return CLOSING.sub(rb" \g<0>", low).split()

    def _some(self, cut_up: list[list[bytes]]) -> Iterator[bytes]:
        wide = 1 << 18
        if max(map(len, cut_up)) > wide:
            for t in cut_up:
                yield b"".join([next(self._some([t[start : start + wide]])) for start in range(0, max(1, len(t)), wide)])
            return
        self._learn(self.chunks.missing(set().union(*cut_up)))
        known = self.chunks.young.__getitem__
        for t in cut_up:
            yield b"".join(map(known, t))


@remembered
def words(path: str, most: int) -> Words:
    return Words(path, most, most)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, most: int = 150_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids as little-endian 32-bit binary): each text's ids and a
    closing 0, cut only where longer than the capacity. A null text is empty and gives one piece of length 1. most: chunks, and
    runs, that each generation of a worker's memories of words has; fewer take less memory and more time."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        known, rows = words(vocabulary, most), []
        for doc, own in zip(batch.column(0).to_pylist(), known.ids(utf8(batch.column(1)))):
            ids = own + bytes(4)
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
        yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), zip(*rows))) if rows else {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], schema, each, remembers=True)


class Sums:
    """An index of sums: which one, two or three of the lengths at hand add up to a number."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.lengths = lengths[::-1].tolist()
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        use = (a >= b) & (a + b <= most)
        a, b = a[use], b[use]
        order = np.lexsort((-a, a + b))  # by sum, the longer one falling
        self.a, self.b = a[order].astype(np.int32), b[order].astype(np.int32)
        self.start = np.searchsorted((a + b)[order], np.arange(most + 2))

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        for k in range(self.start[total], self.start[total + 1]):
            yield int(self.a[k]), int(self.b[k])

    def combinations(self, total: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Each combination once, one length before two and two before three, the longest first; those of which a length has
        run out meanwhile are passed over early."""
        if total <= 0:
            yield ()
            return
        yield (total,)
        yield from self.pairs(total)
        for a in self.lengths:
            if a < total and left[a]:
                low, high = self.start[total - a], self.start[total - a + 1]
                there = np.nonzero((self.a[low:high] <= a) & (left[self.a[low:high]] > 0) & (left[self.b[low:high]] > 0))[0]
                for k in there.tolist():
                    if not left[a]:
                        break
                    yield a, int(self.a[low + k]), int(self.b[low + k])


def plan(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times)], number of sequences) that hold count[length] pieces of each length.

    From the longest length down, a gap is filled exactly by one, two or three lengths, found by their sum in an index, as far
    as pieces are left; what then remains goes best-fit, longest first, into the sequence with the least sufficient gap. The work depends on the number of
    different lengths, not on the number of pieces.
    """
    left = count.astype(np.int64).copy()
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    rest: list[tuple[int, int]] = []
    sums = Sums(np.nonzero(left)[0], capacity)
    for first in range(capacity, 0, -1):
        # what is there only falls, so a combination that has run out never comes back
        for others in sums.combinations(capacity - first, left) if left[first] else ():
            need: dict[int, int] = {}
            for x in (first, *others):
                need[x] = need.get(x, 0) + 1
            n = min(int(left[x]) // k for x, k in need.items())
            if n:
                for x, k in need.items():
                    left[x] -= n * k
                patterns.append((sorted(need.items(), reverse=True), n))
                if not left[first]:
                    break
        if left[first]:
            rest.append((first, int(left[first])))
            left[first] = 0
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length, n in rest:
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                if n >= fit:
                    patterns_n, each = n // fit, fit
                else:
                    patterns_n, each = 1, n
                open_.setdefault(capacity - each * length, []).append(([(length, each)], patterns_n))
                n -= patterns_n * each
                continue
            items, bins = open_[gap].pop()
            each = min(gap // length, n)
            use = min(bins, n // each)
            if use < bins:
                open_[gap].append((items, bins - use))
            if not open_[gap]:
                del open_[gap]
            open_.setdefault(gap - each * length, []).append(([*items, (length, each)], use))
            n -= use * each
    return patterns + [p for group in open_.values() for p in group]


def runs(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int) -> np.ndarray:
    """(length, first rank, times, first sequence, offset) sorted by the first two: where the pieces of a length go, by rank."""
    taken, rows, sequence = [0] * (capacity + 1), [], 0
    for items, n in patterns:
        offset = 0
        for length, times in items:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(items: DataFrame, keys: list[str], capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """All rows of items with sequence_id and offset (long), so that a sequence holds at most `capacity` and has no holes.

    Only the counts by length (at most `capacity` numbers) come to the driver, which plans patterns over them; rows are
    numbered within their length (a length with many rows in several runs by a hash of the keys) and look up their place by
    that rank. The table of runs has at most some rows a length, whatever the input. Lengths must be 1 to capacity, or an error is raised; rows equal in
    all keys are interchangeable; an empty table gives no rows. Columns named sequence_id or offset are replaced, no other name clashes.
    """
    spark = items.sparkSession
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = items.select(*[F.col(f"`{c}`") for c in names])
    length = F.col(f"`{length_col}`")
    count = np.zeros(capacity + 1, np.int64)
    for value, n in items.groupBy(length).count().collect():
        if value is None or not 1 <= value <= capacity:
            raise ValueError(f"a length of {value} doesn't fit {capacity}")
        count[value] = n
    splits = [(int(x), math.ceil(int(count[x]) / RUN)) for x in np.nonzero(count)[0]]
    salts = spark.createDataFrame(splits, "l long, salts long")
    keyed = items.select(F.struct("*").alias("r"), length.cast("long").alias("l"), F.xxhash64(*keys).alias("h")).join(salts, "l")
    keyed = keyed.withColumn("salt", F.pmod("h", "salts"))
    starts, before = [], dict.fromkeys((x for x, _ in splits), 0)
    if any(s > 1 for _, s in splits):
        for x, s, n in sorted(keyed.groupBy("l", "salt").count().collect()):
            starts.append((x, s, before[x]))
            before[x] += n
    else:
        starts = [(x, 0, 0) for x, _ in splits]
    start = spark.createDataFrame(starts, "l long, salt long, start long")
    ranked = keyed.withColumn("i", F.row_number().over(Window.partitionBy("l", "salt").orderBy("h", *[F.col(f"r.`{k}`") for k in keys]))).join(start, ["l", "salt"])
    ranked = ranked.select("r", "l", (F.col("start") + F.col("i") - 1).alias("rank"))
    at = runs(plan(count, capacity), capacity)
    wide = 1 << 44
    key = at[:, 0] * wide + at[:, 1]

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        own, rank = batch.column("l").to_numpy(), batch.column("rank").to_numpy()
        run = at[np.searchsorted(key, own * wide + rank, side="right") - 1]
        k = rank - run[:, 1]
        yield dict(zip(names, batch.column("r").flatten())) | {"sequence_id": run[:, 3] + k // run[:, 2], "offset": run[:, 4] + k % run[:, 2] * own}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return mapped(ranked, ["r", "l", "rank"], f"{schema}, sequence_id long, offset long", each)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as pieces of at most 2048 tokens, packed."""
    import public_tokenizers

    cut_up = cut(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return packed(cut_up, ["doc_id", "piece", "ids_crc32"])
