"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text, with thresholds by language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, cut, forget, released, table

#: Symbols (characters, blanks and the ends of a text) in an n-gram; the quantile of trusted documents; one of so many of them is held out of the model for it.
ORDER, QUANTILE, HELD = 4, 0.99, 4
#: Ids of trusted documents that may be broadcast (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST = 2_000_000
#: Code points of text in a block, but for a block of a single longer text; those whose n-grams are looked at together; n-grams that a task counts at once.
CHARS, SLICE, COUNTED = 12 << 20, 1 << 20, 400_000
BEGIN, END = "\x02", "\x03"
BLOCK = "block long, doc_ids array<long>, tags array<string>, marks array<int>, sizes array<long>, texts binary"
#: Bits of an n-gram's place in its block.
PLACE = 26


def plain(text: str) -> str:
    """A text's words, a blank between them. BEGIN and END in it are written as U+FFFD, so that no n-gram inside a text can look like one at its ends."""
    return " ".join(text.replace(BEGIN, "\ufffd").replace(END, "\ufffd").split())


def grams(text: str, order: int) -> list[str]:
    """The n-gram that ends at each symbol of a plain text and at its end: `order` symbols, fewer only where it starts at the text's beginning."""
    s = BEGIN + text + END
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))] if text else []


class Windows:
    """The n-grams of plain texts as numbers: codes of their symbols, in an alphabet of those that occur in some texts.

    A text has order - 1 times BEGIN before it, so each of its symbols ends a window of `order` symbols. Where the alphabet is too
    large for a code in 63 bits, windows are fixed-width strings, which compare alike.
    """

    def __init__(self, texts: list[str], order: int):
        self.order = order
        known = np.zeros(0x110000, bool)
        known[[ord(BEGIN), ord(END)]] = True
        for some in slices(texts):
            known[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")] = True
        self.symbols = np.nonzero(known)[0].astype("<u4")
        self.number = np.zeros(0x110000, np.int64)
        self.number[self.symbols] = np.arange(len(self.symbols))
        self.narrow = len(self.symbols) ** order < 1 << 63

    def of(self, texts: list[str]) -> np.ndarray:
        """All windows of some texts, one text after the other; a text without words has none."""
        before = BEGIN * (self.order - 1)
        points = np.frombuffer("".join([before + t + END for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.zeros(0, np.int64 if self.narrow else f"<U{self.order}")
        ends = np.nonzero(points != ord(BEGIN))[0]
        if not self.narrow:
            wide = np.lib.stride_tricks.sliding_window_view(points, self.order)[ends - self.order + 1]
            return np.ascontiguousarray(wide).view(f"<U{self.order}").ravel()
        own, size = self.number[points], len(self.symbols)
        code = np.zeros(len(points) - self.order + 1, np.int64)
        for k in range(self.order):
            code *= size
            code += own[k : k + len(code)]
        return code[ends - self.order + 1]

    def strings(self, windows: np.ndarray) -> list[str]:
        """The n-grams that windows stand for."""
        if self.narrow:
            rest, columns = windows, []
            for _ in range(self.order):
                columns.append(self.symbols[rest % len(self.symbols)])
                rest = rest // len(self.symbols)
            joined = np.stack(columns[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            found = [joined[i : i + self.order] for i in range(0, len(joined), self.order)]
        else:
            found = [w.ljust(self.order, "\0") for w in windows.tolist()]
        return [BEGIN + g.lstrip(BEGIN) if g.startswith(BEGIN) else g for g in found]

    def distinct(self, texts: list[str]) -> np.ndarray:
        """The different windows of all texts, in order."""
        found = [np.unique(self.of(some)) for some in slices(texts)]
        return np.unique(np.concatenate(found)) if found else self.of([])


def slices(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """Texts in stretches of about so many code points, so that little is looked at together."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > most:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def counted(docs: DataFrame, order: int) -> DataFrame:
    """(gram, a): how often each n-gram occurs in documents (text). Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "a"])
            found.clear()
            return batch

        def count(texts: list[str]) -> None:
            own = Windows(texts, order)
            for some in slices(texts):
                windows, times = np.unique(own.of(some), return_counts=True)
                for g, n in zip(own.strings(windows), times.tolist()):
                    found[g] = found.get(g, 0) + n

        waiting: list[str] = []
        held = 0
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            waiting += [plain(x or "") for x in b.column(0).to_pylist()]
            held += sum(map(len, waiting[-b.num_rows :]))
            if held > SLICE:
                count(waiting)
                waiting, held = [], 0
                if len(found) > COUNTED:
                    yield out()
        count(waiting)
        yield out()
        released()

    return docs.select("text").mapInArrow(run, "gram string, a long").groupBy("gram").agg(F.sum("a").alias("a"))


def discounts(counted: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from how many n-grams have counts 1 to 4; usual values where there are none of a kind."""
    n1, n2, n3, n4 = (float(x or 0) for x in counted.agg(*[F.sum((F.col("a") == k).cast("long")) for k in range(1, 5)]).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = [k - (k + 1) * y * b / a if a and b else 0.5 + 0.25 * (k - 1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(out, 1))


def model(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Interpolated probabilities (gram, p) and back-off weights (context, weight) for each length from 1, and the number of symbols (an unseen one counts).

    counts: (gram, a) of the n-grams of trusted text, as grams() gives them. Shorter ones count the symbols seen before them,
    unless they begin a text, when nothing can stand before them.
    """
    by_length: list[DataFrame] = []
    longer = None
    for k in range(order, 0, -1):
        own = counts.where(F.length("gram") == k)
        if longer is not None:
            shorter = longer.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("a"))
            own = own.unionByName(shorter)  # no gram is in both: only those that begin a text are counted directly
        longer = cut(own.select("gram", F.col("a").cast("long")))
        by_length.insert(0, longer)
    symbols = by_length[0].count() + 1
    probabilities: list[DataFrame] = []
    contexts: list[DataFrame] = []
    for k, own in enumerate(by_length, 1):
        d1, d2, d3 = discounts(own)
        discount = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        rows = own.select("gram", F.expr("left(gram, length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("shorter"), "a", F.least("a", discount).alias("d"))
        total = cut(rows.groupBy("context").agg(F.sum("a").alias("total"), F.sum("d").alias("spared")).select("context", "total", (F.col("spared") / F.col("total")).alias("weight")))
        rows = rows.join(total, "context")
        if k == 1:
            rows = rows.withColumn("q", F.lit(1 / symbols))
        else:  # every n-gram's end is among the shorter ones
            rows = rows.join(probabilities[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter")
        probabilities.append(cut(rows.select("gram", ((F.col("a") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")).alias("p"))))
        contexts.append(total.select("context", "weight"))
    return probabilities, contexts, symbols


def scored(wanted: DataFrame, probabilities: list[DataFrame], contexts: list[DataFrame], symbols: int) -> DataFrame:
    """(gram, logp) for each distinct gram asked for: its own probability, or that of its longest seen end, weighted for each shortening.
    A lazy chain of joins with the model's tables, two for each length."""
    todo, order = wanted.select("gram"), len(probabilities)
    for k in range(order, 0, -1):
        end = F.when(F.length("gram") >= k, F.expr(f"right(gram, {k})"))
        todo = todo.join(probabilities[k - 1].select(F.col("gram").alias("e"), F.col("p").alias(f"p{k}")), end == F.col("e"), "left").drop("e")
        context = F.when(F.length("gram") >= k, F.expr(f"left(right(gram, {k}), {k - 1})"))
        todo = todo.join(contexts[k - 1].select(F.col("context").alias("c"), F.col("weight").alias(f"w{k}")), context == F.col("c"), "left").drop("c")
    weight, value = F.lit(1.0), F.lit(None).cast("double")
    for k in range(order, 0, -1):  # the weights of all lengths beyond the one that is found
        value = F.coalesce(value, F.log(weight * F.col(f"p{k}")))
        weight = weight * F.when(F.length("gram") >= k, F.coalesce(f"w{k}", F.lit(1.0))).otherwise(1.0)
    return todo.select("gram", F.coalesce(value, F.log(weight / F.lit(float(symbols)))).alias("logp"))


def blocked(docs: DataFrame, chars: int) -> DataFrame:
    """Documents (doc_id, text, tag, mark) in blocks of bounded size, as BLOCK: their plain texts, compressed together. A block's number
    tells the task and its order there, up to 2,047 blocks (24 GB of text) a task."""
    arrow = arrow_schema(docs.sparkSession, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        first, done, held = TaskContext.get().partitionId() << 11, 0, 0
        rows: list[tuple] = []
        texts: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal held
            if done >= 1 << 11:
                raise RuntimeError("a task has too much text to number its blocks")
            out = [first + done, *map(list, zip(*rows)), [len(t) for t in texts], zstandard.compress(b"".join(texts), 3)]
            rows.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(out, arrow)], schema=arrow)

        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            for doc, text, tag, mark in zip(*[b.column(i).to_pylist() for i in range(4)]):
                own = plain(text or "").encode("utf-8", "surrogatepass")
                if rows and held + len(own) > chars:
                    yield block()
                    done += 1
                rows.append((doc, tag, mark))
                texts.append(own)
                held += len(own)
        if rows:
            yield block()
        released()

    return docs.select("doc_id", "text", "tag", "mark").mapInArrow(run, BLOCK)


def opened(texts: bytes, sizes: list[int]) -> list[str]:
    """A block's plain texts."""
    raw, ends = zstandard.decompress(texts), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip([0, *ends], ends)]


def packed_values(answers: DataFrame) -> DataFrame:
    """(block, packed) for rows (place, logp): places and values of many together, a few rows a task and block."""
    schema = "block long, packed binary"
    arrow = arrow_schema(answers.sparkSession, schema)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        place, logp = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("place", "logp"))
        order = np.argsort(place)
        place, logp = place[order], logp[order]
        names, at = np.unique(place >> PLACE, return_index=True)
        rows = []
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(place)]):
            i = (place[a:z] & ((1 << PLACE) - 1)).astype("<u4")
            gaps = np.diff(i, prepend=i[:1]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append(int(i[0]).to_bytes(4, "little") + (z - a).to_bytes(4, "little") + zstandard.compress(gaps + logp[a:z].astype("<f8").tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= COUNTED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return answers.select("place", "logp").mapInArrow(run, schema)


def unpacked(rows: list[bytes], n: int) -> np.ndarray:
    """A block's n values by place; NaN where none came."""
    out = np.full(n, np.nan)
    for x in rows:
        first, k = int.from_bytes(x[:4], "little"), int.from_bytes(x[4:8], "little")
        raw = zstandard.decompress(x[8:])
        gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k).reshape(4, k).T).view("<u4").ravel()
        place = first + np.cumsum(gaps, dtype=np.int64)
        if len(place) and place[-1] >= n:
            raise RuntimeError("a block's n-grams changed when it was computed again")
        out[place] = np.frombuffer(raw, "<f8", k, 4 * k)
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, chars: int = CHARS) -> DataFrame:
    """(doc_id, lang, trusted int, n_symbols, perplexity) for each document (doc_id, text, lang), under a model of the trusted ones (doc_id).

    n-grams run on over single blanks between words. Trusted texts are counted where they are read. All texts become compressed
    blocks, dealt once; the different n-grams of each block meet the model's tables in joins by n-gram, and their values go back
    to the block, where documents are summed up. No words: perplexity 1 over no symbols. Nothing trusted: every symbol is
    equally unlikely.
    """
    spark = docs.sparkSession
    marks = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.lit(1).alias("mark")).distinct()
    if marks.count() <= BROADCAST:
        marks = F.broadcast(marks)
    marked = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").alias("tag")).join(marks, "doc_id", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    tables = model(cut(counted(marked.where("mark = 1"), order)), order)
    own = blocked(marked, chars).repartition("block")
    arrow = arrow_schema(spark, "place long, gram string")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for block, sizes, raw in zip(*[b.column(c).to_pylist() for c in ("block", "sizes", "texts")]):
                texts = opened(raw, sizes)
                windows = Windows(texts, order)
                found = windows.distinct(texts)
                if len(found) >= 1 << PLACE:
                    raise RuntimeError("a block has too many n-grams to number them")
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part)) + (block << PLACE), pa.int64()), pa.array(windows.strings(part), pa.string())], schema=arrow)
        released()

    # blocks are dealt once: both uses read all columns of the same exchange
    wanted = own.mapInArrow(distinct, "place long, gram string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram")
    answers = packed_values(wanted.join(scored(wanted.select("gram").distinct(), *tables), "gram"))
    schema = "doc_id long, lang string, trusted int, n_symbols long, perplexity double"
    out_arrow = arrow_schema(spark, schema)

    def total(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in blocks.select(["doc_ids", "tags", "marks", "sizes", "texts"]).to_pylist():
            texts = opened(row["texts"], row["sizes"])
            windows = Windows(texts, order)
            known = windows.distinct(texts)
            logp = unpacked(found.column("packed").to_pylist(), len(known))
            if np.isnan(logp).any():
                raise RuntimeError("a block's n-grams changed when it was computed again")
            sums: list[float] = []
            for some in slices(texts):
                each = logp[np.searchsorted(known, windows.of(some))]
                n = np.array([len(t) + 1 if t else 0 for t in some])
                ends = np.cumsum(n)
                sums += [float(each[z - k : z].sum()) for z, k in zip(ends.tolist(), n.tolist())]
            for doc, tag, mark, text, value in zip(row["doc_ids"], row["tags"], row["marks"], texts, sums):
                n = len(text) + 1 if text else 0
                out.append((doc, tag, mark, n, math.exp(-value / n) if n else 1.0))
        released()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), out_arrow)], schema=out_arrow) if out else out_arrow.empty_table()

    return own.withColumnRenamed("block", "home").groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(total, schema)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, keep) for each document.

    Trusted text is what labels (doc_id, quality) call good. The model is of most of it, and a language's threshold is a quantile
    of the perplexity of its rest, chosen by a hash of the id, as text looks likelier to a model that has seen it (a language
    without any takes that of all; too little trusted text to hold any out: all of it serves for both; none at all: nothing is
    rejected). Repeated rows stay; a null language is a language of its own; a null doc_id is never trusted. Texts of any length
    count as a whole; an empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").cast("long"))
    present = cut(docs.select(F.col("doc_id").cast("long"), F.length(F.trim(F.coalesce("text", F.lit("")))).alias("n")).where("n > 0").join(good, "doc_id", "left_semi").select("doc_id").distinct())
    held = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(HELD)) == 0
    sides = [present.where(~held), present.where(held)]
    if sides[0].isEmpty() or sides[1].isEmpty():
        sides = [present, present]
    found = cut(perplexities(docs, sides[0]))
    trusted = found.where("n_symbols > 0").join(sides[1], "doc_id", "left_semi")
    by_lang = trusted.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    every = trusted.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    every = every if every is not None else float("inf")
    out = found.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(every)))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).cast("int").alias("keep"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: see judged."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
