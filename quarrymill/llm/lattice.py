"""SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, released, table
from quarrymill.llm.blocks import packed_strings, strings

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Code points of a part whose bounds are one 64-bit mask; the bounds of longer parts are blocks of an array.
MASK = 62
#: Bits that an edge's code must at least have for its start: parts are shorter than two to this power.
START = 16
#: Documents in the sample whose most frequent parts are broadcast with their ids, and how many of these there are.
SAMPLE, COMMON = 8_000, 1 << 17
#: Code points of text in a block, but for a block of a single longer text; answers packed at once.
CHARS, PACKED = 6 << 20, 200_000
BLOCK = "block long, doc_ids array<long>, sizes array<long>, payload binary, lexicon binary, keys binary"
#: Bits of a key's place in its block.
PLACE = 24


class Pieces(NamedTuple):
    """A model's pieces by id, whether each is matched in text (normal) or a byte, and how words are folded: `merges` or `viterbi`."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_: list[int]
    fold: str
    prefix: bool


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: numbers, 4-byte floats as bytes, and nested bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes, fold: str | None = None) -> Pieces:
    """Pieces of a serialised model (field numbers as SentencePiece publishes them). Scores of a BPE model are ranks of
    merges, not log probabilities, so its words are folded by merges; a unigram model's by Viterbi. A model too large for an
    edge's code is refused."""
    pieces, scores, normal, bytes_, kind, prefix = [], [], [], [-1] * 256, 1, True
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: bytes(4), 3: 1} | dict(_fields(value))
            text = own[1].decode()
            if own[3] == 6:
                bytes_[int(text[3:5], 16)] = len(pieces)
            pieces.append(text)
            scores.append(float(np.frombuffer(own[2], "<f4")[0]))
            normal.append(own[3] in (1, 4))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            own = dict(_fields(value))
            prefix = bool(own.get(3, 1))
            if own.get(2) or own.get(4, 1):
                raise ValueError("only models that keep texts as they are, spaces too, can be read")
    own = Pieces(pieces, scores, normal, bytes_, fold or {1: "viterbi", 2: "merges"}[kind], prefix)
    layout(own)
    return own


@cache
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return read_model(f.read())


def known_pieces(model: Pieces) -> dict[str, tuple[float, int]]:
    """Pieces that are matched in text, with score and id."""
    return {p: (s, i) for i, (p, s, n) in enumerate(zip(model.pieces, model.scores, model.normal)) if n}


def unknown_score(model: Pieces) -> float:
    return min((s for s, n in zip(model.scores, model.normal) if n), default=0.0) - 10.0


class Layout(NamedTuple):
    """How an edge is one number: bits of rank, start, length, whether it can be late, and id, from high to low. Numbers are in order of
    rank, start and length. What is no piece has the greatest rank and id."""

    ids: int
    lengths: int

    @property
    def at_length(self) -> int:
        return self.ids + 1

    @property
    def at_start(self) -> int:
        return self.ids + 1 + self.lengths

    @property
    def at_rank(self) -> int:
        return 63 - self.ids

    @property
    def unknown(self) -> int:
        return (1 << self.ids) - 1

    def code(self, rank: int, length: int, late: bool, id_: int) -> int:
        return rank << self.at_rank | length << self.at_length | late << self.ids | id_

    def sql(self, x: str) -> dict[str, str]:
        """An edge's start, length, id and whether it is late, in SQL."""
        start = f"cast(shiftright({x}, {self.at_start}) & {(1 << self.at_rank - self.at_start) - 1} as int)"
        return {"s": start, "n": f"cast(shiftright({x}, {self.at_length}) & {(1 << self.lengths) - 1} as int)", "id": f"cast({x} & {self.unknown} as int)", "late": f"({x} & {1 << self.ids}) <> 0"}


def layout(model: Pieces) -> Layout:
    """Bits for a model; one too large to leave START bits for an edge's start is refused."""
    out = Layout((len(model.pieces) + 1).bit_length(), max(map(len, known_pieces(model)), default=1).bit_length())
    if out.at_rank - out.at_start < START:
        raise ValueError(f"a model of {len(model.pieces)} pieces is too large for an edge's code")
    return out


class Cutter:
    """Cuts text where no piece can span: between two neighbours that stand beside each other in no piece."""

    #: Code points whose pairs are looked up in a table; surrogates, which no text has, between words and parts.
    NEAR, WORD, PART = 1024, 0xD800, 0xD801

    def __init__(self, model: Pieces):
        self.known, self.prefix = known_pieces(model), model.prefix
        pairs = {(ord(p[i]), ord(p[i + 1])) for p in self.known for i in range(len(p) - 1)}
        self.table = np.zeros((self.NEAR, self.NEAR), bool)
        for a, b in pairs:
            if max(a, b) < self.NEAR:
                self.table[a, b] = True
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)

    def tokens(self, text: str) -> list[str]:
        """Runs of spaces with what follows them, the space written as its sign; no piece has a space after anything else."""
        if not text:
            return []
        return WORDS.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of some words, none empty, one after the other, and how many each word has."""
        if not words:
            return [], np.zeros(0, np.int64)
        code = np.frombuffer(chr(self.WORD).join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        a, b = code[:-1], code[1:]
        small = (a < self.NEAR) & (b < self.NEAR)
        together = np.zeros(len(a), bool)
        together[small] = self.table[a[small], b[small]]
        if len(self.pairs) and not small.all():
            both = a[~small].astype(np.int64) << 32 | b[~small]
            together[~small] = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both
        words_end = code == self.WORD
        cut = ~together & ~words_end[:-1] & ~words_end[1:]
        marked = np.insert(code, np.nonzero(cut)[0] + 1, self.PART)
        ends = marked == self.WORD
        size = np.diff(np.concatenate([[0], np.cumsum(marked == self.PART)[ends], [int(cut.sum())]])) + 1
        marked[ends] = self.PART
        return marked.tobytes().decode("utf-32-le", "surrogatepass").split(chr(self.PART)), size


def late(known: dict[str, tuple[float, int]]) -> set[str]:
    """Pieces that can become possible after their turn: one of their two parts ranks behind them, or can itself be late."""
    found: set[str] = set()
    for p in sorted(known, key=len):
        for i in range(1, len(p)):
            both = p[:i], p[i:]
            if all(len(x) == 1 or x in known for x in both) and any(len(x) > 1 and (x in found or known[x][0] <= known[p][0]) for x in both):
                found.add(p)
                break
    return found


def lattice(parts: DataFrame, vocabulary: DataFrame, longest: int, edge: str) -> DataFrame:
    """(part, edges array): every piece in every part, and a row of its own for each character that is no piece, as `edge` writes
    it (over s and n, start and length, and the vocabulary's columns), in order.

    Substrings of bounded length are exploded and joined with the pieces by equality; grouping by part needs no shuffle where
    parts are dealt by part.
    """
    at = parts.select("part", F.explode(F.expr("sequence(0, char_length(part) - 1)")).alias("s"))
    each = at.select("part", "s", F.explode(F.expr(f"sequence(1, least({longest}, char_length(part) - s))")).alias("n"))
    each = each.select("part", "s", "n", F.expr("substring(part, s + 1, n)").alias("piece"))
    found = each.join(vocabulary, "piece", "left").where("code is not null or n = 1")
    return found.groupBy("part").agg(F.sort_array(F.collect_list(F.expr(edge))).alias("edges"))


def bound(name: str, value: str, body: str) -> str:
    """SQL of a body in which a name stands for a value that is computed once; the optimizer would copy a column's definition into the body's lambdas."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def merged_short(own: Layout) -> str:
    """SQL of the path, array<struct<s,id>>, of a part of at most MASK code points over its edges, folded by merges.

    Bounds between symbols are bits of a mask. One pass in order of rank, then start: an edge merges if its two ends are bounds
    and one bound is between. A merge that makes edges possible whose turn is over is followed by these, the best first.
    """
    x = own.sql("x")
    inner, ends = f"shiftleft(shiftleft(1L, {x['n']}) - 2, {x['s']})", f"shiftleft(shiftleft(1L, {x['n']}) | 1L, {x['s']})"
    fits = f"(m & {ends}) = {ends} and bit_count(m & {inner}) = 1"
    possible = "y.x < x and (q & y.ends) = y.ends and bit_count(q & y.inner) = 1"
    after = f"aggregate(sequence(1, size(lates)), m & ~{inner}, (q, i) -> q & ~coalesce(get(filter(lates, y -> {possible}), 0).inner, 0L))"
    merge = f"if(exists(lates, y -> {possible.replace('q &', f'(m & ~{inner}) &')}), {after}, m & ~{inner})"
    begin = "shiftleft(1L, char_length(part) + 1) - 1"
    fold = f"aggregate(filter(edges, x -> {x['n']} > 1), {{0}}, (m, x) -> if({{1}}, {{2}}, m))"
    folded = f"if(size(lates) = 0, {fold.format(begin, fits, f'm & ~{inner}')}, {fold.format(begin, fits, merge)})"
    lates = f"transform(filter(edges, x -> {x['late']}), x -> named_struct('x', x, 'inner', {inner}, 'ends', {ends}))"
    last = f"filter(edges, x -> (m & {ends}) = {ends} and (m & {inner}) = 0)"
    path = f"transform(sort_array(transform({last}, x -> shiftleft(cast({x['s']} as bigint), {own.ids}) | (x & {own.unknown}))), x -> named_struct('s', cast(shiftright(x, {own.ids}) as int), 'id', {x['id']}))"
    return bound("m", bound("lates", lates, folded), path)


def merged_wide(own: Layout) -> str:
    """The same for parts of any length. `m` has for each symbol's start where it ends, and 0 elsewhere, in blocks, so that a merge
    writes one block or two; late edges are in blocks as well, of which a merge looks at three."""
    longest = (1 << own.lengths) - 1
    wide = max(64, longest)
    to = f"get(get(m, {{0}} div {wide}), ({{0}}) % {wide})"  # where the symbol that starts there ends

    def fits(x: str, m: str) -> str:
        first = to.replace("get(m,", f"get({m},").format(f"{x}.s")
        return f"{first} > {x}.s and {first} < {x}.s + {x}.n and {to.replace('get(m,', f'get({m},').format(first)} = {x}.s + {x}.n"

    def merge(x: str, m: str) -> str:
        at = f"(b * {wide} + i)"
        return f"""transform({m}, (own, b) -> if(b between {x}.s div {wide} and ({x}.s + {x}.n - 1) div {wide},
            transform(own, (v, i) -> if({at} = {x}.s, {x}.s + {x}.n, if({at} > {x}.s and {at} < {x}.s + {x}.n, 0, v))), own))"""

    near = f"flatten(slice(lates, greatest(x.s div {wide}, 1), 3))"
    # whatever a merge makes possible spans it
    ready = f"filter({near}, y -> y.s <= x.s and y.s + y.n >= x.s + x.n and y.x < x.x and {fits('y', 'a.m')})"
    step = f"aggregate(array(array_min({ready})), a, (r, y) -> if(y is null, named_struct('m', r.m, 'more', false), named_struct('m', {merge('y', 'r.m')}, 'more', true)))"
    after = f"aggregate(sequence(1, {longest}), named_struct('m', {merge('x', 'm')}, 'more', true), (a, k) -> if(a.more, {step}, a), a -> a.m)"
    blocks = f"sequence(0, char_length(part) div {wide})"
    begin = f"transform({blocks}, b -> transform(sequence(0, {wide - 1}), i -> cast(b * {wide} + i + 1 as int)))"
    folded = f"aggregate(filter(opened, x -> x.n > 1), {begin}, (m, x) -> if({fits('x', 'm')}, {after}, m))"
    lates = bound("w", "filter(opened, x -> x.late)", f"transform({blocks}, b -> filter(w, y -> y.s div {wide} = b))")
    last = f"filter(opened, x -> {to.format('x.s')} = x.s + x.n)"
    path = f"sort_array(transform({last}, x -> named_struct('s', x.s, 'id', x.id)))"
    fields = own.sql("x")
    opened = f"transform(edges, x -> named_struct('x', x, 's', {fields['s']}, 'n', {fields['n']}, 'late', {fields['late']}, 'id', {fields['id']}))"
    return bound("opened", opened, bound("m", bound("lates", lates, folded), path))


def merged(parts: DataFrame, vocabulary: DataFrame, own: Layout, longest: int, mask: int = MASK) -> DataFrame:
    """(part, path array<struct<s,id>>) of parts, folded by merges. vocabulary: (piece, code)."""
    edge = f"coalesce(code, {own.code(own.unknown, 1, False, own.unknown)}L) | shiftleft(cast(s as bigint), {own.at_start})"
    short = parts.select("part", F.assert_true(F.char_length("part") < 1 << own.at_rank - own.at_start, "a part is too long for an edge's code").alias("_")).where("_ is null").select("part")
    path = f"if(char_length(part) <= {mask}, {merged_short(own)}, {merged_wide(own)})"
    return lattice(short, vocabulary, longest, edge).select("part", F.expr(path).alias("path"))


def best_path(parts: DataFrame, vocabulary: DataFrame, own: Layout, longest: int, unknown: float) -> DataFrame:
    """(part, path array<struct<s,id>>) of parts of any length, folded by Viterbi: edges in order of their end, then start; each
    place keeps the best sum of scores that reaches it, from the least start among equals. vocabulary: (piece, code, score)."""
    edge = f"named_struct('e', s + n, 's', s, 'score', coalesce(score, {unknown}D), 'id', cast(coalesce(code, {own.unknown}L) & {own.unknown} as int))"
    value = "(if(x.e = a.e, get(a.v, x.s), if(x.s = a.e, a.best, get(a.v, x.s))) + x.score)"
    step = f"""aggregate(edges, named_struct('e', 0, 'best', 0D, 's', 0, 'id', 0, 'v', cast(array() as array<double>), 'back', cast(array() as array<struct<s:int,id:int>>)),
        (a, x) -> if(x.e = a.e,
            if({value} > a.best, named_struct('e', a.e, 'best', {value}, 's', x.s, 'id', x.id, 'v', a.v, 'back', a.back), a),
            named_struct('e', x.e, 'best', {value}, 's', x.s, 'id', x.id, 'v', array_append(a.v, a.best), 'back', array_append(a.back, named_struct('s', a.s, 'id', a.id)))),
        a -> array_append(a.back, named_struct('s', a.s, 'id', a.id)))"""
    walk = """aggregate(sequence(1, char_length(part)), named_struct('at', char_length(part), 'path', cast(array() as array<struct<s:int,id:int>>)),
        (a, i) -> if(a.at = 0, a, named_struct('at', get(back, a.at).s, 'path', array_append(a.path, get(back, a.at)))), a -> reverse(a.path))"""
    return lattice(parts, vocabulary, longest, edge).select("part", F.expr(bound("back", step, walk)).alias("path"))


def encoded_parts(parts: DataFrame, model: Pieces) -> DataFrame:
    """(part, ids array<int>) for the distinct ones of parts of text, none empty, dealt by part as the parts are. Parts of any length
    take the same lattice."""
    score, own = known_pieces(model), layout(model)
    place = {s: k for k, s in enumerate(sorted({s for s, _ in score.values()}, reverse=True))}
    merges, longest = model.fold == "merges", max(map(len, score), default=1)
    tardy = late(score) if merges else set()
    rows = [(p, own.code(place[s], len(p), p in tardy, i), s) for p, (s, i) in score.items()]
    vocabulary = F.broadcast(parts.sparkSession.createDataFrame(rows, "piece string, code long, score double"))  # as large as the model's file
    parts = parts.select("part").distinct()
    paths = merged(parts, vocabulary.select("piece", "code"), own, longest) if merges else best_path(parts, vocabulary, own, longest, unknown_score(model))
    # a character that is no piece falls back to its bytes
    byte_ids = "array(" + ", ".join(map(str, model.bytes_)) + ")"
    spelled = f"transform(filter(split(regexp_replace(hex(encode(substring(part, x.s + 1, 1), 'utf-8')), '(..)', '$1,'), ','), h -> h <> ''), h -> get({byte_ids}, cast(conv(h, 16, 10) as int)))"
    ids = f"if(exists(path, x -> x.id = {own.unknown}), flatten(transform(path, x -> if(x.id = {own.unknown}, {spelled}, array(x.id)))), path.id)"
    return paths.select("part", F.expr(bound("path", "path", ids)).alias("ids"))


def decode(ids: np.ndarray, table_: list[bytes], prefix: bool) -> str:
    """Text of ids: pieces and bytes joined, space signs as spaces, the first one dropped if the model puts it there."""
    text = b"".join(map(table_.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if prefix and text[:1] == " " else text


def byte_table(model: Pieces) -> list[bytes]:
    """What each id stands for in a decoded text; control pieces for nothing."""
    out = [p.encode() if n else b"" for p, n in zip(model.pieces, model.normal)]
    for value, i in enumerate(model.bytes_):
        if i >= 0:
            out[i] = bytes([value])
    return out


def common_parts(docs: DataFrame, cutter: Cutter, n: int, sample: int = SAMPLE, most: int = COMMON) -> DataFrame:
    """(part, n): the most frequent parts of about `sample` documents of n chosen by a hash of their id (all, if there are fewer)."""
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(max(1, n))) < sample).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            parts: Counter[str] = Counter()
            found, size = cutter.parts(list(words))
            for p, times in zip(found, np.repeat(np.fromiter(words.values(), np.int64, len(words)), size).tolist()):
                parts[p] += times
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.string()), pa.array(parts.values(), pa.int64())], ["part", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                words.update(cutter.tokens(text or ""))
                if len(words) > 100_000:
                    yield out()
        yield out()
        released()

    counted = some.mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "part").limit(most)


_LAST: list = [None, {}]


def _numbers(common: Broadcast) -> dict[str, int]:
    """The broadcast parts' numbers, the commonest first; built once a worker."""
    if _LAST[0] != id(common.value):
        _LAST[:] = [id(common.value), {p: i for i, p in enumerate(common.value.column("part").to_pylist())}]
    return _LAST[1]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    whole = pa.chunked_array(lists.chunks, pa.list_(pa.int32())).combine_chunks() if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    whole = whole if isinstance(whole, pa.ListArray) else pa.concat_arrays(whole.chunks)
    return whole.offsets.to_numpy().astype(np.int64), whole.values.to_numpy()


def _squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32, bytes of equal weight together."""
    sizes = np.array([len(columns), *map(len, columns)], "<u4").tobytes()
    return sizes + zstandard.compress(b"".join(np.asarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 3)


def _opened(data: bytes) -> list[np.ndarray]:
    k = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u4", k, 4).astype(np.int64)
    raw, at, out = zstandard.decompress(data[4 + 4 * k :]), 0, []
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of a flat array that `which` names, one after the other."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - ends + n, n) + np.arange(int(ends[-1]))] if len(n) and ends[-1] else flat[:0]


def _check(keys: list[str]) -> int:
    """A sum over keys and their places, so that a block that came out otherwise when a lost task ran again is noticed."""
    return sum((i + 1) * zlib.crc32(k.encode()) for i, k in enumerate(keys)) & ((1 << 62) - 1)


class Words(dict):
    """A block's words to their numbers, as bytes, in order of their first occurrence, with their parts' numbers: those of common
    parts first, then the block's own. Words are cut into parts many at a time."""

    def __init__(self, cutter: Cutter, common: dict[str, int]):
        self.cutter, self.common = cutter, common
        self.own: dict[str, int] = {}
        self.new: list[str] = []
        self.numbers: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def __missing__(self, word: str) -> bytes:
        self[word] = data = len(self).to_bytes(4, "little")
        self.new.append(word)
        return data

    def learn(self) -> None:
        parts, size = self.cutter.parts(self.new)
        numbers = list(map(self.common.get, parts))
        first, own = len(self.common), self.own
        for i in [i for i, n in enumerate(numbers) if n is None]:
            numbers[i] = first + own.setdefault(parts[i], len(own))
        self.numbers.append(np.array(numbers, "<u4"))
        self.sizes.append(size.astype("<u4"))
        self.new.clear()


def word_blocks(docs: DataFrame, cutter: Cutter, common: Broadcast, chars: int) -> DataFrame:
    """Documents (doc_id, text) in blocks of bounded size: their words by number, the words' parts, and as keys the parts that are
    not common, each once a block. A block's number tells the task and its order there, up to 8,191 blocks (48 GB of text) a task."""
    arrow = arrow_schema(docs.sparkSession, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, numbers = TaskContext.get().partitionId() << 13, 0, _numbers(common)
        words, held = Words(cutter, numbers), 0
        ids: list[int | None] = []
        rows: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal words, held
            words.learn()
            if done >= 1 << 13 or len(words.own) >= 1 << PLACE:
                raise RuntimeError("a task has too much text, or a block too many parts, to number them")
            sizes = [len(r) // 4 for r in rows]
            out = [first + done, ids, sizes, _squeezed(np.frombuffer(b"".join(rows), "<u4")), _squeezed(np.concatenate(words.sizes), np.concatenate(words.numbers)), packed_strings(list(words.own))]
            row = pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(out, arrow)], schema=arrow)
            words, held = Words(cutter, numbers), 0
            ids.clear()
            rows.clear()
            return row

        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                if ids and held + len(text) > chars:
                    yield block()
                    done += 1
                ids.append(doc)
                rows.append(b"".join(map(words.__getitem__, cutter.tokens(text))))
                held += len(text)
                if len(words.new) > 50_000:
                    words.learn()
        if ids:
            yield block()
        released()

    return docs.mapInArrow(run, BLOCK)


def packed_answers(answers: DataFrame) -> DataFrame:
    """(block, n, sum, packed) for rows (place, crc, ids): a few rows a task and block, of a fraction of the size."""
    schema = "block long, n long, sum long, packed binary"
    arrow = arrow_schema(answers.sparkSession, schema)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        place, crc = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("place", "crc"))
        block, i = place >> PLACE, place & ((1 << PLACE) - 1)
        offsets, flat = _flat(pa.chunked_array([b.column("ids") for b in held]))
        order = np.lexsort((i, block))
        names, at = np.unique(block[order], return_index=True)
        rows = []
        for name, a, z in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            own = order[a:z]
            size = np.diff(offsets)
            total = sum((x + 1) * y for x, y in zip(i[own].tolist(), crc[own].tolist())) & ((1 << 62) - 1)
            rows.append((name, len(own), total, _squeezed(i[own], size[own], _gathered(flat, offsets[:-1], size, own))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)
        released()

    return answers.select("place", "crc", "ids").mapInArrow(run, schema)


def encoded(docs: DataFrame, model: Pieces, chars: int = CHARS, sample: int = SAMPLE, most: int = COMMON) -> DataFrame:
    """(doc_id, ids array<int>) for each document (doc_id, text): what SentencePiece gives under the model.

    Texts are cut into parts that no piece spans, and each different part is encoded once, over the lattice. The most
    frequent parts, a bounded number, are encoded first and broadcast; every other part is looked up once by each block of
    documents, by a join, so words of texts are never shuffled, only dictionaries and numbers.

    Null and empty texts have no ids. Repeated rows stay, and so do ties: rows with one doc_id keep their own ids. An empty
    table gives no rows. Very long texts are blocks of their own; a part of n code points that no cut divides costs in the order of
    n squared over 64. Columns other than doc_id and text are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    cutter = Cutter(model)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, size = docs.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    first = common_parts(docs, cutter, n, sample, most).repartition(max(1, most >> 13), "part")
    common = spark.sparkContext.broadcast(first.join(encoded_parts(first.select("part"), model), "part").orderBy(F.desc("n"), "part").select("part", "ids").toArrow())
    own = word_blocks(docs, cutter, common, chars).repartition("block")
    key_schema = arrow_schema(spark, "place long, part string")

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys in zip(b.column("block").to_pylist(), b.column("keys").to_pylist()):
                parts = strings(keys)
                for i in range(0, len(parts), 10_000):
                    places = np.arange(i, min(i + 10_000, len(parts))) + (block << PLACE)
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(parts[i : i + 10_000], pa.string())], schema=key_schema)

    # blocks are dealt once: both uses read all columns of the same exchange. Parts are dealt for about 20,000 of them a task, over
    # as many tasks as joins use, or these would deal them again
    wanted = own.mapInArrow(only_keys, "place long, part string").where("part is not null").repartition(max(1 + (size or 0) // (8 << 20), int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    # so are parts: a place, which is never null, goes along, or the different ones would be dealt once more without places
    different = wanted.groupBy("part").agg(F.first("place").alias("place")).where("place is not null")
    found = wanted.join(encoded_parts(different, model).hint("shuffle_hash"), "part")
    answers = packed_answers(found.withColumn("crc", F.crc32(F.col("part").cast("binary"))))
    arrow = arrow_schema(spark, "doc_id long, ids array<int>")

    def assemble(texts: pa.Table, found: pa.Table) -> pa.Table:
        offsets, first_flat = _flat(common.value.column("ids"))
        out: list[pa.RecordBatch] = []
        for row in range(texts.num_rows):
            doc_ids, sizes, payload, lexicon, keys = (texts.column(c)[row].as_py() for c in ("doc_ids", "sizes", "payload", "lexicon", "keys"))
            keys = strings(keys)
            if sum(found.column("n").to_pylist()) != len(keys) or sum(found.column("sum").to_pylist()) & ((1 << 62) - 1) != _check(keys):
                raise RuntimeError("a block's parts changed when it was computed again")
            answers_ = [_opened(x) for x in found.column("packed").to_pylist()]
            i, size_, flat = (np.concatenate([a[k] for a in answers_]).astype(np.int64) if answers_ else np.zeros(0, np.int64) for k in range(3))
            order = np.argsort(i)
            # ids of the common parts, then of the block's own; of its words; of its documents
            part_start = np.concatenate([offsets[:-1], (np.cumsum(size_) - size_)[order] + len(first_flat)])
            part_size = np.concatenate([np.diff(offsets), size_[order]])
            per_word, parts = _opened(lexicon)
            ends = np.concatenate([[0], np.cumsum(part_size[parts])])[np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])]
            word_flat = _gathered(np.concatenate([first_flat, flat.astype(np.int32)]), part_start, part_size, parts)
            number = _opened(payload)[0]
            at = 0
            for k in range(0, len(doc_ids), 256):
                bounds = np.concatenate([[0], np.cumsum(sizes[k : k + 256])]).astype(np.int64)
                words = number[at : at + bounds[-1]]
                at += int(bounds[-1])
                flat_ids = _gathered(word_flat, ends[:-1], np.diff(ends), words)
                upto = np.concatenate([[0], np.cumsum(np.diff(ends)[words])])[bounds].astype(np.int32)
                out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + 256], pa.int64()), pa.ListArray.from_arrays(pa.array(upto), pa.array(flat_ids, pa.int32()))], schema=arrow))
        released()
        return pa.Table.from_batches(out, schema=arrow)

    return own.withColumnRenamed("block", "home").groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: Pieces) -> DataFrame:
    """(doc_id, ids, text) for rows of (doc_id, ids); null ids give a null text."""
    arrow = arrow_schema(ids.sparkSession, "doc_id long, ids array<int>, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_table(model)
        for b in batches:
            texts = [None if not x.is_valid else decode(x.values.to_numpy(), known, model.prefix) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], schema=arrow)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their ids, and size and check sum of the text that decoding these gives back."""
    import public_tokenizers

    model = load(public_tokenizers.path("piece_bpe_32k.model"))
    back = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return back.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.octet_length("text").cast("long").alias("decoded_bytes"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))
