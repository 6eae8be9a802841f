"""Personal data: patterns, and a skip-chain conditional random field that keeps labels alike across a document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, released, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive and from the start of a run of digits: the same matches as without, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may be personal data although no pattern holds: digit groups, and addresses spelled out. Possessive, so in linear time.
DIGITS = re.compile(r"(?<![0-9A-Za-z.])\+?\(?[0-9](?:[ ().\-]{0,3}[0-9])*+")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++) ?(?:\(at\)|\[at\]|\{at\}| at ) ?([A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]++)++)", re.I)
DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?", re.I)
CONTEXT = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|schreib|écri|escrib", r"\bip\b|host|server|address", r"card|visa|karte|carte|tarjeta|pay", r"phone|call|tel|fon|fax|llam|appel"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, kind by kind, leftmost and not overlapping within a kind; a match that fails its test is dropped."""
    spans: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            spans.append((0, start, floor))
        at = text.find("@", floor)
    if any(c in text for c in "0123456789"):
        spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                spans.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def soft_spans(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Other candidates, which overlap no base span."""
    found = [(m.start(), m.end()) for m in DIGITS.finditer(text) if sum(c.isdigit() for c in m[0]) >= 8 and not (text[m.end() : m.end() + 1].isascii() and text[m.end() : m.end() + 1].isalnum())]
    if "at" in text or "AT" in text or "At" in text:
        found += [(m.start(), m.end()) for m in SPELLED.finditer(text) if "(" in m[0] or "[" in m[0] or "{" in m[0] or re.search(r" at .* dot ", m[0], re.I)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    kept, end = [], -1
    for s, e in sorted(found):
        k = int(np.searchsorted(starts, e))
        if s >= end and not any(e2 > s for _, e2 in taken[max(0, k - len(KINDS)) : k]):
            kept.append((s, e))
            end = e
    return kept


def normal(token: str) -> str:
    """What repeated mentions of one thing have in common: digits only, or the address in lower case with signs restored."""
    if "@" not in token and (m := SPELLED.fullmatch(token)):
        return f"{m[1]}@{DOT.sub('.', m[2])}".lower()
    return token.lower() if "@" in token else re.sub("[^0-9]", "", token) if not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", token) else token


def features(text: str, start: int, end: int) -> list[float]:
    """What a token's own shape and its neighbourhood say; ones and zeros."""
    token = text[start:end]
    digits = re.sub("[^0-9]", "", token)
    parts = token.split(".")
    before = text[max(0, start - 32) : start]
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    return [
        1.0, "@" in token, bool(SPELLED.fullmatch(token)), token[:1] == "+", quad, quad and all(int(p[-4:]) <= 255 and len(p) < 4 for p in parts),
        16 <= len(digits) <= 19, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15, "(" in token, " " in token, "-" in token,
        *[bool(p.search(before)) for p in CONTEXT],
    ]


#: Features of a token's own shape, which training hides in a copy of each row, so that what its neighbours and like tokens say is learned.
SHAPE = slice(1, 12)


def alike(name: str) -> str:
    """What similar names share: the last nine digits of a number, an address before its @; empty if too short to tell."""
    key = "d" + name[-9:] if name.isdigit() else "m" + name.partition("@")[0] if "@" in name else ""
    return key if len(key) > 4 else ""


def votes(labels: list[int], names: list[str]) -> list[tuple[int, int]]:
    """For each token the commonest label of other tokens of its name, and of tokens of similar names (-1: there are none)."""
    width = len(KINDS) + 1
    by_name: dict[str, list[int]] = {}
    by_key: dict[str, list[int]] = {}
    for y, name in zip(labels, names):
        by_name.setdefault(name, [0] * width)[y] += 1
        by_key.setdefault(alike(name), [0] * width)[y] += 1

    def most(count: list[int]) -> int:
        return max(range(width), key=count.__getitem__) if any(count) else -1

    out = []
    for y, name in zip(labels, names):
        equal = by_name[name].copy()
        similar = [a - b for a, b in zip(by_key[alike(name)], equal)] if alike(name) else [0] * width
        equal[y] -= 1
        out.append((most(equal), most(similar)))
    return out


def halved(strength: float) -> float:
    """How strongly two links in a row must draw so that their ends draw each other with a given strength."""
    low, high = 0.0, strength + 4.0
    for _ in range(60):
        b = (low + high) / 2
        n = len(KINDS) + 1
        through = np.log((np.exp(2 * b) + n - 1) / (2 * np.exp(b) + n - 2))
        low, high = (b, high) if through < strength else (low, b)
    return (low + high) / 2


class Field:
    """Weights of single tokens by label (O and the kinds), of neighbouring labels, and how strongly equal and similar tokens of
    a document draw each other to one label; all learned together."""

    def __init__(self, single: np.ndarray, chain: np.ndarray, equal: float, similar: float):
        self.single, self.chain, self.equal, self.similar = single, chain, equal, similar

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, around: np.ndarray, weight: np.ndarray, steps: int = 500) -> Field:
        """Weights by pseudo-likelihood: each token's label given its features and the labels around it, which are those of the
        token before, the token after (0 where there is none), equal ones and similar ones (-1 where there are none).
        Without rows nothing is ever added."""
        labels = len(KINDS) + 1
        w, chain, skips = np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros(2)
        if not len(x):
            w[0, 0] = 4.0
            return Field(w, chain, 0.0, 0.0)
        hidden = x.copy()
        hidden[:, SHAPE] = 0
        x, y, around, weight = np.concatenate([x, hidden]), np.tile(y, 2), np.tile(around, (2, 1)), np.tile(weight / weight.sum() / 2, 2)
        truth, rows = np.eye(labels)[y], np.arange(len(x))
        said = [np.where((around[:, j] >= 0)[:, None], np.eye(labels)[around[:, j]], 0.0) for j in (2, 3)]
        squares = [np.zeros_like(v) for v in (w, chain, skips)]
        for _ in range(steps):
            z = x @ w + chain[around[:, 0]] + chain.T[around[:, 1]] + skips[0] * said[0] + skips[1] * said[1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - truth) * weight[:, None]
            by_chain = np.zeros_like(chain)
            np.add.at(by_chain, around[rows, 0], off)
            np.add.at(by_chain.T, around[rows, 1], off)
            slopes = (x.T @ off + 1e-4 * w, by_chain + 1e-3 * chain, np.array([(off * s).sum() for s in said]) + 1e-4 * skips)
            for value, slope, square in zip((w, chain, skips), slopes, squares):  # steps of a size that each weight's own slopes tell
                square += slope**2
                value -= 0.3 * slope / np.sqrt(square + 1e-12)
        return Field(w, chain, max(0.0, float(skips[0])), max(0.0, float(skips[1])))

    def graph(self, x: np.ndarray, known: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Log potentials of nodes and of links (node, node, labels x labels). Neighbours in the text are linked; equal names all
        link to a node of their own and similar names link those, so that links grow with the tokens, not their pairs."""
        n, labels = len(x), self.single.shape[1]
        groups = {name: n + k for k, name in enumerate(dict.fromkeys(names))}
        unary = np.zeros((n + len(groups), labels))
        unary[:n] = x @ self.single
        unary[0] += self.chain[0]  # text begins and ends with tokens of no kind
        unary[n - 1] += self.chain[:, 0]
        fixed = np.nonzero(known >= 0)[0]
        unary[fixed] = -60.0
        unary[fixed, known[fixed]] = 0.0
        agree = np.eye(labels)
        links = [(i, i + 1, self.chain) for i in range(n - 1)] + [(i, groups[name], halved(self.equal) * agree) for i, name in enumerate(names)]
        last: dict[str, str] = {}
        for name in groups:
            if key := alike(name):
                if key in last:
                    links.append((groups[last[key]], groups[name], self.similar * agree))
                last[key] = name
        return unary, links

    def label(self, x: np.ndarray, known: np.ndarray, names: list[str], rounds: int = 50) -> np.ndarray:
        """Beliefs by loopy sum-product messages; exact where links make no loop. known: a token's certain label, or -1."""
        n, labels = len(x), self.single.shape[1]
        unary, links = self.graph(x, known, names)
        a = np.array([e[0] for e in links] + [e[1] for e in links])
        b = np.array([e[1] for e in links] + [e[0] for e in links])
        pair = np.array([e[2] for e in links] + [e[2].T for e in links])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        messages = np.zeros((len(a), labels))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, b, messages)
            out = (belief[a] - messages[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-6:
                break
            messages = 0.5 * messages + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, b, messages)
        p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def nodes(text: str) -> tuple[list[Span], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Base spans, soft candidates, and both in text order with their label so far (-1: open)."""
    base = base_spans(text)
    soft = soft_spans(text, base)
    return base, soft, sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, -1) for s, e in soft])


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: with the candidates to which the field gives a kind with a belief over one half."""
    base, soft, order = nodes(text)
    if not soft:
        return base, base
    x = np.array([features(text, s, e) for s, e, _ in order], float)
    p = field.label(x, np.array([k for _, _, k in order]), [normal(text[s:e]) for s, e, _ in order])
    more = [(int(q.argmax()) - 1, s, e) for (s, e, k), q in zip(order, p) if k < 0 and q.argmax() > 0 and q.max() > 0.5]
    return base, sorted([*base, *more])


def lessons(text: str) -> Iterator[tuple[int, ...]]:
    """A row for each token of a text: label, labels before and after, votes of equal and similar tokens, features. What the
    patterns find has their kind; another candidate has the kind of a find of its name, or of a similar one, in the same text, else none."""
    order = nodes(text)[2]
    names = [normal(text[s:e]) for s, e, _ in order]
    kinds = {name: k for (_, _, k), name in zip(order, names) if k > 0}
    like = {alike(name): k for name, k in kinds.items() if alike(name)}
    labels = [k if k > 0 else kinds.get(name, like.get(alike(name), 0)) for (_, _, k), name in zip(order, names)]
    for i, ((s, e, _), vote) in enumerate(zip(order, votes(labels, names))):
        yield labels[i], labels[i - 1] if i else 0, labels[i + 1] if i + 1 < len(order) else 0, *vote, *map(int, features(text, s, e))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> Field:
    """A field fitted on the tokens of about `sample` documents (chosen by a hash of their id; all, if there are fewer), labelled
    as lessons() says. Null and empty texts teach nothing; of an empty table comes a field that never adds anything."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.lit(6), F.col(id_col)), F.lit(max(1, n))) < sample).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, ...], int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for row in lessons(text or ""):
                    seen[row] = seen.get(row, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())], ["row", "n"])

    # distinct rows of small numbers with their counts: bounded by what they can say, not by the documents
    found = some.mapInArrow(run, "row array<int>, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").collect()
    rows = np.array([r.row for r in found], int).reshape(-1, 5 + len(features("", 0, 0)))
    return Field.fit(rows[:, 5:].astype(float), rows[:, 0], rows[:, 1:5], np.array([r.n for r in found], float))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def found(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and masked text if asked for). Counts are of base spans.

    A null text is empty and has no spans; texts of any length are read whole; repeated rows stay; an empty table gives no rows;
    other columns than the two named are not read. Positions are code points, ends exclusive. In masked text each span (where they
    overlap, their union) gives way to its kind in angle brackets, a null text stays null.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * masked
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, every = all_spans(text or "", field)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), *([None if text is None else mask(text, every)] * masked)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs, whatever their names, with the text masked, and its length, where there is such a column,
    counted anew; a null text stays null."""
    schema, names = docs.schema, docs.columns
    arrow = arrow_schema(docs.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            texts = [None if t is None else mask(t, all_spans(t, field)[1]) for t in b.column(names.index(text_col)).to_pylist()]
            new = {text_col: pa.array(texts, pa.string()), length_col: pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n].cast(f.type) if n in new else b.column(i) for i, (n, f) in enumerate(zip(names, arrow))], schema=arrow)
        released()

    return docs.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: see found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found(docs, trained(docs))
