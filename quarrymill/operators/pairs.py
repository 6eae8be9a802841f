"""Completion pairs: functions found in code by its tokens, and cut into prefix and target."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of prompt and target, lines of a body, shares of the body that are shown, share of rows cut after the head.
BUDGET, BODY, SHOWN, HEADS = 9000, 6, (0.2, 0.6), 0.25
#: A definition whose head is one line that ends with its brace.
HEAD = re.compile(r"^([ \t]*)(?:(?:static|override)[ \t]+)?def(?::\w+)?[ \t]+\w+[ \t]*\(.*\)[^{\n]*\{[ \t]*$", re.M)
#: How a pair's prompt may ask.
WORDINGS = (
    "Finish the function that this source breaks off in. Answer with the rest of it and nothing else.",
    "The code below stops within a function. Write what comes next, up to the function's last brace, without what is there already.",
    "Write the missing end of this function. No fences, no copy of the lines shown.",
)
#: What braces are not counted in, and braces.
TOKEN = re.compile(r'''#\*.*?(?:\*#|\Z)|#[^\n]*|"""(?:\\.|(?!""").)*(?:"""|\Z)|\'\'\'(?:\\.|(?!\'\'\').)*(?:\'\'\'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|[{}]''', re.S)


class Function(NamedTuple):
    """Lines of a function's head and of its last brace, and for each line from the head on how many braces are open at its end
    (-1: it ends within a string or comment)."""

    head: int
    end: int
    depths: list[int]


def scanned(code: str, start: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """(index after the brace that closes the first one from `start` on, or -1; (index, depth) of its braces; spans of strings and comments)."""
    depth, braces, closed = 0, [], []
    for m in TOKEN.finditer(code, start):
        if m[0] not in "{}":
            closed.append(m.span())
            continue
        depth += 1 if m[0] == "{" else -1
        braces.append((m.start(), depth))
        if depth <= 0:
            return (m.end() if depth == 0 else -1), braces, closed
    return -1, braces, closed


def closing(code: str, start: int) -> int:
    """Index after the brace that closes the first one at or after `start`; -1 if none does. Braces in strings and comments don't count."""
    return scanned(code, start)[0]


def functions(code: str) -> list[Function]:
    """Functions with a head of one line, a last brace that stands alone at the head's indent, and a body of BODY lines or more."""
    lines = code.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    out = []
    for m in HEAD.finditer(code):
        end, braces, closed = scanned(code, m.start())
        head, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, end - 1) - 1
        if end < 0 or lines[last].rstrip() != m[1] + "}" or last - head <= BODY:
            continue
        at, depths, opened = [i for i, _ in braces], [], [a for a, _ in closed]
        for k in range(head, last + 1):
            eol = starts[k + 1] - 1
            k_closed, known = bisect_right(opened, eol) - 1, bisect_right(at, eol)
            depths.append(-1 if k_closed >= 0 and eol < closed[k_closed][1] else braces[known - 1][1] if known else 0)
        out.append(Function(head, last, depths))
    return out


def unit(code: str, name: str) -> str:
    """B37 (from prose): the whole of a named definition; empty if there is none."""
    m = re.search(rf"\b(?:def|can|walker|node|obj|edge)[ \t]+{re.escape(name)}\b[^{{;]*\{{", code)
    end = closing(code, m.end() - 1) if m else -1
    return code[m.start() : end] if m and end > 0 else ""


def draw(key: str, salt: str) -> float:
    return int(hashlib.md5(f"{salt}:{key}".encode()).hexdigest()[:12], 16) / (1 << 48)


class Pair(NamedTuple):
    prompt: str
    prefix: str
    target: str
    cut_frac: float
    after_head: bool
    open_block: bool
    prefix_lines: int
    target_lines: int


def cut(key: str, code: str, wordings: tuple[str, ...] = WORDINGS) -> Pair | None:
    """One pair of a code: its functions are tried in an order drawn from the key, until one gives prompt and target
    within the budget.

    A quarter of the rows are cut right after the head's brace (if nothing follows it in its line), so that the target begins with
    the line's end; others show a drawn share of the body, at least one line and all but two at most, and end with the line
    nearest to that share which is neither blank nor within a string or comment. Prefix and target are the code up to the
    function's last line exactly.
    """
    lines = code.split("\n")
    found = sorted(enumerate(functions(code)), key=lambda f: draw(f"{key}/{f[0]}", "order"))
    heads = draw(key, "shape") < HEADS
    for i, (head, end, depths) in found:
        body = end - head - 1
        after_head = heads and lines[head].endswith("{")
        wish = min(max(1, round((SHOWN[0] + (SHOWN[1] - SHOWN[0]) * draw(f"{key}/{i}", "share")) * body)), body - 2)
        usable = [0] if after_head else [k for k in range(1, body - 1) if depths[k] >= 0 and lines[head + k].strip()]
        if not usable:
            continue
        k = min(usable, key=lambda k: (abs(k - wish), k))
        whole = "\n".join(lines[: end + 1])
        at = len("\n".join(lines[: head + k + 1])) + (not after_head)
        prompt = wordings[int(draw(f"{key}/{i}", "wording") * len(wordings))] + "\n\n" + whole[:at]
        if len(prompt) + len(whole) - at <= BUDGET:
            return Pair(prompt, whole[:at], whole[at:], round(k / body, 4), after_head, depths[k] > 1, head + k + 1, end - head - k)
    return None


def wordings_differ(wordings: tuple[str, ...], asked: str) -> None:
    """K9: an error if a wording contains the sentence that evaluations ask with, or is contained in it."""
    if bad := [w for w in wordings if asked and (w in asked or asked in w)]:
        raise ValueError(f"wordings are those of the evaluation: {bad}")


def completion_pairs(docs: DataFrame, key: str, code: str, wordings: tuple[str, ...] = WORDINGS, asked: str = "") -> DataFrame:
    """A row for each code that gives a pair: key and the fields of Pair; see cut. Null codes give none. `asked`: what evaluations ask with."""
    wordings_differ(wordings, asked)
    schema = "key string, prompt string, prefix string, target string, cut_frac double, after_head boolean, open_block boolean, prefix_lines int, target_lines int"
    types = [pa.string()] * 4 + [pa.float64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *pair) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (pair := cut(str(k), text or "", wordings))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", *Pair._fields])

    return docs.select(F.col(key).cast("string").alias("key"), F.col(code).alias("code")).mapInArrow(run, schema)


def reconstructed(pairs: DataFrame, docs: DataFrame, key: str, code: str) -> DataFrame:
    """K8: keys of pairs whose prefix and target aren't the beginning of their code; must be empty."""
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(code).alias("_code"))
    return pairs.join(own, "key", "left").where(~F.coalesce(F.col("_code").startswith(F.concat("prefix", "target")), F.lit(False))).select("key")
