"""Interleaved documents: ordered text and media references parsed from HTML, with payloads resolved by digest."""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, cut, table, utf8

#: Samples in a row of a stored picture.
WIDTH = 576
SIGN = b"\x89PNG\r\n\x1a\n"

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Tags that end a run of text.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
MEDIA = frozenset("img audio video source embed".split())


class Figure:
    """An open figure: its media items, what its caption says so far, where among the items the caption began, and whether it is open."""

    def __init__(self) -> None:
        self.media: list[list] = []
        self.caption: list[str] = []
        self.at: int | None = None
        self.open = False


def parsed(page: str) -> list[tuple[int, str, str | None, str | None]]:
    """(position, kind, text, reference) of a page in reading order, kind `text` or `media`.

    A media item's text is its caption: all that the figcaption of its figure says, before or after it and over any number of
    blocks, else its alt text, else null. A figcaption ends with its figure at the latest; one of a figure without media, or of
    no figure, is text. Scripts, styles and comments are dropped; an unclosed one ends the page. Text between block tags is one
    item, blanks collapsed.
    """
    items: list[list] = []
    words: list[str] = []
    figures: list[Figure] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text and figures and figures[-1].open:
            figures[-1].caption.append(text)
        elif text:
            items.append(["text", text, None])

    def close() -> None:
        figure = figures.pop()
        text = " ".join(figure.caption)
        for item in figure.media:
            item[1] = text or item[1]
        if text and not figure.media:
            items.insert(figure.at or 0, ["text", text, None])

    end = 0
    for m in TAG.finditer(page):
        words.append(page[end : m.start()])
        end, name = m.end(), (m[3] or "").lower()
        if name in BLOCKS:
            flush()
        if name == "figure":
            if not m[2]:
                figures.append(Figure())
            elif figures:
                close()
        elif name == "figcaption" and figures:
            figures[-1].open = not m[2]
            if figures[-1].at is None:
                figures[-1].at = len(items)
        elif name in MEDIA and not m[2]:
            flush()
            own = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[4])}
            if own.get("src"):
                items.append(["media", own.get("alt") or None, own["src"]])
                if figures:
                    figures[-1].media.append(items[-1])
    words.append(page[end:])
    flush()
    while figures:
        close()
    return [(k, *item) for k, item in enumerate(items)]


def picture(payload: bytes, width: int = WIDTH) -> bytes:
    """Bytes, a multiple of the width, as an 8-bit greyscale PNG: one sample a byte, rows unfiltered, lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")]
    return SIGN + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def samples(stored: bytes) -> np.ndarray:
    """The rows of samples of a PNG that picture() wrote; an error if a check sum or the format is wrong."""
    if stored[:8] != SIGN:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def padded(text: bytes, width: int = WIDTH) -> bytes:
    """Bytes 255 appended up to a positive multiple of the width."""
    return text + b"\xff" * (-len(text) % width if text else width)


def feature(rows: np.ndarray) -> str:
    """Mean and deviation of the samples, entropy in bits, and an average hash of 8 x 8 blocks."""
    count = np.bincount(rows.ravel(), minlength=256)
    p = count / rows.size
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256.0) ** 2 - mean**2)))
    p = p[p > 0]
    edges = np.unique(np.arange(8) * len(rows) // 8)
    blocks = np.add.reduceat(np.add.reduceat(rows, np.arange(0, rows.shape[1], rows.shape[1] // 8)[:8], axis=1, dtype=np.int64), edges, axis=0)
    height = np.diff(np.append(edges, len(rows)))[:, None]
    grid = np.zeros((8, 8), bool)
    grid[: len(blocks)] = blocks / height > blocks.sum() / (len(rows) * blocks.shape[1])
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};hash={np.packbits(grid).tobytes().hex()}"


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items array<struct<position,kind,text,ref>>) for each page, in reading order: see parsed. Null and empty pages
    have no items; repeated rows stay; pages of any length are read whole; an empty table gives no rows; other columns are not read."""
    arrow = arrow_schema(pages.sparkSession, "id long, items array<struct<position:int,kind:string,text:string,ref:string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [[dict(zip(("position", "kind", "text", "ref"), x)) for x in parsed(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, arrow.field(1).type)], schema=arrow)

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, items array<struct<position:int,kind:string,text:string,ref:string>>")


def resolved(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items with the columns of the stored payload that their reference names (digest), null where none does.

    A digest that many items name is a hot key of the join, which Spark splits; the store must hold a digest once.
    """
    one = items.select("id", F.explode("items").alias("item")).select("id", "item.*")
    return one.join(store.withColumnRenamed("digest", "ref"), "ref", "left")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, page, media): each text's payload as a picture, and a page that names it by its digest.

    The picture is null where the same task has written the same digest before. A null text is empty; repeated rows stay, each with
    its page; texts of any length are stored whole; an empty table gives no rows; columns other than the two named are not read.
    """
    schema = "doc_id long, digest string, page string, media binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[bytes] = set()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                payload = padded(text)
                digest = hashlib.sha256(payload)
                page = f'<article><p>A text of {len(text)} bytes.</p><figure><img src="sha256:{digest.hexdigest()}" alt="payload"><figcaption>Payload of {len(payload)} samples</figcaption></figure></article>'
                media = None if digest.digest() in written else picture(payload)
                written.add(digest.digest())
                rows.append((doc, "sha256:" + digest.hexdigest(), page, media))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def read_back(store: DataFrame) -> DataFrame:
    """What the stored pictures hold, one row a digest: (digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    UTF-8 has no byte 255, so the bytes before the padding are the text's. A digest stored several times is one row; an empty store
    gives none.
    """
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    arrow = arrow_schema(store.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = samples(media)
                payload = own.tobytes()
                rows.append((digest, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return store.where("media is not null").select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages that refer to their stored payloads, with what reading the payloads back gives.

    The pictures are written once, to the shared folder, and never shuffled; references and what the pictures hold meet by digest.
    """
    own = cut(stored(table(spark, sf_dir, "documents")))
    found = resolved(sequences(own, "doc_id", "page"), read_back(own)).where("kind = 'media'")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", F.col("text").alias("caption"))
