"""Lists of strings, compressed together."""

from __future__ import annotations

import numpy as np
import zstandard


def packed_strings(words: list[str]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.compress(len(words).to_bytes(4, "little") + sizes + "".join(words).encode("utf-8", "surrogatepass"), 3)


def strings(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    text = raw[4 + 4 * n :].decode("utf-8", "surrogatepass")
    return [text[a:b] for a, b in zip([0, *ends], ends)]
