"""Hashed character counts of whole texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose counts are made together; a longer text is counted by itself.
BLOCK_BYTES = 1 << 20
_BYTES = np.arange(256, dtype=np.uint8)


def _table(f) -> np.ndarray:
    return np.array([f(int(b)) for b in _BYTES], dtype=np.uint8)


#: Bytes as they count for the shape of a text: small letters, capitals and digits each as one, the rest themselves.
SHAPE = _table(lambda b: ord("a") if chr(b).isascii() and chr(b).islower() or b >= 0x80 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b)
#: Bytes as they count for the language: everything in ASCII that is no letter is a space.
LETTERS = _table(lambda b: b if b >= 0x80 or chr(b).isalpha() else 32)


def trigrams(raw: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    """Counts (n, width) of hashed byte trigrams; none crosses from one owner to the next."""
    if len(raw) < 3:
        return np.zeros((n, width), dtype=np.float32)
    code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - (width - 1).bit_length())
    own = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][own] * width + code[own], minlength=n * width).reshape(n, width).astype(np.float32)


def joined(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, a space before and after each, and the number of the text that each byte is of."""
    parts = [f" {(t.lower() if lower else t) if t else ''} ".encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES and 256 texts at most."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= BLOCK_BYTES or i - start >= 255:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sampled(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The rows of ``most`` distinct values of ``keys`` at most, chosen by a hash of them; rows of equal keys all stay.

    Only keys are shuffled, and which ones are chosen depends on no order. Rows with a null key are left out.
    """
    chosen = rows.select(*keys).distinct().orderBy(F.xxhash64(F.lit(13), *keys), *keys).limit(most)
    return rows.join(F.broadcast(chosen), list(keys))  # ``most`` rows of ids and names
