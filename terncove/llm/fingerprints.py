"""Word shingles as 64-bit hashes, and SimHash fingerprints of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shingle_hashes(text: str | None, words: int, step: int = 65_536) -> Iterator[np.ndarray]:
    """uint64 XXH64 (seed 42) of the space-joined shingles of a lower-cased (A-Z) text, ``step`` at a time; fewer words than a shingle
    make one, no words none."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(1, len(parts) - words + 1)
    for at in range(0, last, step):
        to = min(last, at + step)
        stops = ends[min(words, len(parts)) - 1 :][at:to].tolist()
        yield np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), stops, strict=True)], "<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> np.uint64:
    """The bits that more than half of ``n`` hashes have."""
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]


def simhash(texts: list[str | None], words: int = 3) -> np.ndarray:
    """uint64 fingerprints over all shingles, repeats included; zero for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        counts, n = np.zeros(64, np.int64), 0
        for hashes in shingle_hashes(text, words):
            counts += bit_counts(hashes)
            n += len(hashes)
        if n:
            out[k] = majority(counts, n)
    return out


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct shingle hashes as ascending int64."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)
