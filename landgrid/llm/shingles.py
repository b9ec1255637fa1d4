"""Word shingles of texts, their hashes and fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 64


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The hash of each word shingle of a text in UTF-8; A-Z lower-cased, words between ASCII blanks."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)


def simhash_of(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a text's shingle hashes, repeats included; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])
