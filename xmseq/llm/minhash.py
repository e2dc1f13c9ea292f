"""MinHash signatures in numpy: many multiply-shift hashes over the shingles of many rows."""

from __future__ import annotations

import numpy as np

from xmseq.llm.words import S32

BLOCK = 1 << 15
EMPTY = np.uint32(0xFFFFFFFF)


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of n members of the multiply-shift family."""
    drawn = np.random.default_rng(seed).integers(0, 2**63, (2, n)).astype(np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def signatures(shingles: np.ndarray, counts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Signature of each row of `counts` shingles, as a matrix of n columns; EMPTY for a row without shingles."""
    out = np.full((len(counts), n), EMPTY, np.uint32)
    rows = np.repeat(np.arange(len(counts)), counts)
    factors, summands = universal(n, seed)
    for at in range(0, len(shingles), BLOCK):
        x, row = shingles[at : at + BLOCK], rows[at : at + BLOCK]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        own = row[first]
        for k in range(n):
            low = np.minimum.reduceat((x * factors[k] + summands[k]) >> S32, first).astype(np.uint32)
            out[own, k] = np.minimum(out[own, k], low)
    return out
