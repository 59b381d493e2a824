"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures follow C-MinHash: sigma permutes the shingle space once, and coordinate k is the minimum of one permutation
pi, circularly shifted by k, over the permuted shingles: pi((sigma(x) - k) mod 2**32). The 128 coordinates form 32 bands
of 4; at a similarity of 0.75 a pair misses all bands with probability 0.684**32, about 5e-6.

The band values are a document's keys. Documents with a band in common are in one family (see count_tree), and every pair
of a family is verified on full shingle sets, unless its members are in one component already or counts of their shingles
by hash show that they share too few. Rows grow with the members of families and blocks, not with their pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HASH_BASE, SHINGLE, WORD_PATTERN, keep_by_row, mix
from tallyspark.llm.count_tree import linked_documents

BANDS = 32
BAND_ROWS = 4
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75


def signatures(sets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The circulant signatures of concatenated non-empty sets that start at firsts: (sets, BANDS * BAND_ROWS)."""
    sigma = (mix(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(firsts), BANDS * BAND_ROWS), np.uint32)
    shifted, spare = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(BANDS * BAND_ROWS):
        np.subtract(sigma, np.uint32(k), out=shifted)
        shifted *= np.uint32(0x9E3779B1)
        np.right_shift(shifted, np.uint32(15), out=spare)
        shifted ^= spare
        shifted *= np.uint32(0x85EBCA77)
        np.right_shift(shifted, np.uint32(16), out=spare)
        shifted ^= spare
        out[:, k] = np.minimum.reduceat(shifted, firsts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(BAND_ROWS):
        keys = keys * np.uint64(HASH_BASE) + signature[:, r::BAND_ROWS]
    return mix(keys)


def banded(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band values of concatenated non-empty sets, and the set of each."""
    keys = band_keys(signatures(flat, np.cumsum(sizes) - sizes))
    return keys.ravel(), np.repeat(np.arange(len(sizes)), BANDS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A-Z count as a-z. Shingles are five consecutive words; a text of one to four words is one shingle; null or wordless
    texts have none and are linked with nothing. Documents with equal sets always link. Rows that share a doc_id are told
    apart by their texts; a row without a doc_id takes part, and component_id is the smallest doc_id there is (null if
    there is none). An empty table gives an empty result; other columns are not read.
    """
    found = linked_documents(docs, banded, PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, with all its columns.

    Rows with the same doc_id and text stay or go together; rows without a doc_id stay where no row of their component has one,
    the one with the smallest hash of its text.
    """
    return keep_by_row(docs, linked_documents(docs, banded, PERCENT).filter("n_shingles = 0 or row = first_row"))


def components_by_brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    """The contract's definition on all pairs, for small inputs in tests."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall(WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= PERCENT * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]
