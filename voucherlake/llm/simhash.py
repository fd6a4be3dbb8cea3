"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2h bits apart share a variant at most h bits from each. So every fingerprint gives all its
variants within h flips, variants meet by a shuffle, and the fingerprints that gave one variant are linked.
The 2,081 variants of a fingerprint are not shuffled one by one: variants are dealt by their leading bits (a cell), and
a fingerprint goes once to each cell it has a variant in. The other bits are flipped where the cell is.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.components import components
from voucherlake.llm.staging import staged, whole_texts

SEED = 42
HASHES_AT_ONCE = 1 << 15
#: Variants sorted at once in a task (8 bytes each, and as many again for the owners looked up).
VARIANTS_AT_ONCE = 1 << 21
#: Fingerprints in one group; a cell with more is dealt out by further bits.
CELL_ROWS = 1 << 18


def fingerprint(text: str | None, words: int) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; zero without a word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        spans = zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE])
        codes = np.array([hashed(joined[s:e], SEED) for s, e in spans], dtype=">u8")
        votes += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint long): the bits of fingerprint() as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fingerprint"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, fingerprint long")


@functools.cache
def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most `most` ones, by number of ones."""
    found = [0]
    fresh = [(0, -1)]
    for _ in range(most):
        fresh = [(mask | 1 << i, i) for mask, last in fresh for i in range(last + 1, bits)]
        found += [mask for mask, _ in fresh]
    return np.array(found, dtype=np.uint64)


def _meet(codes: np.ndarray, used: np.ndarray, prefix: int, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(least owner, owner) of the variants in a cell that several fingerprints gave, as positions in codes.

    used: flips spent on the leading bits, which are `prefix` in every variant of the cell.
    """
    if len(codes) < 2:
        return
    rest = 64 - bits
    by_flips = [_masks(rest, half - f) for f in range(half + 1)] if rest <= 64 - 4 else None
    total = sum(int((used == f).sum()) * (sum(math.comb(rest, k) for k in range(half - f + 1))) for f in range(half + 1))
    if (total > VARIANTS_AT_ONCE or by_flips is None) and rest > 4:
        low = np.uint64(rest - 4)
        following = (codes >> low) & np.uint64(15)
        for value in range(16):
            spent = used + np.bitwise_count(following ^ np.uint64(value))
            kept = np.flatnonzero(spent <= half)
            for a, b in _meet(codes[kept], spent[kept], prefix << 4 | value, bits + 4, half):
                yield kept[a], kept[b]
        return
    top = np.uint64(prefix << rest) if bits else np.uint64(0)
    tails = (codes & np.uint64((1 << rest) - 1)) | top
    groups = [np.flatnonzero(used == f) for f in range(half + 1)]
    variants = [(tails[g][:, None] ^ by_flips[f][None, :]).ravel() for f, g in enumerate(groups)]
    every = np.sort(np.concatenate(variants))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(shared):
        return
    del every
    owners, met = [], []
    for f, g in enumerate(groups):
        at = np.minimum(np.searchsorted(shared, variants[f]), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == variants[f])
        owners.append(g[hit // len(by_flips[f])])
        met.append(at[hit])
    owners, met = np.concatenate(owners), np.concatenate(met)
    least = np.full(len(shared), len(codes))
    np.minimum.at(least, met, owners)
    yield least[met], owners


def _join_cell(codes: np.ndarray, prefix: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, least code reached inside the cell) of the codes that share a variant there."""
    codes = np.unique(codes)
    used = np.bitwise_count((codes >> np.uint64(64 - bits)) ^ np.uint64(prefix)).astype(np.int64)
    pairs = [np.unique(np.stack([a, b], axis=1)[a != b], axis=0) for a, b in _meet(codes, used, prefix, bits, half)]
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    a, b = pairs[:, 0], pairs[:, 1]
    near = np.bitwise_count(codes[a] ^ codes[b]) <= 2 * half
    a, b = a[near], b[near]
    label = np.arange(len(codes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _cell_links(bits: int, half: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _join_cell(rows["fingerprint"].to_numpy().view(np.uint64), int(key[0]), bits, half)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(codes: DataFrame, radius: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) long: links that join all distinct fingerprints within radius bits (even); at most one row per code and cell.

    All fingerprints that gave one variant lie within radius of each other, so a star per variant loses none.
    codes: (fingerprint long), distinct. How many leading bits make a cell follows from their number.
    """
    half = radius // 2
    one = sum(math.comb(64, k) for k in range(half + 1))
    count = codes.count()
    bits = min(60, max(4, math.ceil(math.log2(max(1, count * one / VARIANTS_AT_ONCE)))))
    added = bits
    waiting = codes.select("fingerprint", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("used"))
    found = None
    while True:
        masks = [(int(m), int(m).bit_count()) for m in _masks(added, half)]
        options = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in masks])
        following = F.shiftrightunsigned("fingerprint", 64 - bits).bitwiseAND(F.lit((1 << added) - 1))
        cells = (
            waiting.select("fingerprint", "cell", "used", following.alias("f"), F.explode(options).alias("o"))
            .where(F.col("used") + F.col("o.k") <= half)
            .select(
                "fingerprint",
                F.shiftleft("cell", added).bitwiseOR(F.col("f").bitwiseXOR(F.col("o.m"))).alias("cell"),
                (F.col("used") + F.col("o.k")).alias("used"),
            )
        )
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
        large = staged(sizes.where(F.col("n") > cell_rows), "cells") if bits < 60 else None
        crowded = large is not None and bool(large.take(1))
        light = cells.join(large, "cell", "left_anti") if crowded else cells
        part = light.select("cell", "fingerprint").groupBy("cell").applyInPandas(_cell_links(bits, half), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not crowded:
            return found
        waiting = staged(cells.join(large, "cell", "left_semi"), "crowded")
        added = min(4, 60 - bits)
        bits += added


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    fingerprint: 16 hexadecimal digits; component_id: the smallest doc_id reached over links of at most `radius`
    differing bits, itself included. Null, empty and blank texts have fingerprint zero and are linked like any other.
    Rows that share a doc_id keep their own rows; a null doc_id stays null and is never the smallest of a component
    that has a number. Other columns are not read. An empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, words), "fingerprints")
    codes = staged(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "codes")
    linked = components(staged(links(codes.select("fingerprint"), radius), "links"))
    classed = codes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    classed = staged(classed, "classes")
    least = classed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_code = classed.join(least, "component").select("fingerprint", "component_id")
    return marked.join(by_code, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
