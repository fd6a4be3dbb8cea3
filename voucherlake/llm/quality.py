"""Quality from weak labels: heuristics vote, EM weighs them, their posterior trains a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged, whole_texts

#: Dimensions that features are hashed to, and the documents the scorer is fitted on: those with the least hash of doc_id.
DIMENSIONS, SAMPLE_DOCS = 1 << 12, 6_000
EM_ROUNDS, FIT_ROUNDS = 50, 300
#: A document goes if its score is below.
KEEP_FROM = 0.5

_SPACE, _LOWER, _UPPER, _DIGIT, _BYTE = b" \t\n\r\x0b\x0c", range(97, 123), range(65, 91), range(48, 58), range(128, 256)
#: Bytes by class: a letter or any non-ASCII byte, A upper case, 0 digit, the space, other signs as they are.
_CLASSES = bytes(
    ord("a") if i in _LOWER or i in _BYTE else ord("A") if i in _UPPER else ord("0") if i in _DIGIT else ord(" ") if i in _SPACE else i
    for i in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Fewer words are judged by signs, capitals and cells alone.
SHORT = 20
#: Votes: 1 good, -1 bad, 0 none. Only the last three ever praise.
LABELLERS = ("signs", "capitals", "cells", "repeats", "neighbours", "sentences", "word_length", "plain")


def measures(text: str | None) -> dict[str, float] | None:
    """Shares of words and letters that tell prose from junk; None for a text without a word."""
    words = text.split() if text else []
    if not words:
        return None
    n = len(words)
    raw = text.encode("utf-8", "surrogatepass").translate(_CLASSES)
    letters, capitals = raw.count(b"a"), raw.count(b"A")
    spaces = raw.count(b" ")
    shown = max(1, len(raw) - spaces)
    digits = raw.count(b"0")
    marks = sum(map(raw.count, (b".", b",", b"'", b"-")))
    stops = text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.rstrip().endswith((".", "?", "!"))
    return {
        "n": n,
        "signs": (shown - letters - capitals - digits - marks) / shown,
        "capitals": capitals / max(1, letters + capitals),
        "cells": text.count("|") / n,
        "repeats": 1 - len(set(words)) / n,
        "neighbours": sum(map(str.__eq__, words, words[1:])) / n,
        "sentences": stops / n,
        "word_length": shown / n,
        "digits": digits / shown,
    }


def votes(text: str | None) -> list[int]:
    """One vote per labeller; a text without a word gets a bad one from all that judge words."""
    m = measures(text)
    if m is None:
        return [0, 0, 0, 0, 0, -1, -1, -1]
    found = [-1 if m["signs"] > 0.06 else 0, -1 if m["capitals"] > 0.4 else 0, -1 if m["cells"] > 0.2 else 0]
    if m["n"] < SHORT:
        return [*found, 0, 0, 1, 1, 0 if any(found) else 1]
    return [
        *found,
        -1 if m["repeats"] > 0.85 else 0,
        -1 if m["neighbours"] > 0.15 else 0,
        -1 if m["sentences"] < 0.004 else 1 if 0.02 < m["sentences"] < 0.35 else 0,
        -1 if m["word_length"] > 14 or m["word_length"] < 2.5 else 1 if 3.5 < m["word_length"] < 7.5 else 0,
        1 if m["signs"] < 0.03 and m["capitals"] < 0.2 and m["neighbours"] < 0.1 else 0,
    ]


def _slot(name: bytes) -> int:
    return zlib.crc32(name) % DIMENSIONS


_SLOTS: dict[bytes, int] = {}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): shares of word shapes and the measures in bins, hashed; a text without a word has one slot."""
    m = measures(text)
    if m is None:
        return np.array([_slot(b"no word")]), np.array([1.0], np.float32)
    raw = text.encode("utf-8", "surrogatepass").translate(_CLASSES)
    shapes = Counter(raw.split())
    found: dict[int, float] = {}
    total = sum(shapes.values())
    for shape, n in shapes.items():
        slot = _SLOTS.get(shape)
        if slot is None:
            slot = _slot(b"shape " + _RUNS.sub(rb"\1", shape)[:40])
            if len(_SLOTS) < 100_000 and len(shape) < 100:
                _SLOTS[shape] = slot
        found[slot] = found.get(slot, 0.0) + n / total
    judged = ("signs", "capitals", "cells") if m["n"] < SHORT else m
    for name in judged:
        value = m[name]
        step = min(12, int(np.log2(value))) if name == "n" else min(20, int(value * 20)) if name != "word_length" else min(20, int(value))
        slot = _slot(f"{name} {step}".encode())
        found[slot] = found.get(slot, 0.0) + 0.5
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float32, len(found))


def fit_votes(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of each pattern, prior, accuracies) by expectation-maximisation.

    patterns: distinct vote vectors; counts: documents with each. A labeller has, for good and for bad documents, a
    probability of each of its three votes; labellers are taken as independent given the truth.
    """
    posterior = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    marks = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior, tables = 0.5, None
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        tables = np.einsum("cp,plv->clv", weight, marks) + 1.0
        tables /= tables.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        score = np.einsum("plv,clv->pc", marks, np.log(tables)) + np.log([1 - prior, prior])
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    accuracy = np.stack([tables[0, :, 0], tables[1, :, 2]])
    return posterior, float(prior), accuracy


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pattern): the votes of all labellers as one number in base 3, and what tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            cast = np.array([votes(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(LABELLERS))
            columns = [batch.column(0), batch.column(2), pa.array((cast + 1) @ weights)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "pattern"])

    hashed = whole_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, "doc_id long, text_hash long, pattern long")


def fit_scorer(slots: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """Logistic weights (the last one is the bias) for soft targets, by gradient descent with a small ridge."""
    x = np.zeros((len(slots), DIMENSIONS + 1), np.float32)
    for i, (s, v) in enumerate(zip(slots, values)):
        x[i, s] = v
    x[:, -1] = 1
    w = np.zeros(DIMENSIONS + 1, np.float32)
    speed = np.zeros_like(w)
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - targets).astype(np.float32) / max(1, len(targets)) + 1e-5 * w
        speed = 0.9 * speed - 1.0 * gradient
        w += speed
    return w


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The weights of the scorer. Votes are counted over all rows; it is fitted on sample_docs distinct rows at most.

    Those have the least hash of doc_id and text; rows that repeat both are one, and rows that share or lack an id are not.
    """
    marked = staged(vote_patterns(docs), "votes")
    # at most 3^8 rows, whatever the input
    rows = marked.groupBy("pattern").count().collect()
    if not rows:
        return np.zeros(DIMENSIONS + 1, np.float32)
    codes = np.array([r["pattern"] for r in rows], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    posterior, _, _ = fit_votes(patterns, np.array([r["count"] for r in rows], float))
    by_code = dict(zip(codes.tolist(), posterior.tolist()))
    row = ["doc_id", "text_hash"]
    chosen = marked.dropDuplicates(row).orderBy(F.xxhash64(*row), *row).limit(sample_docs)
    # sample_docs rows of three numbers
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__chosen"), F.col("text_hash").alias("__hash"), "pattern"))
    own = F.col("doc_id").eqNullSafe(F.col("__chosen")) & (F.xxhash64("text") == F.col("__hash"))
    texts = whole_texts(docs).join(chosen, own).dropDuplicates(["__chosen", "__hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            slots = pa.array([s for s, _ in found], pa.list_(pa.int32()))
            shares = pa.array([v for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), slots, shares], ["pattern", "slots", "shares"])

    sample = texts.select("text", "pattern").mapInArrow(run, "pattern long, slots array<int>, shares array<float>").collect()
    targets = np.array([by_code[r["pattern"]] for r in sample])
    return fit_scorer([np.array(r["slots"]) for r in sample], [np.array(r["shares"], np.float32) for r in sample], targets)


def _scorer(docs: DataFrame, sample_docs: int):
    """An Arrow UDF from text to quality, trained on docs; a worker holds one text at a time as a string."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))

    @F.arrow_udf("double")
    def scorer(texts: pa.Array) -> pa.Array:
        w = weights.value
        raw = np.array([float(w[s] @ v) + float(w[-1]) for s, v in (features(t.as_py()) for t in texts)])
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -50, 50))), pa.float64())

    return scorer


def score(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, quality double, keep boolean) of every row of docs (doc_id, text).

    quality: the scorer's probability that the text is good; keep: it is at least KEEP_FROM. Null, empty and blank texts have
    no word, which is bad; they share one score. Equal texts have equal scores; rows that repeat a doc_id and a
    text count once in the fit and keep their rows. Other columns are not read. An empty table gives no rows.
    """
    scored = whole_texts(docs).select("doc_id", _scorer(docs, sample_docs)(F.col("text")).alias("quality"))
    return scored.withColumn("keep", F.col("quality") >= KEEP_FROM)


def keep_good(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs that are not rejected, each judged by its own text; nothing is shuffled."""
    return docs.where(_scorer(docs, sample_docs)(F.col("text").cast("string")) >= KEEP_FROM)
