"""Language of texts by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the number of n-grams (1 to 4 characters, lower case, hashed) that both have, over the
geometric mean of what each has. Only n-grams that some landmark has can count, so a batch of texts is a matrix over those,
and its kernels with all landmarks, and the scores of all languages, are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.llm.staging import small, staged

#: Labelled documents learnt from, and of those the landmarks, for each language: those with the least hash of doc_id.
LEARNT, LANDMARKS = 400, 32
#: Languages learnt: those with most labelled documents (of equals the first by name).
LANGUAGES = 500
SIZES, BITS, RIDGE = (1, 2, 3, 4), 15, 1e-2
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 17, 128
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def presence(text: str, flags: np.ndarray) -> None:
    """Sets in flags (2^BITS) the slot of every n-gram of the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = max(SIZES) - 1
    for at in range(0, max(1, len(codes)), CHARS_AT_ONCE):
        part = codes[at : at + CHARS_AT_ONCE + overlap]
        rolled = np.zeros(len(part), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(part) < n:
                break
            rolled = rolled[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            if n in SIZES:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                flags[mixed >> np.uint32(32 - BITS)] = True


def grams(text: str) -> np.ndarray:
    flags = np.zeros(1 << BITS, bool)
    presence(text, flags)
    return np.flatnonzero(flags)


class Model:
    """Scores texts against the languages learnt. samples: (language, n-gram slots), landmarks of each language first."""

    def __init__(self, samples: list[tuple[str, np.ndarray]]):
        self.languages = sorted({language for language, _ in samples})
        taken = dict.fromkeys(self.languages, 0)
        chosen = []
        for i, (language, _) in enumerate(samples):
            if taken[language] < LANDMARKS:
                chosen.append(i)
                taken[language] += 1
        self.columns = np.unique(np.concatenate([samples[i][1] for i in chosen])) if chosen else np.zeros(0, np.int64)
        self.base = self._matrix([samples[i][1] for i in chosen])
        sizes = [len(samples[i][1]) for i in chosen]
        self.base /= np.sqrt(np.maximum(1, sizes))[:, None].astype(np.float32)
        if not chosen:
            return
        every = [slots for _, slots in samples]
        kernel = np.concatenate([self._kernel(self._matrix(every[i : i + TEXTS_AT_ONCE]), [len(s) for s in every[i : i + TEXTS_AT_ONCE]]) for i in range(0, len(every), TEXTS_AT_ONCE)]).astype(float)
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])  # Nyström: kernel columns -> features
        mapped = kernel @ root
        wanted = np.array([[1.0 if language == own else -1.0 for language in self.languages] for own, _ in samples])
        ridge = mapped.T @ mapped + RIDGE * len(samples) / 100 * np.eye(mapped.shape[1])
        self.weights = (root @ np.linalg.solve(ridge, mapped.T @ wanted)).astype(np.float32)

    def _matrix(self, slots: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(slots), len(self.columns)), np.float32)
        for row, own in zip(rows, slots):
            row[np.searchsorted(self.columns, np.intersect1d(own, self.columns, assume_unique=True))] = 1
        return rows

    def _kernel(self, rows: np.ndarray, sizes: list[int]) -> np.ndarray:
        return (rows @ self.base.T) / np.sqrt(np.maximum(1, sizes))[:, None].astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        readable = [i for i, text in enumerate(texts) if text and LETTER.search(text)]
        flags = np.zeros(1 << BITS, bool)
        for at in range(0, len(readable), TEXTS_AT_ONCE):
            part = readable[at : at + TEXTS_AT_ONCE]
            rows, sizes = np.empty((len(part), len(self.columns)), np.float32), []
            for row, i in zip(rows, part):
                flags[:] = False
                presence(texts[i], flags)
                row[:] = flags[self.columns]
                sizes.append(int(np.count_nonzero(flags)))
            scores = self._kernel(rows, sizes) @ self.weights
            best = scores.argmax(axis=1)
            for i, language, score in zip(part, best, scores[np.arange(len(part)), best]):
                found[i] = (self.languages[language], float(np.clip((score + 1) / 2, 0, 1)))
        return found


def held_out() -> Column:
    """Documents never learnt from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 == 2


def train(docs: DataFrame) -> Model:
    """A model of the labelled documents that are not held out; LEARNT of each of LANGUAGES languages at most are read.

    Rows that repeat a doc_id and language count once. A language with a single readable document is learnt from that.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    labelled = docs.where(lang.isNotNull() & ~held_out()).where(text.rlike(r"\p{L}"))
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"))
    # each task keeps LEARNT rows of a language before they are shuffled, whatever the language's share
    ranked = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= LEARNT)
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(F.col("lang").alias("__lang"))
    # LEARNT rows of three numbers for each of LANGUAGES languages
    chosen = chosen.join(F.broadcast(common), F.col("lang") == F.col("__lang"), "left_semi")
    chosen = small(staged(chosen.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), "n"), "learnt"))
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang"))
    texts = labelled.join(chosen, own).select("n", "lang", "text").dropDuplicates(["lang", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": batch["n"], "lang": batch["lang"], "slots": [grams(t).tolist() for t in batch["text"]]})

    rows = texts.mapInPandas(run, "n int, lang string, slots array<int>").collect()
    rows.sort(key=lambda r: (r["n"], r["lang"]))
    return Model([(r["lang"], np.array(r["slots"], np.int64)) for r in rows])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang).

    lang is read in learning only, and never of documents held out. Null texts and texts without a letter are `und` with
    score 0, as are all if nothing is labelled; else lang_pred is the language with the best score (of equals the first by
    name), score that score from 0 to 1. Rows keep their count; a null doc_id is not held out; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.value.predict(batch["text"].tolist())
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                "lang_pred": [language for language, _ in found], "score": [score for _, score in found],
            })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
