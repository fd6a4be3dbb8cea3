"""Periodic runs: stretches of words that repeat themselves three times and more, found by tiles of every period octave.

Octave P holds the periods P to 2P - 1 (the first one all periods below its stride) and has a boundary at every P-th word. A
run of period q with 3q words agrees with itself q words on over 2P words, so from some boundary P words on. Blocks of P words
are compared by hashes, and around the boundaries where a block comes back within the octave's distance a document is cut
into tiles, which overlap by what their last boundary needs. Other stretches have no run of the octave.
Tiles are dealt over all tasks and solved apart: the Z-function of the words from a boundary on, and that of the words before
it read backwards, tell for every period at once how far it holds to both sides (exact, on words; hashes only choose tiles).
The fragments meet by a shuffle on (document, period), are stitched where they touch, and are then long enough or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged, whole_texts

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 24, 3
#: Words marked at once (a longer document alone), words of a tile (more where one boundary needs more), rows sent at once.
WORDS_AT_ONCE, TILE_WORDS, ROWS_AT_ONCE = 1 << 18, 1 << 14, 256
_FACTORS = np.random.default_rng(42).integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

MARKED = "key binary, doc_id long, n_words long, open boolean, text string, stride int, first long, ids array<int>, marks array<long>"
NAMES = [part.strip().split(" ")[0] for part in MARKED.split(",")]
TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]


def split(text: str | None) -> list[bytes]:
    """The words: runs of bytes that are not ASCII space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def octaves(words: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(stride, first period, end of periods) of the octaves that a document of so many words can have runs in."""
    stride = 1 << max(0, (least // 3).bit_length() - 1)
    if words >= least:
        yield stride, 1, stride
        while words >= times * stride:
            yield stride, stride, 2 * stride
            stride *= 2


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of 2 * size words from those of size words."""
    later = hashes[size:]
    return hashes[:-size] * _FACTORS[0] + (later ^ (later >> np.uint64(29))) * _FACTORS[1] if len(later) else hashes[:0]


def hit_boundaries(sizes: list[int], ids: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(document, stride, first period, end of periods, boundaries): where a block of `stride` words comes back.

    ids: the words of all documents, each followed by a number of its own; boundaries count from the document's start.
    """
    starts = np.cumsum([0] + [n + 1 for n in sizes[:-1]]) if sizes else np.zeros(0, np.int64)
    counts = np.array(sizes, np.int64)
    hashes = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * _FACTORS[1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _FACTORS[0]
    size = 1
    for stride, low, end in octaves(max(sizes, default=0), least, times):
        while size < stride:
            hashes, size = _blocks(hashes, size), 2 * size
        if end <= low:
            continue
        able = np.flatnonzero(counts >= max(least, times * low))
        each = np.maximum(0, (counts[able] - stride - low) // stride + 1)  # so that the block and its first copy fit in
        docs = np.repeat(able, each)
        order = np.arange(len(docs)) - np.repeat(np.cumsum(each) - each, each)
        places = starts[docs] + order * stride
        found = np.zeros(len(docs), bool)
        rows = max(1, (1 << 20) // (end - low))
        for at in range(0, len(docs), rows):
            here = places[at : at + rows, None]
            there = here + np.arange(low, end)
            inside = there < len(hashes)
            found[at : at + rows] = ((hashes[here] == hashes[np.where(inside, there, 0)]) & inside).any(axis=1)
        for doc, group in groupby(np.flatnonzero(found).tolist(), key=lambda i: int(docs[i])):
            yield doc, stride, low, end, order[list(group)] * stride


def tiles(words: int, stride: int, end: int, boundaries: np.ndarray, tile_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, last word + 1, boundaries): each boundary with a stride before it, and two and the longest period after it."""
    reach = 2 * stride + end - 1
    group: list[int] = []
    for b in boundaries.tolist():
        if group and (b + reach - group[0] > tile_words or b - group[-1] > reach):
            yield max(0, group[0] - stride), min(words, group[-1] + reach), np.array(group)
            group = []
        group.append(b)
    if group:
        yield max(0, group[0] - stride), min(words, group[-1] + reach), np.array(group)


def z_function(word: list) -> list[int]:
    """For every place, how many items from there on equal those from the start on."""
    n = len(word)
    found = [0] * n
    if n:
        found[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, found[i - left]) if i < right else 0
        if i + k >= right or i >= right:
            while i + k < n and word[k] == word[i + k]:
                k += 1
            left, right = i, i + k
        found[i] = k
    return found


def fragments(ids: list[int], first: int, boundaries: list[int], stride: int, low: int, end: int) -> list[tuple[int, int, int]]:
    """(period, start, end): words from start to end that equal those a period on, found from the boundaries of a tile.

    Where the q + stride words from a boundary on have a smaller period of at most `stride`, they have a divisor of q (Fine and
    Wilf), and so has every stretch of period q around them: nothing of period q starts from there. Pieces that touch are one.
    """
    pieces: dict[int, list[list[int]]] = {}
    for b in boundaries:
        at = b - first
        ahead = ids[at : at + 2 * stride + end - 1]
        forward = z_function(ahead)
        reach = max((p + forward[p] for p in range(1, min(low, len(ahead)))), default=0)
        periods = []
        for q in range(low, min(end, len(ahead))):
            if forward[q] >= stride and q + stride > reach:
                periods.append(q)
            if low == 1:
                reach = max(reach, q + forward[q])
        if not periods:
            continue
        behind = ids[max(0, at - stride) : at][::-1]
        most = min(end - 1, len(ahead))
        mirrored = z_function([*behind, None, *ids[max(0, at - stride) : at + most][::-1]])
        for q in periods:
            start, stop = b - mirrored[len(behind) + 1 + most - q], b + min(forward[q], 2 * stride)
            known = pieces.setdefault(q, [])
            if known and start <= known[-1][1]:
                known[-1][1] = max(known[-1][1], stop)
            else:
                known.append([start, stop])
    return [(q, start, stop) for q, spans in pieces.items() for start, stop in spans]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that some run (start, length, period) holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


def _told(digest: bool) -> Callable[[bytes], str]:
    return (lambda raw: hashlib.sha256(raw).hexdigest()) if digest else (lambda raw: raw.decode("utf-8", "surrogatepass"))


def _marked(docs: DataFrame, least: int, times: int, digest: bool, tile_words: int) -> DataFrame:
    """One row per document (open: it has tiles, text: its words; else what is told of it), and one per tile."""
    told = _told(digest)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, TYPES)], NAMES)

    def of(group: list[tuple[int | None, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        ids: list[int] = []
        for i, (_, words) in enumerate(group):
            ids += [number.setdefault(w, len(number)) for w in words]
            ids.append(-1 - i)
        codes = np.array(ids, np.int32)
        sizes = [len(words) for _, words in group]
        starts = np.cumsum([0] + [n + 1 for n in sizes])
        keys = [xxhash.xxh3_128_digest(b" ".join([str(i).encode(), *words])) for i, words in group]
        rows, waiting, held = [], set(), 0
        for doc, stride, low, end, boundaries in hit_boundaries(sizes, codes, least, times):
            waiting.add(doc)
            for start, stop, marks in tiles(sizes[doc], stride, end, boundaries, tile_words):
                # the first octave's periods are below its stride, and told by a negative one
                part = codes[starts[doc] + start : starts[doc] + stop]
                rows.append((keys[doc], None, None, None, None, stride if low == stride else -stride, start, part, marks))
                held += len(part)
                if len(rows) >= ROWS_AT_ONCE or held > WORDS_AT_ONCE:
                    yield batch(rows)
                    rows, held = [], 0
        for i, (doc_id, words) in enumerate(group):
            raw = b" ".join(words)
            text = raw.decode("utf-8", "surrogatepass") if i in waiting else told(raw)
            rows.append((keys[i], doc_id, len(words), i in waiting, text, None, None, None, None))
            if len(rows) >= ROWS_AT_ONCE:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in batches:
            group, held = [], 0
            for doc_id, text in zip(received.column(0), received.column(1)):
                group.append((doc_id.as_py(), split(text.as_py())))
                held += len(group[-1][1])
                if held > WORDS_AT_ONCE:
                    yield from of(group)
                    group, held = [], 0
            if group:
                yield from of(group)

    return whole_texts(docs).mapInArrow(run, MARKED)


def _solved(found: DataFrame) -> DataFrame:
    """(key, period, start, end): the fragments of all tiles (key, stride, first, ids, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in batches:
            rows = []
            for key, stride, first, ids, marks in zip(*received.columns):
                s = abs(stride.as_py())
                low, end = (s, 2 * s) if stride.as_py() > 0 else (1, s)
                pieces = fragments(ids.values.to_numpy().tolist(), first.as_py(), marks.values.to_numpy().tolist(), s, low, end)
                rows += [(key.as_py(), *piece) for piece in pieces]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "period", "start", "end"])

    return found.mapInArrow(run, "key binary, period long, start long, end long")


def _runs(marked: DataFrame, least: int, times: int) -> DataFrame:
    """(key, runs) of the documents that have runs, by start, then period."""
    # so many tasks whatever the bytes: tiles of repeating words shrink to little, but their work does not
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.where("stride is not null").select("key", "stride", "first", "ids", "marks").repartition(parts, "key", "stride", "first")
    by_period = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        _solved(dealt)
        .withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("fresh").over(by_period.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "period", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + F.col("period"))
        .where(F.col("length") >= F.greatest(F.lit(least), F.col("period") * times))
    )
    ordered = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    told = F.transform(ordered, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return stitched.groupBy("key").agg(told.alias("runs"))


def periodic_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, digest: bool = False, tile_words: int = TILE_WORDS
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs (doc_id, text).

    A word is a run of characters other than ASCII space. runs: array of (start, length, period) of all stretches of words with
    smallest period `period`, of at least `least` words and `times` (3 or more) periods, that no neighbouring word extends, by
    start, then period. collapsed: the words joined by one space, without those that some run holds after its first period; with
    `digest` the hexadecimal SHA-256 of that. Null, empty and blank texts have no words and no runs and collapse to the empty
    text. Rows that repeat a doc_id, null ones too, keep their own rows and texts. Other columns are not read. An empty table
    gives no rows. tile_words changes the work's grain only. The words of one document, and a tile as long as five of its periods, fit into a worker.
    """
    if least < 3 or times < 3:
        raise ValueError("a run has 3 words and 3 periods at least")
    marked = staged(_marked(docs, least, times, digest, tile_words), "tiles")
    told, kind = _told(digest), "array<struct<start:bigint,length:bigint,period:bigint>>"
    rows = marked.where("stride is null")
    none = F.array().cast(kind)
    settled = rows.where("not open").select("doc_id", "n_words", none.alias("runs"), F.col("text").alias("collapsed"))
    waiting = rows.where("open").select("key", "doc_id", "n_words", "text").join(_runs(marked, least, times), "key", "left")
    waiting = waiting.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for received in batches:
            pairs = zip(received.column(3), received.column(2))
            texts = [told(collapsed(split(t.as_py()), [(r["start"], r["length"], r["period"]) for r in runs.as_py()])) for t, runs in pairs]
            yield pa.RecordBatch.from_arrays([*received.columns[:3], pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return settled.unionByName(waiting.mapInArrow(run, f"doc_id long, n_words long, runs {kind}, collapsed string"))


def described(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs(digest=True).

    start to exponent_milli tell of the run with the greatest length / period (of equals that with the smallest start, then
    period), and are null without a run.
    """
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda most, r: F.when(r["length"] * most["period"] > most["length"] * r["period"], r).otherwise(most),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
