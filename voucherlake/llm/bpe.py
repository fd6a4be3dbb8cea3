"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by merging linked bytes from a heap."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.llm.staging import whole_texts

#: Pre-tokens a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000
#: Longer pre-tokens are not remembered.
REMEMBERED_CHARS = 64
#: Characters of texts that are cut and looked up at once.
CHARS_AT_ONCE = 500_000
#: Bytes of ids that leave a worker at once.
BYTES_AT_ONCE = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """A minimal perfect hash: each key has its own number below their count. Unknown keys get any number, or -1.

    Level by level, keys that share their slot with no other take it and the others go on to the next level; a key's
    number is the count of taken slots before its own.
    """

    def __init__(self, keys: list[bytes], slots_per_key: float = 1.5):
        left = self.codes(keys)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat, or two have one 64-bit hash")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(left):
            size = int(len(left) * slots_per_key) + 1
            slots = self._slots(left, len(self.levels), size)
            taken = np.bincount(slots, minlength=size) == 1
            self.levels.append((taken, np.cumsum(taken) - 1 + before))
            before += int(taken.sum())
            left = left[~taken[slots]]

    @staticmethod
    def codes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _slots(codes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = codes ^ np.uint64((level + 1) * int(_GOLDEN) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _GOLDEN
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(size)).astype(np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        codes = self.codes(keys)
        found = np.full(len(codes), -1, np.int64)
        left = np.arange(len(codes))
        for level, (taken, numbers) in enumerate(self.levels):
            slots = self._slots(codes[left], level, len(taken))
            hit = taken[slots]
            found[left[hit]] = numbers[slots[hit]]
            left = left[~hit]
        return found


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, space, rank), in the order of their ranks."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encodes and decodes with one vocabulary; tokens: bytes by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.hash = PerfectHash(tokens)
        ids = self.hash.numbers(tokens)
        self.id_of = np.empty(len(tokens), np.int64)  # number in the hash -> rank
        self.id_of[ids] = np.arange(len(tokens))
        self.rank_of = {token: rank for rank, token in enumerate(tokens)}
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.known: dict[str, bytes] = {}

    def lookup(self, pieces: list[bytes]) -> list[int]:
        """The rank of each piece that is a token, else -1."""
        numbers = self.hash.numbers(pieces)
        ids = np.where(numbers >= 0, self.id_of[numbers], -1).tolist()
        tokens = self.tokens
        return [i if i >= 0 and tokens[i] == piece else -1 for i, piece in zip(ids, pieces)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: of all neighbours, those with the least rank merge first, the leftmost of equals."""
        rank_of, size = self.rank_of, len(piece)
        after = list(range(1, size + 1))  # start of the next part; parts are known by their start
        before = list(range(-1, size))
        alive = bytearray(b"\x01" * size)
        heap = [(rank_of[pair], i, i + 2) for i in range(size - 1) if (pair := piece[i : i + 2]) in rank_of]
        heapq.heapify(heap)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = after[start]
            if not alive[start] or middle >= size or after[middle] != end:
                continue
            alive[middle] = 0
            after[start] = end
            if end < size:
                before[end] = start
                if (pair := piece[start : after[end]]) in rank_of:
                    heapq.heappush(heap, (rank_of[pair], start, after[end]))
            low = before[start]
            if low >= 0 and (pair := piece[low:end]) in rank_of:
                heapq.heappush(heap, (rank_of[pair], low, end))
        return [rank_of[piece[i : after[i]]] for i in range(size) if alive[i]]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        raw = [piece.encode() for piece in pieces]
        packed, found = self.packed, {}
        for piece, whole, rank in zip(pieces, raw, self.lookup(raw)):
            found[piece] = packed[rank] if rank >= 0 else b"".join([packed[i] for i in self.merge(whole)])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(text) for text in texts]
        known = self.known
        fresh = set()
        for pieces in cut:
            fresh.update(pieces)
        fresh.difference_update(known)
        learnt = self._learn(list(fresh))
        if len(known) + len(learnt) > REMEMBERED:
            known.clear()
            learnt |= self._learn([p for p in {p for pieces in cut for p in pieces} if p not in learnt])
        known.update(learnt)
        encoded = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in learnt:
            if len(piece) > REMEMBERED_CHARS:
                del known[piece]
        return encoded

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= CHARS_AT_ONCE:
                yield from self.encode(group)
                group, chars = [], 0
        yield from self.encode(group)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and broadcast vocabulary."""
    tokens, pattern = shared.value
    if id(tokens) not in _codecs:
        _codecs.clear()
        _codecs[id(tokens)] = Codec(tokens, pattern)
    return _codecs[id(tokens)]


def share(spark: SparkSession, path: str, pattern: str):
    """The vocabulary in `path` (a file of the driver, of fixed size) and the pattern, sent to each executor once."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, ids binary) of every row of docs (doc_id, text): little-endian unsigned 32-bit ids of the whole text.

    Every match of the pattern is encoded by itself, without special tokens. Null and empty texts have no ids. Rows keep
    their count: repeated rows give repeated rows, an empty table none. Other columns are not read.
    vocabulary: from share().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            ids = pa.array(list(codec.encode_all(t.as_py() or "" for t in batch.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, ids, payload binary): the bytes that ids (as encode() gives them; null as none) stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            payload = pa.array([codec.decode(i.as_py() or b"") for i in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), payload], ["doc_id", "ids", "payload"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, payload binary")


def round_trip(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, ids binary, payload binary) of every row of docs: its ids, as encode() gives them, and what they decode to.

    One worker does both, so that a core holds the vocabulary once; rows leave in small batches, whatever came in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            left, ids, size = batch.column(0), [], 0
            for packed in codec.encode_all(t.as_py() or "" for t in batch.column(1)):
                ids.append(packed)
                size += len(packed)
                if size >= BYTES_AT_ONCE:
                    yield _both(codec, left[: len(ids)], ids)
                    left, ids, size = left[len(ids) :], [], 0
            if ids:
                yield _both(codec, left[: len(ids)], ids)

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids binary, payload binary")


def _both(codec: Codec, doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    payload = pa.array(list(map(codec.decode, ids)), pa.binary())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), payload], ["doc_id", "ids", "payload"])


def digests(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs, encoded and decoded again."""
    return round_trip(docs, vocabulary).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("payload", 256).alias("decoded_sha256"),
    )
