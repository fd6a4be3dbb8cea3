"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are words (runs of letters and digits, lower case). The CGK embedding walks a window: each step emits the word it
stands on and a random bit of (step, word) tells whether it goes on; windows at a small edit distance emit mostly the same
words at the same steps. Each of several embeddings is sampled several times at a few steps; a window and an item that
agree in one sample are candidates, and the edit distance of the item to the text there decides.

A window has about as many words as the shorter items of its size class, less its stride, and LONGEST at most. Documents have a window at
every stride-th word. Items have windows over their whole length, from the first word to the last, each at stride offsets in a
row, so some pair of windows starts at the same word of a passage wherever its edits lie.

The random bits are computed from (walk, step, word), the word by a hash of its own, so neither the order nor the blocks of items,
nor the batches of documents, change what is found, and an index takes memory by the words of its items only. Tasks get a
block of items as texts and index it themselves; the driver holds the texts of one block at a time.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import whole_texts, without

WORD = re.compile(r"[^\W_]+")
#: Embeddings, samples of each, and steps in a sample. Recall is measured in tests/llm/test_text.py.
WALKS, SAMPLES, STEPS = 3, 16, 4
#: Words of items that are held by every task at once; more items are searched in blocks of that size.
BLOCK_WORDS = 500_000
#: Words of the longest window; longer items have more windows.
LONGEST = 64
#: Words of an item beyond which the places of a word are held as numbers and made to bits when asked for.
BITS_HELD = 4096
#: Words of documents that a task embeds at once.
TEXT_WORDS = 400_000
SEED = 7
#: What parts words: the other ASCII characters as bytes, and all other characters that are no letter or digit.
SIGNS_TO_SPACE = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
OTHER_SIGN = re.compile(r"[^\x00-\x7f\w]")


def window_of(n: int) -> tuple[int, int]:
    """(words in a window, stride) for an item of n words; window + stride - 1 never exceeds n."""
    if n < 9:
        return n, 1
    m = 8
    while m < LONGEST and m * 2 + m // 2 - 1 <= n:
        m *= 2
    return m, m // 4


def window_starts(n: int) -> list[int]:
    """Where the windows of an item of n words start: groups of stride offsets in a row, over the whole item.

    Groups follow one another by half a window at most, the first at the first word and the last as far back as it goes.
    """
    m, stride = window_of(n)
    last = n - m - stride + 1
    if last < 0:
        return [0]
    groups = -(-last // (m // 2)) + 1 if m > 1 else last + 1
    bases = sorted({round(last * k / max(1, groups - 1)) for k in range(groups)})
    return sorted({base + offset for base in bases for offset in range(stride)})


def best_end(masks: dict[int, int], n: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of text, end of the first such part), bit-parallel.

    masks: for each word the bits of its places in the pattern. anchored: the part starts with the text.
    """
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, word in enumerate(text):
        same = masks.get(word, 0)
        across = (((same & plus) + plus) ^ plus) | same
        down = same | minus
        up, less = (minus | ~(across | plus)) & full, plus & across
        if up & high:
            score += 1
        elif less & high:
            score -= 1
        up = (up << 1 | anchored) & full
        less = (less << 1) & full
        plus = (less | ~(down | up)) & full
        minus = up & down
        if score < best:
            best, end = score, j + 1
    return best, end


class _Places(dict):
    """Places of the words of a long pattern; get() makes their bits."""

    def get(self, word: int, default: int = 0) -> int:
        places = super().get(word)
        if places is None:
            return default
        bits = bytearray(places[-1] // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")


def _masks(words: list[int]) -> dict[int, int]:
    if len(words) > BITS_HELD:
        places: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            places[word].append(i)
        return _Places(places)
    masks: dict[int, int] = defaultdict(int)
    for i, word in enumerate(words):
        masks[word] |= 1 << i
    return dict(masks)


def _code(word: bytes) -> int:
    """64 bits of a word, the same in every block of items."""
    return _digest(word, SEED)


_digest = xxhash.xxh3_64_intdigest


class Index:
    """A block of benchmark items, ready for search. items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.number: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall((text or "").lower())]
            if words:
                self.items.append((item_id, words, int(len(words) * (1 - similarity) + 1e-9)))
        self.raw_number = {word.encode("utf-8", "surrogatepass"): n for word, n in self.number.items()}
        # number -> code; the number 0 stands for no word
        self.codes = np.array([0, *map(_code, self.raw_number)], np.uint64)
        self.masks = [_masks(words) for _, words, _ in self.items]
        self.mirrored = [_masks(words[::-1]) for _, words, _ in self.items]
        classes = defaultdict(list)
        for i, (_, words, _) in enumerate(self.items):
            classes[window_of(len(words))].append(i)
        self.classes = [self._sketch(m, stride, members) for (m, stride), members in sorted(classes.items())]

    def _sketch(self, m: int, stride: int, members: list[int]):
        """What it takes to look up a window of m words: the walks, the sampled steps, the items' samples."""
        rng = np.random.default_rng((SEED, m))
        walks = rng.integers(0, 2**63, (WALKS, 2 * m), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        factors = rng.integers(0, 2**63, (WALKS, 2 * m), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        steps = min(STEPS, 2 * m)
        sampled = [[np.sort(rng.choice(2 * m, steps, replace=False)).tolist() for _ in range(SAMPLES)] for _ in range(WALKS)]
        starts, owners, text, ends = [], [], [], []
        for i in members:
            words = self.items[i][1]
            for offset in window_starts(len(words)):
                starts.append(len(text) + offset)
                owners.append((i, offset))
            text += words + [0]
            ends += [len(text) - 1] * (len(owners) - len(ends))
        sketch = {"m": m, "stride": stride, "walks": walks, "factors": factors, "sampled": sampled}
        sketch["owners"] = np.array(owners, np.int64)
        sketch["most"] = max(self.items[i][2] for i in members)
        tables = []
        for keys in self._samples(self.codes[text], np.array(starts, np.int32), np.array(ends, np.int32), sketch):
            order = np.argsort(keys, kind="stable")
            light = np.zeros(1 << 16, bool)
            light[(keys >> np.uint64(48)).astype(np.int64)] = True
            tables.append((keys[order], order.astype(np.int32), light))
        return sketch | {"tables": tables}

    def _samples(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sketch: dict) -> Iterator[np.ndarray]:
        """For each walk and sample, a 64-bit key of every window: the words it emits at the sampled steps.

        A walk of 2m steps stands on m words in the mean; at the end of its text (ends, a place without a word) it stays.
        """
        for turns, factors, sampled in zip(sketch["walks"], sketch["factors"], sketch["sampled"]):
            needed = {step for steps in sampled for step in steps}
            at = starts.copy()
            emitted = {}
            for step in range(max(needed) + 1):
                word = codes[at]
                if step in needed:
                    emitted[step] = word * factors[step]
                # the bit of (walk, step, word) is the top one of a multiple of the word's code
                at += (word * turns[step] >> np.uint64(63)).astype(np.int32)
                np.minimum(at, ends, out=at)
            for steps in sampled:
                keys = emitted[steps[0]].copy()
                for step in steps[1:]:
                    keys += emitted[step]
                yield (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)

    def candidates(self, text: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(item, start) rows, sorted: where in text an item may start; each document ends with a place without a word."""
        known = np.concatenate([[0], np.cumsum(text > 0)])
        sizes = bounds[1:] - bounds[:-1]
        found = [np.zeros((0, 2), np.int64)]
        for sketch in self.classes:
            m = sketch["m"]
            each = -(-sizes // sketch["stride"])
            docs = np.repeat(np.arange(len(sizes)), each)
            starts = bounds[docs] + (np.arange(len(docs)) - np.repeat(np.cumsum(each) - each, each)) * sketch["stride"]
            # every word that is no word of the benchmark costs an edit
            enough = known[np.minimum(starts + m, bounds[docs + 1])] - known[starts] >= m - sketch["most"]
            starts, ends = starts[enough].astype(np.int32), (bounds[docs + 1][enough] - 1).astype(np.int32)
            if not len(starts):
                continue
            for keys, (sorted_keys, order, light) in zip(self._samples(codes, starts, ends, sketch), sketch["tables"]):
                hit = np.flatnonzero(light[keys >> np.uint64(48)])
                low = np.searchsorted(sorted_keys, keys[hit], "left")
                count = np.searchsorted(sorted_keys, keys[hit], "right") - low
                several = np.repeat(np.arange(len(hit)), count)
                if not len(several):
                    continue
                within = np.arange(len(several)) - np.repeat(np.cumsum(count) - count, count)
                owner = sketch["owners"][order[low[several] + within]]
                found.append(np.stack([owner[:, 0], starts[hit[several]] - owner[:, 1]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, text: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of the best match of each item in each document that holds it.

        text, codes: word numbers and codes of the documents one after another, document k from bounds[k] to bounds[k + 1], each with
        a last place without a word.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        rows = self.candidates(text, codes, bounds)
        at = 0
        while at < len(rows):
            item, low = rows[at]
            _, words, most = self.items[item]
            masks = self.masks[item]
            n, high = len(words), low
            while at + 1 < len(rows) and rows[at + 1, 0] == item and rows[at + 1, 1] <= high + n:
                at += 1
                high = rows[at, 1]
            at += 1
            low, high = max(0, low - most), min(len(text), high + n + most)
            doc = int(np.searchsorted(bounds, low, "right")) - 1
            while doc < len(bounds) - 1 and bounds[doc] < high:
                a, b = max(low, bounds[doc]), min(high, bounds[doc + 1])
                part = text[a:b].tolist()
                # a word of the text that is no word of the item costs an edit, and so does a missing one
                if sum(map(masks.__contains__, part)) >= n - most:
                    distance, end = best_end(masks, n, part)
                    if distance <= most:
                        _, size = best_end(self.mirrored[item], n, part[:end][::-1], anchored=True)
                        start = int(a - bounds[doc]) + end - size
                        found = (distance, start, start + size)
                        key = (doc, int(item))
                        best[key] = min(found, best.get(key, found))
                doc += 1
        for (doc, item), found in sorted(best.items()):
            yield doc, item, *found

    def numbers(self, text: str | None) -> list[int]:
        """The numbers of the words of a text, 0 for words of no item."""
        get = self.raw_number.get
        return [get(word, 0) for word in words_of(text)]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, codes) of the words of a text and of the place without a word after them."""
        words = words_of(text)
        numbers = np.array([*map(self.raw_number.get, words, repeat(0)), 0], np.int32)
        codes = self.codes[numbers]
        foreign = np.flatnonzero(numbers[:-1] == 0)
        codes[foreign] = np.fromiter((_digest(words[i], SEED) for i in foreign.tolist()), np.uint64, len(foreign))
        return numbers, codes


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of letters and digits, lower case."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = OTHER_SIGN.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(SIGNS_TO_SPACE).split()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, words = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates().toLocalIterator():
        block.append((row[0], row[1]))
        words += sum(1 for _ in WORD.finditer(row[1] or "")) + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


_indexed: dict[str, Index] = {}


def _index(name: str, block: list[tuple[int, str]], similarity: float) -> Index:
    """The index of a block, made once in each worker process; only the last one is held."""
    if name not in _indexed:
        _indexed.clear()
        _indexed[name] = Index(block, similarity)
    return _indexed[name]


def matches(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start_word, end_word): the benchmark items found in the documents.

    An item of n words is in a document if a part of it is within floor((1 - similarity) * n) word edits; one row for each
    document and item tells the best such part (of equals the first), by word offsets. Items of fewer than 1 / (1 - similarity)
    words match exactly only, items without a word never. Null, empty and short texts hold nothing; rows that repeat give
    one row; null ids stay null. Items with equal texts are all told. Other columns are not read.
    """
    docs = whole_texts(docs)
    schema = "doc_id long, item_id long, distance int, n_words int, start_word int, end_word int"
    types = dict.fromkeys(("doc_id", "item_id"), pa.int64()) | dict.fromkeys(("distance", "n_words", "start_word", "end_word"), pa.int32())
    found = None
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, similarity)

            def searched(ids: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                bounds = np.concatenate([[0], np.cumsum([len(numbers) for numbers, _ in texts])])
                text, codes = (np.concatenate(parts) for parts in zip(*texts))
                rows = [
                    (ids[doc], index.items[item][0], distance, len(index.items[item][1]), start, end)
                    for doc, item, distance, start, end in index.search(text, codes, bounds)
                ]
                columns = zip(*rows) if rows else [()] * len(types)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

            ids, texts, words = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(doc_id)
                    texts.append(index.read(text.as_py()))
                    words += len(texts[-1][0])
                    if words >= TEXT_WORDS:
                        yield searched(ids, texts)
                        ids, texts, words = [], [], 0
            if texts:
                yield searched(ids, texts)

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.distinct()


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    return without(docs, matches(docs, items, similarity).select("doc_id").distinct())
