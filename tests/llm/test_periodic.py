import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voucherlake.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """All runs by counting, for every period, how far words agree with those a period on; a divisor's run wins."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
    )


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_the_query_against_brute_force(spark):
    want = [plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = [tuple(r) for r in queries.op12(spark, DATA).collect()]
    assert order(found) == order(want) and sum(r[1] > 0 for r in want) > 10


def made(rng, n, letters):
    """Words with repeated stretches of many lengths and periods, runs inside runs, and runs side by side."""
    words = []
    while len(words) < n:
        period = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 100]))]
        if rng.random() < 0.3:
            period = period[: max(1, len(period) // 4)] * 4 + period
        words += (period * 12)[: int(len(period) * rng.choice([1, 2, 2.9, 3, 3.1, 4.5, 8]))]
        words += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
    return words[:n]


@pytest.mark.parametrize("tile_words", [1, 200, 1 << 14])
def test_made_texts_against_brute_force(docs, tile_words):
    """Runs at every place of a tile, tiles of one boundary and of many; brute force knows nothing of tiles."""
    rng = random.Random(12)
    rows = [(i, " ".join(made(rng, rng.choice([20, 24, 60, 200, 700, 1500]), rng.choice([1, 2, 3, 50])))) for i in range(60)]
    rows += [(60, "a " * 1000), (61, "a b " * 300 + "c " + "a b " * 300), (62, "q " * 24), (63, "q " * 23)]
    found = {r.doc_id: r for r in periodic.periodic_runs(docs(rows), tile_words=tile_words).collect()}
    runs = 0
    for i, text in rows:
        words = text.split()
        want = plain_runs(words)
        assert [tuple(x) for x in found[i].runs] == want, i
        assert found[i].collapsed == plain_collapsed(words, want) and found[i].n_words == len(words)
        runs += len(want)
    assert runs > 100


def test_other_lengths(docs):
    rng = random.Random(5)
    rows = [(i, " ".join(made(rng, 300, 2))) for i in range(10)]
    for least, times in ((3, 3), (10, 4), (50, 3)):
        for r in periodic.periodic_runs(docs(rows), least, times).collect():
            assert [tuple(x) for x in r.runs] == plain_runs(rows[r.doc_id][1].split(), least, times), (least, times)


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        word = [rng.randrange(2) for _ in range(rng.randrange(20))]
        want = [next((k for k in range(len(word) - i) if word[k] != word[i + k]), len(word) - i) for i in range(len(word))]
        assert periodic.z_function(word) == want


def test_odd_rows(docs):
    rows = [(None, None), (None, "a b c"), (None, "x y " * 20), (1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "z " * 30), (5, "z " * 30)]
    rows += [(6, "é è " * 12 + "é\x1cè " * 12)]
    df = docs(rows)
    for name in ("key", "runs", "open", "stride", "ids", "period", "start", "n_words", "collapsed"):
        df = df.withColumn(name, F.lit("clash"))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()]
    want = [(i, *of((t or "").encode().split())) for i, t in rows]
    assert order(found) == order(want)
    assert periodic.periodic_runs(docs([])).collect() == []


def of(words):
    words = [w.decode() for w in words]
    runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
    return len(words), runs, plain_collapsed(words, runs)
