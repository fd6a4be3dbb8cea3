import random
import re

import numpy as np

from voucherlake.llm import line_dedup, simhash
from voucherlake.llm.components import components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    chain = list(range(0, 200))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(200)} == {0}
    assert {found[1000 + i] for i in range(300)} == {1000}
    assert found[5000] == 5000 and len(found) == 501


def test_cells_meet_at_any_depth():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 3, 4, 5)]
    codes = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {(int(a), int(b)) for a in codes for b in codes if a < b and int(a ^ b).bit_count() <= 4}
    for bits, limit in ((4, 1 << 21), (6, 2000)):
        before, simhash.VARIANTS_AT_ONCE = simhash.VARIANTS_AT_ONCE, limit
        parent = {int(c): int(c) for c in codes}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for cell in range(1 << bits):
            flips = np.bitwise_count((codes >> np.uint64(64 - bits)) ^ np.uint64(cell))
            for a, b in zip(*simhash._join_cell(codes[flips <= 2], cell, bits, 2)):
                assert root(int(a)) == root(int(b)) or parent.update({root(int(a)): root(int(b))}) is None
        simhash.VARIANTS_AT_ONCE = before
        assert all(root(a) == root(b) for a, b in want)
        assert len({root(int(c)) for c in codes}) == len(codes) - len({(root(a), max(a, b)) for a, b in want} & set()) - _merged(codes, want)


def _merged(codes, links):
    parent = {int(c): int(c) for c in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = 0
    for a, b in links:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            n += 1
    return n


def test_crowded_cells_are_dealt_further(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    codes = sorted({base ^ sum(1 << int(k) for k in rng.choice(60, 3, replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(c,) for c in codes], "fingerprint long")
    want = _merged([c for c in codes], {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 4})
    found = components(simhash.links(df, 4, cell_rows=20)).collect()
    assert len({r.component for r in found}) == len(found) - want


def test_near_duplicates_against_all_pairs(docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        rows.append((3 * i, " ".join(text)))
        text[rng.randrange(len(text))] = "changed"
        rows.append((3 * i + 1, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "Über ÜBER"), (904, "über ÜBER")]
    codes = {i: simhash.fingerprint(t, 4) for i, t in rows}
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    assert all(found[i].fingerprint == f"{code:016x}" for i, code in codes.items())
    component = {i: i for i in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if (codes[a] ^ codes[b]).bit_count() <= 4 and component[a] > component[b]:
                    component[a], changed = component[b], True
    assert {i: found[i].component_id for i in codes} == component
    assert found[903].fingerprint != found[904].fingerprint  # A-Z only are lowered


def plain_dedup(rows, least):
    """Every run of `least` words or more that stands earlier, by brute force over all runs."""
    first, out = {}, {}
    for i, text in rows:
        lines = text.split("\n")
        counts = [len(re.findall(r"\S+", line)) for line in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(counts[a:b]) >= least:
                    run = tuple(lines[a:b])
                    if run in first and first[run] != (i, a):
                        gone |= set(range(a, b))
                    first.setdefault(run, (i, a))
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def test_line_runs_against_brute_force(docs):
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randint(0, 5)}" for _ in range(rng.randint(0, 6))) for _ in range(7)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    for least in (1, 6, 12):
        found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows), least).collect()}
        assert found == plain_dedup(rows, least)


def test_repeated_run_inside_one_document_and_repeated_rows(docs):
    rows = [(1, "a b c\nd e f\n" * 5 + "end"), (2, "q r s t"), (2, "q r s t"), (3, "q r s t")]
    found = {(r.doc_id, r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs(rows), 4).collect()}
    assert found == {(1, "a b c\nd e f\nend", 8), (2, "q r s t", 0), (3, "", 1)}
    kept = line_dedup.without_repeats(docs(rows), 4).collect()
    assert sorted((r.doc_id, r.n_chars) for r in kept) == [(1, 15), (2, 7), (2, 7)]
