import re
from collections import Counter

from pyspark.sql import functions as F

from voucherlake.llm import quality_rules

DATA = "/root/testdata/sf0.01"


def plain(text):
    """The base measures by counting, one text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    copies = Counter(windows)
    covered = {j for i, w in enumerate(windows) if copies[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for doc in df.collect():
        row, want = rows[doc.doc_id], plain(doc.text)
        assert tuple(row[c] for c in quality_rules.BASE) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    assert all(row.kept for row, good in labels if good and not row.base_failed)
    assert not any(row.kept for row, good in labels if not good)


PROSE = "the old house stood near a river and nobody knew who had built it or why its doors were painted green "
UNLIKE = " ".join(f"{a}{b}" for a in ("river", "stone", "cloud", "grass", "night") for b in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"))
CASES = [
    (1, UNLIKE, True),
    (2, UNLIKE.upper(), False),
    (3, UNLIKE.replace(" ", " # "), False),
    (4, "\n".join([UNLIKE] + ["one line"] * 9 + ["two"]), False),
    (5, " ".join(f"{i}{i + 7}" for i in range(100, 180)), False),
    (6, "\n".join(f"{w}..." for w in UNLIKE.split()), False),
    (7, "\n".join(f"- {w}" for w in UNLIKE.split()), False),
    (8, UNLIKE.replace("a", "\x01\x02"), False),
    (9, " ".join(f"a{i:x}" * 9 for i in range(60)), False),
    (10, PROSE * 5, False),
    (11, "too short", False),
    (12, None, False),
    (13, "", False),
    (14, " \n\t ", False),
    (None, UNLIKE, True),
    (15, UNLIKE, True),
    (15, UNLIKE, True),
    (16, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(60_000)), True),
]


def test_each_rule_rejects_its_case(docs):
    df = docs([(i, t) for i, t, _ in CASES])
    for name in ("lines", "words", "kept", "n_words", "m", "windows", "starts"):
        df = df.withColumn(name, F.lit("clash"))
    found = quality_rules.judge(df)
    assert sorted((r.doc_id or 0, r.kept) for r in found.collect()) == sorted((i or 0, k) for i, _, k in CASES)
    assert sorted((r.doc_id or 0) for r in quality_rules.keep_good(df).collect()) == sorted((i or 0) for i, _, k in CASES if k)
    assert sorted((r.doc_id or 0) for r in found.where("kept and n_words > 10").collect()) == sorted((i or 0) for i, _, k in CASES if k)


def test_an_empty_table_and_no_rules(docs):
    assert quality_rules.judge(docs([])).collect() == []
    assert [r.kept for r in quality_rules.judge(docs([(1, UNLIKE.upper())]), rules={}).collect()] == [True]


def test_the_order_changes_no_verdict_and_follows_rejections_by_cost(docs, monkeypatch):
    df = docs([(i, t) for i, t, _ in CASES])
    rows = quality_rules.measured(df)
    for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):
        kept = rows.select("doc_id", quality_rules.verdict(order).alias("kept")).collect()
        assert sorted((r.doc_id or 0, r.kept) for r in kept) == sorted((i or 0, k) for i, _, k in CASES)
    clock = iter(range(10_000))
    monkeypatch.setattr(quality_rules.time, "perf_counter", lambda: next(clock))  # every rule costs the same
    rules = {"never": lambda c: c("n_words") < 0, "few": lambda c: c("doc_id") == 2, "most": lambda c: c("doc_id") <= 9, "rest": lambda c: c("doc_id") >= 9}
    shares = [(name, share) for name, _, share in quality_rules.ordered(rows.where("doc_id between 1 and 12"), rules)]
    assert shares == [("most", 9 / 12), ("rest", 1.0), ("never", 0.0), ("few", 0.0)]


def test_no_python_in_the_plan(docs):
    plan = quality_rules.judge(docs([(1, UNLIKE)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
