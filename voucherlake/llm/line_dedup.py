"""Removal of repeated line runs: a suffix array over line ids by prefix doubling, as joins and windows only.

A position is (document, line). Rank 0 of a position is the rank of its line among all lines that occur twice;
rank k orders positions by their next 2^k lines and comes from the pair (rank k-1 here, rank k-1 at 2^(k-1) further on).
Positions that are alone with their prefix fall out, for nothing longer from there repeats. Positions that agree in their
next n lines are one interval of the suffix array with a longest common prefix of n or more; two overlapping ranks of
2^k <= n lines name it. The first position of an interval stays, the run at every later one goes.

Of all repeated runs with at least min_words words only the shortest from each start and to each end are looked up:
together they cover every maximal run, line by line, and there are at most two per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.llm.staging import free_name, small, staged

DOC = ["doc", "hash"]
PLACE = [*DOC, "line"]


def _ranked(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys with `rank`, which grows with the key: ranges are sorted apart, numbers start anew in each."""
    dealt = keys.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    return staged(dealt.withColumn("rank", F.monotonically_increasing_id()), name)


def _place() -> Column:
    return F.struct(*PLACE)


def line_places(docs: DataFrame) -> DataFrame:
    """(doc, hash, line, id1, id2, words) of every line; a row that repeats id and text is the same document."""
    slim = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    lines = slim.select("doc", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select(
        *PLACE,
        F.xxhash64("t").alias("id1"),
        F.xxhash64(F.lit(1), "t").alias("id2"),
        F.regexp_count("t", F.lit(r"\S+")).alias("words"),
    )


def _shortest_runs(places: DataFrame, min_words: int) -> DataFrame:
    """(doc, hash, line, n, rank): the shortest runs of min_words words from each start, and to each end, of repeated lines."""
    by_doc = Window.partitionBy(*DOC).orderBy("line")
    stretch = Window.partitionBy(*DOC, "stretch")
    upto = stretch.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        places.withColumn("stretch", F.col("line") - F.row_number().over(by_doc))
        .withColumn("to_here", F.sum("words").over(upto))
        .withColumn("last", F.max("line").over(stretch) + 1)
    )
    # A start asks for the first end with so many words: ends and starts in one falling order, ends first.
    marks = F.array(
        F.struct(F.col("to_here").alias("at"), F.lit(0).alias("asks"), (F.col("line") + 1).alias("end")),
        F.struct((F.col("to_here") - F.col("words") + min_words).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("end")),
    )
    falling = stretch.orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        summed.select(*PLACE, "stretch", "rank", "last", F.explode(marks).alias("m"))
        .select(*PLACE, "stretch", "rank", "last", "m.*")
        .withColumn("end", F.min("end").over(falling))
        .where("asks = 1")
    )
    following = F.lead("end").over(stretch.orderBy("line"))
    reach = starts.withColumn("most", F.greatest("end", F.coalesce(following - 1, "last"))).where("end is not null")
    return reach.select(*PLACE, "rank", F.explode(F.sequence(F.col("end") - F.col("line"), F.col("most") - F.col("line"))).alias("n"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, hash, line, n): runs of n lines from `line` on whose first copy stands earlier, by (doc, hash, line)."""
    places = staged(line_places(docs), "lines")
    twice = places.groupBy("id1", "id2").agg(F.count("*").alias("copies")).where("copies > 1")
    ranks = _ranked(twice, ["id1", "id2"], "rank")
    known = places.join(ranks, ["id1", "id2"]).select(*PLACE, "words", "rank")
    known = staged(known.repartition(*DOC).dropDuplicates(PLACE), "places")
    runs = staged(_shortest_runs(known, min_words), "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    known = known.select(*PLACE, "rank")
    later = []
    k = 0
    while 1 << k <= longest:
        if k:
            ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(1 << (k - 1), 1 << (k - 1))
            pairs = known.withColumn("then", F.first("rank").over(ahead)).where("then is not null")
            pairs = staged(pairs.withColumnRenamed("rank", "now"), "pairs")
            twice = pairs.groupBy("now", "then").agg(F.count("*").alias("copies")).where("copies > 1")
            known = staged(pairs.join(_ranked(twice, ["now", "then"], "rank"), ["now", "then"]).select(*PLACE, "rank"), "places")
        wanted = runs.where(F.col("n").between(1 << k, (2 << k) - 1)).drop("rank")
        second = known.select(*[F.col(c).alias(f"{c}2") for c in PLACE], F.col("rank").alias("rank2"))
        same_doc = F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("hash") == F.col("hash2"))
        first = known.select(*[F.col(c).alias(f"{c}1") for c in PLACE], F.col("rank").alias("rank1"))
        here = F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("hash") == F.col("hash1")) & (F.col("line") == F.col("line1"))
        named = wanted.join(first, here).join(second, same_doc & (F.col("line") + F.col("n") - (1 << k) == F.col("line2")))
        later.append(staged(named.select(*PLACE, "n", "rank1", "rank2"), "named"))
        k += 1
    if not later:
        return runs.select(*PLACE, "n").limit(0)
    named = later[0]
    for part in later[1:]:
        named = named.unionByName(part)
    interval = ["n", "rank1", "rank2"]
    firsts = named.groupBy(*interval).agg(F.min(_place()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # written first: counted before the shuffle, and the join of a frequent interval can be split
    return named.join(staged(firsts.drop("copies"), "firsts"), interval).where(_place() != F.col("first")).select(*PLACE, "n")


def removed_ranges(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, hash, ranges, removed): the merged line ranges (start, end exclusive) that go, in order, and their lines."""
    runs = repeated_runs(docs, min_words).select(*DOC, F.col("line").alias("start"), (F.col("line") + F.col("n")).alias("end"))
    before = Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    merged = (
        runs.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(upto))
        .groupBy(*DOC, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return merged.groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("removed")
    )


def _cleaned(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """docs with one more column, of the name told: the struct (text, n_lines, removed_lines)."""
    ranges = removed_ranges(docs, min_words)
    ranges = small(staged(ranges, "ranges"), 16 * F.size("ranges"))  # else every text would be shuffled
    cut, key = free_name(docs, "cut"), free_name(docs, "text_hash")
    found = ranges.select(F.struct(*DOC).alias(key), F.struct("ranges", "removed").alias(cut))
    text = F.col("text").cast("string")
    same = F.col("doc_id").eqNullSafe(F.col(key)["doc"]) & (F.xxhash64(text) == F.col(key)["hash"])
    joined = docs.join(found, same, "left")
    ranges, removed = F.col(cut)["ranges"], F.col(cut)["removed"]
    lines, gaps = F.split(text, "\n"), F.size(ranges)

    def rest(lines: Column) -> Column:
        kept = F.transform(
            F.sequence(F.lit(0), gaps),
            lambda i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["end"]).alias("start"),
                F.when(i == gaps, F.size(lines)).otherwise(F.get(ranges, i)["start"]).alias("end"),
            ),
        )
        return F.array_join(F.flatten(F.transform(kept, lambda r: F.slice(lines, r["start"] + 1, r["end"] - r["start"]))), "\n")

    # the text is cut once: a lambda's argument is computed once, a column used twice may be computed twice
    after = F.when(removed.isNull(), text).otherwise(F.get(F.transform(F.array(lines), rest), 0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    told = F.struct(after.alias("text"), n_lines.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("int").alias("removed_lines"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], told.alias(cut)), cut


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with the later copies of repeated line runs taken out of `text`, and n_lines and removed_lines added.

    A run is a sequence of whole lines (parted by newline) inside one document with at least min_words words of
    non-space characters; it goes wherever an equal run stands earlier in the order of (doc_id, hash of the text, line),
    so one copy of every line always stays. A document whose lines all go has the empty text. A null text stays null with
    no lines; an empty text is one empty line. Rows that repeat doc_id and text are one document and change alike; a null
    doc_id is the first. Other columns stay as they are, but for former ones called n_lines and removed_lines.
    """
    cleaned, cut = _cleaned(docs, min_words)
    own = [F.col(cut)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "removed_lines")]
    return cleaned.select(*own, F.col(cut)["n_lines"].alias("n_lines"), F.col(cut)["removed_lines"].alias("removed_lines"))


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The columns of docs, texts without repeated runs, n_chars to match; documents that lost every line go."""
    cleaned, cut = _cleaned(docs, min_words)
    new = F.col(cut)
    changed = {"text": new["text"], "n_chars": F.when(new["removed_lines"] > 0, F.length(new["text"])).otherwise(F.col("n_chars") if "n_chars" in docs.columns else None)}
    kept = cleaned.where(~((new["removed_lines"] > 0) & (new["removed_lines"] == new["n_lines"])))
    return kept.select(*[changed[c].cast(kind).alias(c) if c in changed else F.col(f"`{c}`") for c, kind in docs.dtypes])
