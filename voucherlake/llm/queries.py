"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.llm import bpe, chat, decontam, language, line_dedup, media, periodic, quality, quality_rules, simhash, url_filter, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words of the shortest run of lines that line dedup removes.
RUN_WORDS = 50
URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession):
    return bpe.share(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary(spark))


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.transcript(table(spark, sf_dir, "conversations"))
    return chat.turns(raw, chat.fit(raw))


BASE32_SQL = " || ".join(
    f"substr('{warc.ALPHABET}', ((CAST('0x' || substr(s, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)


@query(
    "op4_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
    SELECT page_id, n AS payload_bytes, {BASE32_SQL} AS payload_digest,
      CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> f THEN f END AS refers_to FROM q""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


@query("op5_media")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op9_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, lines, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
    w AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY line) AS copies
          FROM (SELECT *, len(regexp_extract_all(line, '\\S+')) AS words FROM l)),
    r AS (SELECT * FROM w WHERE copies > 1),
    ends AS (SELECT a.doc_id, a.lines, a.i, min(b.i) AS e
             FROM r a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - (a.upto - a.words) >= {RUN_WORDS} GROUP BY ALL),
    nexts AS (SELECT a.doc_id, a.lines, a.i, a.e,
                     (SELECT min(b.i) FROM w b WHERE b.doc_id = a.doc_id AND b.i > a.i AND b.upto - v.upto >= {RUN_WORDS}) AS f
              FROM ends a JOIN w v ON v.doc_id = a.doc_id AND v.i = a.i),
    spans AS (SELECT doc_id, lines, i, unnest(range(e, greatest(e, coalesce(f - 1, len(lines) - 1)) + 1)) AS e FROM nexts),
    keyed AS (SELECT doc_id, i, e, min((doc_id, i)) OVER (PARTITION BY lines[i + 1 : e + 1]) AS first FROM spans),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM keyed WHERE first <> (doc_id, i)),
    kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
    SELECT d.doc_id, len(d.lines) AS n_lines, coalesce(c.n, 0) AS removed_lines, coalesce(k.text, '') AS text
    FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) c USING (doc_id)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), RUN_WORDS)
    return cleaned.select("doc_id", "n_lines", "removed_lines", "text")


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32(doc_id), h % 10 = 0 and g = h / 10, words from number g % n on repeat with a period by g."""
    seed = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(seed / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        return F.struct(words.alias("words"), first.alias("a"), (F.floor((n - first) / (3 + g % 8)) + 1).cast("int").alias("p"))

    def written(v: Column) -> Column:
        words, a, p = v["words"], v["a"], v["p"]
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, a + (i - a) % p)).otherwise(w)), " ")

    def let(value: Column, function: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), function), 0)

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    changed = let(words, lambda w: F.when(F.size(w) > 0, let(repeated(w), written)))
    return docs.select("doc_id", F.when(seed % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_repeats(table(spark, sf_dir, "documents"))
    return periodic.described(periodic.periodic_runs(docs, digest=True))


@query(
    "op13_quality_rules",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    places AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i,
                      unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x FROM w),
    windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS copies FROM places),
    covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE copies > 1) GROUP BY r),
    m AS (SELECT doc_id, t, ls, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
          FROM w LEFT JOIN covered USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed
        OR NOT (word_chars / n_words BETWEEN 2.5 AND 15)
        OR 10 * n_symbols > n_words
        OR 2 * n_dup_lines > len(ls)
        OR 10 * length(regexp_replace(t, '\P{L}+', '', 'g')) < 7 * word_chars
        OR 10 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 4 * word_chars
        OR len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) / greatest(len(ls), 1) > 0.3
        OR len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣●]'))) / greatest(len(ls), 1) > 0.9
        OR 100 * (length(t) - length(regexp_replace(t, '[\x00-\x08\x0E-\x1F\x{FFFD}]+', '', 'g'))) > word_chars) AS kept
    FROM b""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))
