"""Every operator on nulls in all columns, empty and blank texts, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voucherlake.llm import bpe, chat, decontam, language, line_dedup, media, quality, queries, shingles, simhash, url_filter, warc

ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, "  \n "), (4, "word " * 3_000), (5, "x" * 5_000), (5, "x" * 5_000)]
CLASHES = ["key", "hash", "rank", "words", "component_id", "__kept", "first", "ids", "rule", "digest", "line", "n_lines", "pattern"]


def odd(docs):
    df = docs(ODD)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


OPERATORS = {
    "bpe": lambda df: bpe.digests(df, bpe.share(df.sparkSession, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)),
    "quality": quality.score,
    "keep_good": quality.keep_good,
    "simhash": simhash.near_duplicates,
    "keep_one": shingles.keep_one,
    "lines": lambda df: line_dedup.dedup_lines(df, 3),
    "without_repeats": lambda df: line_dedup.without_repeats(df, 3),
    "matches": lambda df: decontam.matches(df, df.select(F.col("doc_id").alias("item_id"), "text")),
    "clean": lambda df: decontam.clean(df, df.select(F.col("doc_id").alias("item_id"), "text").where("item_id = 4")),
    "language": language.identify,
    "media": media.document_media,
    "sequences": lambda df: media.sequences(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))),
    "urls": lambda df: url_filter.judge(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), queries.URL_RULES),
    "warc": lambda df: warc.round_trip(df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))),
    "chat": lambda df: chat.turns(
        df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("line_no"), F.col("text").alias("line")), chat.Model({})
    ),
}
SAME_COUNT = {"bpe", "quality", "simhash", "lines", "language", "media", "urls", "warc"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    rows = OPERATORS[name](odd(docs)).collect()
    if name in SAME_COUNT:
        assert len(rows) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs([])).collect() == []


def test_filters_keep_all_columns(docs):
    df = odd(docs)
    for name in ("keep_good", "keep_one", "without_repeats", "clean"):
        assert OPERATORS[name](df).columns == df.columns, name
