"""Media columns: documents as ordered sequences of texts and media references, payloads resolved by digest.

HTML gives one row per text or image, in reading order, a figure's caption beside its image. Payloads lie once or more in
a media table keyed by digest; whatever is computed from them is computed there, so that only small rows are shuffled.
A payload is stored as a binary portable pixmap: eight-bit samples, 64 pixels of three samples in a row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import small, staged, whole_texts
from voucherlake.session import fresh_path

#: Bytes of one row of pixels; a payload is padded with blanks to a positive multiple.
ROW_BYTES = 192
#: References to one digest beyond which they are not shuffled by digest; words of a document's caption.
HOT, CAPTION_WORDS = 1000, 8
_HEADER = re.compile(rb"P6\n64 (\d+)\n255\n")
_SILENT = {"script", "style", "template", "noscript"}
_BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())


class SequenceParser(HTMLParser):
    """Collects [kind, text, reference, caption, attributes] in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure = -1
        self.silent = 0

    def flush_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None, {}])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS:
            self.flush_text()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.flush_text()
            self.caption = []
        if tag == "img":
            self.flush_text()
            named = {k: v or "" for k, v in attrs}
            self.items.append(["media", None, named.pop("src", None), named.pop("alt", None) or None, named])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCKS:
            self.flush_text()
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[max(0, self.figure) :] if self.figure >= 0 else self.items[-1:]:
                if item[0] == "media" and text:
                    item[3] = text
        if tag == "figure":
            self.figure = -1

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[list]:
    parser = SequenceParser()
    parser.feed(html or "")
    parser.close()
    parser.flush_text()
    return parser.items


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, position, kind, text, digest, caption, attributes): the texts and images of every page, in order.

    position counts from 0 in a page. An image's reference `sha256:<hex>` gives its digest (any other reference a null one);
    its caption is that of its figure, else its alt text. Scripts and styles are no text. A null, empty or broken page
    gives what can be read, maybe no row. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, kind, text, ref[7:] if ref and ref.startswith("sha256:") else None, caption, named)
                for page, html in zip(batch["page_id"].astype("Int64"), batch["html"])
                for i, (kind, text, ref, caption, named) in enumerate(parse(html))
            ]
            columns = ["page_id", "position", "kind", "text", "digest", "caption", "attributes"]
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype({"page_id": "Int64", "position": "int32"})

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, position int, kind string, text string, digest string, caption string, attributes map<string,string>"
    return slim.mapInPandas(run, schema)


def padded(payload: Column) -> Column:
    size = F.greatest(F.lit(ROW_BYTES), F.ceil(F.length(payload) / ROW_BYTES).cast("int") * ROW_BYTES)
    return F.rpad(payload, size, F.lit(b" "))


def pixmap(payload: Column) -> Column:
    """The stored form of a payload whose length is a positive multiple of ROW_BYTES."""
    height = (F.length(payload) / ROW_BYTES).cast("int").cast("string")
    return F.concat(F.encode(F.concat(F.lit("P6\n64 "), height, F.lit("\n255\n")), "UTF-8"), payload)


def samples(media: bytes) -> bytes:
    """The payload of a stored pixmap."""
    found = _HEADER.match(media)
    if not found or len(media) != found.end() + int(found[1]) * ROW_BYTES:
        raise ValueError("no pixmap of 64 pixels in a row")
    return media[found.end() :]


def feature(payload: bytes) -> str:
    """Height, mean of each channel in thousandths, and 64 bits that tell which column is brighter than the next."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    totals = pixels.sum(axis=(0, 1), dtype=np.int64) * 1000 // (len(pixels) * 64)
    columns = pixels.sum(axis=(0, 2), dtype=np.int64)
    bits = np.packbits(columns > np.roll(columns, -1)).tobytes().hex()
    return f"{len(pixels)}:{totals[0]}.{totals[1]}.{totals[2]}:{bits}"


def described(media: DataFrame) -> DataFrame:
    """One row per digest of the media table (digest, media), with what is known of its payload.

    Computed where the payloads lie; of copies, which agree, one row remains.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch["digest"], batch["media"]):
                payload = samples(stored)
                rows.append((
                    digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), feature(payload),
                ))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "media").mapInPandas(run, schema).dropDuplicates(["digest"])


def resolve(items: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of sequences() with the columns of `known` (one row per digest); positions and captions stay beside them.

    A text, or a reference to a digest that is not known, has nulls there. References are counted by digest first: those to a
    digest with more than HOT of them are not shuffled to one task, if what is known of these digests measures small enough to
    be broadcast. items is read twice.
    """
    counted = items.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"))
    hot = staged(counted.where(F.col("copies") > HOT).select("digest"), "hot")
    if not hot.take(1):
        return items.join(known, "digest", "left")
    shared = small(staged(known.join(small(hot), "digest", "left_semi"), "shared"), row_bytes=512)
    often = items.join(small(hot), "digest", "left_semi").join(shared, "digest", "left")
    return items.join(small(hot), "digest", "left_anti").join(known, "digest", "left").unionByName(often)


def _illustrated(text: Column, image: Column) -> Column:
    """A page of the paragraphs (lines) of a text with a figure after the first one, whose caption is the text's first words."""
    safe = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))

    def of(lines: Column) -> Column:
        rest = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), "")
        caption = F.array_join(F.slice(F.split(F.trim(F.get(lines, 0)), " "), 1, CAPTION_WORDS), " ")
        return F.concat(
            F.lit("<p>"), F.get(lines, 0), F.lit("</p><figure>"), image, F.lit("<figcaption>"), caption, F.lit("</figcaption></figure>"), rest
        )

    return F.get(F.transform(F.array(F.split(safe, "\n")), of), 0)


def document_media(docs: DataFrame) -> DataFrame:
    """Stores every text as a pixmap, sets the image among the text's own paragraphs, and resolves the reference there.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption) of every row
    of docs (doc_id, text): what is known of the stored image, and where it stands in the sequence of the page's texts and
    media. A null text is empty: its page is the image alone. Equal texts have equal values; a repeated or null doc_id keeps its
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = whole_texts(docs).select(F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.encode("text", "UTF-8")
    keyed = texts.select("page_id", "text", raw.alias("raw")).select("page_id", "text", F.length("raw").alias("n"), padded(F.col("raw")).alias("payload"))
    path = fresh_path(spark, "media")
    stored = keyed.select(F.sha2("payload", 256).alias("digest"), pixmap(F.col("payload")).alias("media"))
    stored.write.option("compression", "zstd").parquet(path)
    image = F.concat(F.lit('<img data-bytes="'), F.col("n").cast("string"), F.lit('" src="sha256:'), F.sha2("payload", 256), F.lit('">'))
    items = sequences(keyed.select("page_id", _illustrated(F.col("text"), image).alias("html"))).where("kind = 'media'")
    known = described(spark.read.schema(stored.schema).parquet(path))
    return resolve(staged(items, "references"), known).select(
        F.col("page_id").alias("doc_id"), F.col("attributes")["data-bytes"].cast("long").alias("n_bytes"),
        "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption",
    )
