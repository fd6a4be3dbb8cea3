import hashlib

import __spark_entry__ as entry
import corpus_pipeline
from test_dedup import plain_dedup
from test_shingles import plain_components
from test_text import reference

from voucherlake.llm import decontam, quality

DATA = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    """Each stage by a plain rule over the rows the one before kept; the scorer and the search give decisions, not rows."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in quality.score(df).where("keep").collect()}
    rows = sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id in kept)
    rows = sorted((i, t) for i, t in plain_dedup(rows, 50).items() if t or not dict(rows)[i])
    component, _ = plain_components(rows)
    rows = [(i, t) for i, t in rows if component[i] == i]
    index = decontam.Index(items, 0.8)

    def holds(text):
        words = index.numbers(text)
        return any(decontam.best_end(m, len(w), words)[0] <= most for m, (_, w, most) in zip(index.masks, index.items))

    library = reference()
    want = set()
    for i, text in rows:
        if not holds(text):
            ids = library.encode_ordinary(text)
            packed = b"".join(n.to_bytes(4, "little") for n in ids)
            want.add((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert found == want and len(found) > 100


def test_stages_and_registration(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokenise"]
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).dtypes == docs.dtypes
