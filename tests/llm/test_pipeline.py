import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panewright.llm import bpe, mixing, queries
from panewright.llm.common import shared_dir


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    table = "embeddings" if name.startswith("op6") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert got.count() == n or name.startswith("op1_")


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    first = docs.orderBy("doc_id").first()
    extra = spark.createDataFrame([(top + 1, "12 34", "en", "src0", 5), (top + 2, None, None, None, 0), (top + 3, first.text.encode().upper().decode(), "en", "src1", first.n_chars), (top + 4, first.text + " end", "en", "src1", first.n_chars)], docs.schema)
    docs = docs.unionByName(extra).cache()
    out, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir).cache()
        out[name] = rows.collect()
    for name in ("language_id", "exact_dedup", "near_dedup", "mixing"):
        assert list(out[name][0].asDict()) == docs.columns
    ids = lambda name: {r.doc_id for r in out[name]}
    every = {r.doc_id: r for r in docs.collect()}
    assert set(every) - ids("language_id") == {i for i, r in every.items() if not any(c.isalpha() for c in r.text or "")}
    groups = {}
    for r in out["language_id"]:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text), []).append(r.doc_id)
    assert ids("exact_dedup") == {max(g) for g in groups.values()}
    assert first.doc_id not in ids("exact_dedup") and len(ids("near_dedup")) <= len(ids("exact_dedup"))
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(out["near_dedup"], docs.schema)).collect()}
    assert Counter(r.doc_id for r in out["mixing"]) == Counter({i: n for i, n in taken.items() if n})
    e = bpe.encoder(queries.tokenizer_file("word_bpe_49k.json"))
    want = Counter((r.doc_id, hashlib.sha256(" ".join(map(str, e.ids(r.text))).encode()).hexdigest()) for r in out["mixing"])
    assert Counter((r.doc_id, r.ids_sha256) for r in out["bpe"]) == want


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
