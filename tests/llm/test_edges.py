"""Every operator and every stage over nulls, odd texts, repeated rows and empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airtide.llm import (
    language_id,
    license_scan,
    lm_scoring,
    packing,
    pieces,
    quality_rules,
    secret_scan,
    simhash,
    topk,
    warc_archive,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

PER_DOCUMENT = {
    "lm_scoring": lambda docs: lm_scoring.score(docs, lm_scoring.fold_of(F.col("doc_id"))),
    "license_scan": license_scan.find_licenses,
    "secret_scan": secret_scan.find_secrets,
    "redact": secret_scan.redact,
    "pieces": lambda docs: pieces.encode(docs, model=PIECES),
    "quality_rules": quality_rules.judge,
    "language_id": lambda docs: language_id.predict(docs, language_id.train(docs)),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_every_document(name, odd_documents):
    assert PER_DOCUMENT[name](odd_documents).count() == odd_documents.count()


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_no_row_for_no_document(name, no_documents):
    assert PER_DOCUMENT[name](no_documents).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_over_odd_documents(spark, name, stage, odd_documents):
    out = stage(spark, odd_documents, "")
    if name != "packing":
        assert out.columns == odd_documents.columns
        assert {r["words"] for r in out.select("words").collect()} <= {"own words"}
    assert out.count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_over_no_documents(spark, name, stage, no_documents):
    assert stage(spark, no_documents, "").count() == 0


def test_packing_places_every_odd_document(odd_documents):
    out = packing.pack(odd_documents, tokenizer=BPE).toPandas()
    assert out["doc_tokens"].min() == 1
    tokens = odd_documents.count()  # an end for each, and the text's own
    assert out["length"].sum() > tokens
    assert (out["source"].isna()).any()


def test_archive_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, None, "x" * 200), (2, "a\r\nb: c", None), (3, "v", "")],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("own"))
    archive = warc_archive.write_archive(pages)
    out = warc_archive.read_records(archive).toPandas()
    assert len(out) == 5
    long = out[out["payload_bytes"] == 200]
    assert sorted(long["record_type"]) == ["response", "revisit", "revisit"]
    assert set(long[long["record_type"] == "revisit"]["refers_to"]) == {1}
    assert archive.payloads.count() == 2
    assert "a%0D%0Ab: c" in set(out["url"])
    assert warc_archive.read_records(warc_archive.write_archive(pages.limit(0))).count() == 0


def test_search_with_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.5], 0),
        (20, [1.0], 0),
        (20, [1.0], 0),
        (1, None, 0),
        (2, [float("nan"), 1.0], 0),
        (3, [None, 1.0], 0),
        (4, [float("inf"), 1.0], 0),
        (None, [9.0, 9.0], 0),
        (5, [0.5, 0.5], 0),
        (6, [0.5, 0.5], 0),
        (7, [], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = topk.top_k(table, F.col("id") % 20 == 0).collect()
    of_first = [(r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 0]
    assert sorted(of_first) == [(1, 20, 4096), (2, 20, 4096), (3, 5, 3072), (4, 6, 3072), (5, 7, 0)]
    assert sum(r["query_id"] == 20 for r in out) == 2 * 4
    assert topk.top_k(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_near_dedup_keeps_one_of_repeated_rows(odd_documents):
    kept = simhash.deduplicate(odd_documents).collect()
    assert sum(r["doc_id"] == 1 for r in kept) == 1
    assert sum((r["text"] or "").strip() == "" for r in kept) == 1  # all without a word
