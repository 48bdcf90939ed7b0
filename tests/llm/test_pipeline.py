"""The pipeline and the registered queries against plain versions, on the smallest tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from airtide.llm import language_id, queries
from airtide.plans.staging import stage
from tests.llm.test_operators import brute_groups, brute_print
from tests.oracle_check import as_rows, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage made of them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), f"test-{name}")
        out[name] = docs
    return out


def rows_of(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def plain_line_passes(line):
    ends = re.search(r"[.!?…。！？।؟۔։።၊။។༎][\"'”’»)\]」』]*[ \t-\r]|[.!?…。！？।؟۔։።၊။។༎:;\"'”’»)\]」』][ \t-\r]*$", line)
    ends = ends or re.search("[฀-࿿က-႟ក-៿]", line)
    link = re.match(
        r"(?i)[ \t-\r]*(home|menu|next|previous|back to top|sign in|sign up|log ?in|log ?out|read more"
        r"|skip to content|share this|contact us|about us|site ?map)\W*$", line, re.A)  # fmt: skip
    n = sum(line.count(c) for c in "|›•→") + len(re.findall("[ \t-\r]·[ \t-\r]", line))
    if "«" not in line:
        n = len(re.findall("[|›•→]|[ \t-\r][·»][ \t-\r]", line))
    menu = n >= 2 and len(line) <= 24 * (n + 1)
    phrases = re.findall(
        r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript"
        r"|lorem ipsum|click here|subscribe to our|accept (?:all )?cookies)\b", line)  # fmt: skip
    symbols = sum(c in "#*$%&|<>" for c in line)
    return bool(ends) and not link and not menu and 3 * sum(map(len, phrases)) <= len(line) and symbols <= 0.1 * len(line)


def plain_clean(text):
    """The lines that pass, or None if the document goes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    passing = [x for x in lines if plain_line_passes(x)]
    lost = 1 - sum(map(len, passing)) / sum(map(len, lines))
    return "\n".join(passing) if lost <= 0.5 else None


def test_quality_stage(stages):
    plain = {i: plain_clean(r["text"] or "") for i, r in rows_of(stages["documents"]).items()}
    kept = {i: r["text"] for i, r in rows_of(stages["quality_rules"]).items()}
    assert kept == {i: t for i, t in plain.items() if t is not None}
    assert 0 < len(kept) < len(plain)


def test_language_stage(stages):
    before, after = rows_of(stages["quality_rules"]), rows_of(stages["language_id"])
    model = language_id.train(stages["quality_rules"])
    found = model.predict([r["text"] for r in before.values()])
    expected = {i for i, (lang, _, score) in zip(before, found) if lang != "und" and score >= 0.25}
    assert set(after) == expected
    assert all(after[i] == before[i] for i in after)


def test_language_stage_rejects_texts_without_language(spark, documents):
    prose = "Plain words in a plain order, over and over, about the house and the garden."
    docs = documents((1, prose, "en", "a"), (2, "12 34 -- 56 78.", "en", "a"), (3, None, "en", "a"))
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SMALL).collect()} == {1}


def test_dedup_stage(stages):
    before, after = rows_of(stages["language_id"]), rows_of(stages["simhash_near_dedup"])
    prints = {i: brute_print(r["text"]) for i, r in before.items()}
    groups = brute_groups(sorted(set(prints.values())), 4)
    first = {min(i for i, p in prints.items() if p in group) for group in groups}
    assert set(after) == first and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_secrets_stage(stages):
    before, after = rows_of(stages["simhash_near_dedup"]), rows_of(stages["secret_scans"])
    assert set(before) == set(after)
    secret = re.compile(
        r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}"
        r"|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", re.I | re.A)  # fmt: skip
    for i, r in after.items():
        for marked in re.split("<(?:assign|access|hex)>", r["text"]):
            assert marked in before[i]["text"]
            assert not [m for m in secret.findall(marked) if m != m.upper() or m.startswith("AKIA")]
        assert (r["text"] == before[i]["text"]) == ("<" + "assign>" not in r["text"] and "<access>" not in r["text"] and "<hex>" not in r["text"])
        assert r["n_chars"] == len(r["text"])


def test_packing_stage_and_the_whole_run(spark, stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {
        i: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        for i, r in rows_of(stages["secret_scans"]).items()
    }
    for out in (stages["packing"], corpus_pipeline.run(spark, SMALL)):
        out = out.toPandas()
        assert set(out["doc_id"]) == set(ids)
        assert out["length"].sum() == sum(map(len, ids.values()))
        for r in out.itertuples():
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        filled = out.groupby("sequence_id")["length"].sum()
        assert all(n == 2048 or n & (n - 1) == 0 for n in filled)


def test_the_first_four_stages_keep_the_columns(stages):
    columns = stages["documents"].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "simhash_near_dedup", "secret_scans", "packing",
    ]
    for name in ("quality_rules", "language_id", "simhash_near_dedup", "secret_scans"):
        assert stages[name].columns == columns


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    first = {}
    for group in brute_groups(sorted(set(prints.values())), 4):
        members = [i for i, p in prints.items() if p in group]
        first |= dict.fromkeys(members, min(members))
    found = queries.QUERIES["op7_simhash"](spark, SMALL).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {
        (i, f"{p:016x}", first[i]) for i, p in prints.items()
    }


def test_license_query_names_each_planted_line(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
        "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "Released under the MIT License": "MIT",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    }
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    planted = {(i, m.start(), m.end(), name) for i, t in texts.items() for line, name in lines.items() for m in re.finditer(re.escape(line), t)}
    found = queries.QUERIES["op3_license_scan"](spark, SMALL).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["license"]) for r in found} == planted
    assert all(r["exact"] and r["reduction"] > 0.2 for r in found)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_with_sql(spark, name):
    table = queries.QUERIES[name](spark, SMALL)
    cursor = connect(SMALL).execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert as_rows(table.columns, table.collect()) == as_rows(columns, cursor.fetchall())
    assert sorted(columns) == sorted(table.columns)


def test_every_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
