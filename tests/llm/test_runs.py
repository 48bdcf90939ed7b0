"""Runs of words against a search of every period."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest

from airtide.llm import queries, runs

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, min_length, min_exponent):
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q):
                part = words[i : i + length]
                if not any(part[k:] == part[:-k] for k in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def test_lyndon_arrays():
    dice = random.Random(1)
    for _ in range(1500):
        x = [dice.randrange(dice.choice([1, 2, 3, 6])) for _ in range(dice.randrange(40))]
        assert runs.lyndon_array(x) == plain_lyndon(x)
        assert runs.lyndon_array([-s for s in x]) == plain_lyndon([-s for s in x])


@pytest.mark.parametrize("bounds", [(24, 3), (10, 2), (4, 2), (12, 3), (1, 2), (30, 5)])
def test_runs_equal_a_search_of_every_period(bounds):
    dice = random.Random(sum(bounds))
    found = 0
    for _ in range(600):
        n, kinds = dice.randrange(160), dice.choice([1, 2, 3, 9, 60])
        words = [b"%d" % dice.randrange(kinds) for _ in range(n)]
        for _ in range(dice.randrange(4)):
            if n > 12:
                a, p = dice.randrange(n), dice.randrange(1, 14)
                for i in range(a + p, min(n, a + dice.randrange(10, 90))):
                    words[i] = words[i - p]
        want = plain_runs(words, *bounds)
        assert runs.find(words, *bounds) == want
        found += len(want)
    assert found > 100


def test_equal_hashes_cost_time_only(monkeypatch):
    monkeypatch.setattr(runs, "hash", lambda word: 1, raising=False)
    words = [b"%d" % (i % 50) for i in range(200)] + [b"%d" % (i % 7) for i in range(90)]
    assert runs.find(words) == plain_runs(words, 24, 3)


def test_long_texts_take_linear_time():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a  # words of this kind have the most runs
    for words in ([b"x"] * 200_000, [b"%d" % (i % 7) for i in range(200_000)], b):
        begin = time.time()
        assert runs.find(words)
        assert time.time() - begin < 20


def test_columns_of_odd_documents(odd_documents):
    period = "one two three "
    odd = odd_documents.sparkSession.createDataFrame(
        [(8, period * 9 + "end", None, None), (8, period * 9 + "end", None, None), (9, "a " * 30, None, None)],
        "doc_id long, text string, lang string, source string",
    )
    docs = odd_documents.unionByName(odd, allowMissingColumns=True)
    out = runs.with_runs(docs).collect()
    assert len(out) == docs.count()
    by_id = {r["doc_id"]: r for r in out}
    assert [tuple(r) for r in by_id[8]["runs"]] == [(0, 27, 3)]
    assert by_id[8]["collapsed"] == period + "end"
    assert [tuple(r) for r in by_id[9]["runs"]] == [(0, 30, 1)] and by_id[9]["collapsed"] == "a"
    for i in (2, 3, 4):
        assert by_id[i]["runs"] == [] and by_id[i]["collapsed"] == ""
    assert len(by_id[5]["runs"]) == 1  # one passage, four hundred times
    assert by_id[1]["words"] == "own words"
    assert runs.with_runs(docs.limit(0)).count() == 0


def test_own_columns_of_these_names_are_replaced(documents):
    docs = documents((1, "a b " * 20, None, None)).selectExpr("*", "1 AS runs", "2 AS collapsed")
    assert runs.with_runs(docs).first()["collapsed"] == "a b"


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.QUERIES["op13_runs"](spark, SMALL).collect()
    assert {r["doc_id"] for r in out} == set(texts) and len(out) == len(texts)
    total = 0
    for r in out:
        words = planted(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]))
        want = plain_runs(words, 24, 3) if len(words) < 2000 else runs.find([w.encode() for w in words])
        total += len(want)
        assert r["n_runs"] == len(want)
        best = (None,) * 4
        if want:
            start, length, period = min(want, key=lambda w: (-Fraction(w[1], w[2]), w[0], w[2]))
            best = (start, length, period, 1000 * length // period)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == best
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in want)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        dropped = {i for s, length, q in want for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert total > 20


def test_planting_of_null_ids_and_texts(spark):
    rows = [(None, "a b"), (3, None), (20, ""), (20, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = docs.select(runs.planted(docs["doc_id"], docs["text"]).alias("t")).collect()
    assert [r["t"] for r in out][:2] == ["a b", None]
