"""Language-model scores against counts and weights made in plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from airtide.llm import lm_scoring, queries

SMALL = "/root/testdata/sf0.001"


def level(count):
    return count.bit_length()


@pytest.mark.parametrize("block_bytes, part_entries", [(8 << 20, 1 << 20), (20_000, 2_000)])
def test_scores(spark, monkeypatch, block_bytes, part_entries):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm_scoring, "PART_ENTRIES", part_entries)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + ["end"] for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}
    pairs_of = lambda t: zip(["start", *t[:-1]], t)

    def count(folds):
        words, pairs = Counter(), Counter()
        for i, t in tokens.items():
            if fold[i] in folds:
                words.update(t)
                pairs.update(pairs_of(t))
        total, types = sum(words.values()), len(words)
        words["start"] = sum(fold[i] in folds for i in tokens)
        return words, pairs, total, types

    words, pairs, total, types = count(range(1, 10))
    kept_words, kept_pairs, kept_total, kept_types = count(range(2, 10))
    held = defaultdict(list)
    for i, t in tokens.items():
        if fold[i] == 1:
            for v, w in pairs_of(t):
                c = kept_words[v]
                held[level(c)].append((kept_pairs[v, w] / max(c, 1), kept_words[w] / kept_total, 1 / (kept_types + 1)))
    weights = {}
    for b in range(65):
        parts, allowed = np.array(held[b]).reshape(-1, 3), np.array([b > 0, 1, 1], float)
        now = allowed / allowed.sum()
        for _ in range(lm_scoring.ROUNDS):
            share = parts * now
            now = ((share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1) * allowed
            now /= now.sum()
        weights[b] = now

    found = queries.QUERIES["op1_lm_scoring"](spark, SMALL).collect()
    assert len(found) == len(tokens)
    for r in found:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        score = sum(
            math.log10(weights[level(words[v])] @ [pairs[v, w] / max(words[v], 1), words[w] / total, 1 / (types + 1)])
            for v, w in pairs_of(t)
        )
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(t), total, fold[r["doc_id"]] == 0)
        assert r["n_known"] == sum(words[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-3)  # estimates are weighed in quarter octaves
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_numbers_survive_packing():
    random = np.random.default_rng(0)
    for kind in (np.uint8, np.uint32, np.uint64):
        numbers = random.integers(0, np.iinfo(kind).max, 1000, dtype=kind)
        assert (lm_scoring.unpack(lm_scoring.pack(numbers), kind) == numbers).all()
    ordered = np.unique(random.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(ordered)) == ordered).all()
    assert len(lm_scoring.unpack(lm_scoring.pack(np.zeros(0, np.uint32)), np.uint32)) == 0
    parts = list(lm_scoring.slices(ordered, 64, 8))
    assert [a for _, a, _ in parts[1:]] == [b for _, _, b in parts[:-1]] and parts[-1][2] == 1000


def test_weights_of_one_bucket_go_to_the_better_part():
    import pandas as pd

    cells = pd.DataFrame({"bucket": [5], "s1": [1], "s2": [9], "n": [1000.0], "p1": [900.0], "p2": [1.0]})
    weights = lm_scoring.learn_weights(cells, 99)
    assert weights[5, 0] > 0.95 and weights.min() >= 0 and weights[0, 0] == 0
    assert np.allclose(weights.sum(axis=1), 1)
