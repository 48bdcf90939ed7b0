"""Machines against plain solutions, and training on many languages."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtide.llm import language_id


def plain_machine(rows, signs, cost=1.0, scale=10.0, steps=20_000):
    """The same problem by projected gradient on all dual variables at once."""
    rows = np.hstack([rows * scale, np.ones((len(rows), 1))]).astype(float)
    signed = rows * signs[:, None]
    gram = signed @ signed.T
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    alphas = np.zeros(len(rows))
    for _ in range(steps):
        alphas = np.clip(alphas - step * (gram @ alphas - 1), 0, cost)
    weights = signed.T @ alphas
    return np.append(weights[:-1] * scale, weights[-1])


def test_machines_solve_the_plain_problem():
    random = np.random.default_rng(0)
    for apart in (0.0, 0.4, 2.0):
        signs = np.repeat([1.0, -1.0], 20)
        rows = random.normal(0, 0.03, (40, 12)) + apart * signs[:, None] * random.normal(0, 0.03, 12)  # small, as shares are
        fitted = language_id.fit_machine(rows.astype(np.float32), signs, passes=3000)
        plain = plain_machine(rows, signs)
        margins = [rows @ w[:-1] + w[-1] for w in (fitted, plain)]
        sure = abs(margins[1]) > 0.05
        assert ((margins[0] > 0) == (margins[1] > 0))[sure].all()
        assert np.allclose(*margins, atol=0.05 + 0.02 * abs(margins[1]).max())


def made_up(languages, texts, ids=None):
    """Rows of texts in languages that each draw words from their own few syllables."""
    rows = []
    for k in range(languages):
        random = np.random.default_rng(k)
        syllables = ["".join(random.choice([*"bcdfghjklmnprstvwz"], 1)) + "".join(random.choice([*"aeiouy"], 2)) for _ in range(14)]
        for i in range(texts):
            words = ["".join(random.choice(syllables, 2)) for _ in range(60)]
            rows.append((k * texts + i if ids is None else ids, " ".join(words), f"l{k:03}"))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def test_all_of_many_languages_are_learned(spark):
    docs = spark.createDataFrame(made_up(250, 12), SCHEMA)
    held = F.col("doc_id") % 12 >= 10
    model = language_id.train(docs.where(~held))
    learned = {name for machines in model.languages.values() for name in machines.classes}
    assert len(learned) == 250
    assert len(pickle.dumps(model)) < 50 << 20
    found = language_id.predict(docs.where(held), model).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.9 * len(found)


@pytest.mark.parametrize("doc_id", [7, None, 8])
def test_one_id_on_all_rows_learns_all(spark, doc_id):
    docs = spark.createDataFrame(made_up(6, 150, ids=doc_id) if doc_id else [(None, *r[1:]) for r in made_up(6, 150)], SCHEMA)
    model = language_id.train(docs, sample_rows=120)
    learned = {name for machines in model.languages.values() for name in machines.classes}
    assert len(learned) == 6


def test_copies_of_one_row_do_not_fill_the_sample(spark):
    rows = made_up(2, 30)
    docs = spark.createDataFrame(rows + [rows[0]] * 900 + [(1000 + i, "同じ文", "l999") for i in range(5)] + [(0, "12 3", "l888")] * 9, SCHEMA)
    model = language_id.train(docs, sample_rows=60)
    learned = {name for machines in model.languages.values() for name in machines.classes}
    assert learned == {"l000", "l001", "l999"}  # a text without a letter teaches nothing
    assert language_id.predict(docs, model).count() == docs.count()


def test_unlisted_languages_join_those_like_them():
    centres = np.eye(4)[[0, 1, 0, 1, 2, 2, 3, 3]] + 0.01 * np.arange(8)[:, None]
    family = language_id.kindred([*"abcdefgh"], centres)
    assert [family[x] for x in "abcdefgh"] == [*"ababeegg"]
    assert language_id.kindred([], np.zeros((0, 4))) == {} and language_id.kindred(["x"], np.ones((1, 4))) == {"x": "x"}
