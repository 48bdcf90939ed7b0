"""Codes of vectors against full comparisons."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtide.llm import vector_codes


def plain_nearest(points, entries):
    apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


def plain_codes(vectors, parts, entries, rounds):
    """Codebooks, codes and errors of integer vectors in order of their ids."""
    split = vectors.reshape(len(vectors), parts, -1)
    books = split[:entries].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for part in range(parts):
            index, _ = plain_nearest(split[:, part], books[part])
            for entry in set(index.tolist()):
                mine = split[index == entry, part]
                books[part, entry] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    found = [plain_nearest(split[:, part], books[part]) for part in range(parts)]
    codes = ["".join(f"{i:02x}" for i in row) for row in np.stack([f[0] for f in found], axis=1).tolist()]
    return books, codes, sum(f[1] for f in found)


@pytest.mark.parametrize("spread", [2, 30, 5000])
@pytest.mark.parametrize("cell", [1, 5, 16, 200])
def test_memo_equals_a_full_comparison(spread, cell):
    random = np.random.default_rng(spread + cell)
    for limit in (7, 1 << 18):
        entries = random.integers(-spread, spread + 1, (40, 3))
        entries[20:25] = entries[:5]  # equal entries: the lower index wins
        memo = vector_codes.CellMemo(entries, cell, limit)
        for _ in range(3):
            points = random.integers(-spread, spread + 1, (300, 3))
            index, distance = memo.nearest(points)
            want = plain_nearest(points, entries)
            assert (index == want[0]).all() and (distance == want[1]).all()
            assert len(memo._hashes) <= max(limit, 300)


def test_memo_leaves_out_dominated_entries():
    random = np.random.default_rng(0)
    entries = random.integers(-100, 101, (64, 4))
    memo = vector_codes.CellMemo(entries)
    points = random.integers(-100, 101, (5000, 4))
    memo.nearest(points)
    assert memo.evaluated < 0.5 * len(points) * len(entries)


def test_cells_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(vector_codes, "cell_hashes", lambda cells: np.full(len(cells), 7, np.uint64))
    random = np.random.default_rng(0)
    entries, points = random.integers(-90, 91, (30, 4)), random.integers(-90, 91, (500, 4))
    index, _ = vector_codes.CellMemo(entries).nearest(points)
    assert (index == plain_nearest(points, entries)[0]).all()


def odd_rows():
    random = np.random.default_rng(3)
    rows = [(i, random.normal(0, 0.3, 8).tolist(), i % 3 or None) for i in range(60)]
    rows += [(2, rows[2][1], 1), (None, rows[5][1], None), (90, [0.1, -0.1], 7), (91, [], 7)]
    bad = [(70, None, 1), (71, [None] * 8, 1), (72, [float("nan")] * 8, 2), (73, [float("-inf")] * 8, 2)]
    return rows, bad


def test_odd_vectors(spark):
    rows, bad = odd_rows()
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    table = table.withColumns({c: F.lit("own") for c in ("id", "vector", "code", "error", "part")})
    vectors = vector_codes.integer_vectors(table, "vec_id", "embedding", "label", 256)
    books = vector_codes.train(vectors, parts=4, entries=10)
    codes = vector_codes.label_errors(vector_codes.encode(vectors, books)).collect()
    assert len(codes) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    matrix = np.zeros((len(rows), 8), np.int64)
    for to, row in zip(matrix, ordered):
        to[: len(row[1])] = np.floor(256 * np.array(row[1], np.float32).astype(np.float64))
    plain_books, plain, errors = plain_codes(matrix, 4, 10, 2)
    assert (books == plain_books).all()
    want = sorted((r[0] is None, r[0] or 0, code, int(e)) for r, code, e in zip(ordered, plain, errors))
    assert sorted((r["id"] is None, r["id"] or 0, r["code"], r["error"]) for r in codes) == want
    for label in (None, 1, 2, 7):
        mine = [r for r in codes if r["label"] == label]
        assert mine and {r["label_error"] for r in mine} == {sum(r["error"] for r in mine)}
    text = ",".join(str(v) for part in plain_books for entry in part for v in entry)
    assert vector_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_decoded_vectors_have_the_errors(spark):
    rows, _ = odd_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = vector_codes.integer_vectors(table, "vec_id", "embedding", None, 256)
    books = vector_codes.train(vectors, parts=4, entries=10)
    decoded = vector_codes.decode(vector_codes.encode(vectors.where("id = 7"), books), books).first()
    vector = np.array(vectors.where("id = 7").first()["vector"])
    assert ((vector - np.array(decoded["vector"])) ** 2).sum() == decoded["error"]


def test_no_vectors(spark):
    rows, bad = odd_rows()
    for some in ([], bad):
        table = spark.createDataFrame(some, "vec_id long, embedding array<float>, label int")
        vectors = vector_codes.integer_vectors(table, "vec_id", "embedding", "label", 256)
        books = vector_codes.train(vectors)
        assert vector_codes.label_errors(vector_codes.encode(vectors, books)).count() == 0


def test_one_label_and_one_vector_on_most_rows(spark, monkeypatch):
    from airtide.operators import lookup

    monkeypatch.setattr(lookup, "HEAVY_ROWS", 50)
    rows = [(i, [0.5, 0.25], 4 if i % 3 else None) for i in range(300)] + [(300, [0.0, 9.0], 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = vector_codes.integer_vectors(table, "vec_id", "embedding", "label", 256)
    books = vector_codes.train(vectors, parts=2, entries=1)
    out = vector_codes.label_errors(vector_codes.encode(vectors, books)).collect()
    assert len(out) == 301
    for label in (4, None, 5):
        mine = [r for r in out if r["label"] == label]
        assert {r["label_error"] for r in mine} == {sum(r["error"] for r in mine)}
