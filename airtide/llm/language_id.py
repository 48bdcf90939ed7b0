"""Language identification: the language's family first, then the language within it.

Features are shares of hashed character bigrams and trigrams. Linear support vector
machines, one for each pair of families, choose the family; within it one for each pair
of its languages chooses the language, so that closely related languages are told apart
by machines that saw nothing else.

Machines always choose one of the learned languages, so their score alone can't reject a
text. Each language also has a likeness: how probable a text's n-grams are for it, against
its own labelled documents and the text's length. A text less like its language than they
are has its score lowered; random letters, encoded bytes, code and languages that were not
learned fall below any reasonable bound. A text of few words has little to be judged by.

All languages with a labelled text are learned. Training takes a bounded sample: the labelled
documents with the smallest hashes of id and text, as many of each language, ``SAMPLE_ROWS``
over all or ``LEAST_ROWS`` of each language if that is more. Their features are made on the
executors, from whole texts; the driver gets one vector of ``DIM`` numbers for each. Listed
languages have their families; the others are put into families of like ones, of about the
cube root of their number, so that machines grow with the 4/3 power of the languages (250
languages: 30 MB) and not with the square. Machines are fitted in tasks and go to every
task of a prediction, which reads the text alone, whole, and shuffles nothing.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every
text if no row is labelled. A language with fewer than ``LIKENESS_DOCS`` different
labelled texts takes the likeness of all labelled texts, with a limit that keeps its own;
if all languages together have fewer, no score is lowered. Rows with a null label are not trained on; a null id is not held out. Repeated rows
each get their result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from airtide.operators.lookup import attach
from airtide.plans.staging import stage

UNDETERMINED = "und"
#: Labelled documents to train on, over all languages.
SAMPLE_ROWS = 2000
LEAST_ROWS = 8
BIGRAMS, TRIGRAMS = 1 << 10, 1 << 12
DIM = BIGRAMS + TRIGRAMS
#: Documents whose features a task holds at once, and characters that it hashes at once.
ROWS = 128
PART_CHARS = 1 << 20
#: Different labelled texts that a language needs for its likeness.
LIKENESS_DOCS = 8
#: Of a text's trigrams, so many count at most when a language's probabilities are learned.
HEARD_CHARS = 3000
#: A deviation at which a text's score is lowered to ``AT_LIMIT`` of itself: this multiple of
#: the one that ``TAIL`` of the labelled texts go below, but within ``LIMITS``.
TAIL, TAIL_MARGIN, LIMITS = 0.005, 1.25, (-8.0, -4.0)
AT_LIMIT = 0.25

#: Language -> family. Fixed values; other languages go into families of like ones.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
    "no": "germanic", "nb": "germanic", "nn": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "sr": "slavic",
    "hr": "slavic", "sl": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
    "tr": "turkic", "az": "turkic", "kk": "turkic", "uz": "turkic",
    "hi": "indic", "mr": "indic", "ne": "indic", "bn": "indic", "gu": "indic", "pa": "indic",
    "ar": "semitic", "he": "semitic", "mt": "semitic",
    "id": "malayic", "ms": "malayic",
}


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """A row of bigram and trigram shares for each text."""
    return measure(texts)[0]


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features, and how many trigrams with a letter each text has."""
    out = np.zeros((len(texts), DIM), np.float32)
    heard = np.zeros(len(texts))
    for parts in _parts(texts):
        for row, n, counts in _count(parts):
            out[row] += counts
            heard[row] += n
    return out / np.maximum(heard, 1)[:, None].astype(np.float32), heard


def _parts(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(row, part of its text) in lists of at most PART_CHARS; a part has two more characters
    than it has beginnings of trigrams."""
    parts, size = [], 0
    for row, text in enumerate(texts):
        padded = text + "\0\0"
        for at in range(0, len(text), PART_CHARS):
            part = padded[at : at + PART_CHARS + 2]
            if parts and size + len(part) > PART_CHARS:
                yield parts
                parts, size = [], 0
            parts.append((row, part))
            size += len(part)
    if parts:
        yield parts


def _count(parts: list[tuple[int, str]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, number of trigrams with a letter, counts by hash of those and their bigrams)."""
    joined = "".join(part for _, part in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).copy()
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    codes[upper] += 32
    codes[(codes < 97) | (codes > 122) & (codes < 0xAA)] = 0  # ASCII and controls but letters
    spread = codes * np.uint32(0x9E3779B1)
    pairs = spread[:-1] * np.uint32(31) + spread[1:]
    triples = pairs[:-1] * np.uint32(0x85EBCA6B) + spread[2:]
    pairs = (pairs >> np.uint32(32 - 10)).astype(np.int64)
    triples = (triples >> np.uint32(32 - 12)).astype(np.int64) + BIGRAMS
    heard = (codes[:-2] | codes[1:-1] | codes[2:]) != 0
    at = 0
    for row, part in parts:
        end = at + len(part) - 2
        here = heard[at:end]
        hashes = np.concatenate([pairs[at:end][here], triples[at:end][here]])
        yield row, int(here.sum()), np.bincount(hashes, minlength=DIM)
        at = end + 2


def fit_machine(
    rows: np.ndarray, signs: np.ndarray, cost: float = 1.0, passes: int = 30, scale: float = 10.0
) -> np.ndarray:
    """Weights and offset of a linear support vector machine, by dual coordinate descent."""
    rows = np.hstack([rows * np.float32(scale), np.ones((len(rows), 1), np.float32)])
    squares = np.einsum("ij,ij->i", rows, rows)
    weights, alphas = np.zeros(rows.shape[1], np.float32), np.zeros(len(rows), np.float32)
    order = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (rows[i] @ weights) - 1
            alpha = min(max(alphas[i] - gradient / squares[i], 0.0), cost)
            if alpha != alphas[i]:
                weights += (alpha - alphas[i]) * signs[i] * rows[i]
                moved = max(moved, abs(alpha - alphas[i]))
                alphas[i] = alpha
        if moved < 1e-3:
            break
    weights[:-1] *= scale
    return weights


class Machines:
    """A machine for each pair of classes; the class that wins most, softly, is chosen."""

    def __init__(self, classes: list[str], weights: np.ndarray):
        self.classes = classes
        pairs = np.array(list(combinations(range(len(classes)), 2)), int).reshape(-1, 2)
        self._weights = weights
        self._first = np.eye(len(classes))[pairs[:, 0]]
        self._second = np.eye(len(classes))[pairs[:, 1]]

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen class's index, and its mean chance to win a pair."""
        margins = np.clip(rows @ self._weights[:, :-1].T + self._weights[:, -1], -10, 10)
        chances = 1 / (1 + np.exp(-3 * margins))
        wins = chances @ self._first + (1 - chances) @ self._second
        wins = wins / (len(self.classes) - 1) if len(self._weights) else wins + 1
        best = wins.argmax(axis=1)
        return best, wins[np.arange(len(rows)), best]


def fit_pairs(
    spark: SparkSession, rows: np.ndarray, groups: list[tuple[list[str], np.ndarray]]
) -> list[Machines]:
    """Machines of each (classes, label of each row or None); a task fits some of the pairs."""
    todo = [(g, a, b) for g, (classes, _) in enumerate(groups) for a, b in combinations(classes, 2)]
    found: dict[tuple, np.ndarray] = {}
    if todo:
        shared = spark.sparkContext.broadcast((rows, [labels for _, labels in groups]))  # the sample

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, labels = shared.value
            for batch in batches:
                out = []
                for g, a, b in batch.itertuples(index=False):
                    both = (labels[g] == a) | (labels[g] == b)
                    signs = np.where(labels[g][both] == a, 1.0, -1.0)
                    out.append((g, a, b, fit_machine(rows[both], signs).astype("<f4").tobytes()))
                yield pd.DataFrame(out, columns=["g", "a", "b", "weights"])

        pairs = spark.createDataFrame(pd.DataFrame(todo, columns=["g", "a", "b"]))
        tasks = min(len(todo), spark.sparkContext.defaultParallelism)
        fitted = pairs.repartition(tasks).mapInPandas(fit, "g long, a string, b string, weights binary")
        for row in fitted.collect():  # the model
            found[row["g"], row["a"], row["b"]] = np.frombuffer(row["weights"], "<f4")
    machines = []
    for g, (classes, _) in enumerate(groups):
        own = [found[g, a, b] for a, b in combinations(classes, 2)]
        machines.append(Machines(classes, np.array(own, np.float32).reshape(len(own), DIM + 1)))
    return machines


def kindred(names: list[str], centres: np.ndarray) -> dict[str, str]:
    """Language -> family, named by its first member: each time, the next language with those
    of the others that are most like it."""
    size = max(1, math.ceil(len(names) ** (1 / 3)))
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    left, family = list(range(len(names))), {}
    while left:
        first = left[0]
        order = np.argsort(-(unit[left] @ unit[first]), kind="stable")
        own = {first, *(left[i] for i in order[:size])}
        own = {first, *sorted(own - {first}, key=lambda i: -float(unit[i] @ unit[first]))[: size - 1]}
        for i in own:
            family[names[i]] = names[first]
        left = [i for i in left if i not in own]
    return family


class Likeness:
    """How far a text lies from a language, in deviations of the language's own texts.

    The statistic is the mean log probability of a text's n-grams. Its variance is that
    between texts plus that of a mean of the text's own n-grams, so short texts may differ
    more. Both are learned from texts that the probabilities were not learned from. The
    limit is no nearer than the texts ``keep``.
    """

    def __init__(self, rows: np.ndarray, heard: np.ndarray, keep: np.ndarray | None = None):
        half = np.arange(len(rows)) % 2 == 0
        means, spreads = np.zeros(len(rows)), np.zeros(len(rows))
        for here in (half, ~half):
            self._logs = self._learn(rows[~here], heard[~here])
            means[here], spreads[here] = self._statistic(rows[here], heard[here])
        longer = heard >= np.median(heard)
        self._mean = float(np.median(means[longer]))
        between = 1.4826 * float(np.median(np.abs(means[longer] - self._mean)))
        self._between = max(between, 0.02) ** 2
        away = (means - self._mean) / np.sqrt(self._between + spreads)
        self._limit = float(np.clip(TAIL_MARGIN * np.quantile(away, TAIL), *LIMITS))
        if keep is not None:
            self._limit = min(self._limit, TAIL_MARGIN * float(away[keep].min()))
        self._logs = self._learn(rows, heard)

    @staticmethod
    def _learn(rows: np.ndarray, heard: np.ndarray) -> np.ndarray:
        counts = np.minimum(heard, HEARD_CHARS) @ rows.astype(np.float64) + 0.5
        for part in (counts[:BIGRAMS], counts[BIGRAMS:]):
            part /= part.sum()
        return np.log(counts)

    def _statistic(self, rows: np.ndarray, heard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.astype(np.float64) / 2  # shares of bigrams and of trigrams add up to 1 each
        means = rows @ self._logs
        own = np.maximum(rows @ self._logs**2 - means**2, 0)
        # A character is in three trigrams, so only a third of them are independent.
        return means, 3 * own / 2 / np.maximum(heard, 1)

    def share(self, rows: np.ndarray, heard: np.ndarray) -> np.ndarray:
        """1 up to half the limit, ``AT_LIMIT`` at the limit, falling on below it."""
        means, spreads = self._statistic(rows, heard)
        away = (means - self._mean) / np.sqrt(self._between + spreads)
        return AT_LIMIT ** np.maximum(0.0, 2 * away / self._limit - 1)


@dataclass(frozen=True)
class LanguageModel:
    """The machines between families, those within each family, and the likenesses."""

    families: Machines
    languages: dict[str, Machines]
    likenesses: dict[str, Likeness]

    def predict(self, texts: list[str | None]) -> list[tuple[str, str | None, float]]:
        """(language, family, score) for each text."""
        out: list[tuple[str, str | None, float]] = [(UNDETERMINED, None, 0.0)] * len(texts)
        lettered = [i for i, text in enumerate(texts) if has_letter(text)]
        if not lettered or not self.languages:
            return out
        rows, heard = measure([texts[i] for i in lettered])
        family, chance = self.families.predict(rows)
        for f, name in enumerate(self.families.classes):
            here = np.flatnonzero(family == f)
            if len(here):
                machines = self.languages[name]
                language, within = machines.predict(rows[here])
                alike = np.ones(len(here))
                for k in set(language):
                    likeness = self.likenesses.get(machines.classes[k])
                    if likeness:
                        its = language == k
                        alike[its] = likeness.share(rows[here[its]], heard[here[its]])
                for i, k, p, share in zip(here, language, within, alike):
                    score = float(min(1.0, chance[i] * p) * share)
                    out[lettered[i]] = machines.classes[k], name, score
        return out


def train(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    families: dict[str, str] = FAMILIES,
    sample_rows: int = SAMPLE_ROWS,
) -> LanguageModel:
    """Learn from a bounded, repeatable sample of the labelled documents."""
    spark = docs.sparkSession
    labelled = docs.select(
        F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("key"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x00-@\[-`{-\x{A9}]"))
    keys = stage(labelled.select("lang", "key").distinct(), "language-keys")
    counts = stage(keys.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    each = max(LEAST_ROWS, sample_rows // max(1, counts.count()))
    # First thin out to about twice what is wanted, wherever the rows lie, then take that.
    counted = attach(keys, counts, {"lang": F.col("lang")}, row_id="key", weight="n")
    hashed = F.pmod("key", F.lit(1 << 30))
    near = counted.where(hashed * F.col("n") < (2 * each + 50) * (1 << 30))
    first = Window.partitionBy("lang").orderBy(hashed, "key")
    keys = near.select("lang", "key", F.row_number().over(first).alias("n")).where(F.col("n") <= each)
    keys = stage(keys.drop("n"), "language-sample")  # at most ``each`` rows of each language
    sample = labelled.join(F.broadcast(keys), ["lang", "key"], "left_semi")
    copy = Window.partitionBy("lang", "key").orderBy(F.lit(0))
    sample = sample.withColumn("n", F.row_number().over(copy)).where("n = 1").drop("n")
    schema = "lang string, key bigint, row binary, heard bigint"

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                names, keys, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                kept = [i for i, t in enumerate(texts) if has_letter(t)]
                rows, heard = measure([texts[i] for i in kept]) if kept else ([], [])
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([names[i] for i in kept], pa.string()),
                        "key": pa.array([keys[i] for i in kept], pa.int64()),
                        "row": pa.array([r.tobytes() for r in rows], pa.binary()),
                        "heard": pa.array([int(n) for n in heard], pa.int64()),
                    }
                )

    sample = sample.select("lang", "key", "text").mapInArrow(vectors, schema)
    sample = sorted(sample.collect(), key=lambda row: (row["lang"], row["key"]))
    labels = np.array([row["lang"] for row in sample], object)
    rows = np.array([np.frombuffer(row["row"], np.float32) for row in sample]).reshape(-1, DIM)
    unlisted = sorted(set(labels) - set(families))
    centres = np.array([rows[labels == name].mean(axis=0) for name in unlisted]).reshape(-1, DIM)
    families = families | kindred(unlisted, centres)
    family_of = np.array([families[name] for name in labels], object)
    heard = np.array([row["heard"] for row in sample], float)
    _, first = np.unique(rows, axis=0, return_index=True)
    different = np.sort(first)
    likenesses = {}
    for name in sorted(set(labels)):
        its = labels[different] == name
        if its.sum() >= LIKENESS_DOCS:
            likenesses[name] = Likeness(rows[different[its]], heard[different[its]])
        elif len(different) >= LIKENESS_DOCS and its.any():
            likenesses[name] = Likeness(rows[different], heard[different], its)
    names = sorted(set(family_of))
    groups = [(names, family_of)]
    for name in names:
        here = family_of == name
        groups.append((sorted(set(labels[here])), np.where(here, labels, None)))
    first, *within = fit_pairs(spark, rows, groups)
    return LanguageModel(first, dict(zip(names, within)), likenesses)


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (as it was), ``lang_pred``, ``family``, ``score``."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers per pair

    @F.pandas_udf("lang_pred string, family string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for at in range(0, len(texts), ROWS):
                rows += shared.value.predict([*texts[at : at + ROWS]])
            yield pd.DataFrame(rows, columns=["lang_pred", "family", "score"])

    out = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return out.select("row", language("text").alias("found")).select("row", "found.*")


def held_out(id: Column) -> Column:
    """One document in four is kept from training."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float, **training) -> DataFrame:
    """The documents in a language that can be told with at least ``min_score``."""
    found = predict(docs, train(docs, **training))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "family"
    )
