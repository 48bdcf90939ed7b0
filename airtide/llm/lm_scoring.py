"""Language-model scores of documents: bigrams by deleted interpolation.

P(w | v) = l1 c(vw) / c(v) + l2 c(w) / N + l3 / (V + 1). The three weights belong to the
bucket of the context's count (powers of two) and are learned by expectation-maximisation
on training text that is deleted from the counts: fold 1's tokens, with counts of fold 2.
Scores then use the counts of both folds.

Counts are of the whole corpus and meet the texts by shuffles, in two rounds:

1. A task turns texts into blocks of a few MB: a stream of local word numbers, and for
   each distinct word its hash and its counts. Every block's words go, in one sorted and
   delta-coded run, to each of the partitions of the hash space, which add them up and
   answer every run with global word numbers and counts.
2. A block, joined with its answers, sends its distinct word pairs the same way. Their
   partitions answer with pair counts, and add up, for the pairs of fold 1, a histogram
   of (bucket, both estimates) in steps of a quarter octave. It has at most 64 x 256 x
   256 cells whatever the input, and is what the driver learns the weights from.

A block that is joined with the answers of both rounds scores its documents. A word pair
is sent once per block however often it occurs, so a frequent pair is a small part of any
partition, and no table of words or pairs is ever in one place.

Words are told apart by 64-bit hashes. Among a billion distinct words two are expected to
share one with a chance of about 3 %; pairs are numbered by their words and are exact.

Edge cases: a null text is empty, and an empty text is its end token. A null id is of no
fold: such rows are scored and not learned from. Repeated rows count and are scored each.
Without training text all words are unknown. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airtide.plans.staging import stage

#: Text of a block, unless one document is longer.
BLOCK_BYTES = 8 << 20
#: Entries that a partition of words or pairs adds up, on average.
PART_ENTRIES = 1 << 20
SCORED, WEIGHING, COUNTED = 0, 1, 2
#: No word, since it is a white space.
END = b"\n"
#: Odd; spreads pair numbers over their range.
SPREAD = 0x9E3779B97F4A7C15
BIN = 4
ROUNDS = 100

_ANSWER = "block long, kind int, part int, ids binary, counted binary, weighing binary"


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as zstandard-compressed byte planes."""
    import zstandard

    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def slices(numbers: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the non-empty parts of sorted numbers of so many bits."""
    shift = np.uint64(bits - (parts.bit_length() - 1))
    part = numbers >> shift if parts > 1 else np.zeros(len(numbers), np.uint64)
    cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    for start, end in zip(cuts, [*cuts[1:], len(numbers)]):
        yield int(part[start]), int(start), int(end)


def pair_bits(words: int) -> int:
    """Bits of the number of a pair, of a word number below ``words`` and a context."""
    return max(1, ((words + 1) ** 2).bit_length())


def parts_for(entries: int) -> int:
    return 1 << max(0, (entries // PART_ENTRIES)).bit_length()


def _blocks(docs: DataFrame, id: str, text: str, fold: Column) -> DataFrame:
    """Texts as blocks of local word numbers."""
    docs = docs.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.coalesce(fold, F.lit(SCORED)).cast("int").alias("fold"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    binary, long = T.BinaryType(), T.LongType()
    schema = T.StructType(
        [T.StructField("block", long), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType))]
        + [T.StructField(n, binary) for n in ("folds", "lengths", "stream", "hashes", "counted", "weighing")]
        + [T.StructField(n, long) for n in ("n_words", "n_tokens", "docs_counted", "docs_weighing")]
    )

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        from xxhash import xxh64_intdigest

        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        rows: list = []
        size = 0

        def block() -> pa.RecordBatch:
            vocabulary: dict[bytes, int] = {}
            place = vocabulary.setdefault
            streams = []
            for _, _, data in rows:
                words = data.lower().split()
                words.append(END)
                streams.append(np.array([place(w, len(vocabulary)) for w in words], np.uint32))
            stream, folds = np.concatenate(streams), np.array([f for _, f, _ in rows], np.uint8)
            lengths = np.array([len(s) for s in streams], np.uint32)
            of_token, n = np.repeat(folds, lengths), len(vocabulary)
            counts = [
                np.bincount(stream[of_token == f], minlength=n).astype(np.uint32)
                for f in (COUNTED, WEIGHING)
            ]
            hashes = np.array([xxh64_intdigest(w) for w in vocabulary], np.uint64)
            values = [number, [d for d, _, _ in rows], *map(pack, (folds, lengths, stream, hashes, *counts))]
            values += [n, len(stream), int((folds == COUNTED).sum()), int((folds == WEIGHING).sum())]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for doc, fold_, text_ in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    rows.append((doc, fold_, (text_ or "").encode()))
                    size += len(rows[-1][2])
                    if size >= BLOCK_BYTES:
                        yield block()
                        rows.clear()
                        size, number = 0, number + 1
        if rows:
            yield block()

    return stage(docs.mapInArrow(build, schema), "lm-blocks")


def _add_up(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted distinct keys of all runs, their place for each entry, both counts, run ends."""
    keys = [unpack_sorted(k) for k in rows["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [
        np.bincount(place, np.concatenate([unpack(c, np.uint32) for c in rows[name]]), len(distinct))
        for name in ("counted", "weighing")
    ]
    return distinct, place, [s.astype(np.uint64) for s in sums], ends


def _count_words(blocks: DataFrame, parts: int) -> DataFrame:
    """Answers of kind 0 for each block; and a row of totals per part, of kind -1."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                hashes = unpack(row.hashes, np.uint64)
                order = np.argsort(hashes)
                hashes = hashes[order]
                counts = [unpack(c, np.uint32)[order] for c in (row.counted, row.weighing)]
                yield pd.DataFrame(
                    [
                        (p, row.block, pack_sorted(hashes[a:b]), *(pack(c[a:b]) for c in counts))
                        for p, a, b in slices(hashes, 64, parts)
                    ],
                    columns=["part", "block", "keys", "counted", "weighing"],
                )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        distinct, place, (counted, weighing), ends = _add_up(rows)
        out = []
        for block, start, end in zip(rows["block"], [0, *ends[:-1]], ends):
            here = place[start:end]
            ids = here.astype(np.uint64) * np.uint64(parts) + np.uint64(part)
            out.append((block, 0, part, pack_sorted(ids), pack(counted[here]), pack(weighing[here])))
        both = counted + weighing
        totals = [len(distinct) * parts, (counted > 0).sum(), (both > 0).sum(), counted.sum(), both.sum()]
        out.append((0, -1, part, np.array(totals, np.int64).tobytes(), b"", b""))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    sent = blocks.select("block", "hashes", "counted", "weighing").mapInPandas(
        send, "part int, block long, keys binary, counted binary, weighing binary"
    )
    return stage(sent.groupBy("part").applyInPandas(answer, _ANSWER), "lm-words")


class _Block:
    """A block with the answers to its words, in local numbers."""

    def __init__(self, block: pd.Series, answers: pd.DataFrame, word_parts: int):
        hashes = unpack(block["hashes"], np.uint64)
        order = np.argsort(hashes)
        words = answers[answers["kind"] == 0].sort_values("part")
        self.ids = np.empty(len(hashes), np.uint64)
        self.ids[order] = np.concatenate([unpack_sorted(i) for i in words["ids"]])
        self.counted, self.weighing = (np.empty(len(hashes), np.uint64) for _ in range(2))
        self.counted[order] = np.concatenate([unpack(c, np.uint64) for c in words["counted"]])
        self.weighing[order] = np.concatenate([unpack(c, np.uint64) for c in words["weighing"]])
        self.stream = unpack(block["stream"], np.uint32).astype(np.int64)
        self.lengths = unpack(block["lengths"], np.uint32).astype(np.int64)
        self.folds = unpack(block["folds"], np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        #: Local number of the word before, -1 at the start of a text.
        self.before = np.concatenate([[-1], self.stream[:-1]])
        self.before[self.starts] = -1

    def pairs(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted spread numbers of the distinct pairs, each token's place, a token of each, bits."""
        width = words + 1
        context = np.where(self.before < 0, np.uint64(0), self.ids[self.before] + np.uint64(1))
        numbers = context * np.uint64(width) + self.ids[self.stream]
        bits = pair_bits(words)
        numbers = (numbers * np.uint64(SPREAD)) & np.uint64((1 << bits) - 1)
        distinct, token, place = np.unique(numbers, return_index=True, return_inverse=True)
        return distinct, place, token, bits

    def of_context(self, counts: np.ndarray, at_start: int, tokens=slice(None)) -> np.ndarray:
        before = self.before[tokens]
        return np.where(before < 0, np.uint64(at_start), counts[before])


def bucket(context_counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the count's binary logarithm."""
    return np.frexp(context_counts.astype(np.float64))[1].astype(np.int64)


def estimates(pair, context, word, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates from the context and from nothing; 0 where undefined."""
    pair, context, word = (x.astype(np.float64) for x in (pair, context, word))
    return pair / np.maximum(context, 1), word / max(total, 1)


def histogram(n, buckets, p1, p2) -> pd.DataFrame:
    """Sums of n, n p1 and n p2 for each bucket and step of both estimates."""

    def step(p):
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.minimum(254, np.floor(-BIN * np.log2(p))), -1).astype(np.int64)

    rows = pd.DataFrame({"bucket": buckets, "s1": step(p1), "s2": step(p2), "n": n.astype(float)})
    rows["p1"], rows["p2"] = p1 * rows["n"], p2 * rows["n"]
    return rows.groupby(["bucket", "s1", "s2"], as_index=False).sum()


def learn_weights(cells: pd.DataFrame, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """A row of three weights per bucket, by expectation-maximisation over a histogram.

    One pseudo-token per part keeps all weights positive; an unseen context has no first
    part.
    """
    weights = np.zeros((65, 3))
    for b in range(65):
        rows = cells[cells["bucket"] == b]
        n = rows["n"].to_numpy()
        parts = np.column_stack(
            [rows["p1"].to_numpy() / n, rows["p2"].to_numpy() / n, np.full(len(rows), 1 / (types + 1))]
        )
        allowed = np.array([b > 0, True, True], float)
        now = allowed / allowed.sum()
        for _ in range(rounds):
            share = parts * now
            share /= share.sum(axis=1, keepdims=True)
            new = (n @ share + 1) * allowed
            new /= new.sum()
            done = np.abs(new - now).max() < 1e-9
            now = new
            if done:
                break
        weights[b] = now
    return weights


def _count_pairs(joined, words: int, parts: int, word_parts: int, starts: int, total: int) -> DataFrame:
    """Answers of kind 1 for each block, and histogram cells of kind 2."""
    sent_schema = "part int, block long, keys binary, counted binary, weighing binary, context binary, word binary"

    def send(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            block = _Block(row, answers, word_parts)
            keys, place, token, bits = block.pairs(words)
            of_token = np.repeat(block.folds, block.lengths)
            counted, weighing = (
                np.bincount(place[of_token == f], minlength=len(keys)).astype(np.uint32)
                for f in (COUNTED, WEIGHING)
            )
            context = block.of_context(block.counted, starts, token)
            word = block.counted[block.stream[token]]
            for p, a, b in slices(keys, bits, parts):
                weighed = np.flatnonzero(weighing[a:b]) + a
                runs = pack_sorted(keys[a:b]), pack(counted[a:b]), pack(weighing[a:b])
                out.append((p, row["block"], *runs, pack(context[weighed]), pack(word[weighed])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in sent_schema.split(", ")])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        _, place, (counted, weighing), ends = _add_up(rows)
        n = np.concatenate([unpack(w, np.uint32) for w in rows["weighing"]])
        weighed = np.flatnonzero(n)
        context = np.concatenate([unpack(c, np.uint64) for c in rows["context"]])
        word = np.concatenate([unpack(w, np.uint64) for w in rows["word"]])
        p1, p2 = estimates(counted[place[weighed]], context, word, total)
        cells = histogram(n[weighed], bucket(context), p1, p2)
        out = [(0, 2, part, cells.to_numpy(np.float64).tobytes(), b"", b"")]
        for block, start, end in zip(rows["block"], [0, *ends[:-1]], ends):
            here = place[start:end]
            out.append((block, 1, part, b"", pack(counted[here]), pack(weighing[here])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    sent = joined.applyInPandas(send, sent_schema)
    return stage(sent.groupBy("part").applyInPandas(answer, _ANSWER), "lm-pairs")


def score(
    docs: DataFrame, fold: Column, *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fold, n_tokens, n_known, train_tokens, base_score, score.

    ``fold`` is 0 for documents that are only scored, 1 for those that the weights and 2
    for those that the counts are learned from; final counts are of 1 and 2. Scores are
    sums of log10 over a text's tokens, its end included: ``base_score`` of
    (c + 0.1) / (N + 0.1 (V + 1)), ``score`` of the model.
    """
    blocks = _blocks(docs, id, text, fold)
    sizes = blocks.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "docs_counted", "docs_weighing")]
    ).first()
    word_parts = parts_for(sizes["n_words"])
    answers = _count_words(blocks, word_parts)
    totals = answers.where("kind = -1").select("ids").mapInPandas(_totals, _TOTALS).agg(
        F.max("words"), *[F.coalesce(F.sum(c), F.lit(0)) for c in _TOTALS.replace(" long", "").split(", ")[1:]]
    ).first()  # added up by the executors
    words = int(totals[0] or 0) + word_parts
    counted_types, types, counted_total, total = totals[1:]

    plain = blocks.select("block", "doc_ids", "folds", "lengths", "stream", "hashes")
    words_of = answers.where("kind = 0").groupBy("block")
    joined = plain.drop("doc_ids").groupBy("block").cogroup(words_of)
    pair_parts = min(parts_for(sizes["n_tokens"]), 1 << pair_bits(words))
    pairs = _count_pairs(joined, words, pair_parts, word_parts, sizes["docs_counted"], counted_total)
    cells = pairs.where("kind = 2").select("ids").mapInPandas(_cells, "bucket long, s1 long, s2 long, n double, p1 double, p2 double")
    cells = cells.groupBy("bucket", "s1", "s2").agg(*[F.sum(c).alias(c) for c in ("n", "p1", "p2")])
    weights = learn_weights(cells.orderBy("bucket", "s1", "s2").toPandas(), counted_types)
    starts = sizes["docs_counted"] + sizes["docs_weighing"]
    schema = T.StructType(
        [T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType)]
        + [T.StructField(n, T.LongType()) for n in ("fold", "n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )

    def scored(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            block = _Block(row, answers, word_parts)
            _, place, _, _ = block.pairs(words)
            found = answers[answers["kind"] == 1].sort_values("part")
            pair = sum(
                np.concatenate([unpack(c, np.uint64) for c in found[name]]) for name in ("counted", "weighing")
            )[place]
            counts = block.counted + block.weighing
            word, context = counts[block.stream], block.of_context(counts, starts)
            p1, p2 = estimates(pair, context, word, total)
            w = weights[bucket(context)]
            chance = w[:, 0] * p1 + w[:, 1] * p2 + w[:, 2] / (types + 1)
            base = (word + 0.1) / (total + 0.1 * (types + 1))
            per_text = lambda x: np.add.reduceat(x, block.starts)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.Series([*row["doc_ids"]], dtype=object),
                        "fold": block.folds.astype(np.int64),
                        "n_tokens": block.lengths,
                        "n_known": per_text((word > 0).astype(np.int64)),
                        "train_tokens": total,
                        "base_score": per_text(np.log10(base)),
                        "score": per_text(np.log10(chance)),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in schema.names})

    both = answers.where("kind = 0").union(pairs.where("kind = 1"))
    return plain.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(scored, schema)


_TOTALS = "words long, counted_types long, types long, counted_total long, total long"


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _TOTALS.split(", ")]
    for batch in batches:
        rows = [np.frombuffer(data, np.int64) for data in batch["ids"]]
        yield pd.DataFrame(np.array(rows).reshape(-1, 5), columns=names)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["ids"]:
            rows = np.frombuffer(data, np.float64).reshape(-1, 6)
            cells = pd.DataFrame(rows, columns=["bucket", "s1", "s2", "n", "p1", "p2"])
            yield cells.astype({"bucket": int, "s1": int, "s2": int})


def fold_of(id: Column) -> Column:
    """A tenth is held out, a tenth of the documents is for the weights, the rest is counted."""
    remainder = F.crc32(id.cast("string")) % 10
    return F.when(remainder == 0, SCORED).when(remainder == 1, WEIGHING).when(remainder > 1, COUNTED)


def scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fold_of(F.col("doc_id")))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
