"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

All pieces stand in one automaton. A single pass over the text yields, at each position,
every piece that ends there (the state's own piece and those down its output links), and
each relaxes the best score of that position. The path back through the best pieces is
the encoding with the highest sum of piece scores. A character that no piece covers by
itself may also be an unknown of one character, which is written as its UTF-8 bytes.

Blanks become the piece mark, and one mark is put before a text, as the model file says.
Where no piece of the model has a mark behind another character, no piece can reach over
the start of a word, so that the best path of a text is that of its words one after the
other, and the paths of words already seen are remembered.

Ties: of equal sums at a position the longest last piece wins. Edge cases: null and empty
texts have no pieces; a text with the mark character itself does not decode to itself
(it comes back as a blank), which ``round_trip`` tells. Repeated rows each get their
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MARK = "▁"
#: How much less than the lowest piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, for each of two generations.
CACHE_WORDS = 300_000
#: Documents that a task holds decoded at once.
ROWS = 128


class PieceCodec:
    """Encode and decode with the pieces of a SentencePiece model file's bytes."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        automaton = ahocorasick.Automaton()
        self._text_of: list[bytes] = []
        self._byte_ids: dict[int, int] = {}
        lowest = 0.0
        self._single: set[str] = set()
        self._words_apart = True
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self._byte_ids[value] = i
                self._text_of.append(bytes([value]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self._text_of.append(b"")
            else:
                self._text_of.append(piece.replace(MARK, " ").encode())
                score = library.get_score(i)
                lowest = min(lowest, score)
                automaton.add_word(piece, (len(piece), i, score))
                self._words_apart &= MARK not in piece.lstrip(MARK)
                if len(piece) == 1:
                    self._single.add(piece)
        automaton.make_automaton()
        self._matches = automaton.iter
        self._unknown_id = library.unk_id()
        self._unknown_score = lowest - UNKNOWN_PENALTY
        self._known: dict[str, tuple[bytes, float]] = {}
        self._older: dict[str, tuple[bytes, float]] = {}
        self._limit = cache_words

    def best_path(self, word: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of a normalized text."""
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        start_of, id_of = [0] * (n + 1), [0] * (n + 1)
        if self._single.issuperset(word):
            for last, (length, i, score) in self._matches(word):
                end = last + 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end], start_of[end], id_of[end] = total, end - length, i
        else:
            ending: list[list] = [[] for _ in range(n + 1)]
            for last, piece in self._matches(word):
                ending[last + 1].append(piece)
            for end in range(1, n + 1):
                pieces = ending[end]
                if word[end - 1] not in self._single:
                    pieces = [*pieces, (1, -1, self._unknown_score)]
                for length, i, score in pieces:
                    total = best[end - length] + score
                    if total > best[end]:
                        best[end], start_of[end], id_of[end] = total, end - length, i
        ids: list[int] = []
        end = n
        while end:
            if id_of[end] >= 0:
                ids.append(id_of[end])
            else:
                ids += reversed(self._unknown(word[end - 1]))
            end = start_of[end]
        return ids[::-1], best[n]

    def _unknown(self, character: str) -> list[int]:
        if len(self._byte_ids) < 256:
            return [self._unknown_id]
        return [self._byte_ids[b] for b in character.encode("utf-8", "replace")]

    def _words(self, text: str) -> list[str]:
        """The words of a text, each without the mark that it starts with."""
        if not self._words_apart:
            return [text.replace(" ", MARK)]
        parts = text.split(" ")
        if "" not in parts:
            return parts
        words, blanks = [], 0
        for part in parts[:-1]:
            if part:
                words.append(MARK * blanks + part)
                blanks = 0
            else:
                blanks += 1
        return [*words, MARK * blanks + parts[-1]]

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """For each text its ids, as 32-bit integers in native order, and their score."""
        import array

        rows = [self._words(text) if text else [] for text in texts]
        known, older = self._known, self._older
        for word in set().union(*rows).difference(known):
            path = older.get(word)
            if path is None:
                ids, score = self.best_path(MARK + word)
                path = array.array("i", ids).tobytes(), score
            known[word] = path
        look = known.__getitem__
        out = []
        for row in rows:
            paths = list(map(look, row))
            out.append((b"".join([p[0] for p in paths]), sum([p[1] for p in paths])))
        if len(known) > self._limit:
            self._older, self._known = known, {}
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self._text_of.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")

    def is_byte(self):
        """A numpy mask over ids."""
        import numpy as np

        mask = np.zeros(len(self._text_of), bool)
        mask[list(self._byte_ids.values())] = True
        return mask


def _read(model: str) -> bytes:
    with open(model, "rb") as file:
        return file.read()


def encode(docs: DataFrame, *, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, n_bytes, score, ids, round_trip.

    ``model`` is the path of a SentencePiece model on the driver. ``n_bytes`` counts
    pieces that stand for a byte, ``score`` is the sum of the pieces' scores, and
    ``round_trip`` whether the ids decode to the text.
    """
    definition = docs.sparkSession.sparkContext.broadcast(_read(model))  # one file
    docs = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_pieces", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        codec = PieceCodec(definition.value)
        mask = codec.is_byte()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                paths = codec.encode(texts)
                flat = np.frombuffer(b"".join([p[0] for p in paths]), np.intc)
                ends = np.cumsum([len(p[0]) // 4 for p in paths])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                bytes_before = np.concatenate([[0], np.cumsum(mask[flat])])
                decoded = [
                    codec.decode(memoryview(p[0]).cast("i")) == t for p, t in zip(paths, texts)
                ]
                columns = [
                    part.column(0),
                    np.diff(offsets).astype(np.int64),
                    bytes_before[offsets[1:]] - bytes_before[offsets[:-1]],
                    [p[1] for p in paths],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    decoded,
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c).cast(f.type) for c, f in zip(columns, arrow)],
                    schema=arrow,
                )

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Add the text that an array of piece ids stands for; null ids give null."""

    definition = encoded.sparkSession.sparkContext.broadcast(_read(model))  # one file

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = PieceCodec(definition.value)
        for batch in batches:
            yield batch.map(lambda row: None if row is None else codec.decode(row))

    return encoded.withColumn(to, decoded(F.col(f"`{ids}`")))


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, model=public_tokenizers.path("piece_bpe_32k.model"))
