"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Every source is a queue of tokens, cut into blocks of ``BLOCK`` tokens. In each round a
queue's deficit grows by its quantum, its target share of a window, and the queue sends
as many whole blocks as its deficit covers; what is left over is carried into the next
round, and so from window to window. The quanta of a round add up to one window. Queues
that run dry drop out and the others go on with their own quanta. A queue begins with a
part of a block as credit, and queues of like shares with evenly spread parts: so those
that send less than a block per window, however many, do not all send in the same one.

The round in which block ``j`` of a queue is sent follows from its weight and its credit
by integer arithmetic alone. The blocks, small rows without their tokens, are sorted by
(round, source, j), and a block's place is its rank: running totals over the ranges of
that sort. So deficits carry over partitions without a sequential pass, and there may be
any number of sources: none has a rule, a column or a row on the driver of its own.

Texts are tokenized once. A task cuts the tokens of each source into blocks as it reads
and writes a row per piece of a document in a block; token ids are never shuffled. What
a task has left of a source, less than a block, becomes blocks of smaller powers of two.
In falling size those of all tasks fill further full blocks of the source, which are sent
like the others. What then is left of a source, less than one block in all, follows the
full blocks in falling size, so that no block crosses a sequence. The tokens after the last
full sequence are split into sequences whose lengths are powers of two. There is no padding
at all.

Edge cases: a null text is the end token alone. A null source is a queue of its own.
Repeated rows and null ids are packed like others. An empty table gives no pieces. Other
columns are not read. A target of zero or less is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from airtide.llm.prefix_sums import running_totals, with_offsets
from airtide.plans.staging import stage

SEQUENCE = 2048
BLOCK = 256
END_ID = 1
#: Targets become integers out of this.
SHARES = 1 << 40
#: Credits are integers out of this; the second number is its golden section.
CREDIT, _SPREAD = 1 << 20, 648_056
#: Parts of more characters are encoded by ``tokenizers``: tiktoken's pattern search overflows
#: its stack on long runs of blanks.
LONG_PART = 10_000


def merge_ranks(definition: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE definition by bytes, without added tokens.

    The definition writes printable bytes as themselves and the other bytes as the
    characters from 256 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {token["content"] for token in definition.get("added_tokens", [])}
    return {
        bytes(byte_of[c] for c in token): rank
        for token, rank in definition["model"]["vocab"].items()
        if token not in added
    }


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The ids are those that ``tokenizers`` gives for the definition. The merges are run by
    tiktoken on the definition's own vocabulary, which takes a fraction of the time. Texts
    that hold an added token, and long parts, are left to ``tokenizers`` itself. Without
    ``added_tokens`` special tokens are taken as ordinary text.

    A byte-level BPE tokenizer never joins a blank that is followed by a visible
    character to what stands before it, so a text can be encoded in parts that start at
    such blanks; that is done where one of them is long.
    """

    #: How the definition's byte-level pre-tokenizer splits a text.
    WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, definition: str, added_tokens: bool = False):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        ranks = merge_ranks(parsed)
        self._whole = Tokenizer.from_str(definition)
        self._whole.encode_special_tokens = not added_tokens
        self._added = [t["content"] for t in parsed.get("added_tokens", []) if added_tokens]
        self._encode = tiktoken.Encoding(
            "definition", pat_str=self.WORDS, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._blank_run = re.compile(r" (?=\s|\Z)")
        self._part_starts = re.compile(r"(?= [^\s])")

    def _parts(self, text: str) -> list[str]:
        """The parts without their leading blank; the first has none."""
        if self._blank_run.search(text):
            parts = self._part_starts.split(text)
            return parts[:1] + [p[1:] for p in parts[1:]]
        return text.split(" ")

    def _bytes(self, text: str) -> bytes:
        import array

        return array.array("I", self._encode(text)).tobytes()

    def _whole_bytes(self, text: str) -> bytes:
        import array

        return array.array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(text) for text in texts]

    def _one(self, text: str) -> bytes:
        if any(token in text for token in self._added):
            return self._whole_bytes(text)
        if len(text) <= LONG_PART:
            return self._bytes(text)
        first, *others = self._parts(text)
        if max(map(len, others), default=0) < LONG_PART and len(first) <= LONG_PART:
            return self._bytes(text)
        parts = [first, *(" " + part for part in others)]
        return b"".join(
            self._bytes(part) if len(part) <= LONG_PART else self._whole_bytes(part) for part in parts
        )


_encoders: dict[str, Encoder] = {}


def worker_encoder(definition: str) -> Encoder:
    """The worker process's own encoder, which tasks after each other share."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition, added_tokens=True)
    return _encoders[definition]


def _cut_blocks(encoder: Encoder, batches: Iterator, task: int, block: int) -> Iterator:
    """Pieces of the documents of one task, as columns of the piece table."""
    import zlib

    end = END_ID.to_bytes(4, "little")
    filled: dict = {}  # source -> tokens and pieces of its block in the making
    n_blocks: dict = {}

    def emit(out, source, size, number, pieces):
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((task, source, size, number, at, doc, start, n, zlib.crc32(ids), total))
            at += n

    for ids_of_docs, sources, texts in batches:
        out: list[tuple] = []
        for doc, source, ids in zip(ids_of_docs, sources, encoder.encode([t or "" for t in texts])):
            ids += end
            total, start = len(ids) // 4, 0
            n, pieces = filled.get(source, (0, []))
            while start < total:
                take = min(block - n, total - start)
                pieces.append((doc, start, ids[4 * start : 4 * (start + take)], total))
                n, start = n + take, start + take
                if n == block:
                    number = n_blocks.get(source, 0)
                    emit(out, source, block, number, pieces)
                    n_blocks[source] = number + 1
                    n, pieces = 0, []
            filled[source] = (n, pieces)
        yield out
    out = []
    for source, (n, pieces) in filled.items():
        size = block // 2
        while size:
            if n & size:
                taken, room = [], size
                while room:
                    doc, start, ids, total = pieces.pop(0)
                    cut = min(room, len(ids) // 4)
                    taken.append((doc, start, ids[: 4 * cut], total))
                    if 4 * cut < len(ids):
                        pieces.insert(0, (doc, start + cut, ids[4 * cut :], total))
                    room -= cut
                emit(out, source, size, 0, taken)
            size //= 2
    yield out


def _pieces(docs: DataFrame, id: str, text: str, source: str, tokenizer: str, block: int) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())  # one file
    docs = docs.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField("task", long),
            T.StructField("source", T.StringType()),
            T.StructField("size", long),
            T.StructField("block", long),
            T.StructField("at", long),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("start", long),
            T.StructField("length", long),
            T.StructField("ids_crc32", long),
            T.StructField("doc_tokens", long),
        ]
    )

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        few = (
            [column.to_pylist() for column in batch.slice(i, 128).columns]
            for batch in batches
            for i in range(0, batch.num_rows, 128)
        )
        task = TaskContext.get().partitionId()
        encoder = worker_encoder(definition.value)
        for rows in _cut_blocks(encoder, few, task, block):
            columns = zip(*rows) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return docs.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece of a document: where it is cut and where it lies.

    ``tokenizer`` is the path of a byte-level BPE definition. ``targets`` are the sources'
    relative shares of each window; sources that it leaves out share what the targets leave
    of 1 by their sizes, and come last if they leave nothing. Without targets the shares
    are those of the corpus. ``sequence`` and ``block`` are powers of two.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.
    """
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    pieces = stage(_pieces(docs, id, text, source, tokenizer, block), "packing-pieces")
    runs = pieces.groupBy("task", "source", "size").agg((F.max("block") + 1).alias("n"))
    runs = stage(runs, "packing-runs")
    queues = _queues(runs, targets, block)
    totals = queues.agg(F.sum("n_blocks"), F.sum("n_tokens"), F.sum("weight")).first()
    n_blocks, n_tokens, whole = (total or 0 for total in totals)
    places = _places(queues, whole, sequence // block)
    runs = _runs(runs, queues, block, n_blocks * block)

    key = ["task", "source", "size"]
    r = runs.select(*[F.col(k).alias(f"_{k}") for k in key], "first", "tail", "tail_start")
    same = F.col("source").eqNullSafe(F.col("_source"))
    same = same & (F.col("task") == F.col("_task")) & (F.col("size") == F.col("_size"))
    placed = pieces.join(r, same).drop("_task", "_source", "_size")
    token = F.col("first") + F.col("block") * F.col("size") + F.col("at")
    placed = placed.withColumn("token", token)
    placed = placed.withColumn("j", F.when(~F.col("tail"), F.expr(f"token DIV {block}")))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("j") == F.col("_j"))
    full = placed.where("NOT tail").join(places, same).drop("_source", "_j")
    full = full.withColumn("position", F.col("place") * block + F.col("token") % block).drop("place")
    tails = placed.where("tail").withColumn(
        "position", F.col("tail_start") + F.col("block") * F.col("size") + F.col("at")
    )
    placed = full.unionByName(tails)

    n_full = n_tokens // sequence
    sequence_id, offset = F.expr(f"position DIV {sequence}"), F.col("position") % sequence
    start, left, number = n_full * sequence, n_tokens % sequence, n_full
    while left:  # the last sequences, of falling powers of two
        size = 1 << (left.bit_length() - 1)
        here = F.col("position") >= start
        sequence_id = F.when(here, F.lit(number)).otherwise(sequence_id)
        offset = F.when(here, F.col("position") - start).otherwise(offset)
        start, left, number = start + size, left - size, number + 1
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        sequence_id.cast("long").alias("sequence_id"),
        offset.cast("long").alias("offset"),
        "source",
    )


def _queues(runs: DataFrame, targets: dict[str, float] | None, block: int) -> DataFrame:
    """A row per source: its tokens, full blocks, weight and credit."""
    queues = runs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("n_tokens"))
    queues = queues.withColumn("n_blocks", F.expr(f"n_tokens DIV {block}"))
    weight = F.greatest("n_blocks", F.lit(1))
    if targets:
        scale = SHARES / max(1.0, sum(targets.values()))
        named = [(name, max(1, round(share * scale))) for name, share in targets.items()]
        rest = max(0, SHARES - sum(weight for _, weight in named))
        named = runs.sparkSession.createDataFrame(named, "_name string, _weight long")
        queues = queues.join(named, F.col("source") == F.col("_name"), "left").drop("_name")
        other = F.when(F.col("_weight").isNull(), F.col("n_tokens"))
        n_other = queues.agg(F.sum(other)).first()[0] or 1
        weight = F.coalesce("_weight", F.greatest(F.floor(rest * (other / n_other)), F.lit(1)))
    queues = queues.select("source", "n_tokens", "n_blocks", weight.cast("long").alias("weight"))
    # Neighbours by weight get credits a golden section apart, which any few spread evenly.
    ordered = queues.repartitionByRange("weight", "source").sortWithinPartitions("weight", "source")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(ordered.withColumn("credit", row * _SPREAD % CREDIT), "packing-queues")


def _places(queues: DataFrame, whole: int, per_window: int) -> DataFrame:
    """(_source, _j, place) of all full blocks: their ranks by the rounds that send them.

    After r rounds a queue has sent floor(credit + r * per_window * weight / whole) blocks,
    or all that it has.
    """
    few = 1 << 16  # numbers in one array
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(few).cast("long"))
    blocks = queues.where("n_blocks > 0").withColumn("start", F.explode(starts))
    ends = F.least(F.col("start") + (few - 1), F.col("n_blocks") - 1)
    blocks = blocks.withColumn("j", F.explode(F.sequence("start", ends)))
    due = f"CAST((j + 1) * {CREDIT} - credit AS DECIMAL(20, 0)) * CAST({whole} AS DECIMAL(18, 0))"
    quantum = f"CAST({CREDIT * per_window} AS DECIMAL(12, 0)) * CAST(weight AS DECIMAL(18, 0))"
    blocks = blocks.select(
        F.col("source").alias("_source"),
        F.col("j").alias("_j"),
        F.expr(f"({due} + {quantum} - 1) DIV ({quantum})").alias("round"),
    )
    placed = running_totals(blocks, ["round", "_source", "_j"], None, "packing-blocks")
    return placed.select("_source", "_j", F.col("offset").alias("place"))


def _runs(runs: DataFrame, queues: DataFrame, block: int, at: int) -> DataFrame:
    """Runs with their first token's place in their source, which has sizes in falling order.

    Those after the source's last full block are ``tail``. They stand from ``at`` on, again
    in falling size; ``tail_start`` is the place of the first token of the run there.
    """
    by_size = runs.groupBy("source", "size").agg(F.sum("n").alias("n"))
    larger = Window.partitionBy("source").orderBy(F.desc("size"))
    larger = larger.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))
    by_size = by_size.select("source", "size", before.alias("before"))
    runs = with_offsets(runs, ["source", "size"], "task", [], "n")
    on = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.size") == F.col("b.size")]
    runs = runs.alias("a").join(by_size.alias("b"), on).select("a.*", "before")
    on = F.col("a.source").eqNullSafe(F.col("b.source"))
    runs = runs.alias("a").join(queues.alias("b"), on).select("a.*", "before", "n_blocks")
    first = F.col("before") + F.col("offset") * F.col("size")
    runs = runs.withColumn("first", first).drop("before", "offset")
    runs = stage(runs.withColumn("tail", F.col("first") >= F.col("n_blocks") * block), "packing-runs")
    tails = runs.where("tail").withColumns(
        {"falling": -F.col("size"), "tokens": F.col("n") * F.col("size")}
    )
    tails = running_totals(tails, ["falling", "task", "source"], "tokens", "packing-tails")
    tails = tails.withColumn("tail_start", F.col("offset") + at).drop("offset", "falling", "tokens")
    others = runs.where("NOT tail").withColumn("tail_start", F.lit(None).cast("long"))
    return others.unionByName(tails)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
