"""Periodic runs of words: maximal stretches that repeat with a smallest period.

The Lyndon array of a word sequence (the length of the longest Lyndon word that starts at
each position) is what the first phase of Baier's suffix sorter leaves behind. Suffixes
lie in groups of equal first words. Groups are taken from the highest down; each position
of the group is linked to the nearest position on its left whose group is lower, and that
position moves to a new group just above its own, one for each number of links, whose
prefix is longer by as many copies of the taken group's. The prefix of a group when it is
taken is its positions' Lyndon word. This is done under the order of the words and under
the reverse order: each run has a root that is a Lyndon word under one of them, at a place
other than its start. A root (i, p) is extended to both sides by the longest common
extensions of i and i + p, and the runs are what results.

Only stretches that may hold a run are sorted. In a run of period q and exponent e each
window of words recurs q words further on, so that all windows but those of the first
period have an earlier copy within q words. Stretches of consecutive windows that recur
within a distance that their number allows are found by hashes of whole windows; equal
windows have equal hashes, so that no run is lost, and a chance match costs time only.
The extension reads the whole text.

Edge cases: a null, empty or blank text has no run. Overlapping runs are all reported.
Repeated rows and null ids are treated like any other row. An empty table gives no rows.
Other columns are carried along; columns ``runs`` and ``collapsed`` are replaced. Time and
memory of a text grow with its length alone, whatever it repeats.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words of a window that is hashed.
WINDOW = 8

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"runs array<{RUN}>, collapsed string"

#: Words as in the contracts; Java's and Python's patterns agree on it.
BLANKS = r"[\x20\x09-\x0D]+"


def lyndon_array(symbols: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word at each position; phase one of Baier's sorter."""
    n = len(symbols)
    # Positions count from 1; 0 and n + 1 are the ends of the list of untaken positions.
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols, 1):
        by_symbol[s].append(i)
    ordered = sorted(by_symbol)
    members = [by_symbol[s] for s in ordered]
    prefix = [1] * len(members)  # length of the words that a group's suffixes share
    below = list(range(-1, len(members) - 1))
    group = [0] * (n + 2)
    for g, positions in enumerate(members):
        for i in positions:
            group[i] = g
    # The next group above, needed to insert between two groups.
    above = list(range(1, len(members) + 1))
    length = [0] * (n + 2)
    taken = len(members) - 1
    while taken >= 0:
        grown = prefix[taken]
        links: dict[int, int] = {}
        for i in sorted([i for i in members[taken] if group[i] == taken]):
            length[i] = grown
            before, after = left[i], right[i]
            right[before] = after
            left[after] = before
            if before:
                links[before] = links.get(before, 0) + 1
        moving: dict[tuple[int, int], list[int]] = {}
        for i, count in links.items():
            moving.setdefault((group[i], count), []).append(i)
        # More links go above fewer, all just above the old group.
        for (old, count), positions in sorted(moving.items(), reverse=True) if len(moving) > 1 else moving.items():
            new = len(members)
            members.append(positions)
            prefix.append(prefix[old] + count * grown)
            upper = above[old]
            above.append(upper)
            below.append(old)
            above[old] = new
            if upper < new:
                below[upper] = new
            for i in positions:
                group[i] = new
        members[taken] = []
        taken = below[taken]
    return length[1 : n + 1]


def extension(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How far x agrees from a and from b > a on, forward (step 1) or backward (step -1)."""
    room = len(x) - b if step > 0 else a + 1
    done, block = 0, 16
    while done < room:
        m = min(block, room - done)
        if step > 0:
            differ = x[a + done : a + done + m] != x[b + done : b + done + m]
        else:
            differ = (x[a - done - m + 1 : a - done + 1] != x[b - done - m + 1 : b - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += m
        block *= 2
    return done


def _stretches(flags: np.ndarray) -> np.ndarray:
    """(first, one past the last) of each stretch of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def _places(words: list[bytes], min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Ranges of words; every run lies in one, with the words beside it."""
    n, window = len(words), WINDOW
    # Of a run of length L and period q, L - q - window + 1 windows recur within q words.
    least = min_length - min_length // min_exponent - window + 1
    if least < 1:
        return [(0, n)]
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        windows *= np.uint64(0x9E3779B97F4A7C15)
        windows += hashes[j : n - window + 1 + j]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(same) < least:
        return []
    distance = np.zeros(len(windows), np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    while True:
        found = _stretches(distance > 0)
        found = found[found[:, 1] - found[:, 0] >= least]
        # m recurring windows are those of a period of at most this many words.
        longest = (found[:, 1] - found[:, 0] + window - 1) // (min_exponent - 1)
        near = np.zeros(len(windows), bool)
        for (a, b), q in zip(found.tolist(), longest.tolist()):
            near[a:b] = distance[a:b] <= q
        if near.sum() == (distance > 0).sum():
            break
        distance[~near] = 0
    return [
        (max(0, a - q - 1), min(n, b + window))
        for (a, b), q in zip(found.tolist(), longest.tolist())
    ]


def find(
    words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period."""
    if len(words) < min_length:
        return []
    places = _places(words, min_length, min_exponent)
    if not places:
        return []
    ranks: dict[bytes, int] = {}
    x = np.fromiter((ranks.setdefault(w, len(ranks)) for w in words), np.int64, len(words))
    found = set()
    for begin, end in places:
        part = x[begin:end]
        for symbols in (part, -part):
            roots = np.array(lyndon_array(symbols.tolist()), np.int64)
            at = np.arange(len(roots))
            # The root of an exponent of 3 is followed by a copy, a root as well; one of 2 may not be.
            following = at + roots
            inside = np.minimum(following, len(roots) - 1)
            twice = following < len(roots)
            if min_exponent >= 3:
                twice &= roots[inside] == roots
            twice &= part[inside] == part
            seen: dict[int, int] = {}  # period -> end of the last run of it
            for i, p in zip((at[twice] + begin).tolist(), roots[twice].tolist()):
                if i + p < seen.get(p, 0):
                    continue
                stop = i + p + extension(x, i, i + p, 1)
                start = i - extension(x, i - 1, i + p - 1, -1) if i else 0
                if stop - start >= 2 * p:
                    seen[p] = stop
                if stop - start >= max(min_length, min_exponent * p):
                    found.add((start, stop - start, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def with_runs(
    docs: DataFrame,
    *,
    text: str | Column = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Add ``runs`` (by start, then period) and ``collapsed``, the kept words with one space between.

    A run has ``min_length`` words or more and ``min_exponent`` (2 or more) periods or more.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have two periods or more, and a word or more")

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            words = value.encode().split()  # blanks of ASCII, which are those of BLANKS
            runs = find(words, min_length, min_exponent)
            out.append((runs, b" ".join(collapse(words, runs)).decode()))
        return pd.DataFrame(out, columns=["runs", "collapsed"])

    value = F.col(f"`{text}`") if isinstance(text, str) else text
    found = search(F.coalesce(value.cast("string"), F.lit("")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.select(*kept, found.alias("_found")).select(*kept, "_found.runs", "_found.collapsed")


def planted(id: Column, text: Column) -> Column:
    """The text, of which a tenth by their ids repeat their words from some word on."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - a)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), repeated).otherwise(text)


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of runs, the one of the greatest exponent, and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = with_runs(docs).drop("text")

    def order(a: Column, b: Column) -> Column:
        more = a["length"] * b["period"] - b["length"] * a["period"]
        first = F.when(more != 0, -more).when(
            a["start"] != b["start"], a["start"] - b["start"]
        ).otherwise(a["period"] - b["period"])
        return F.signum(first).cast("int")

    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("runs").alias("_runs"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "start", "length", "period",
        F.expr("1000 * length DIV period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
