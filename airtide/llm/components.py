"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airtide.operators.lookup import attach
from airtide.plans.staging import stage

MAX_ROUNDS = 60


def star_links(links: DataFrame, name: str = "stars") -> DataFrame:
    """(a, b) links -> (node, root): every node that is not its component's smallest.

    Each round replaces links by links to the smallest neighbour, once among larger and
    once among smaller neighbours; the number of rounds grows with the logarithm of a
    component's width. A round's links are written, so no round is ever done twice. The
    number of links does not grow.
    """
    links = links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    links = stage(links, name)
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.selectExpr("b AS a", "a AS b"))
        smallest = both.groupBy("a").agg(
            F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")
        )
        found = attach(both, smallest, {"a": F.col("a")}, row_id="a, b", weight="n")
        large = found.where("b > a").selectExpr("b AS a", "m AS b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        found = attach(large, smallest, {"a": F.col("a")}, row_id="a, b", weight="n")
        small = found.where("b <> m").selectExpr("b AS a", "m AS b")
        links = stage(small.union(smallest.selectExpr("a", "m AS b")).distinct(), name)
        before, state = state, _state(links)
        if state == before:
            return links.selectExpr("a AS node", "b AS root")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def _state(links: DataFrame) -> tuple:
    """A digest of the set of links."""
    return tuple(
        links.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % (1 << 20))
        ).first()
    )
