"""Connected components of link tables, by alternating large-star and small-star steps.

A step takes the smallest neighbour of each node and sends it to the node's other neighbours. A node may have a third of all links,
so the minima are a table of their own, with one row for each node: they are broadcast where they are few, and otherwise joined by a
shuffle whose large side Spark can split, as nothing else hangs on how it is dealt. The minima themselves are combined before they
are shuffled, once by (node, part) and then by node, so no task gets more than PARTS rows of one node for each of its own.

Links are written to the shared folder after each step, so a lost executor costs one step at most. Nothing but two numbers a round
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, small_side, written

ROUNDS, PARTS = 60, 16


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(links: DataFrame) -> DataFrame:
    """(a, m): the smallest b of each a."""
    some = links.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part")).agg(F.min("b").alias("m"))
    return written(some.groupBy("a").agg(F.min("m").alias("m")), "least")


def _step(links: DataFrame) -> DataFrame:
    """links have a > b. A large star, then a small one; each drops what says nothing new."""
    both = _both(links)
    least = _least(both)
    # each node's larger neighbours get its smallest neighbour, or itself
    large = written(both.filter("b > a").join(small_side(least), "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct(), "links")
    discard(least)
    # each node's smaller neighbours get the smallest of them, and so does the node itself
    least = _least(large)
    moved = large.join(small_side(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    now = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    discard(large)
    discard(least)
    return now


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node that has a link. links: (a long, b long),
    in any direction, repeats and loops allowed."""
    turned = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(turned, "links")
    mark = None
    for _ in range(ROUNDS):
        after = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if after[0] == 0 or after == mark:
            break
        mark = after
        old, now = now, _step(now)
        discard(old)
    else:
        raise RuntimeError(f"components haven't settled after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
