"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write

SMALL = 20_000           # edges whose minima (a row per node) are broadcast, so that edges are not shuffled for them
PER_FILE, FILES = 50_000, 12    # edges written to a file, and files at least


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """``rows``, ``count`` at most, in fewer tasks and files if they are few."""
    return rows.coalesce(max(FILES, count // PER_FILE))


def _by_node(rows: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``rows`` with the minimum ``m`` of their node."""
    return rows.join(F.broadcast(_dealt(least, count)) if count <= SMALL else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Larger neighbours of each node linked to its smallest one or itself; always (larger, smaller), rows may repeat."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _by_node(both.filter("b > a"), least, count).filter("a != b")


def _small_star(down: DataFrame, count: int) -> DataFrame:
    """The same for the smaller neighbours and the node itself; ``down`` has (larger, smaller) rows."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return _by_node(down, least, count).unionByName(_dealt(own, count) if count <= SMALL else own).filter("a != b").distinct()


def _state(edges: DataFrame) -> tuple[int, object]:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; bigint); component: its smallest node.

    Every step only groups with map-side minima and joins on a node, and is written to the shared
    folder.  Steps of few edges broadcast the minima and end in few tasks, as most of their time goes
    to tasks without rows.  A node that is its component's smallest has a row as well.  No edges: no rows.
    """
    down = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = write(down.distinct(), "edges")
    seen = _state(edges)
    while seen[0]:
        # each step has at most the edges of the one before
        edges = write(_dealt(_small_star(_large_star(edges, seen[0]), seen[0]), seen[0]), "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = _dealt(edges.select(F.col("b").alias("node")).distinct(), seen[0]).withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
