"""Operators on networks: edges (eid, src, dst, class, len_m), travelled both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def from_ways(ways: DataFrame, precision: int = 1) -> DataFrame:
    """Edges between successive points of ways (way, vidx, x, y, class); points that round alike are one vertex."""
    rounded = ways.withColumns({"x": F.round("x", precision), "y": F.round("y", precision)})
    over = Window.partitionBy("way").orderBy("vidx")
    after = lambda c: F.lead(c).over(over)
    spans = rounded.withColumns({"x1": after("x"), "y1": after("y")}).where("x1 IS NOT NULL AND NOT (x = x1 AND y = y1)")
    node = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    return spans.select(
        F.concat_ws("-", F.col("way").cast("string"), F.col("vidx").cast("string")).alias("eid"),
        node("x", "y").alias("src"),
        node("x1", "y1").alias("dst"),
        "class",
        F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("len_m"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(turned)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def road_vertices(edges: DataFrame, kind: str = "road") -> DataFrame:
    """Vertices that touch an edge of the kind; all of them if there is none."""
    roads = edges.where(F.col("class") == kind)
    return vertices(roads) if not roads.isEmpty() else vertices(edges)


def edge_of_pair(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, eid: the first edge between two vertices, either way.

    An edge is one row, under its two ends in order. Rows are dealt before they are grouped, so that no task sorts them while it still holds what they were made from.
    """
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    ends = {"__a": F.when(both, F.least("src", "dst")), "__b": F.when(both, F.greatest("src", "dst"))}
    dealt = edges.select("eid", *(c.alias(n) for n, c in ends.items())).repartition("__a", "__b")
    first = dealt.groupBy("__a", "__b").agg(F.min("eid").alias("eid"))
    return pairs.withColumns(ends).join(first, ["__a", "__b"], "left").select(*pairs.columns, "eid")


def class_counts(edges: DataFrame, kinds: tuple[str, ...] = ("road", "4wd", "trail")) -> DataFrame:
    domain = edges.sparkSession.createDataFrame([(k,) for k in kinds], "class string")
    return domain.join(edges.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
