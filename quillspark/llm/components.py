"""Connected components of links, by alternating stars.

Links are (a, b) of 64-bit nodes. The large star links each node's larger neighbours to its smallest one, the
small star its smaller ones; both repeat until nothing changes, when every node is linked to the smallest of its
component. Each round is two aggregations and joins, split by Spark where a node has very many links; rounds are
cut by tables in the shared folder.

Defined results: links of a node to itself and repeated links don't count, links with a null end are left out, no links give no rows; a node without a link isn't
returned. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common


def _directed(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b): of each node and its smallest neighbour or itself, the links of its larger or smaller neighbours to that."""
    around = _directed(links) if large else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("of", "m").alias("m"))
    joined = around.join(least, around.a == least.of)
    found = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node that it reaches. Links of a node to itself don't count."""
    now = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = common.stored(_star(_star(now, True), False), "links")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (r["n"], r["h"]):
            break
        state = (r["n"], r["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
