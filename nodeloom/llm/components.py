"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Minima are aggregated before the shuffle. Where they are joined back to the links, those of hubs (nodes with
more than ``HUB`` links, and more than one in HUBS of all links; at most 2 x HUBS nodes, so their parts are broadcast)
are dealt in parts, so no task gets all of a hub's links. Each round is written to the shared folder: lineage stays short and lost
executors cost one round.

Defined cases: links of a node to itself say nothing; repeated links count once; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import Scratch, stored, task_count

#: Links for each task.
ROWS = 200_000
HUB, HUBS = 1000, 20_000


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """u, v, m: the least v of u's links; n: the number of links, or more."""
    limit = max(HUB, n // HUBS)
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_parts"))
    hubs = least.filter("_parts > 1").select("u", "_parts")
    part = F.coalesce(F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int"), F.lit(0)).alias("_part")
    dealt = links.join(F.broadcast(hubs), "u", "left").select("u", "v", part)
    each = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return dealt.join(each, ["u", "_part"]).select("u", "v", "m")


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) of longs: u, v, where v is the least member of u's component; least members have no row."""
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        state = None
        while True:
            sums = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if not sums[0] or sums == state:
                scratch.keep(edges)
                return edges
            state, before = sums, edges
            tasks = task_count(spark, sums[0], ROWS)
            # Small stars read the large ones' links three times, so these are made once and written.
            middle = stored(_large(edges, sums[0]).coalesce(tasks), "links")
            edges = stored(_small(middle, sums[0]).coalesce(tasks), "links")
            scratch.drop(middle)
            scratch.drop(before)
