"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At every node each child c draws -ln(u(key, c)) / weight(c), where u is a uniform hash of the key and
of the child's own name; the least draw wins, so a child gets rows in proportion to its weight. A
child's draw depends on nothing but its name and weight: where one weight grows, rows move only into
that subtree, where one falls, only out of it, and elsewhere nothing moves. A shard that comes as a
subtree of its own (``grown``) takes rows only into itself.

Placement needs no shuffle. Slots are numbered in two steps, so that no task holds a shard: counts
of (shard, bucket) come from the ids alone and are summed before the shuffle, their running totals
are bounded by shards x BUCKETS rows, and row numbers are taken within one bucket.

Defined cases: a null text counts no bytes and has the checksum of an empty one; a null id is a key
of its own; repeated rows and equal ids go to the same shard and get slots in the order of id,
checksum and size; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard are numbered in so many buckets.
BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A shard (a leaf, with its number) or a region or rack (with children); a node weighs what its leaves weigh."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks: int = 2, per_rack: int = 5, weights: dict[int, float] | None = None) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards, filled in order; the last may be smaller."""
    weights, regions = weights or {}, []
    for first in range(0, shards, racks * per_rack):
        inside = []
        for at in range(first, min(shards, first + racks * per_rack), per_rack):
            leaves = tuple(Node(f"shard{s}", shard=s, own_weight=weights.get(s, 1.0)) for s in range(at, min(shards, at + per_rack)))
            inside.append(Node(f"rack{at // per_rack}", leaves))
        regions.append(Node(f"region{first // (racks * per_rack)}", tuple(inside)))
    return Node("root", tuple(regions))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"region-of-shard{shard}", (Node(f"rack-of-shard{shard}", (leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    """Exponential with the child's weight as its rate; 53 bits of the hash, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(child.weight)


def _descend(key: Column, node: Node) -> Column:
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return _descend(key, live[0])
    if all(not c.children for c in live):
        return F.least(*[F.struct(_draw(key, c).alias("draw"), F.lit(c.shard).alias("shard")) for c in live])["shard"]
    best = F.least(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)])["child"]
    return _switch(best, [_descend(key, c) for c in live])


def _switch(at: Column, results: list[Column]) -> Column:
    out = None
    for i, result in enumerate(results):
        out = F.when(at == i, result) if out is None else out.when(at == i, result)
    return out


def shard_of(key: Column, root: Node) -> Column:
    """The shard number, as one expression."""
    return _descend(key, root).cast("int")


def placed(docs: DataFrame, root: Node, larger: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null without ``larger``)."""
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    rows = docs.select(
        key.alias(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, root).alias("shard"),
        bucket.alias("_bucket"),
        (shard_of(key, larger) if larger is not None else F.lit(None).cast("int")).alias("grown_shard"),
    )
    counts = docs.select(shard_of(key, root).alias("shard"), bucket.alias("_bucket")).groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    out = numbered.join(starts, ["shard", "_bucket"])
    return out.select(id_col, "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
