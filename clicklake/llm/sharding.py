"""Sharding by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, documents, running_sum, unused

SHARDS = 8


class Leaf(NamedTuple):
    """A shard, where it stands, and the share of the rows it should take."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def default_tree(shards: int = SHARDS) -> list[Leaf]:
    """Regions of two racks of two equal shards; those that fill no region stand alone.

    Shards that stand alone have a region of their own, so a tree of one more shard up to
    a full region, and ``with_one_more`` of any tree, leave all other subtrees as they are.
    """
    full = shards // 4 * 4
    leaves = [Leaf(f"region{s // 4}", f"rack{s // 2}", s) for s in range(full)]
    return leaves + [Leaf(f"alone{s}", f"alone{s}", s) for s in range(full, shards)]


def with_one_more(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with a further shard, in a region of its own: no other weight changes."""
    shard = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"alone{shard}", f"alone{shard}", shard, weight)]


def _drawn(key: Column, level: str, weights: dict, pick) -> Column:
    """What ``pick`` gives for the child of the smallest draw; draws are exponential, of rate weight.

    A child's draw hangs on the key, its own name and its own weight alone. A change of one
    weight therefore moves rows only to or from that child.
    """
    draws = []
    for name, weight in weights.items():
        hashed = F.xxhash64(key, F.lit(level), F.lit(str(name)))
        uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("draw"), pick(name).alias("to")))
    return (draws[0] if len(draws) == 1 else F.array_min(F.array(*draws)))["to"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key: the tree is descended level by level with weighted draws.

    Equal keys, null ones too, come to one shard. Shards of weight 0 or less take no row.
    """
    nested: dict = defaultdict(lambda: defaultdict(dict))
    for leaf in tree:
        if leaf.weight > 0 and math.isfinite(leaf.weight):
            nested[leaf.region][leaf.rack][leaf.shard] = leaf.weight
    if not nested:
        raise ValueError("no shard has a weight above 0")
    region_weights = {r: sum(sum(shards.values()) for shards in racks.values()) for r, racks in nested.items()}

    def region(name: str) -> Column:
        racks = nested[name]
        rack_weights = {rack: sum(shards.values()) for rack, shards in racks.items()}
        # Names of racks and shards are unique within their parent only.
        return _drawn(key, f"rack of {name}", rack_weights, lambda rack: _drawn(
            key, f"shard of {name}/{rack}", racks[rack], lambda shard: F.lit(int(shard))
        ))

    return _drawn(key, "region", region_weights, region).cast("int")


def sharded(docs: DataFrame, tree: Sequence[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and a gapless place in it.

    Gives the columns of ``docs`` besides ``_size`` (UTF-8 bytes of the text plus 1; a null
    text has none), ``_shard`` and ``_slot``, which replace columns of these names. Rows of equal or null keys share a shard, and
    each has a place of its own. An empty table gives an empty result. Slots come from
    counts of hash buckets, so no task holds a shard.
    """
    kept = [name for name in docs.columns if name not in ("_size", "_shard", "_slot")]
    size, shard, bucket, order, slot = unused(docs.select(*kept), "_size", "_shard", "_bucket", "_order", "_slot")
    buckets = buckets_for(docs.count())
    placed = docs.select(
        *kept,
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias(size),
        shard_of(F.col(key), tree).alias(shard),
        F.pmod(F.xxhash64(F.lit("slot"), F.col(key), F.col(text)), F.lit(buckets)).alias(bucket),
        F.col(key).alias(order),
    )
    return running_sum(placed, [shard], bucket, [order], F.lit(1), slot).select(*kept, size, shard, slot)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """``documents`` in 8 shards under the law ``key``, and where they go with a ninth."""
    tree = default_tree(SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    docs = documents(spark, sf_dir).select("doc_id", "text", digest)
    return sharded(docs, tree).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        shard_of(F.col("doc_id"), with_one_more(tree)).alias("grown_shard"),
    )
