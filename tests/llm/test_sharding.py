import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from clicklake.llm import sharding
from clicklake.llm.sharding import Leaf


def drawn(key, level, weights):
    """The child of the smallest exponential draw, with another library's 64-bit hash."""

    def draw(name, weight):
        hashed = 42
        for part in (struct.pack("<q", key) if key is not None else None, level.encode(), str(name).encode()):
            hashed = hashed if part is None else xxhash.xxh64(part, seed=hashed).intdigest()
        return -math.log(((hashed >> 11) + 0.5) / 2**53) / weight

    return min(weights, key=lambda name: draw(name, weights[name]))


def descended(key, tree):
    """The shard of a key, level by level."""

    def level(leaves, part):
        weights = defaultdict(float)
        for leaf in leaves:
            weights[getattr(leaf, part)] += leaf.weight
        return {name: weight for name, weight in weights.items() if weight > 0}

    region = drawn(key, "region", level(tree, "region"))
    tree = [leaf for leaf in tree if leaf.region == region]
    rack = drawn(key, f"rack of {region}", level(tree, "rack"))
    tree = [leaf for leaf in tree if leaf.rack == rack]
    return drawn(key, f"shard of {region}/{rack}", level(tree, "shard"))


def test_shards_equal_a_plain_descent(spark):
    tree = [Leaf("a", "x", 0, 3.0), Leaf("a", "y", 1, 1.0), Leaf("b", "x", 2, 4.0), Leaf("b", "x", 3, 0.5), Leaf("b", "x", 4, 0.0)]
    ids = spark.createDataFrame([(n,) for n in [*range(-300, 300), 2**62, None]], "id long")
    for leaves in (tree, sharding.default_tree(8), sharding.default_tree(9)):
        found = {r["id"]: r["shard"] for r in ids.select("id", sharding.shard_of(ids["id"], leaves).alias("shard")).collect()}
        assert found == {key: descended(key, leaves) for key in found}


def test_documents_in_shards(spark, sf_dir):
    rows = sharding.op8_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == descended(r["doc_id"], sharding.default_tree(8))
        assert r["grown_shard"] == descended(r["doc_id"], sharding.default_tree(9)) and r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert slots.keys() == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_follow_the_weights(spark):
    tree = [Leaf("a", "x", 0, 3.0), Leaf("a", "y", 1, 1.0), Leaf("b", "x", 2, 4.0), Leaf("b", "x", 3, 0.0)]
    ids = spark.range(40000)
    counts = Counter(r[0] for r in ids.select(sharding.shard_of(ids["id"], tree)).collect())
    assert counts.keys() == {0, 1, 2}
    for shard, share in ((0, 3 / 8), (1, 1 / 8), (2, 4 / 8)):
        assert abs(counts[shard] - 40000 * share) < 5 * (40000 * share) ** 0.5


@pytest.mark.parametrize("shards", range(1, 13))
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    before = sharding.default_tree(shards)
    after = sharding.with_one_more(before)
    ids = spark.range(5000)
    moved = ids.select(sharding.shard_of(ids["id"], before).alias("a"), sharding.shard_of(ids["id"], after).alias("b"))
    assert {r["b"] for r in moved.filter("a <> b").collect()} == {shards}


def test_a_changed_weight_moves_rows_within_its_subtree_or_across_regions_to_it(spark):
    tree = sharding.default_tree(8)
    heavier = [leaf._replace(weight=2.0) if leaf.shard == 5 else leaf for leaf in tree]
    ids = spark.range(8000)
    moved = ids.select(sharding.shard_of(ids["id"], tree).alias("a"), sharding.shard_of(ids["id"], heavier).alias("b"))
    for r in moved.filter("a <> b").collect():
        # Only into region 1, and within it only into rack 2, and within that only to shard 5.
        assert r["b"] // 4 == 1
        assert r["a"] // 4 == 0 or r["b"] // 2 == 2
        assert r["a"] // 2 != 2 or r["b"] == 5


def test_odd_documents(odd_documents, no_documents):
    tree = sharding.default_tree()
    rows = sharding.sharded(odd_documents, tree).collect()
    assert len(rows) == odd_documents.count()
    assert {"_row", "kind", "size", "_size", "_shard", "_slot"} <= set(rows[0].asDict())
    shards = defaultdict(set)
    for r in rows:
        shards[r["doc_id"]].add(r["_shard"])
        assert r["_size"] == len((r["text"] or "").encode()) + 1
    assert all(len(s) == 1 for s in shards.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r["_shard"]].append(r["_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.sharded(odd_documents.withColumnRenamed("kind", "_bucket"), tree)
    assert again.count() == len(rows)
    assert sharding.sharded(no_documents, tree).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(odd_documents["doc_id"], [Leaf("a", "b", 0, 0.0)])
