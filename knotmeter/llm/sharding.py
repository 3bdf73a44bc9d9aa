"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted draws.

:func:`descend` draws at each level among the children of the chosen node only: a child's draw is an exponential
variable with the summed weight below it as its rate, made from a hash of key, level and child, and the least draw wins. A
changed weight moves keys between the subtrees that hold it and others; within subtrees whose weights stay nothing moves.
A tree that grows by a new region (:func:`grown_tree`) sends keys into that region alone, so one more shard takes rows only
into itself.

:func:`assign` is the variant for weights that change inside a region: a rack's draw is the least of its shards' draws and
a region's the least of its racks'. That costs a draw for every shard, and moves keys to or from the changed shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.common import ranked
from knotmeter.session import materialize

#: ``(region, rack, shard, weight)``
Tree = list[tuple[int, int, int, float]]


def regular_tree(shards: int, racks: int = 4, per_rack: int = 3) -> Tree:
    """Shards in the order of their numbers: ``per_rack`` to a rack, ``racks`` to a region, equal weights."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    return [(i // (racks * per_rack), i // per_rack, i, 1.0) for i in range(shards)]


def _least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def _draw(key: Column, shard: int, weight: float) -> Column:
    # 53 bits of the hash as a number in (0, 1)
    part = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((part + 0.5) / float(1 << 53)) / F.lit(float(weight))


def assign(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """Adds the shard of each row; a null key is a key like any other. Weights must be above 0.

    Pure column expressions, no shuffle: key and tree decide, so equal keys stay together.
    """
    if any(weight <= 0 for *_, weight in tree):
        raise ValueError("weights must be above 0; leave a shard without weight out of the tree")
    regions: dict[int, dict[int, list[Column]]] = {}
    for region, rack, shard, weight in tree:
        leaf = F.struct(_draw(F.col(key), shard, weight).alias("draw"), F.lit(shard).alias("shard"))
        regions.setdefault(region, {}).setdefault(rack, []).append(leaf)
    # each level passes its least draw up, together with the shard below that has it
    root = _least([_least([_least(leaves) for leaves in racks.values()]) for racks in regions.values()])
    return df.withColumn(name, root["shard"])


def grown_tree(tree: Tree) -> Tree:
    """The tree with one more shard of weight 1, in a region and rack of its own."""
    region, rack, shard = (max(node[level] for node in tree) + 1 for level in range(3))
    return [*tree, (region, rack, shard, 1.0)]


def _level_draw(key: Column, level: str, node: int, weight: float) -> Column:
    # 53 bits of the hash as a number in (0, 1)
    part = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double")
    return -F.log((part + 0.5) / float(1 << 53)) / F.lit(float(weight))


def _chosen(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_level_draw(key, level, node, weight).alias("draw"), F.lit(node).alias("node")) for node, weight in weights.items()]
    return _least(draws)["node"]


def _below(chosen: Column, found: dict[int, Column]) -> Column:
    """The column of the chosen node; those of other nodes are not worked out."""
    out = None
    for node, column in found.items():
        out = F.when(chosen == node, column) if out is None else out.when(chosen == node, column)
    return out


def descend(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """Adds the shard of each row by a draw at each level; a null key is a key like any other.

    Pure column expressions, no shuffle: key and tree decide, so equal keys stay together. Racks and shards have numbers
    of their own in the whole tree. Columns that are called as the steps on the way are left as they are.
    """
    if any(weight <= 0 for *_, weight in tree):
        raise ValueError("weights must be above 0; leave a shard without weight out of the tree")
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for region, rack, shard, weight in tree:
        regions.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    of_rack = {rack: sum(shards.values()) for racks in regions.values() for rack, shards in racks.items()}
    of_region = {region: sum(of_rack[rack] for rack in racks) for region, racks in regions.items()}
    column = F.col(key)
    region_step, rack_step = f"_{name}_region", f"_{name}_rack"
    while {region_step, rack_step} & set(df.columns):
        region_step, rack_step = f"_{region_step}", f"_{rack_step}"
    racks = {region: _chosen(column, "rack", {rack: of_rack[rack] for rack in below}) for region, below in regions.items()}
    shards = {rack: _chosen(column, "shard", below) for found in regions.values() for rack, below in found.items()}
    return (
        df.withColumn(region_step, _chosen(column, "region", of_region))
        .withColumn(rack_step, _below(F.col(region_step), racks))
        .withColumn(name, _below(F.col(rack_step), shards))
        .drop(region_step, rack_step)
    )


def sharded_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """Each document's size, checksum, shard, place in the shard and shard in the grown tree.

    ``doc_id, size, text_crc32, shard, slot, grown_shard``. Texts stay where they are read; narrow rows
    are numbered in hash buckets, so a shard is the work of many tasks. A null text has size 8
    and the checksum of no bytes. Rows that share an id share a shard and have slots of their own.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = descend(narrow, "doc_id", tree)
    out = descend(out, "doc_id", grown, "grown_shard") if grown else out.withColumn("grown_shard", F.lit(None).cast("int"))
    stored = materialize(out)
    return ranked(stored, ["shard"], ["doc_id", "size", "text_crc32"], "slot", stored.count())


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """Writes whole documents to a folder for each shard, with all their columns.

    Null ids and texts are written as any other. A column ``shard`` would be lost to the folders' names: it is refused.
    No documents give a folder without shards.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the documents have a column named shard; rename it first")
    descend(docs, "doc_id", tree).write.mode("overwrite").partitionBy("shard").parquet(path)
