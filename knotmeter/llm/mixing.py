"""Mixing sources to target weights along a low-discrepancy schedule.

Slots of equal size follow one another. Slot i belongs to the source in whose share of the cumulative
weights the van der Corput point of i falls, so that every stretch of the schedule has the sources near
their weights. Each source's documents stand in a shuffled order, once an epoch, cut into
blocks as long as a slot, and the n-th slot of a source takes its n-th block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.common import WORD, row_key
from knotmeter.session import materialize

#: A source is repeated at most so often.
EPOCHS = 3
#: Slots whose bits are reversed to a point; the schedule may be longer, then points repeat.
BITS = 40


def sizes(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, source, size, copies``: a row for all equal documents, with its words (null: 0)."""
    each = docs.select(
        *row_key(), F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return each.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame) -> DataFrame:
    """``source, weight, source_size, target``: a row for each source; sources are few, as weights are set by hand.

    Weights are 1, 2, 3, repeating, by code point, null last. Targets share the sum of all sizes by
    weight and stop at three times the source. In the order of size by weight the sources that stop
    come first, so the level at which the others share the rest follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        .withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("cap", (EPOCHS * F.col("source_size")).cast("double"))
        .withColumn("all_size", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("rest", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("weights"))
        .withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # the level of the first source that does not stop holds for all after it
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(whole)["level"]
    return out.select(
        "source", "weight", "source_size",
        F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * free).alias("target"),
    )


def _point(slot: Column) -> Column:
    """Van der Corput point in base 2: the bits of the slot mirrored at the binary point."""
    mirrored = F.conv(F.reverse(F.lpad(F.conv(F.pmod(slot, F.lit(1 << BITS)).cast("string"), 10, 2), BITS, "0")), 2, 10)
    return mirrored.cast("double") / F.lit(float(1 << BITS))


def schedule(shares: DataFrame, slots: int, slot_size: int) -> DataFrame:
    """``slot, source, rank``: which block of which source each slot takes.

    A source stops when its target is reached. What a source still lacks at the end, a few blocks by the
    discrepancy of the points, follows after the last slot. Ranks are counted in stretches of
    slots to which running totals are added, so no source is numbered in one task.
    """
    spark = shares.sparkSession
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = shares.where("target > 0").select(
        "source",
        (F.sum("target").over(running) / F.sum("target").over(whole)).alias("upto"),
        F.ceil(F.round("target") / slot_size).alias("quota"),
    )
    # a list of the few cumulative weights, in the plan as a literal
    bounds = ranges.orderBy("upto").collect()
    if not bounds:
        return spark.createDataFrame([], "slot long, source string, rank long")
    ends = F.array(*[F.lit(float(r["upto"])) for r in bounds])
    names = F.array(*[F.lit(r["source"]).cast("string") for r in bounds])
    quotas = F.array(*[F.lit(int(r["quota"])) for r in bounds])
    place = F.least(F.size(F.filter(ends, lambda x: x <= F.col("point"))), F.lit(len(bounds) - 1))
    drawn = (
        spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
        .select("slot", place.alias("at"), F.floor(F.col("slot") / 16_384).alias("stretch"))
    )
    before = Window.partitionBy("at").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("at", "stretch").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("at", "stretch").orderBy("slot")
    regular = (
        drawn.join(offsets, ["at", "stretch"])
        .select("slot", "at", (F.col("done") + F.row_number().over(inside) - 1).alias("rank"))
        .where(F.col("rank") < F.element_at(quotas, F.col("at") + 1))
    )
    sources = spark.createDataFrame([(i,) for i in range(len(bounds))], "at int")
    missing = (
        sources.join(counts.groupBy("at").agg(F.sum("n").alias("have")), "at", "left")
        .select("at", F.coalesce("have", F.lit(0)).alias("have"), F.element_at(quotas, F.col("at") + 1).alias("quota"))
        .where("have < quota")
        .select("at", F.explode(F.sequence("have", F.col("quota") - 1)).alias("rank"))
        .select((F.lit(slots) + F.row_number().over(Window.orderBy("rank", "at")) - 1).alias("slot"), "at", "rank")
    )
    return regular.unionByName(missing).select("slot", F.element_at(names, F.col("at") + 1).alias("source"), "rank")


def blocks(sized: DataFrame, shares: DataFrame, slot_size: int, seed: int) -> DataFrame:
    """``source, rank, k1, k2, copy, epoch, start, length``: pieces of documents in each block of a source.

    Documents are put in the order of a hash of seed, epoch and id, which runs through buckets of
    the hash with running totals, so a source with a third of all rows is spread.
    """
    wanted = F.round("target").cast("long")
    spread = (
        sized.where("size > 0").join(shares.where("target > 0"), sized["source"].eqNullSafe(shares["source"]))
        .select(
            sized["source"], "k1", "k2", "doc_id", "size", "source_size", wanted.alias("wanted"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("wanted") - 1) / F.col("source_size")).cast("int"))))
        .withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy")))
        .withColumn("bucket", F.substring("order", 1, 3))
    )
    stored = materialize(spread)
    key = ["source", "epoch", "bucket"]
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(*key).agg(F.sum("size").alias("n"))
        .select(*[F.col(c).alias(f"b_{c}") for c in key], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"))
    )
    inside = Window.partitionBy(*key).orderBy("order", "k2").rowsBetween(Window.unboundedPreceding, 0)
    same = [stored["source"].eqNullSafe(offsets["b_source"]), stored["epoch"] == offsets["b_epoch"], stored["bucket"] == offsets["b_bucket"]]
    placed = (
        stored.join(offsets, same)
        .withColumn("end", F.col("epoch") * F.col("source_size") + F.col("done") + F.sum("size").over(inside))
        .withColumn("begin", F.col("end") - F.col("size"))
        .where("begin < wanted")
        .withColumn("stop", F.least("end", "wanted"))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / slot_size), F.floor((F.col("stop") - 1) / slot_size))))
        .withColumn("from", F.greatest("begin", F.col("rank") * slot_size))
        .withColumn("to", F.least("stop", (F.col("rank") + 1) * slot_size))
    )
    return placed.select(
        "source", "rank", "k1", "k2", "copy", "epoch",
        (F.col("from") - F.col("begin")).alias("start"), (F.col("to") - F.col("from")).alias("length"),
    )


def mix(sized: DataFrame, shares: DataFrame, slot_size: int | None = None, seed: int = 17) -> DataFrame:
    """The mix as ``slot, source, rank, k1, k2, copy, epoch, start, length``, one row for each piece.

    ``sized`` and ``shares`` are stored tables as :func:`sizes` and :func:`targets` make them. A slot has
    as many words as gives about 4,096 slots and at most 2,048 words, unless it is set. No words: no rows.
    """
    total = int(shares.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    slot_size = slot_size or max(1, min(2048, total // 4096))
    taken = schedule(shares, math.ceil(total / slot_size), slot_size)
    pieces = blocks(sized, shares, slot_size, seed)
    slots = taken.select("slot", F.col("source").alias("s_source"), F.col("rank").alias("s_rank"))
    return pieces.join(slots, pieces["source"].eqNullSafe(slots["s_source"]) & (pieces["rank"] == slots["s_rank"])).select(
        "slot", "source", "rank", "k1", "k2", "copy", "epoch", "start", "length"
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Each document with its size, its source's size and target, and the words the mix takes of it.

    ``doc_id, size, source_size, target, taken, source, first_slot``; the last is the slot of the schedule that takes the
    document's first words, null if none does, and puts the documents in the order of the mix. Documents without words take nothing. Equal rows
    are copies that stand in the mix on their own; of ``taken`` each gets its own part.
    """
    sized = materialize(sizes(docs))
    shares = materialize(targets(sized))
    pieces = mix(sized, shares, seed=seed)
    taken = pieces.groupBy("k1", "k2", "source", "copy").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select("k1", "k2", F.col("source").alias("t_source"), F.col("copy").alias("t_copy"), "taken", "first_slot")
    each = (
        sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .join(shares.select(F.col("source").alias("s_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s_source")))
    )
    out = each.join(
        taken,
        (each["k1"] == taken["k1"]) & (each["k2"] == taken["k2"]) & (each["copy"] == taken["t_copy"]) & each["source"].eqNullSafe(taken["t_source"]),
        "left",
    )
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_slot")


def mixed_texts(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: each as often as it is taken, with all columns; the last of a source may be cut short.

    Documents without words are not taken. A document that is cut keeps its first words, joined by blanks;
    ``n_chars``, if there is such a column, follows its text.
    """
    sized = materialize(sizes(docs))
    shares = materialize(targets(sized))
    pieces = mix(sized, shares, seed=seed)
    # the pieces of one epoch follow one another, so their sum is where the document ends
    taken = pieces.groupBy("k1", "k2", "source", "copy", "epoch").agg(F.sum("length").alias("taken"))
    lists = taken.groupBy("k1", "k2", "source").agg(F.collect_list(F.struct("copy", "taken")).alias("takes"))
    lists = lists.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("source").alias("t_source"), "takes")
    keyed = docs.select(F.struct("*").alias("row"), *row_key(), F.col("source").cast("string").alias("source"))
    joined = keyed.join(lists, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")) & F.col("source").eqNullSafe(F.col("t_source")))
    # rows that are equal are copies of each other in any order
    number = F.row_number().over(Window.partitionBy("k1", "k2", "source").orderBy(F.lit(1)))
    joined = joined.withColumn("number", number).withColumn("size", F.regexp_count("row.text", F.lit(WORD)))
    own = F.transform(F.filter("takes", lambda t: t["copy"] == F.col("number")), lambda t: t["taken"])
    each = joined.select("row", "size", F.explode(own).alias("taken"))
    text = F.when(F.col("taken") >= F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), 0), F.lit(1), F.col("taken").cast("int")), " ")
    )
    new = each.withColumn("text", text)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return new.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
