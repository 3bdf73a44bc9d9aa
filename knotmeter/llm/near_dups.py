"""SuperMinHash near-duplicates: signatures, banding, verification on full sets, union-find grouping.

A signature of SuperMinHash gives each element a random order of the components: in round j an element
offers a value in [j, j + 1) to the j-th component of its order. The values of one element are thus tied to
each other, which lowers the variance of the estimate, and once every component holds a value below
the next round's the rounds stop, after a few of them for a long document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.common import Words, components, mixed, row_key, sequence_hashes, slices
from knotmeter.session import materialize

#: Components of a signature, and of a band: a pair at 0.8 has no band in common once in 20 million times.
COMPONENTS, BAND = 128, 4
BANDS = COMPONENTS // BAND
#: The bands and AGREE are made for similarities from so many percent on.
LEAST_PERCENT = 80
#: Components that must agree before full sets are compared: 5.6 deviations below those of a pair at 0.8.
AGREE = 77
#: Pairs a member that a bucket may list for its open components; the members of others go through prefixes.
PAIRS_A_MEMBER = 4
#: Keys that a node or bucket with very many rows is dealt into, and the rows of a bucket that fill a key.
SALTS, SALT_ROWS = 64, 256


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as numbers in order of the text, and where each text's begin.

    A-Z are lower-cased; a text with fewer words than ``width`` has its whole sequence as one shingle.
    """
    words = Words(texts, lower=True)
    hashes = words.hashes()
    runs = sequence_hashes(hashes, width)
    found = []
    for row in range(words.rows):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= width:
            found.append(np.unique(runs[a:b - width + 1]))
        elif b > a:
            found.append(mixed(sequence_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), starts


def super_min_hash(elements: np.ndarray, starts: np.ndarray, m: int = COMPONENTS, chunk: int = 1 << 17) -> np.ndarray:
    """A signature of ``m`` numbers for each set; sets without elements have the largest number throughout.

    The elements of many sets go through a round together, at most ``chunk`` at a time. Round j offers values
    from j on, so a set drops out once no component of it holds more than the next round could offer.
    """
    sets = len(starts) - 1
    out = np.full(sets * m, 0xFFFFFFFFFFFFFFFF, np.uint64)
    owners = np.repeat(np.arange(sets), np.diff(starts))
    for begin in range(0, len(elements), chunk):
        part, owner = elements[begin:begin + chunk], owners[begin:begin + chunk]
        first, end = owner[0], owner[-1] + 1
        order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(part), m)).copy()
        for j in range(m):
            at = np.arange(len(part))
            draw = mixed(part + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            component = order[at, pick]
            order[at, pick] = order[at, j]
            np.minimum.at(out, owner * m + component, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
            open_ = (out.reshape(sets, m)[first:end] >= np.uint64((j + 1) << 32)).any(axis=1)
            stay = open_[owner - first]
            if not stay.any():
                break
            if not stay.all():
                part, owner, order = part[stay], owner[stay], order[stay]
    return out.reshape(sets, m)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A number for each band of each signature."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for k in range(BAND):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + signatures[:, k::BAND])
    return mixed(out + np.arange(BANDS, dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signed_sets(docs: DataFrame, width: int) -> DataFrame:
    """``k1, k2, doc_id, n, d1, d2, bands, sketch``: each document's set size, digest, bands and signature.

    The digest is made of sums over the set's numbers, so equal sets have equal ones. The sketch has a byte
    of each component.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            elements, starts = shingles(batch.column(3), width)
            signatures = super_min_hash(elements, starts)
            digests = []
            for values in (mixed(elements), mixed(elements ^ np.uint64(0x5851F42D4C957F2D))):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
                digests.append(pa.array(_signed(sums[starts[1:]] - sums[starts[:-1]])))
            flat = pa.array(_signed(bands(signatures)).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)
            sketch = np.ascontiguousarray(mixed(signatures).astype(np.uint8))
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(np.diff(starts)), *digests, lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["k1", "k2", "doc_id", "n", "d1", "d2", "bands", "sketch"],
            )

    narrow = docs.select(*row_key(), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(sign, "k1 long, k2 long, doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary")


def _full_set(text: bytes, width: int) -> set:
    words = text.lower().split()  # of bytes: A-Z, and blanks as in WORD
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)], strict=False))


def _looked_up(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the columns that ``about`` has for each ``a``.

    An ``a`` may stand in a third of all pairs: its row goes once to each of at most ``SALTS`` keys.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    wanted = dealt.select("a", "salt").distinct().join(about, "a")
    return dealt.join(wanted, ["a", "salt"]).drop("salt")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity, as ``(u, v)``.

    The text of ``b`` is sent to the pair's ``a``, and that of ``a`` once to each of at most ``SALTS`` keys, where it
    stands before those that it is compared with. One set is held at a time, and the texts of one slice.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in slices(batches):
            keep = []
            a, salt, b, own, texts_ = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                other = _full_set(texts_[i].encode(), width)
                if own[i]:
                    last, mine = (a[i], salt[i]), other
                    continue
                if (a[i], salt[i]) != last:
                    raise ValueError("a text came before the one that it is compared with")
                common = len(mine & other)
                union = len(mine) + len(other) - common
                if union and 100 * common >= percent * union:
                    keep.append(i)
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64()))], ["u", "v"])

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    hubs = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("cid"), F.lit(True).alias("own"))
    asked = hubs.unionByName(dealt.select("a", "salt", F.col("b").alias("cid"), F.lit(False).alias("own")))
    sent = asked.join(texts, "cid").select("a", "salt", F.col("cid").alias("b"), "own", "text")
    met = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("own"))
    return met.mapInArrow(compare, "u long, v long")


def _agreeing(a: Column, b: Column) -> Column:
    """Bytes in which two sketches agree, of all components."""
    places = F.sequence(F.lit(1), F.lit(COMPONENTS))
    same = F.transform(places, lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y)


class _Groups:
    """Classes of equal sets, their texts, and the component of each class by the links found so far."""

    def __init__(self, classes: DataFrame, docs: DataFrame, width: int, percent: int):
        self.classes, self.docs, self.width, self.percent = classes, docs, width, percent
        self.texts: DataFrame | None = None
        self.labels: DataFrame | None = None

    def fetch(self, members: DataFrame) -> None:
        """Texts of the classes that share a bucket with another; the one time that texts are shuffled."""
        wanted = members.select("cid").distinct().join(self.classes.select("cid", "k1", "k2"), "cid")
        texts = self.docs.select(*row_key(), "text").join(wanted, ["k1", "k2"]).select("cid", "text")
        self.texts = materialize(texts.dropDuplicates(["cid"]))

    def link(self, pairs: DataFrame) -> None:
        """Adds the pairs ``(a, b)`` that hold, after a look at sizes and signatures, to the links."""
        about = self.classes.select("cid", "n", "sketch")
        left = about.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        close = (
            _looked_up(pairs.distinct(), left)
            .join(about.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
            .where(_agreeing(F.col("sa"), F.col("sb")) >= AGREE)
            .select("a", "b")
        )
        # stored, as both sides of each pair are asked for
        close = materialize(close)
        found = materialize(_verify(close, self.texts, self.width, self.percent))
        if self.labels is not None:
            found = found.unionByName(self.labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
        self.labels = components(found)

    def labelled(self, members: DataFrame) -> DataFrame:
        labels = self.labels.select(F.col("node").alias("cid"), "component")
        return members.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows ``(bucket, cid, ...)`` of buckets with two or more, with their number ``m`` and the bucket's smallest ``first``.

    A bucket may hold a third of all rows, so its rows are dealt by (bucket, salt), and the totals are sent to the salts it has.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    parts = dealt.groupBy("bucket", "salt").agg(F.count("*").alias("m"), F.min("cid").alias("first"))
    totals = parts.groupBy("bucket").agg(F.sum("m").alias("m"), F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    totals = totals.where("m > 1").select("bucket", "m", "first", F.explode("salts").alias("salt"))
    return dealt.join(totals, ["bucket", "salt"]).drop("salt")


def _salts(m: Column) -> Column:
    """Keys that a bucket of so many rows is dealt into."""
    return F.least(F.ceil(m / SALT_ROWS), F.lit(SALTS))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of buckets, each with one salt of its bucket."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), _salts(F.col("m"))))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of buckets, each with all salts of its bucket."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts(F.col("m")) - 1)))


def _stars(members: DataFrame) -> DataFrame:
    """Each member paired with its bucket's first one."""
    return members.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))


def _first(members: DataFrame, order: Column) -> DataFrame:
    """Members with their bucket's first one in an order, then by number."""
    first = members.groupBy("bucket").agg(F.max("m").alias("m"), F.min(F.struct(order, "cid"))["cid"].alias("first"))
    return _dealt(members).join(_sent(first).drop("m"), ["bucket", "salt"]).drop("salt")


def _across(labelled: DataFrame, parts: DataFrame, condition: Column | bool = True) -> DataFrame:
    """Pairs of members of different components of a bucket: those outside its largest one with all others."""
    open_ = _dealt(labelled).join(_sent(parts.select("bucket", "m", "largest")).drop("m"), ["bucket", "salt"])
    outside = _sent(open_.where("component <> largest").drop("salt"))
    outside = outside.select([F.col(c).alias(f"x_{c}") for c in outside.columns])
    met = (F.col("x_bucket") == F.col("bucket")) & (F.col("x_salt") == F.col("salt"))
    different = (F.col("x_component") != F.col("component")) & ((F.col("component") == F.col("largest")) | (F.col("x_cid") < F.col("cid")))
    pairs = outside.join(open_, met & different & F.lit(condition))
    return pairs.select(F.col("x_cid").alias("a"), F.col("cid").alias("b"))


def _parts(labelled: DataFrame) -> DataFrame:
    """Buckets that span several components: rows ``m``, rows and pairs across components that are left, the largest component."""
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    return (
        sizes.groupBy("bucket").agg(
            F.max("m").alias("m"), F.sum("c").alias("left"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("parts"),
            F.max(F.struct("c", "component"))["component"].alias("largest"),
        ).where("parts > 1").withColumn("across", (F.col("left") * F.col("left") - F.col("squares")) / 2)
    )


def _prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``bucket, cid, n, p``: the rarest shingles of each class, enough of them that similar sets share one.

    A set of n shingles that reaches the similarity with another shares at least ``percent`` of its n, so one of
    its n - that + 1 first ones in any common order; rare ones come first. ``p`` shingles come before.
    A row goes when even the best partner in its bucket could not reach the similarity: if this is the first
    common shingle, no more than n - p are common.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            elements, starts = shingles(batch.column(1), width)
            n = np.diff(starts)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch([batch.column(0).take(owner), pa.array(np.repeat(n, n)), pa.array(_signed(elements))], ["cid", "n", "bucket"])

    rows = texts.mapInArrow(cut, "cid long, n long, bucket long")
    # a shingle of one set alone is rarer than all others, so it only moves their places
    order = Window.partitionBy("cid").orderBy("m", "bucket")
    shared = _counted(rows).drop("first")
    placed = shared.withColumn("p", F.col("n") - F.count("*").over(Window.partitionBy("cid")) + F.row_number().over(order) - 1)
    placed = materialize(placed.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    least = placed.groupBy("bucket").agg(F.max("m").alias("m"), F.min("n").alias("least"), F.count("*").alias("left")).where("left > 1")
    common = F.col("n") - F.col("p")
    return (
        _dealt(placed).join(_sent(least).drop("m"), ["bucket", "salt"])
        .where(100 * common >= percent * (F.col("n") + F.greatest("least", common) - common)).select("bucket", "cid", "n", "p", "m")
    )


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``k1, k2, doc_id, n, component_id`` and the inner number ``component`` for each document; see :func:`near_duplicates`."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent {percent} is not from {LEAST_PERCENT} to 100: bands would miss pairs")
    sets = materialize(signed_sets(docs, width))
    classes = (
        sets.where("n > 0").groupBy("d1", "d2")
        .agg(F.min(F.struct("k1", "k2")).alias("key"), F.min("doc_id").alias("least_id"), F.min("n").alias("n"), F.min_by(F.struct("bands", "sketch"), F.struct("k1", "k2")).alias("s"))
        .select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "key.k1", "key.k2", "least_id", "n", "s.bands", "s.sketch")
    )
    classes = materialize(classes)
    members = materialize(_counted(classes.select("cid", F.explode("bands").alias("bucket"))))
    groups = _Groups(classes, docs, width, percent)
    groups.fetch(members)
    groups.link(_stars(members))
    labelled = materialize(groups.labelled(members))
    parts = materialize(_parts(labelled))
    few = F.col("across") <= PAIRS_A_MEMBER * F.col("m")
    pairs = _across(labelled, parts.where(few))
    wide = _dealt(labelled).join(_sent(parts.where(~few)), ["bucket", "salt"], "left_semi").select("cid").distinct()
    prefixes = materialize(_prefixes(groups.texts.join(wide, "cid"), width, percent))
    groups.link(pairs.unionByName(_stars(_first(prefixes, F.col("p") / F.col("n")))))
    labelled = materialize(groups.labelled(prefixes))
    common = F.least(F.col("n") - F.col("p"), F.col("x_n") - F.col("x_p"))
    reachable = 100 * common >= percent * (F.col("n") + F.col("x_n") - common)
    pairs = materialize(_across(labelled, _parts(labelled), reachable).distinct())
    if pairs.limit(1).count():
        groups.link(pairs)
    named = classes.select("cid", "d1", "d2", "least_id").join(groups.labels.select(F.col("node").alias("cid"), "component"), "cid", "left")
    named = materialize(named.select("d1", "d2", "least_id", F.coalesce("component", "cid").alias("component")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_set = named.join(least, "component").select("d1", "d2", "component", "component_id")
    return sets.drop("bands", "sketch").join(by_set, ["d1", "d2"], "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``k1, k2, doc_id, n_shingles, component_id, kept`` for each document.

    Documents are linked when their shingle sets have a similarity of ``percent`` or more, confirmed on the
    full sets; ``component_id`` is the smallest id that links reach. Sets are compared once for all documents
    that have them, so a group of copies is one class however large. Members of a bucket are compared with its
    first. Buckets that still span several components list the pairs across them if these are few for
    their members. The members of the others are linked by their rarest shingles, which loses no pair: most variants
    of a text or users of a passage have so many shingles of their own that they meet nobody there.
    Bands miss a pair at the threshold with a chance of about 5e-8; so does the
    look at signatures before verification with about 1e-8; every other step is exact. A ``percent`` below 80 is refused.

    Null or blank texts have no set and are linked with nothing. Rows with equal texts are linked.
    A null id is never a component's id unless it has no other; such a document is kept if it stands alone.
    """
    out = _grouped(docs, width, percent)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def kept_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: that of the least id, null ids last, then of the least
    hash of the text. Of documents without shingles, rows equal in id and text count once."""
    grouped = materialize(_grouped(docs, width, percent).select("k1", "k2", "doc_id", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("first")
    found = grouped.where("component is not null").groupBy("component").agg(first).select("first.k1", "first.k2")
    found = found.unionByName(grouped.where("component is null").select("k1", "k2").distinct())
    one = Window.partitionBy("k1", "k2").orderBy(F.lit(1))
    keyed = docs.select(F.struct("*").alias("row"), *row_key())
    return (
        keyed.join(found, ["k1", "k2"], "left_semi")
        .withColumn("copy", F.row_number().over(one)).where("copy = 1").select("row.*")
    )
