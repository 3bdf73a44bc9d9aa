"""Training-order materialisation: every sequence gets a slot by a keyed permutation and a place in a shard.

A sequence's number is a hash of its document's id and text and of its part, so the same rows have the same numbers however
they are split into tasks. A Feistel network permutes the smallest
domain of an even number of bits that holds all numbers there can be; numbers that leave the range
are encrypted again until they are back in it, which makes it a permutation of the range. The range is cut
into equal parts, one a shard, and a sequence's slot is its rank among all permuted numbers; equal numbers stand in the
order of id, part and ids. (Numbers without gaps would need the ids of all documents before the first is placed.)
Shards hold consecutive slots as records of one length, so slot t of a shard that begins with slot b is found at
byte ``(t - b) * stride``, and reading resumes anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.common import mixed
from knotmeter.llm.tokens import encoded
from knotmeter.session import materialize, scratch_path

ROUNDS = 6
#: Numbers are below this.
RANGE = 10**18
PLACED = "doc_id long, part int, n_tokens int, crc32 long, shard int, position int"
#: Bytes of text that are taken for one id when the number of shards is chosen.
BYTES_AN_ID = 3


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a keyed permutation of ``range(size)`` puts each number."""
    half = max(1, (max(1, int(size) - 1).bit_length() + 1) // 2)
    low, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> low, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        x = left << low | right
        out[walking] = x
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int, key: int, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """``code, doc_id, part, ids``: each document's ids and ``end_id`` in parts of at most ``length``.

    ``code`` is the permuted number of the sequence; id, text and part decide it. Ids are little-endian unsigned
    16-bit, so the vocabulary must have at most 65,536 of them. A null text counts as empty: one
    sequence with ``end_id``.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in encoded(batches, tokenizer, end_id):
            doc_ids, parts, data, counts = [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                if ids.max() >= 1 << 16:
                    raise ValueError("the records hold 16-bit ids")
                raw = ids.astype("<u2").tobytes()
                for part, at in enumerate(range(0, len(raw), 2 * length)):
                    doc_ids.append(doc_id)
                    parts.append(part)
                    data.append(raw[at:at + 2 * length])
                counts.append(-(-len(raw) // (2 * length)))
            rows = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), counts)
            numbers = mixed(rows + np.array(parts, np.uint64)) % np.uint64(RANGE)
            codes = permuted(numbers, RANGE, key)
            yield pa.record_batch([pa.array(codes), pa.array(doc_ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["code", "doc_id", "part", "ids"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    narrow = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id.isNull(), doc_id, text).alias("number"))
    return narrow.mapInArrow(cut, "code long, doc_id long, part int, ids binary")


def shard_file(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:08d}.bin"


def _file_system(folder: str):
    """The file system of a folder and its path there; a folder without a scheme is a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _write(folder: str, name: str, data: bytes) -> None:
    """One write and a rename, so that a reader never sees half a shard and a retry replaces it."""
    from uuid import uuid4

    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")


def materialise(docs: DataFrame, folder: str | None = None, length: int = 512, shard_slots: int = 8192, key: int = 20_240_229,
                tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all sequences into shards of fixed stride and returns where each one is.

    ``doc_id, part, n_tokens, crc32, slot, shard, position``; crc32 is that of the record. A record has
    ``length`` ids of two bytes, the rest is ``end_id``. The number of shards is the text's bytes by what
    ``shard_slots`` records may hold; permuted numbers are even, so shards have about as many each.
    One task writes a shard, which is also what it holds in memory; a lost task writes the same file
    again. ``folder`` must be shared by all executors; by default it is a new one in the session's shared
    folder. Ids are shuffled once. No documents give no shards.
    """
    if length < 1 or shard_slots < 1:
        raise ValueError("records and shards must hold something")
    size = docs.agg(F.sum(F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / (BYTES_AN_ID * length)))).first()[0] or 0
    width = -(-RANGE // max(1, -(-size // shard_slots)))
    folder = folder or scratch_path(docs.sparkSession)
    padding = np.array([end_id], "<u2").tobytes() * length

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by([(name, "ascending") for name in ("code", "doc_id", "part", "ids")])
        shard, ids = part["shard"][0].as_py(), part["ids"].to_pylist()
        records = [x + padding[len(x):] for x in ids]
        _write(folder, shard_file("", shard).lstrip("/"), b"".join(records))
        n = len(records)
        columns = {
            "n_tokens": pa.array([len(x) // 2 for x in ids], pa.int32()), "crc32": pa.array([zlib.crc32(x) for x in records], pa.int64()),
            "shard": pa.array(np.full(n, shard, np.int32)), "position": pa.array(np.arange(n, dtype=np.int32)),
        }
        return pa.table({"doc_id": part["doc_id"], "part": part["part"], **columns})

    sequences = token_sequences(docs, length, key, tokenizer, end_id).withColumn("shard", F.expr(f"cast(code div {width}L as int)"))
    placed = materialize(sequences.groupBy("shard").applyInArrow(write, PLACED))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    return placed.join(first, "shard").select("doc_id", "part", "n_tokens", "crc32", (F.col("first_slot") + F.col("position")).alias("slot"), "shard", "position")


def read_from(folder: str, first_slots: list[int], slot: int, count: int, length: int) -> Iterator[np.ndarray]:
    """The ids of ``count`` records from a slot on, in sequence; ``first_slots`` has that of each shard.

    The folder is read through the file system that it was written through.
    """
    stride = 2 * length
    system, path = _file_system(folder)
    shard = int(np.searchsorted(first_slots, slot, side="right")) - 1
    position = slot - first_slots[shard]
    while count > 0 and shard < len(first_slots):
        # a shard that no sequence fell into has no file
        if first_slots[shard] < (first_slots[shard + 1] if shard + 1 < len(first_slots) else np.inf):
            with system.open_input_file(shard_file(path, shard)) as file:
                file.seek(position * stride)
                while count > 0 and (record := file.read(stride)):
                    yield np.frombuffer(record, "<u2")
                    count -= 1
        shard, position = shard + 1, 0
