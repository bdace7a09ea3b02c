"""Token ids in patched frame-of-reference blocks, written in ascending doc_id order and read back.

A part is one self-contained binary value (little-endian):

    magic "PFR1" | u32 documents | u32 ids | u32 blocks
    per document   i64 doc_id, u32 ids; then flags: u8, 1 if the doc_id is null
    per block      u32 start: the block's first byte, counted from the first block
    blocks         u32 minimum | u16 ids | u8 width | u16 exceptions
                   the low ``width`` bits of every id less the minimum, packed bit after bit
                   u16 position of each exception, then u32 of the bits above ``width`` of each

The width covers a chosen percentile of the block's values, so a few large ids do not widen the rest.
Parts are rows of a Parquet folder, which any Spark file system can hold; a part never exceeds one task's batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, maybe_broadcast
from .tokens import encoder

MAGIC = b"PFR1"
BLOCK, PERCENTILE = 2048, 90
#: Ids after which a part ends.
PART_IDS = 1 << 20
#: Documents of a shard, and shards at most (then they grow).
SHARD_ROWS, MAX_SHARDS = 4096, 16_384
PART_SCHEMA = "shard long, part long, first_doc long, ids long, payload binary"
_HEAD, _BLOCK = struct.Struct("<4sIII"), struct.Struct("<IHBH")


def _word(width: int) -> str:
    return "<u2" if width <= 16 else "<u4"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, lowest bit first."""
    if not width:
        return b""
    kind = np.dtype(_word(width))
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, dtype=np.uint32)
    kind = np.dtype(_word(width))
    full = np.zeros((n, 8 * kind.itemsize), dtype=np.uint8)
    full[:, :width] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return np.packbits(full, axis=1, bitorder="little").view(kind).reshape(-1).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    cut = int(np.partition(rest, k := (len(rest) - 1) * percentile // 100)[k])
    width = cut.bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    head = _BLOCK.pack(least, len(ids), width, len(odd))
    high = (rest[odd] >> np.uint32(width)).astype("<u4") if len(odd) else np.zeros(0, "<u4")
    return head + pack_bits(rest, width) + odd.astype("<u2").tobytes() + high.tobytes()


def decode_block(data: bytes, at: int) -> np.ndarray:
    least, n, width, odd = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = (n * width + 7) // 8
    out = unpack_bits(data[at : at + size], n, width)
    at += size
    if odd:
        where = np.frombuffer(data, "<u2", odd, at)
        out[where] |= np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint32) << np.uint32(width)
    return out + np.uint32(least)


def encode_part(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    blocks = [encode_block(ids[k : k + block], percentile) for k in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4")
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(counts, dtype="<u4").tobytes()
    nulls = bytes(d is None for d in doc_ids)
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks)) + docs + nulls + starts.tobytes() + b"".join(blocks)


def decode_part(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    magic, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a part of this format")
    at = _HEAD.size
    docs = np.frombuffer(data, "<i8", n_docs, at).tolist()
    counts = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    nulls = data[at + 12 * n_docs : at + 13 * n_docs]
    at += 13 * n_docs
    starts = np.frombuffer(data, "<u4", n_blocks, at)
    at += 4 * n_blocks
    ids = np.concatenate([decode_block(data, at + int(s)) for s in starts]) if n_blocks else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("a part is damaged")
    return [None if x else d for d, x in zip(docs, nulls, strict=True)], counts, ids


def block_of(data: bytes, k: int) -> np.ndarray:
    """Random access: block ``k`` by the index of block starts, the others left packed."""
    _, n_docs, _, n_blocks = _HEAD.unpack_from(data)
    at = _HEAD.size + 13 * n_docs
    return decode_block(data, at + 4 * n_blocks + int(np.frombuffer(data, "<u4", n_blocks, at)[k]))


def ranged(docs: DataFrame, rows_per_shard: int) -> DataFrame:
    """``docs`` dealt to shards of ascending doc_id (nulls first), sorted inside; at most MAX_SHARDS of them."""
    shards = min(MAX_SHARDS, max(1, -(-docs.count() // rows_per_shard)))
    return docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").withColumn("shard", F.spark_partition_id())


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, rows_per_shard: int = SHARD_ROWS) -> None:
    """Encode ``docs`` (doc_id, text) and write parts to ``path``; ``shard`` and ``part`` ascend with doc_id.

    Null and empty texts have the end id alone; rows that repeat a doc_id stay, in any order among themselves, and rows
    without doc_id come first. Only doc_id and text are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        part, names, counts, held, total = 0, [], [], [], 0

        def flush(shard: int) -> pa.RecordBatch:
            nonlocal part, names, counts, held, total
            payload = encode_part(names, counts, np.frombuffer(b"".join(held), "<u4"))
            row = ([shard], [part], [names[0]], [total], [payload])
            part, names, counts, held, total = part + 1, [], [], [], 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "part", "first_doc", "ids", "payload"])

        shard = 0
        for rows in batches:
            if not rows.num_rows:
                continue
            shard = rows.column("shard")[0].as_py()
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist()), strict=True):
                ids += end
                names.append(doc)
                counts.append(len(ids) // 4)
                held.append(ids)
                total += len(ids) // 4
                if total >= PART_IDS:
                    yield flush(shard)
        if names:
            yield flush(shard)

    map_arrow(ranged(docs.select("doc_id", "text"), rows_per_shard), run, PART_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the parts at ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, unless
    left out, ids (binary).

    The start of a part comes from the parts' own counts, summed by shard; a shard's rows are no more than its parts.
    """
    parts = spark.read.schema(PART_SCHEMA).parquet(path)
    # One row per shard, of which there are MAX_SHARDS at most: the driver sees counts, never ids.
    sums = {r["shard"]: r["n"] for r in parts.groupBy("shard").agg(F.sum("ids").alias("n")).toLocalIterator()}
    before, at = {}, 0
    for shard in sorted(sums):
        before[shard], at = at, at + sums[shard]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard long, shard_start long")
    running = F.coalesce(F.expr("sum(ids) over (partition by shard order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = parts.select("shard", "part", "ids").withColumn("in_shard", running).join(starts, "shard").select("shard", "part", (F.col("shard_start") + F.col("in_shard")).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for payload, start in zip(rows.column("payload"), rows.column("part_start").to_pylist(), strict=True):
                docs, counts, ids = decode_part(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                firsts = ends - counts
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(firsts + start, pa.int64()), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # A part has a million ids: its offset is broadcast as long as the parts are few enough to count; the payload stays.
    joined = parts.select("shard", "part", "payload").join(maybe_broadcast(offsets, 200_000), ["shard", "part"]).select("payload", "part_start")
    return map_arrow(joined, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` in this format to the shared folder and read every document back.

    One row per row of ``docs``, in ascending doc_id by ``start``; rows without doc_id come first, rows that repeat one stay,
    in any order among themselves; null and empty texts are the end id alone. Only doc_id and text are read, so other
    columns may have any name; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "pfor")
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(spark, path, with_ids)
