"""Token ids in binary shards of patched frame-of-reference blocks.

A shard is one self-contained file image::

    magic "QPFR" | u16 version | u16 block size | u32 documents | u64 ids | u32 blocks
    per document: i64 doc_id, u8 has_doc_id (a null id is 0), u32 number of ids
    index: u64 byte offset of each block, counted from the first block
    blocks: u32 minimum | u8 width | u16 n | u16 exceptions | packed bits | u16 positions | u32 high bits

In a block the minimum is subtracted and every difference is packed at the width that holds a chosen percentile of
them; the high bits of the others stand in the exception list. Any document can be read without its neighbours:
the cumulative document lengths give the ids, the index gives the block.

Shards travel through Spark's own writers (one image per row), so task retries and any store that Spark writes to work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cached_tokenizer, documents, new_path, slices, text_of, tokenizer_file

MAGIC, VERSION = b"QPFR", 1
BLOCK = 4096
_HEAD = struct.Struct("<4sHHIQI")
_BLOCK = struct.Struct("<IBHH")


def pack_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """One block of up to 65,535 ids (unsigned 32-bit)."""
    ids = np.asarray(ids, dtype=np.uint32)
    low = int(ids.min())
    diff = ids - np.uint32(low)
    at = min(len(diff) - 1, int(len(diff) * percentile / 100))
    width = int(np.partition(diff, at)[at]).bit_length()
    wide = diff.astype("<u2") if width <= 16 else diff  # the low bits are all that is packed
    bits = np.unpackbits(wide.view(np.uint8), bitorder="little").reshape(len(ids), -1)[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    high = diff >> np.uint32(width) if width < 32 else np.zeros_like(diff)
    at = np.flatnonzero(high)
    return (
        _BLOCK.pack(low, width, len(ids), len(at))
        + packed
        + at.astype("<u2").tobytes()
        + high[at].astype("<u4").tobytes()
    )


def unpack_block(data: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at byte ``at``, and where the next one starts."""
    low, width, n, extra = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = (n * width + 7) // 8
    if width:
        kind = "<u2" if width <= 16 else "<u4"
        bits = np.zeros((n, 16 if width <= 16 else 32), dtype=np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        diff = np.packbits(bits.ravel(), bitorder="little").view(kind)
    else:
        diff = np.zeros(n, dtype=np.uint32)
    at += size
    where = np.frombuffer(data, "<u2", extra, at)
    at += 2 * extra
    high = np.frombuffer(data, "<u4", extra, at)
    at += 4 * extra
    diff = diff.astype(np.uint32)
    if extra:
        diff[where] |= high << np.uint32(width)
    return diff + np.uint32(low), at


def encode_shard(doc_ids: list[int | None], arrays: list[np.ndarray], block: int = BLOCK, percentile: float = 90.0) -> bytes:
    """The file image of these documents' ids, in the order given."""
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    blocks = [pack_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    table = np.zeros(len(arrays), dtype=[("id", "<i8"), ("has", "u1"), ("n", "<u4")])
    table["id"] = [d or 0 for d in doc_ids]
    table["has"] = [d is not None for d in doc_ids]
    table["n"] = [len(a) for a in arrays]
    starts = np.cumsum([0, *map(len, blocks)])[: len(blocks)].astype("<u8")
    head = _HEAD.pack(MAGIC, VERSION, block, len(arrays), len(ids), len(blocks))
    return b"".join([head, table.tobytes(), starts.tobytes(), *blocks])


def shard_documents(image: bytes) -> tuple[list[int | None], np.ndarray, int, int, np.ndarray]:
    """Document ids and lengths, the block size, the first block's byte and the index of block starts."""
    magic, version, block, docs, _, blocks = _HEAD.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard of this version")
    table = np.frombuffer(image, [("id", "<i8"), ("has", "u1"), ("n", "<u4")], docs, _HEAD.size)
    at = _HEAD.size + table.nbytes
    starts = np.frombuffer(image, "<u8", blocks, at)
    ids = [int(i) if has else None for i, has in zip(table["id"], table["has"], strict=True)]
    return ids, table["n"].astype(np.int64), block, at + starts.nbytes, starts


def decode_shard(image: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    doc_ids, lengths, _, at, starts = shard_documents(image)
    parts = []
    for _ in range(len(starts)):
        ids, at = unpack_block(image, at)
        parts.append(ids)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return doc_ids, np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


def decode_document(image: bytes, position: int) -> np.ndarray:
    """One document's ids by way of the block index."""
    _, lengths, block, first, starts = shard_documents(image)
    begin = int(lengths[:position].sum())
    end = begin + int(lengths[position])
    if begin == end:
        return np.zeros(0, np.uint32)
    parts = [unpack_block(image, first + int(starts[b]))[0] for b in range(begin // block, (end - 1) // block + 1)]
    return np.concatenate(parts)[begin % block : begin % block + end - begin]


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    shard_ids: int = 1_000_000,
    percentile: float = 90.0,
) -> None:
    """Encodes every whole text and writes shard images, in ascending doc_id order, as a table at ``path``.

    Rows: part (range of doc_ids), shard (number within the part), n_ids, n_docs, image. Null texts count as empty;
    a document is its ids and then ``end_id``. Rows with a null doc_id come first, rows of one doc_id in order of their text's hash.
    A shard closes at ``shard_ids`` ids, so a task holds one shard and one Arrow batch.
    """
    path_of = tokenizer_file(tokenizer)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        size, end = 0, np.array([end_id], dtype=np.uint32)

        def row() -> pd.DataFrame:
            image = encode_shard(names, arrays, percentile=percentile)
            return pd.DataFrame({"part": [part], "shard": [shard], "n_ids": [size], "n_docs": [len(names)], "image": [image]})

        tok = cached_tokenizer(path_of)
        for pdf in batches:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for a, b in slices(texts):
                for key, has, ids in zip(keys[a:b], pdf["has"].iloc[a:b], tok.encode(texts[a:b]), strict=True):
                    names.append(int(key) if has else None)
                    arrays.append(np.concatenate((ids, end)))
                    size += len(ids) + 1
                    if size >= shard_ids:
                        yield row()
                        names, arrays, size, shard = [], [], 0, shard + 1
        if names:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has"), "text")
    )
    ranged.mapInPandas(encode, "part int, shard int, n_ids long, n_docs long, image binary").write.option(
        "compression", "none"
    ).parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document: part, shard, doc_id, local_start (within its shard), n_tokens, ids, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, shard, image in zip(pdf["part"], pdf["shard"], pdf["image"], strict=True):
                doc_ids, arrays = decode_shard(image)
                lengths = np.array([len(a) for a in arrays], dtype=np.int64)
                for a in range(0, len(arrays), 512):
                    some = arrays[a : a + 512]
                    yield pd.DataFrame(
                        {
                            "part": part,
                            "shard": shard,
                            "doc_id": pd.array(doc_ids[a : a + 512], dtype="Int64"),
                            "local_start": (np.cumsum(lengths) - lengths)[a : a + 512],
                            "n_tokens": lengths[a : a + 512],
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in some],
                        }
                    )

    schema = "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    return shards.select("part", "shard", "image").mapInPandas(decode, schema)


def token_output(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_ids: int = 1_000_000
) -> DataFrame:
    """Writes the shards of ``docs`` into the shared folder and reads them back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. An empty table gives
    no rows. The starts come from running sums over the shards (one row for every ``shard_ids`` ids): first within
    each part, then over the parts, whose number is that of the write's tasks.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_token_shards(docs, path, tokenizer, end_id, shard_ids)
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("p"))
    starts = sizes.withColumn("s", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "part").select("part", "shard", (F.col("s") + F.col("p")).alias("base"))
    return (
        read_token_shards(shards)
        .join(starts, ["part", "shard"])
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir))
