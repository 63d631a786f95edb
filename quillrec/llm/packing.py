"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached_tokenizer, documents, slices, text_of, tokenizer_file


class BestFit:
    """Online best-fit into bins of ``capacity``, at most ``open_bins`` of them open.

    The free spaces of the open bins form a bitset (an int): bit s is set if some open bin has s free. The best fit for
    a piece is the lowest set bit at or above its length. When one bin more would be open, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.next = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.count -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        """The bin of a piece, and its place there."""
        fitting = self.bits >> length
        if fitting and length:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.capacity, self.next
            self.next += 1
        rest = space - length
        if rest:
            if self.count >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest < rest:
                    self._take(fullest)
                else:
                    return found, self.capacity - space  # the fullest is this one: it stays closed
            self.free[rest].append(found)
            self.bits |= 1 << rest
            self.count += 1
        return found, self.capacity - space


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of up to ``capacity`` ids is one piece; a longer one is cut into full pieces, of which the first may be shorter."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = 1024,
    open_bins: int = 2048,
    lookahead: int = 4096,
    with_ids: bool = False,
    remember: int = 1_200_000,
) -> DataFrame:
    """Packs every document of ``docs`` into sequences of at most ``capacity`` ids.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). Null texts
    count as empty; a document is its ids and then ``end_id``, so each has at least one id. Repeated rows are packed
    each on its own. Every task packs its own rows: no shuffle, no shared state. ``lookahead`` pieces are put in
    descending order before they are placed; the memory of a task is that, the open bins, one Arrow batch and the ids of
    ``remember`` chunks (about 250 bytes each).
    """
    path = tokenizer_file(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        bins = BestFit(capacity, open_bins)
        tok = cached_tokenizer(path, remember)
        end = np.array([end_id], dtype=np.uint32)
        held: list[tuple] = []

        def placed() -> pd.DataFrame:
            held.sort(key=lambda r: -r[3])
            where = [bins.add(r[3]) for r in held]
            out = {name: [r[i] for r in held] for i, name in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            out["sequence_id"] = [base + b for b, _ in where]
            out["offset"] = [o for _, o in where]
            if with_ids:
                out["ids"] = [r[5].tolist() for r in held]
            return pd.DataFrame(out)

        for pdf in batches:
            texts, keys, has = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["has"].tolist()
            for a, b in slices(texts):
                for i, ids in enumerate(tok.encode(texts[a:b]), a):
                    ids, start = np.concatenate((ids, end)), 0
                    for piece, n in enumerate(piece_lengths(len(ids), capacity)):
                        part = ids[start : start + n]
                        held.append((int(keys[i]) if has[i] else None, piece, start, n, zlib.crc32(part.astype("<u4").tobytes()), part if with_ids else None))
                        start += n
                if len(held) >= lookahead:
                    yield placed()
                    held.clear()
        if held:
            yield placed()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("has"),
        text_of().alias("text"),
    )
    return rows.mapInPandas(run, schema + (", ids array<long>" if with_ids else ""))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
