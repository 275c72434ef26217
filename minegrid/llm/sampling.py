"""Uniform sample of fixed size from data of unknown length: the k rows with the smallest random keys.

Every row draws an independent uniform key (a digest of a seed and its identity, so a task that runs again draws
the same). A partition keeps its k smallest in a heap; heaps are merged in two steps, first within about the
square root of their number of groups, then into one, so no task ever holds more than k rows per heap it merges and
the total need not be known. Samples of parts are merged the same way (``merge_samples``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "__draw"


def with_draw(df: DataFrame, identity: Sequence[str], seed: str) -> DataFrame:
    """Adds the random key: 128 digest bits of seed and identity as hex. Rows that agree in ``identity`` draw alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in identity]
    return df.withColumn(KEY, F.md5(F.concat_ws(":", F.lit(seed), *parts)))


def _heaps(k: int):
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []  # largest key on top, negated
        n = 0
        for b in batches:
            keys = np.asarray(b.column(b.schema.get_field_index(KEY)).to_pylist(), dtype="S32")
            # hex digests compare as their numbers do: what isn't below the heap's largest is out before any row is touched
            at = np.flatnonzero(keys < b"%032x" % -heap[0][0]) if len(heap) == k else np.arange(len(keys))
            keep = []
            for i in at.tolist():
                inv = -int(keys[i], 16)
                if len(heap) < k:
                    heapq.heappush(heap, (inv, n + i, None))
                elif inv > heap[0][0]:
                    heapq.heapreplace(heap, (inv, n + i, None))
                else:
                    continue
                keep.append(i)
            if keep:
                alive = {m for _, m, _ in heap}
                rows = {n + i: b.take(pa.array([i])) for i in keep if n + i in alive}  # a copy, so the batch can go
                heap = [(inv, m, rows.get(m, r)) for inv, m, r in heap]
                heapq.heapify(heap)
            n += b.num_rows
        if heap:
            yield from pa.Table.from_batches([r for _, _, r in heap]).combine_chunks().to_batches()

    return smallest


def merge_samples(keyed: DataFrame, k: int, groups: int | None = None) -> DataFrame:
    """The k smallest draws of ``keyed`` (rows with their draws: data, or samples of parts); keeps the draws."""
    parts = groups or max(1, int(keyed.rdd.getNumPartitions() ** 0.5))
    heaps = keyed.mapInArrow(_heaps(k), keyed.schema)
    if parts > 1:
        heaps = heaps.repartition(parts).mapInArrow(_heaps(k), keyed.schema)
    return heaps.coalesce(1).mapInArrow(_heaps(k), keyed.schema)


def uniform_sample(df: DataFrame, k: int, identity: Sequence[str], seed: str = "draw") -> DataFrame:
    """k rows of ``df``, every set of k equally likely; all rows if there are fewer.

    ``identity`` must tell rows apart (a unique number); rows with equal identity share a draw, and ties at the
    edge keep whichever comes first. Nulls in any column are carried along; an empty table gives an empty sample.
    """
    if k < 1:
        return df.limit(0)
    keyed = with_draw(df, identity, seed).select(KEY, F.struct(*df.columns).alias("row"))
    return merge_samples(keyed, k).select("row.*")


def sample_pieces(df: DataFrame, piece: str, k: int, identity: Sequence[str], seed: str = "draw") -> DataFrame:
    """The mergeable partial result: each piece's own k smallest, with draws. Feed it to ``merge_samples``.

    Pieces may be of any size: their rows are spread over tasks first and a task keeps k rows per piece it meets.
    """
    import pyarrow.compute as pc

    keyed = with_draw(df, identity, seed)

    def per_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for b in batches:
            at = b.schema.get_field_index(piece)
            t = pa.Table.from_batches([b])
            for p in set(t.column(at).to_pylist()):
                own = t.filter(pc.is_null(t.column(at)) if p is None else pc.fill_null(pc.equal(t.column(at), p), False))
                if p in best:
                    own = pa.concat_tables([best[p], own])
                best[p] = own.sort_by(KEY).slice(0, k)
        for t in best.values():
            yield from t.combine_chunks().to_batches()

    local = keyed.mapInArrow(per_piece, keyed.schema)
    return local.repartition(piece).mapInArrow(per_piece, keyed.schema)
