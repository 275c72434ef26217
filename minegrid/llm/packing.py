"""Filling containers of fixed capacity with whole texts: lexical retrieval packing.

Texts are measured in tokens of a public tokenizer and ordered by content: by their six rarest terms
(of those some other text has), rarest first, so texts that share rare terms lie side by side. The order is cut into
range partitions, and these into shards of about ``SHARD`` texts, one after the other. A group of more texts
than a shard holds is spread over consecutive shards. Each
shard holds a BM25 inverted index over token ids, weighted with document frequencies of the whole corpus (one count per
vocabulary entry, at most some 50,000 numbers). In a shard the largest unused text seeds a container; retrieval with all its
terms returns its unused neighbours and the best one that fits goes in, until the room left is small (``close``); then the
largest unused text that fits closes the gap. Only texts longer than a container are split: into full containers and
a rest that is packed like any other item. A task holds one shard at a time, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import written
from .tokenizers import DEFAULT_VOCABULARY, pieces, vocabulary_path

SHARD = 4096
CLOSE = 256  # room below which only the best fit counts
K1, B = 1.2, 0.75


def measured(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """doc_id, row (unique), n_tokens, terms and their frequencies."""
    path = vocabulary_path(vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyspark

        ctx = pyspark.TaskContext.get()
        row = ctx.partitionId() << 40 if ctx else 0
        p = pieces(path)
        for b in batches:
            n, terms, tfs, rows = [], [], [], []
            for t in b["text"]:
                row += 1
                ids = p.encode(t) if t else []
                u, c = np.unique(np.asarray(ids, np.int32), return_counts=True)
                rows.append(row)
                n.append(len(ids))
                terms.append(u)
                tfs.append(c.astype(np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": rows, "n_tokens": n, "terms": terms, "tfs": tfs})

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInPandas(run, f"doc_id {kind}, row bigint, n_tokens bigint, terms array<int>, tfs array<int>")


def pack_shard(size: np.ndarray, length: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, mean_length: float, capacity: int, close: int = CLOSE) -> np.ndarray:
    """Container number of each item (sizes 1..capacity)."""
    n = len(size)
    where = np.full(n, -1, np.int64)
    counts = np.array([len(t) for t in terms], np.int64)
    term = np.concatenate(terms) if n else np.empty(0, np.int64)
    tf = np.concatenate(tfs).astype(np.float64) if n else np.empty(0)
    owner = np.repeat(np.arange(n), counts)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean_length, 1e-9)))
    by_term = np.argsort(term, kind="stable")
    sorted_terms, post, post_w = term[by_term], owner[by_term], weight[by_term]
    start = np.concatenate(([0], np.cumsum(counts)))
    unused = np.ones(n, bool)
    by_size = np.argsort(size, kind="stable")  # for the best fit
    sizes_sorted = size[by_size]
    prev = np.arange(-1, n)  # union-find to the next unused item of smaller or equal size; place k+1 stands for sorted k

    def fit(room: int) -> int:
        """Largest unused item of at most ``room``, or -1."""
        k = int(np.searchsorted(sizes_sorted, room, "right"))
        trail = []
        while k > 0 and not unused[by_size[k - 1]]:
            trail.append(k)
            k = int(prev[k]) + 1 if prev[k] + 1 < k else k - 1
        for x in trail:
            prev[x] = k - 1
        return int(by_size[k - 1]) if k > 0 else -1

    left, number = n, 0
    while left:
        seed = fit(capacity)
        room = capacity - int(size[seed])
        where[seed], unused[seed] = number, False
        left -= 1
        if room > close and left:
            top = term[start[seed] : start[seed + 1]]
            lo, hi = np.searchsorted(sorted_terms, top, "left"), np.searchsorted(sorted_terms, top, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(top) else np.empty(0, np.int64)
            score = np.bincount(post[at], post_w[at], minlength=n)
            score[~unused] = 0
            found = np.flatnonzero((score > 0) & (size <= room))
            for k in found[np.argsort(-score[found], kind="stable")]:
                if room <= close:
                    break
                if size[k] <= room:
                    where[k], unused[k] = number, False
                    room -= int(size[k])
                    left -= 1
        while left and room > 0 and (k := fit(room)) >= 0:
            where[k], unused[k] = number, False
            room -= int(size[k])
            left -= 1
        number += 1
    return where


def rarity_ranks(df: np.ndarray) -> np.ndarray:
    """Place of each vocabulary entry by rising document frequency; entries of fewer than two texts get -1 (they have no neighbours)."""
    order = np.argsort(df, kind="stable")
    order = order[df[order] >= 2]
    out = np.full(len(df), -1, np.int64)
    out[order] = np.arange(len(order))
    return out


def lexical_keys(terms: list[np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Per text two numbers that order it by its six rarest shared terms, rarest first (21 bits a term); texts with fewer end in ones."""
    out = np.full((len(terms), 6), (1 << 21) - 1, np.int64)
    n = np.array([len(t) for t in terms], np.int64)
    if n.sum():
        doc = np.repeat(np.arange(len(terms)), n)
        rank = ranks[np.concatenate([np.asarray(t, np.int64) for t in terms])]
        doc, rank = doc[rank >= 0], rank[rank >= 0]
        order = np.lexsort((rank, doc))
        doc, rank = doc[order], rank[order]
        first = np.searchsorted(doc, np.arange(len(terms)))
        place = np.arange(len(doc)) - first[doc]
        keep = place < 6
        out[doc[keep], place[keep]] = rank[keep]
    return np.stack([(out[:, 0] << 42) | (out[:, 1] << 21) | out[:, 2], (out[:, 3] << 42) | (out[:, 4] << 21) | out[:, 5]])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY, shard: int = SHARD, close: int = CLOSE) -> DataFrame:
    """(doc_id, part, container, n_tokens) for every row of ``docs``; containers hold at most ``capacity`` tokens.

    ``part`` counts the pieces of a split text from 0; texts within capacity are part 0, whole. Null and empty texts
    measure 0 and lie in the first container of their shard. Repeated rows are items of their own; an empty
    table gives no rows. Container numbers are unique but not consecutive.
    """
    spark = docs.sparkSession
    rows = written(measured(docs, doc_id, text, vocabulary), "measured")
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean")).first()
    total, mean = stats["n"], float(stats["mean"] or 0.0)
    got = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()  # at most one row per vocabulary entry
    df = np.zeros(int(got["t"].max()) + 1 if len(got) else 1)
    df[got["t"].to_numpy()] = got["count"].to_numpy(float)
    ranks = spark.sparkContext.broadcast(rarity_ranks(df))
    weights = spark.sparkContext.broadcast(np.log1p((total - df + 0.5) / (df + 0.5)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one, two = lexical_keys(list(b["terms"]), ranks.value)
            yield b.assign(one=one, two=two)

    def one(pdf: pd.DataFrame, base: int) -> tuple[pd.DataFrame, int]:
        """A packed shard, and the number after its last container; numbers start at ``base``."""
        n = pdf["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        whole = (full > 0) & (rest == 0)
        items = np.flatnonzero(rest > 0)
        idf = weights.value
        where = pack_shard(rest[items], n[items].astype(float), [np.asarray(x, np.int64) for x in pdf["terms"].iloc[items]], [np.asarray(x, np.int64) for x in pdf["tfs"].iloc[items]], idf, mean, capacity, close)
        used = int(where.max()) + 1 if len(where) else 0
        idx, part, box, size = [items], [full[items]], [where], [rest[items]]
        for k in np.flatnonzero(full > 0):  # full containers of split texts, and texts that fill one exactly
            m = int(full[k])
            idx.append(np.full(m, k))
            part.append(np.arange(m))
            box.append(np.arange(used, used + m))
            size.append(np.full(m, capacity))
            used += m
        empty = np.flatnonzero((n == 0) & ~whole)
        idx.append(empty)
        part.append(np.zeros(len(empty), np.int64))
        box.append(np.zeros(len(empty), np.int64))
        size.append(np.zeros(len(empty), np.int64))
        at = np.concatenate(idx).astype(int)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at].array, "part": np.concatenate(part), "container": np.concatenate(box) + base, "n_tokens": np.concatenate(size)}), base + max(used, 1)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyspark

        ctx = pyspark.TaskContext.get()
        base = ctx.partitionId() << 40 if ctx else 0
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            while size >= shard + shard // 2:  # so the last shard of a partition isn't a small one
                some = pd.concat(held, ignore_index=True)
                out, base = one(some.iloc[:shard].reset_index(drop=True), base)
                yield out
                held = [some.iloc[shard:].reset_index(drop=True)]
                size -= shard
        if size:
            yield one(pd.concat(held, ignore_index=True), base)[0]

    parts = max(1, min(-(-total // shard), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    fields = f"doc_id {kind}, row bigint, n_tokens bigint, terms array<int>, tfs array<int>"
    order = rows.mapInPandas(keyed, f"{fields}, one bigint, two bigint").repartitionByRange(parts, "one", "two", "row").sortWithinPartitions("one", "two", "row")
    out = order.select("doc_id", "row", "n_tokens", "terms", "tfs").mapInPandas(shards, f"doc_id {kind}, part bigint, container bigint, n_tokens bigint")
    return out.withColumnRenamed("doc_id", doc_id)
