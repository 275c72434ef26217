"""Tokenizing a corpus with content-defined chunks that are shared across documents and encoded once.

Texts are cut where a rolling hash of the last ``WINDOW`` characters meets a mask, so equal passages give equal
chunks wherever they stand. A chunk that occurs twice or more in the corpus is encoded once and its record reused; what lies
between shared chunks occurs once and is encoded where it stands. Only digests, the shared chunks' records and, where these
are many, the texts once are shuffled. A chunk's own
encoding is right inside and may be wrong at its ends, where the cut fell into a piece of the tokenizer's
pattern or hid what follows. So every chunk's record keeps, beside its ids, the first piece borders after its start
and the last one that nothing behind it can change. Joining repairs each seam: the text from the last settled border is
encoded again into the next chunk, further and further, until one of its borders agrees with one of the chunk's;
from there the chunk's ids hold. If none of the stored borders agrees, the whole chunk is encoded again with the carry.
The result equals encoding the text in one go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import written
from .tokenizers import DEFAULT_VOCABULARY, pieces, vocabulary_path

WINDOW = 16
MASK_BITS = 8  # a cut every 256 characters on average
LEAST, MOST = 64, 2048  # bounds of a chunk's length
SIGHT = 3  # how far behind a piece's end the pattern looks: white space before a word 1, contractions 2
HEADS = 6  # stored borders at a chunk's start

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text. Depends on content only: where the rolling hash of 16 characters has its top bits clear."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    roll = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        roll += codes[k : n - WINDOW + 1 + k] * _POWERS[WINDOW - 1 - k]
    roll ^= roll >> np.uint64(29)
    roll *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(roll >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    out, last = [], 0
    for c in at.tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def encode_chunk(p, text: str) -> tuple[list[int], list[int], list[int], int, int]:
    """ids; first borders (character offsets) and their token indices; last settled border and its token index.

    A border is the start of a piece. It is settled if the piece before it ends at least SIGHT characters before the
    chunk does.
    """
    ids: list[int] = []
    heads, head_at = [], []
    tail, tail_at, n = 0, 0, len(text)
    for m in p.pattern.finditer(text):
        s = m.start()
        if s <= n - SIGHT:
            tail, tail_at = s, len(ids)
            if s and len(heads) < HEADS:
                heads.append(s)
                head_at.append(len(ids))
        w = m.group()
        ids.extend(p.known.get(w) or p.piece(w))
    return ids, heads, head_at, tail, tail_at


def join_chunks(p, parts: list[tuple]) -> list[int]:
    """ids of the whole text from its chunks (text, ids, heads, head_at, tail, tail_at) in order; seams repaired."""
    out: list[int] = []
    carry = ""  # text behind the last settled border
    for k, (text, ids, heads, head_at, tail, tail_at) in enumerate(parts):
        last = k == len(parts) - 1
        if not carry:
            if last:
                out.extend(ids)
            else:
                out.extend(ids[:tail_at])
                carry = text[tail:]
            continue
        base = len(carry)
        sync = None
        if len(heads):
            # encode again from the carry into the chunk; a border that agrees and can't be changed by what lies behind the window ends the repair
            reach = min(len(text), heads[-1] + SIGHT)
            window = carry + text[:reach]
            whole = reach == len(text) and last
            want = {base + h: i for i, h in enumerate(heads)}
            again: list[int] = []
            for m in p.pattern.finditer(window):
                s = m.start()
                if s in want and (whole or s <= len(window) - SIGHT):
                    sync = want[s]
                    break
                w = m.group()
                again.extend(p.known.get(w) or p.piece(w))
        if sync is None or (not last and heads[sync] > tail):
            # no agreement: this chunk goes through the tokenizer again with the carry
            joined = carry + text
            if last:
                out.extend(p.encode(joined))
            else:
                jids, _, _, jtail, jtail_at = encode_chunk(p, joined)
                out.extend(jids[:jtail_at])
                carry = joined[jtail:]
            continue
        out.extend(again)
        if last:
            out.extend(ids[head_at[sync] :])
        else:
            out.extend(ids[head_at[sync] : tail_at])
            carry = text[tail:]
    return out


def read_text(p, text: str, ends: list[int], known: dict[int, tuple]) -> list[int]:
    """ids of a text cut at ``ends``; ``known`` has the records of the shared chunks by their number.

    Stretches of chunks that occur nowhere else are encoded here, as one chunk each; a text without shared chunks at once.
    """
    if not known:
        return p.encode(text)
    parts: list[tuple] = []
    last = open_ = 0
    for n, end in enumerate(ends):
        got = known.get(n)
        if got is not None:
            if open_ < last:
                parts.append((text[open_:last], *encode_chunk(p, text[open_:last])))
            parts.append((text[last:end], *got))
            open_ = end
        last = end
    if open_ < last:
        parts.append((text[open_:last], *encode_chunk(p, text[open_:last])))
    return join_chunks(p, parts)


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts get an empty list, white space is text like any other.

    Repeated rows and repeated or null ids give a row each. No special tokens are added or recognised. An empty
    table gives no rows.
    """
    path = vocabulary_path(vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyspark

        ctx = pyspark.TaskContext.get()
        row = ctx.partitionId() << 40 if ctx else 0
        for b in batches:
            rows, ends, digests = [], [], []
            for t in b["text"]:
                row += 1
                at = cuts(t) if t else []
                rows.append(row)
                ends.append(at)
                digests.append([hashlib.blake2b(t[i:j].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i, j in zip([0, *at], at)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "row": rows, "ends": ends, "digests": digests})

    # texts lie here once more; null and empty ones have no chunks and take part in nothing that is shuffled
    cut = written(src.mapInPandas(split, f"doc_id {kind}, text string, row bigint, ends array<int>, digests array<binary>"), "chunks")
    each = cut.select("row", F.posexplode("digests").alias("seq", "digest"))
    counts = each.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "seq")).alias("first"))
    shared = counts.where("n > 1").select("digest", "first.row", "first.seq")
    # a shared chunk is encoded by the first document that holds it
    owners = written(shared.groupBy("row").agg(F.collect_list(F.struct("seq", "digest")).alias("own")), "owners")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for b in batches:
            got = []
            for t, ends, own in zip(b["text"], b["ends"], b["own"]):
                for x in own:
                    n = x["seq"]
                    got.append((x["digest"], *encode_chunk(p, t[ends[n - 1] if n else 0 : ends[n]])))
            yield pd.DataFrame(got, columns=["digest", "ids", "heads", "head_at", "tail", "tail_at"])

    first = cut.select("row", "text", "ends").join(owners, "row").select("text", "ends", "own")
    codes = written(first.mapInPandas(encode, "digest binary, ids array<int>, heads array<int>, head_at array<int>, tail int, tail_at int"), "codes")
    places = each.select("row", "seq", "digest").join(codes, "digest")
    parts = written(places.groupBy("row").agg(F.collect_list(F.struct("seq", "ids", "heads", "head_at", "tail", "tail_at")).alias("parts")), "parts")
    # texts move only if the parts are too large to be sent to them, by their size on disk
    both = cut.select("doc_id", "row", "text", "ends").join(parts, "row", "left").select("doc_id", "text", "ends", "parts")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for b in batches:
            res = []
            for t, ends, own in zip(b["text"], b["ends"], b["parts"]):
                known = {x["seq"]: (list(x["ids"]), list(x["heads"]), list(x["head_at"]), x["tail"], x["tail_at"]) for x in own} if own is not None else {}
                res.append(read_text(p, t, list(ends), known) if t else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": res})

    res = both.mapInPandas(join, f"doc_id {kind}, ids array<int>")
    return res.withColumnRenamed("doc_id", doc_id)
