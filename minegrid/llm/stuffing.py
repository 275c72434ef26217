"""Keyword-stuffed pages, link lists and product tags, told from corpus counts of neighbouring words.

1. Texts are normalised (compatibility forms, case, accents and invisible characters dropped, so odd spellings meet their
   plain form), links become one mark, digits one digit, CJK stretches overlapping character pairs.
2. Exact counts of words and neighbour pairs over the whole corpus give every text its mean normalised pointwise mutual
   information of neighbouring words and its share of repeated collocations. Suspects are word salad (mean below
   ``salad``), repeat collocations excessively (share above ``repeated``), or are dense in links or tags.
3. How much a word belongs to suspects is its pointwise mutual information with them: the logarithm of its
   document frequency there against that elsewhere, over the whole corpus. A text's share is that of its words
   that stand in a stretch (a window of neighbours) of suspect words. The verdict is the share plus ``weight`` times how far
   the text is salad or repeats itself: above ``case`` it is one. Verdicts of one round are the suspects of the next, so honest repetition (menus, opening hours, emphatic reviews), whose words
   most honest texts use, drops out and plain tag lists without any repetition come in.

All counts and weights are exact, those of rare words and pairs too. Words of at least 1 in ``HEADS`` of all words, and pairs
of at least 1 in ``HEAD_PAIRS`` of all pairs, are heads: at most that many, whatever the corpus, so they are gathered and sent
to tasks as arrays. The rest stays in tables and is joined: a rare word's count and weight by its code with the texts that
hold it, a rare pair's count by both codes. The two bounds say which way a number takes, not what it is. Nothing is hashed
into slots; what is shuffled are sums, rare words and pairs with their texts, and, to meet these, the texts as numbers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import written

HEADS, HEAD_PAIRS = 1 << 20, 1 << 21
LEAST_WORDS = 8
WINDOW = 4  # neighbours on either side
LEAN = 0.3  # mean association of a stretch that counts as stuffed
ROUNDS = 3


class Limits(NamedTuple):
    """Mean normalised PMI below which neighbours have little to do with each other; shares of repeated pairs, of links and of tags per word that make a suspect; weight of the first two in the verdict; score above which a text is a case."""

    salad: float = 0.36
    repeated: float = 0.55
    links: float = 0.12
    tags: float = 0.5
    weight: float = 0.1
    case: float = 0.5


_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+")
_CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
_WORD = re.compile(rf"\x02|[{_CJK}]+|[^\W_]+")
_IS_CJK = re.compile(rf"[{_CJK}]")
_DIGITS = re.compile(r"\d+")


def normal(text: str) -> str:
    """Compatibility decomposition, lower case, without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text).lower()
    return "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))


def words(text: str) -> list[str]:
    out: list[str] = []
    for w in _WORD.findall(_URL.sub(" \x02 ", normal(text).replace("\x02", " "))):
        if _IS_CJK.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(_DIGITS.sub("0", w))
    return out


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


LINK = _code("\x02")
_TOKENS = "toks array<bigint>, tags int"


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for b in batches:
        toks, tags = [], []
        for t in b["text"]:
            out = []
            for w in words(t):
                s = known.get(w)
                if s is None:
                    if len(known) > 500_000:
                        known.clear()
                    s = known[w] = _code(w)
                out.append(s)
            toks.append(np.asarray(out, np.int64))
            tags.append(t.count("#"))
        yield pd.DataFrame({"doc_id": b["doc_id"], "toks": toks, "tags": tags})


class Counts(NamedTuple):
    """Corpus counts: sorted codes of head words and head pairs with their numbers, and the totals. By themselves they know
    of all others only a stand-in, half of the limit; ``page_scores`` has the exact numbers of those from tables."""

    word: np.ndarray
    word_n: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    total: float
    total_pairs: float

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Places of words among the heads; len(word) for all others."""
        return _places(self.word, codes)

    def n(self, ids: np.ndarray) -> np.ndarray:
        rare = max(1.0, self.total / HEADS / 2)
        return np.append(self.word_n, rare)[ids]


def _places(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, codes)
    if not len(table):
        return at
    return np.where(table[np.minimum(at, len(table) - 1)] == codes, at, len(table))


class Texts(NamedTuple):
    """The texts of a batch laid end to end: word ids, first and end place of the text of each word, text of each word, lengths, tags, links."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    tags: np.ndarray
    links: np.ndarray

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, len(self.n))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair codes of neighbouring words and their texts."""
        if len(self.ids) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inside = self.doc[1:] == self.doc[:-1]
        return ((self.ids[:-1].astype(np.int64) << 32) | self.ids[1:])[inside], self.doc[1:][inside]


def _col(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return _col(b, name).flatten().to_numpy(zero_copy_only=False)


def _lengths(b: pa.RecordBatch, name: str) -> np.ndarray:
    return _col(b, name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(n: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)


def _laid(b: pa.RecordBatch, counts_word: np.ndarray) -> Texts:
    codes, n = _flat(b, "toks"), _lengths(b, "toks")
    doc = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(n)
    t = Texts(_places(counts_word, codes), (end - n)[doc], end[doc], doc, n, _col(b, "tags").to_numpy(zero_copy_only=False), np.empty(0))
    return t._replace(links=t.per_doc(codes == LINK))


def _numbered(b: pa.RecordBatch, word: np.ndarray) -> pa.RecordBatch:
    """Texts as numbers: head words by their place, others by ``len(word)`` and their place among the text's rare words.

    ``rare`` holds the codes of those, each once, in order.
    """
    t, codes = _laid(b, word), _flat(b, "toks")
    other = np.flatnonzero(t.ids == len(word))
    other = other[np.lexsort((codes[other], t.doc[other]))]
    doc, code = t.doc[other], codes[other]
    new = np.ones(len(other), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    k = np.bincount(doc[new], minlength=len(t.n))
    t.ids[other] = len(word) + np.cumsum(new) - 1 - (np.cumsum(k) - k)[doc]
    cols = [_col(b, "row"), _col(b, "doc_id"), _lists(t.n, pa.array(t.ids.astype(np.int32))), _lists(k, pa.array(code[new])), *map(pa.array, (t.n, t.tags, t.links.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "ids", "rare", "n_words", "tags", "links"])


def _read(b: pa.RecordBatch, size: int) -> Texts:
    """Numbered texts; each rare word of each text has a number of its own in the batch, ``size`` plus its place in ``rare``."""
    ids, n, k = _flat(b, "ids").astype(np.int64), _col(b, "n_words").to_numpy(zero_copy_only=False), _lengths(b, "rare")
    doc, end = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    ids += np.where(ids >= size, (np.cumsum(k) - k)[doc], 0)
    return Texts(ids, (end - n)[doc], end[doc], doc, n, _col(b, "tags").to_numpy(zero_copy_only=False), _col(b, "links").to_numpy(zero_copy_only=False))


def _with_values(texts: DataFrame, table: DataFrame) -> DataFrame:
    """Numbered texts with what ``table`` (code, value) has for each of their rare words as ``values``, in the order of ``rare``."""
    each = texts.select("row", F.explode("rare").alias("code")).join(table, "code")
    lists = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "value"))), lambda x: x["value"]).alias("values"))
    return texts.join(lists, "row", "left")


def features(b: pa.RecordBatch, c: Counts) -> pa.RecordBatch:
    """Per text: pairs, the share that repeat an earlier one (0 without any), summed normalised PMI of head pairs, and all other
    pairs as the codes of both words with the logarithm of the product of their numbers."""
    size = len(c.word)
    t, rare = _read(b, size), _flat(b, "rare")
    pairs, doc = t.neighbours()
    k = np.bincount(doc, minlength=len(t.n))
    order = np.lexsort((pairs, doc))
    p, d = pairs[order], doc[order]
    again = np.zeros(len(p), bool)
    again[1:] = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
    repeats = np.bincount(d, again, len(t.n)) / np.maximum(k, 1)
    first, second = pairs >> 32, pairs & 0xFFFFFFFF
    n = np.log2(np.concatenate((c.word_n, _flat(b, "values").astype(float) if len(rare) else np.empty(0))))
    place = _places(c.pair, pairs)
    own = place < len(c.pair)
    joint = np.append(c.pair_n, 1.0)[place[own]] / max(c.total_pairs, 1.0)
    both = n[first] + n[second]
    pmi = (np.log2(joint) + 2 * np.log2(max(c.total, 1.0)) - both[own]) / -np.log2(np.minimum(joint, 0.5))
    code = np.concatenate((c.word, rare))
    rest = pa.StructArray.from_arrays([pa.array(code[first[~own]]), pa.array(code[second[~own]]), pa.array(both[~own])], ["a", "b", "both"])
    keep = ["row", "doc_id", "ids", "rare", "n_words", "tags", "links"]
    cols = [*[_col(b, x) for x in keep], *map(pa.array, (k, repeats, np.bincount(doc[own], pmi, len(t.n)).astype(float))), _lists(np.bincount(doc[~own], minlength=len(t.n)), rest)]
    return pa.RecordBatch.from_arrays(cols, [*keep, "n_pairs", "repeated", "head_pmi", "rest"])


def _rest_pmi(rest: DataFrame, c: Counts) -> DataFrame:
    """Summed normalised PMI of the pairs that aren't heads, per text. Their counts are exact: all their rows are here, and fewer than a head's."""
    joint = F.count("*").over(Window.partitionBy("a", "b")) / F.lit(max(c.total_pairs, 1.0))
    both = rest.withColumn("joint", joint)
    pmi = (F.log2("joint") + F.lit(2 * float(np.log2(max(c.total, 1.0)))) - F.col("both")) / -F.log2(F.least("joint", F.lit(0.5)))
    return both.groupBy("row").agg(F.sum(pmi).alias("rest_pmi"))


def suspects(t: Texts, pmi: np.ndarray, repeats: np.ndarray, lim: Limits) -> np.ndarray:
    """Round 0: word salad, excessively repetitive, or dense in links or tags."""
    return (t.n >= LEAST_WORDS + 4) & ((t.links > lim.links * t.n) | (t.tags > lim.tags * t.n) | (repeats > lim.repeated) | (pmi < lim.salad))


def stuffed_share(t: Texts, weight: np.ndarray) -> np.ndarray:
    """Share of words in stretches whose mean association with suspects is above LEAN; 0 for texts under LEAST_WORDS."""
    i = np.arange(len(t.ids))
    c = np.concatenate(([0.0], np.cumsum(weight[t.ids], dtype=np.float64)))
    lo, hi = np.maximum(t.start, i - WINDOW), np.minimum(t.end, i + WINDOW + 1)
    inside = (c[hi] - c[lo]) > LEAN * (hi - lo)
    return np.where(t.n >= LEAST_WORDS, t.per_doc(inside) / np.maximum(t.n, 1), 0.0)


def score(share: np.ndarray, pmi: np.ndarray, repeats: np.ndarray, n: np.ndarray, lim: Limits) -> np.ndarray:
    """The verdict's number: the share, raised by at most ``weight`` for salad or repetition."""
    incoherent = np.clip((lim.salad - pmi) / lim.salad, 0, 1)
    repetitive = np.clip((repeats - lim.repeated) / (1 - lim.repeated), 0, 1)
    return np.where(n >= LEAST_WORDS, share + lim.weight * np.maximum(incoherent, repetitive), 0.0)


_SUMS = "code bigint, a bigint, b bigint"


def _sums(rows: DataFrame, count, name: str) -> DataFrame:
    """Sums of (code, a, b) over all partitions."""
    got = rows.mapInArrow(count, _SUMS).groupBy("code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return written(got, name)


def _heads(sums: DataFrame, least_share: int) -> tuple[pd.DataFrame, float, Column]:
    """Codes of at least 1 in so many, at most ``least_share`` rows; the total; the condition of a head."""
    total = sums.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("t")).first()["t"]
    head = F.col("a") * least_share >= total
    return sums.where(head).toPandas().sort_values("code"), float(total), head


def _row(code: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    code = np.asarray(code, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.asarray(a, np.int64)), pa.array(np.zeros(len(code), np.int64) if b is None else np.asarray(b, np.int64))], ["code", "a", "b"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _row(*np.unique(b.column(b.schema.get_field_index("toks")).flatten().to_numpy(zero_copy_only=False), return_counts=True))


def exact_counts(tokens: DataFrame) -> tuple[Counts, DataFrame]:
    """Exact counts of head words and head pairs of the whole corpus, and a table (code, value) with those of all other words.

    A head pair is made of head words, so only those are paired; the other pairs are counted where they are used.
    """
    bare = tokens.select("toks", "tags")
    sums = _sums(bare, _count_words, "word-counts")
    w, total, head = _heads(sums, HEADS)
    word, word_n = w["code"].to_numpy(np.int64), w["a"].to_numpy(float)
    heads = tokens.sparkSession.sparkContext.broadcast(word)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _ = _laid(b, heads.value).neighbours()
            rare = len(heads.value)
            code, n = np.unique(np.where((p >> 32 == rare) | (p & 0xFFFFFFFF == rare), -1, p), return_counts=True)
            yield _row(code, n)

    p, total_pairs, _ = _heads(_sums(bare, pairs, "pair-counts"), HEAD_PAIRS)
    own = p[p["code"] >= 0]
    counts = Counts(word, word_n, own["code"].to_numpy(np.int64), own["a"].to_numpy(float), total, total_pairs)
    return counts, sums.where(~head).select("code", F.col("a").alias("value"))


def corpus_counts(tokens: DataFrame) -> Counts:
    return exact_counts(tokens)[0]


def page_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_words, mean_pmi, repeated, share, score) of every document with text; cases have a score above ``case``.

    Null and empty texts give no rows; texts under ``LEAST_WORDS`` words, blank ones too, score 0; repeated rows and copies
    are judged alike, each by itself; a corpus without suspects has shares of 0, an empty one gives no rows. Words are
    counted, not characters.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text != ''")
    tokens = written(src.mapInPandas(_tokenise, f"doc_id {kind}, {_TOKENS}").withColumn("row", F.monotonically_increasing_id()), "words")
    exact, rare_n = exact_counts(tokens)
    counts = spark.sparkContext.broadcast(exact)
    size = len(exact.word)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _numbered(b, counts.value.word)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield features(b, counts.value)

    fields = f"row bigint, doc_id {kind}, ids array<int>, rare array<bigint>, n_words bigint, tags int, links bigint"
    numbered = tokens.mapInArrow(number, fields)
    any_rare = not rare_n.isEmpty()
    if any_rare:
        numbered = _with_values(written(numbered, "numbered"), rare_n)
    measured = written(numbered.mapInArrow(measure, f"{fields}, n_pairs bigint, repeated double, head_pmi double, rest array<struct<a:bigint,b:bigint,both:double>>"), "measured")
    # measured once: words as numbers, mean PMI (1 without any pair), repetition
    texts = measured.drop("rest").join(_rest_pmi(measured.select("row", F.inline("rest")), exact), "row", "left")
    mean = F.when(F.col("n_pairs") > 0, (F.col("head_pmi") + F.coalesce("rest_pmi", F.lit(0.0))) / F.col("n_pairs")).otherwise(1.0)
    texts = written(texts.withColumn("mean_pmi", mean).drop("n_pairs", "head_pmi", "rest_pmi"), "texts")

    def laid(b: pa.RecordBatch, weights) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, mean PMI, repetition, and their shares under ``weights``, with the weights of rare words in ``values``."""
        t, pmi, repeats = _read(b, size), *(_col(b, x).to_numpy(zero_copy_only=False) for x in ("mean_pmi", "repeated"))
        if weights is None:
            return t, pmi, repeats, np.zeros(len(t.n))
        rare = _flat(b, "values") if "values" in b.schema.names else np.zeros(len(_flat(b, "rare")))
        return t, pmi, repeats, stuffed_share(t, np.concatenate((weights.value, rare.astype(np.float32))))

    def class_counts(weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inside, outside = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)  # head words, then documents
            for b in batches:
                t, pmi, repeats, share = laid(b, weights)
                case = suspects(t, pmi, repeats, limits) if weights is None else score(share, pmi, repeats, t.n, limits) > limits.case
                head = t.ids < size
                once = np.unique(t.doc[head] * np.int64(size + 1) + t.ids[head])
                hit = case[once // (size + 1)]
                inside += np.bincount(once[hit] % (size + 1), minlength=size + 1)
                outside += np.bincount(once[~hit] % (size + 1), minlength=size + 1)
                inside[-1] += case.sum()
                outside[-1] += (~case).sum()
                rare = np.repeat(case, _lengths(b, "rare"))  # rare words by their codes, heads and documents below zero
                yield _row(_flat(b, "rare"), rare, ~rare)
            at = np.flatnonzero(inside + outside)
            yield _row(-1 - at, inside[at], outside[at])

        return run

    weights, known = None, texts
    for _ in range(rounds):
        got = _sums(known.drop("doc_id"), class_counts(weights), "classes")
        heads = got.where("code < 0").toPandas()  # one row per head word and one
        a, b = np.zeros(size + 1), np.zeros(size + 1)
        a[-1 - heads["code"]], b[-1 - heads["code"]] = heads["a"], heads["b"]
        n_in, n_out = float(a[-1]), float(b[-1])
        w = np.zeros(size)
        if n_in:
            w = np.log((a[:-1] + 0.2) / (n_in + 1)) - np.log((b[:-1] + 0.2 * n_out / n_in) / (n_out + 1))
        weights = spark.sparkContext.broadcast(np.clip(w, -3, 3).astype(np.float32))
        known = texts
        if not n_in:
            break
        if any_rare:
            lean = F.log((F.col("a") + 0.2) / (n_in + 1)) - F.log((F.col("b") + 0.2 * n_out / n_in) / (n_out + 1))
            known = _with_values(texts, got.where("code >= 0").select("code", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), lean)).alias("value")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, pmi, repeats, share = laid(b, weights)
            cols = [_col(b, "doc_id"), *map(pa.array, (t.n, pmi, repeats, share, score(share, pmi, repeats, t.n, limits)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "mean_pmi", "repeated", "share", "score"])

    out = known.mapInArrow(judge, f"doc_id {kind}, n_words bigint, mean_pmi double, repeated double, share double, score double")
    return out.withColumnRenamed("doc_id", doc_id)


def stuffed_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``page_scores`` that are cases: most of their text is stuffed."""
    return page_scores(docs, doc_id, text, rounds, limits).where(F.col("score") > limits.case)
