"""Several values packed in one field: segmentation learnt by expectation maximisation, decoded by Viterbi.

A string is read as tokens: words, stretches of white space, single marks and quotes. They span a lattice of readings.
A value may be one word, up to ``MAX_JOIN`` words with what stands between them, or a quoted span, which stays whole;
a quote at the start of a slot may open such a span or be a mark like others. The model holds

* how frequent values are in the whole column: each value that makes up at least 1 in ``HEAD_SHARE`` of all words by
  itself (so there are at most ``HEAD_SHARE`` of these, whatever the data), all others by their form (kind of
  characters and length); values of several words likewise, by the expected counts of EM;
* per kind of delimiter how likely it separates, and how likely a quote opens a span. The prior states the field's
  rule (punctuation other than - and _, and white space, separate; quotes enclose) with weight ``strength``.

Strings are folded into signatures (heads, forms and delimiters) with their counts, so an EM pass touches each distinct
signature once. Viterbi then picks the most likely reading of each string. An exact check goes through its values: those
that keep the rule stay as they are, one that breaks it is read again by the rule, and strings so mended are counted. The rule
is silent where text follows a closing quote at once (``'Ann, Bob, O'Neil``: no quotes around a whole slot): there
Viterbi's choice stands, a value with its quotes inside or a quote that is a mark. Without the check it stands everywhere.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import WHITE, trimmed, written

MAX_JOIN = 3
LONGEST = 64  # forms of longer words count as this long
HEAD_SHARE = 1 << 16
NOTHING = {"none", "null", "-"}  # fixed values: unquoted slots that say there is no value
QUOTES = "\"'"

_SPACE = "".join(regex.escape(c) for c in WHITE)
_TOKEN = regex.compile(rf"(?:[^\p{{P}}\p{{S}}{_SPACE}]|[-_])+|[{_SPACE}]+|.", regex.DOTALL)


def unwrapped(text: str) -> str:
    """Trimmed, without one pair of enclosing square brackets."""
    t = text.strip(WHITE)
    return t[1:-1].strip(WHITE) if len(t) > 1 and t[0] == "[" and t[-1] == "]" else t


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


_kinds: dict[str, str] = {}


def _kind(tok: str) -> str:
    """w word, s white space, q quote, m other mark."""
    c = tok[0]
    k = _kinds.get(c)
    if k is None:
        k = "s" if c in WHITE else "q" if c in QUOTES else "w" if c in "-_" or unicodedata.category(c)[0] not in "PS" else "m"
        if len(_kinds) < 100_000:
            _kinds[c] = k
    return k


Heads = dict[str, int]


def _form(word: str, heads: Heads) -> str:
    h = heads.get(word)
    if h is not None:
        return f"h{h}"
    return f"{'d' if word.isdigit() else 'a' if word.isalpha() else 'x'}{min(len(word), LONGEST)}"


def signature(toks: Sequence[str], heads: Heads) -> str:
    """The tokens with words as heads or forms and white space as blanks, as one line. Words start with a letter of their form."""
    out = []
    for t in toks:
        k = _kind(t)
        out.append(_form(t, heads) if k == "w" else "_" if k == "s" else t if t < "\x7f" else "?")
    return "\x1f".join(out)


def _sig_kind(s: str) -> str:
    return "w" if s[0].isalpha() else "s" if s == "_" else "q" if s in QUOTES else "m"


def _closing(toks: Sequence[str], i: int) -> int:
    """Index of the quote that closes the one at ``i`` (doubled quotes inside are one); -1 if none does."""
    q, j, n = toks[i], i + 1, len(toks)
    while j < n:
        if toks[j] == q:
            if j + 1 < n and toks[j + 1] == q:
                j += 2
                continue
            return j
        j += 1
    return -1


def _after(toks: Sequence[str], kind, j: int) -> list[tuple[int, str]]:
    """Separators that may start at ``j``, as (place of the next slot, delimiter). The first is the rule's."""
    n = len(toks)
    k = j + 1 if kind(toks[j]) == "s" else j
    if k == n:  # trailing white space does not occur in trimmed text
        return [(n, "_")]
    c = toks[k]
    marked = k + 2 if k + 1 < n and kind(toks[k + 1]) == "s" else k + 1
    if kind(c) == "m":
        return [(marked, c)]
    if kind(c) == "q":
        if k == j:
            return [(marked, c)]
        return [(k, "_"), (marked, c)] if _closing(toks, k) > 0 else [(marked, c)]
    return [(k, "_")]


def _first(toks: Sequence[str], kind, i: int) -> tuple[int, bool, bool]:
    """The rule's value at the slot start ``i``: its end, whether quoted, whether a span was there to choose."""
    n = len(toks)
    if i < n and kind(toks[i]) == "q":
        c = _closing(toks, i)
        if c > 0:
            end = c + 1
            while end < n and kind(toks[end]) == "w":  # a span followed by more text is one value with its quotes
                end += 1
            return end, end == c + 1, True
    return (i + 1 if i < n and kind(toks[i]) == "w" else i), False, False


Cut = tuple[int, int, bool]


def _open(toks: Sequence[str], kind, i: int) -> bool:
    """Whether the rule is silent on the slot start ``i``: its quote is closed, but text follows at once."""
    _, quoted, choice = _first(toks, kind, i)
    return choice and not quoted


def checked(toks: Sequence[str], kind, reading: Sequence[Cut]) -> list[Cut]:
    """The reading with values that break the rule read again by it; where the rule is silent the reading stands."""
    said = {cut[0]: cut for cut in reading}
    out, i, n = [], 0, len(toks)
    while True:
        end, quoted, _ = _first(toks, kind, i)
        if said.get(i) == (i, i, False) and _open(toks, kind, i):  # the quote is a mark after an empty slot
            end = i
        out.append((i, end, quoted))
        if end >= n:
            return out
        ways = _after(toks, kind, end)
        i = ways[0][0]
        if len(ways) > 1 and _open(toks, kind, i):  # a quote after white space: a mark takes the white space with it
            as_mark = said.get(i) == (i, i, False) or (i not in said and ways[1][0] in said)
            i = ways[1][0] if as_mark else i


def by_rule(toks: Sequence[str], kind=_kind) -> list[Cut]:
    """The rule's reading as (first token, end, quoted) per slot; where the rule is silent a span stays whole."""
    return checked(toks, kind, ())


Model = dict[str, float]


def _inside(sig: Sequence[str], i: int, end: int) -> list[str]:
    """The delimiters that don't separate if ``i`` to ``end``, a quote, its partner and text behind, is one value."""
    kinds = [_sig_kind(x) for x in sig[i:end]]
    marks = [f"i{x}" for x, k in zip(sig[i:end], kinds) if k == "m"]
    return marks + ["i_" for j, k in enumerate(kinds) if k == "s" and "m" not in (kinds[j - 1], kinds[j + 1])]


def _edges(sig: Sequence[str], model: Model) -> list[tuple[int, int, Cut, tuple[str, ...], float]]:
    """(node, next node, value, parameters used, log score) of every value and separator of the lattice, by node.

    Nodes are slot starts (token numbers); n + 1 is the end, as a slot may start empty at n.
    """
    n, get = len(sig), model.get
    unseen = {k: model[k] for k in "vio"}  # scores of parameters that don't occur
    kind = _sig_kind
    out, todo, seen = [], [0], {0}

    def add(i: int, end: int, quoted: bool, used: list[str]) -> None:
        score = 0.0
        for u in used:
            score += get(u, unseen[u[0]])
        if end >= n:
            out.append((i, n + 1, (i, end, quoted), tuple(used), score))
            return
        for nxt, d in _after(sig, kind, end):
            o = f"o{d}"
            out.append((i, nxt, (i, end, quoted), (*used, o), score + get(o, unseen["o"])))
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)

    while todo:
        i = todo.pop()
        end, quoted, choice = _first(sig, kind, i)
        if choice:
            add(i, end, quoted, ["vQ" if quoted else "vG", f"o{sig[i]}span", *([] if quoted else _inside(sig, i, end))])
            add(i, i, False, ["vE", f"i{sig[i]}span"])
            continue
        if end == i:
            add(i, i, False, ["vE"])
            continue
        add(i, end, False, [f"v{sig[i]}"])
        name, inner, j = sig[i], [], end
        for _ in range(MAX_JOIN - 1):  # values of several words
            if j >= n:
                break
            nxt, d = _after(sig, kind, j)[0]
            if nxt >= n or kind(sig[nxt]) != "w":
                break
            inner.append(f"i{d}")
            name = f"{name}\x1e{d}\x1e{sig[nxt]}"
            known = f"v{name}"
            j = nxt + 1
            heads = all(x[0] == "h" for x in name.split("\x1e")[::2])
            add(i, j, False, [known if heads else f"vj{len(inner)}", *inner])
    out.sort(key=lambda e: e[0])
    return out


def expected(sig: str, weight: float, model: Model, into: dict[str, float]) -> None:
    """Forward-backward over one signature; adds ``weight`` times the expected use of every parameter."""
    parts = sig.split("\x1f")
    n = len(parts)
    edges = _edges(parts, model)
    if len(edges) == 1:
        for u in edges[0][3]:
            into[u] = into.get(u, 0.0) + weight
        return
    none = -math.inf
    fwd, bwd = [none] * (n + 2), [none] * (n + 2)
    fwd[0] = bwd[n + 1] = 0.0

    def plus(a: float, b: float) -> float:
        if a == none:
            return b
        hi, lo = (a, b) if a > b else (b, a)
        return hi + math.log1p(math.exp(lo - hi)) if hi - lo < 40 else hi

    for i, j, _, _, s in edges:
        fwd[j] = plus(fwd[j], fwd[i] + s)
    for i, j, _, _, s in reversed(edges):
        bwd[i] = plus(bwd[i], bwd[j] + s)
    for i, j, _, used, s in edges:
        p = fwd[i] + s + bwd[j] - fwd[n + 1]
        if p > -30:
            e = weight * math.exp(p)
            for u in used:
                into[u] = into.get(u, 0.0) + e


def best_reading(sig: str, model: Model) -> list[Cut]:
    """Viterbi: the most likely values as (first token, end, quoted), from the left; ties keep the rule's."""
    parts = sig.split("\x1f")
    n = len(parts)
    best: list[float] = [-math.inf] * (n + 2)
    back: list = [None] * (n + 2)
    best[0] = 0.0
    for i, j, cut, _, s in _edges(parts, model):
        if best[i] + s > best[j]:
            best[j], back[j] = best[i] + s, cut
    out, j = [], n + 1
    while back[j] is not None:
        out.append(back[j])
        j = back[j][0]
        if j == 0:
            break
    return out[::-1]


def _model(counts: dict[str, float], strength: float) -> Model:
    """Maximum a posteriori parameters from expected counts; ``strength`` is the weight of the stated rule in columns like this one."""
    total = counts.get("t", 0.0) + 1.0
    m = {k: math.log((c + 1e-3) / total) for k, c in counts.items() if k[0] == "v"}
    for d in {k[1:] for k in counts if k[0] in "io"}:
        o, i = counts.get(f"o{d}", 0.0) + strength * total + 1e-9, counts.get(f"i{d}", 0.0) + strength * total * 1e-4 + 1e-9
        m[f"o{d}"], m[f"i{d}"] = math.log(o / (o + i)), math.log(i / (o + i))
    return m | _priors(strength) | {"v": math.log(1e-3 / total)}


def _priors(strength: float) -> Model:
    i = math.log(1e-4) if strength else math.log(0.5)
    return {"v": math.log(1e-2), "i": i, "o": math.log1p(-math.exp(i))}


def head_values(strings: DataFrame, col: str = "s") -> tuple[Heads, int]:
    """Words that are at least 1 in ``HEAD_SHARE`` of all words of the column (so at most ``HEAD_SHARE``), numbered in order; number of words."""
    words = strings.select(F.explode(F.split(col, r"[\p{P}\p{S}\p{Z}\p{Cc}&&[^-_]]+")).alias("w")).where("w != ''")
    n = written(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    got = n.where(F.col("n") * HEAD_SHARE >= total).select("w").collect()
    return {w: k for k, w in enumerate(sorted(r["w"] for r in got))}, total


def learn(signatures: DataFrame, n_words: int, rounds: int = 3, strength: float = 10.0) -> Model:
    """EM over (sig, n). What comes to the driver is bounded: values of at least 1 in ``HEAD_SHARE`` of all words, forms and delimiters."""
    model = _priors(strength)
    for _ in range(rounds):

        def e_step(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            acc: dict[str, float] = {}
            for b in batches:
                for s, n in zip(b["sig"], b["n"]):
                    expected(s, float(n), model, acc)
            acc["t"] = sum(c for k, c in acc.items() if k[0] == "v")
            yield pd.DataFrame({"k": pd.Series(list(acc), dtype=object), "c": pd.Series(list(acc.values()), dtype="float64")})

        got = signatures.mapInPandas(e_step, "k string, c double").groupBy("k").agg(F.sum("c").alias("c"))
        few = (~F.col("k").contains("\x1e")) | (F.col("c") * HEAD_SHARE >= n_words)  # single heads, forms, delimiters; values of several heads if frequent
        model = _model({r["k"]: r["c"] for r in got.where(few).collect()}, strength)
    return model


def _value(toks: Sequence[str], cut: Cut) -> str | None:
    i, end, quoted = cut
    if quoted:
        q = toks[i]
        return "".join(toks[i + 1 : end - 1]).replace(q * 2, q)
    if end == i:
        return None
    text = toks[i] if end == i + 1 else "".join(toks[i:end])
    return None if text.lower() in NOTHING else text


def _long(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    long = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), trimmed(f).alias("s")) for f in fields])).alias("x"))
    return long.select("row_id", "x.field_name", "x.s").where("s is not null and s != ''")


def _fitted(long: DataFrame, rounds: int, strength: float) -> tuple[Heads, Model]:
    heads, n_words = head_values(long)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(signature(tokens(unwrapped(s)), heads) for s in b["s"])
            n.pop("", None)
            yield pd.DataFrame({"sig": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    sigs = long.select("s").mapInPandas(signatures, "sig string, n bigint").groupBy("sig").agg(F.sum("n").alias("n"))
    spark = long.sparkSession
    # few bytes but much work each: spread over all cores rather than by size
    sigs = written(sigs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "signatures")
    return heads, learn(sigs, n_words, rounds, strength)


class _Reader:
    """Readings of strings; those of signatures met before are remembered."""

    def __init__(self, heads: Heads, model: Model, exact: bool, remember: int = 50_000) -> None:
        self.heads, self.model, self.exact, self.remember = heads, model, exact, remember
        self.known: dict[str, tuple[list[Cut], bool]] = {}

    def read(self, s: str) -> tuple[list[str], list[Cut], bool]:
        """Tokens, chosen values, and whether the check had to change the choice."""
        toks = tokens(unwrapped(s))
        if not toks:
            return toks, [], False
        sig = signature(toks, self.heads)
        got = self.known.get(sig)
        if got is None:
            cuts, mended = best_reading(sig, self.model), False
            if self.exact:
                kept = checked(sig.split("\x1f"), _sig_kind, cuts)
                cuts, mended = kept, cuts != kept
            if len(self.known) >= self.remember:
                self.known.clear()
            got = self.known[sig] = (cuts, mended)
        return toks, *got


def explode_packed(df: DataFrame, row_id: str, fields: Sequence[str], rounds: int = 3, strength: float = 10.0, exact: bool = True) -> DataFrame:
    """One row (row_id, field_name, pos, item) per value packed in ``fields``; pos counts all slots from 1.

    Null and blank strings and empty brackets give no rows, nor do empty slots and unquoted slots that say only
    none, null or -. Quoted items keep delimiters and white space inside; a doubled quote is one; an empty quoted
    slot is an empty item. A quote that isn't closed, or stands inside a value, is a delimiter like other marks.
    A quote at the start of a slot whose partner is followed by text is either, whichever the learnt model finds likelier:
    part of one value that reaches to the end of that text, or a mark.
    Repeated rows repeat their items. An empty table gives none. With ``exact`` values that break the rule are
    mended; without it the learnt model may keep frequent values of several words together (lower ``strength`` for
    that: 0 leaves all to the column's frequencies).
    """
    long = _long(df, row_id, fields)
    heads, model = _fitted(long, rounds, strength)
    id_type = df.schema[row_id].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(heads, model, exact)
        for b in batches:
            at, pos, items = [], [], []
            for k, s in enumerate(b["s"]):
                toks, cuts, _ = reader.read(s)
                for p, cut in enumerate(cuts, 1):
                    v = _value(toks, cut)
                    if v is not None:
                        at.append(k)
                        pos.append(p)
                        items.append(v)
            out = b[["row_id", "field_name"]].iloc[at].reset_index(drop=True)
            yield out.assign(pos=pd.Series(pos, dtype="int64"), item=pd.Series(items, dtype=object))

    res = long.mapInPandas(decode, f"row_id {id_type}, field_name string, pos bigint, item string")
    return res.withColumnRenamed("row_id", row_id)


def reading_report(df: DataFrame, row_id: str, fields: Sequence[str], rounds: int = 3, strength: float = 10.0) -> DataFrame:
    """Per field: strings, strings with more than one reading, and those whose most likely reading the check had to mend."""
    long = _long(df, row_id, fields)
    heads, model = _fitted(long, rounds, strength)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, acc = _Reader(heads, model, True), Counter()
        open_: dict[str, bool] = {}
        for b in batches:
            for f, s in zip(b["field_name"], b["s"]):
                toks, _, mended = reader.read(s)
                if not toks:
                    continue
                sig = signature(toks, heads)
                if sig not in open_:
                    if len(open_) > 50_000:
                        open_.clear()
                    e = _edges(sig.split("\x1f"), model)
                    open_[sig] = len({x[0] for x in e}) < len(e)
                acc[f, "strings"] += 1
                acc[f, "open"] += open_[sig]
                acc[f, "mended"] += mended
        fs = sorted({f for f, _ in acc})
        yield pd.DataFrame({"field_name": pd.Series(fs, dtype=object), **{c: pd.Series([acc[f, c] for f in fs], dtype="int64") for c in ("strings", "open", "mended")}})

    got = long.mapInPandas(count, "field_name string, strings bigint, open bigint, mended bigint")
    return got.groupBy("field_name").agg(F.sum("strings").alias("n_strings"), F.sum("open").alias("n_with_readings"), F.sum("mended").alias("n_mended"))
