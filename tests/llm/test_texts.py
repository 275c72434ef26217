import random

import numpy as np
import pytest

from minegrid.llm import chunk_encode as E
from minegrid.llm import packing as K
from minegrid.llm import stuffing as X
from minegrid.llm.tokenizers import pieces, vocabulary_path

ALPHABET = ["'ll", "'re", "'", " ", "  ", "\n", "a", "B", "é", "日本", "1", "23", "!", "...", "'s", "l", "\t", "🙂", "<|endoftext|>", "-", "word", " the"]


def text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_seams_are_repaired_wherever_the_cuts_lie():
    p, rng = pieces(vocabulary_path()), random.Random(1)
    for _ in range(3000):
        t = text(rng, rng.randint(1, 60))
        at = sorted({rng.randint(1, len(t)) for _ in range(rng.randint(0, 10))} | {len(t)})
        parts = [t[a:b] for a, b in zip([0, *at], at)]
        assert E.join_chunks(p, [(c, *E.encode_chunk(p, c)) for c in parts if c]) == p.encode(t)


def test_texts_with_some_chunks_known_equal_the_tokenizer():
    p, rng = pieces(vocabulary_path()), random.Random(7)
    for _ in range(2000):
        t = text(rng, rng.randint(1, 60))
        at = sorted({rng.randint(1, len(t)) for _ in range(rng.randint(0, 8))} | {len(t)})
        known = {n: E.encode_chunk(p, t[i:j]) for n, (i, j) in enumerate(zip([0, *at], at)) if rng.random() < 0.5}
        assert E.read_text(p, t, at, known) == p.encode(t) == [x for w in p.pattern.findall(t) for x in p.piece(w)]


def test_cuts_depend_on_content_only():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    a, b = "x" * 100 + shared, "yy" * 333 + shared
    chunks = lambda t: {t[i:j] for i, j in zip([0, *E.cuts(t)], E.cuts(t))}
    assert len(chunks(a) & chunks(b)) > 5 and E.cuts("") == []


def test_corpus_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(3)
    base = text(rng, 4000)
    docs = [(1, base), (2, base + " tail"), (2, base), (3, None), (4, ""), (5, " \n"), (None, "x"), (6, "a" * 30000), (7, text(rng, 50))]
    df = spark.createDataFrame([(i, s, "r", 0) for i, s in docs], "doc_id bigint, text string, row string, seq int")
    got = sorted(((str(r.doc_id), list(r.ids)) for r in E.encode_corpus(df).collect()))
    assert got == sorted((str(i), t.encode(s, add_special_tokens=False).ids if s else []) for i, s in docs)
    assert E.encode_corpus(df.where("false")).count() == 0


def test_containers_hold_whole_texts_tightly(spark):
    rng, p = random.Random(4), pieces(vocabulary_path())
    docs = [(k, " ".join(rng.choice(["soup", "bread", "lift", "stars", "тест"]) for _ in range(rng.choice([3, 20, 60, 150])))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, " word" * 700), (903, " word" * 256), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, container int")
    out = K.pack(df, capacity=256, shard=100).collect()
    room, parts = {}, {}
    for r in out:
        room[r.container] = room.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.n_tokens))
    assert max(room.values()) <= 256 and len(parts) == len({i for i, _ in docs})
    assert sorted(n for _, n in parts[902]) == sorted([256, 256, 700 - 512]) and parts[903] == [(0, 256)] and parts[900] == parts[901] == [(0, 0)]
    for i, t in docs:
        if i not in (5,) and t and len(p.encode(t)) <= 256:
            assert parts[i] == [(0, len(p.encode(t)))]
    assert sorted(n for _, n in parts[5]) == sorted(len(p.encode(t)) for i, t in docs if i == 5)
    assert sum(room.values()) / (256 * len(room)) > 0.9
    assert K.pack(df.where("false")).count() == 0


def test_texts_with_the_same_rare_terms_lie_side_by_side():
    ranks = K.rarity_ranks(np.array([0, 1, 5, 2, 9]))
    assert ranks.tolist() == [-1, -1, 1, 0, 2]
    one, two = K.lexical_keys([np.array([1, 2, 4]), np.array([3, 4]), np.array([2, 4]), np.array([], int)], ranks)
    assert one[0] == one[2] and two[0] == two[2] and one[1] < one[0] < one[3]


def test_retrieval_prefers_lexical_neighbours():
    topics = [np.arange(10 * k, 10 * k + 10) for k in range(4)]
    size = np.array([600] * 4 + [300] * 12)
    terms = [*topics, *[topics[k % 4] for k in range(12)]]
    box = K.pack_shard(size, size.astype(float), terms, [np.ones(10, int) for _ in terms], np.ones(40), 400.0, 1500)
    for k in range(4):
        own = [4 + j for j in range(12) if j % 4 == k]
        assert len({box[k], *[box[j] for j in own]}) == 1


def test_stuffed_pages_among_honest_ones(spark):
    rng = random.Random(6)
    open_, mid, end = ["We came early and", "My brother said that", "On our second visit", "Last week they told us"], ["the soup was warm", "the owner showed us around", "the lift was out of order", "nobody answered the phone"], ["so we stayed for hours.", "and we will be back soon.", "which is fair for a Monday.", "but the garden was lovely."]
    honest = lambda n: " ".join(f"{rng.choice(open_)} {rng.choice(mid)} {rng.choice(end)}" for _ in range(n))
    keys = ["cheap pizza", "car wash", "nail salon", "dentist near me", "free delivery"]
    docs = [(k, honest(rng.randint(1, 6))) for k in range(300)]
    spam = {
        1000: ", ".join(rng.choice(keys) for _ in range(60)), 1001: " ".join(f"#{rng.choice(keys).replace(' ', '')}{rng.randint(0, 9)}" for _ in range(40)),
        1002: " ".join(f"{rng.choice(keys)} http://x{k}.example/a" for k in range(30)), 1003: honest(1) + " " + " | ".join(rng.choice(keys) for _ in range(50)), 1004: "Ché͏ap Pizza! " * 3 + " ".join(rng.choice(keys).upper() for _ in range(40)),
    }
    for k in range(10):
        spam[1010 + k] = " / ".join(rng.choice(keys) for _ in range(50))
    fair = {2000: honest(4) + " see http://a.example and #nice", 2001: honest(1) * 12, 2002: None, 2003: "", 2004: " \n ", 2005: "car wash"}
    df = spark.createDataFrame([(i, t, 0.5) for i, t in [*docs, *spam.items(), *fair.items(), (1000, spam[1000])]], "doc_id bigint, text string, share double")
    got = [r.doc_id for r in X.stuffed_pages(df).collect()]
    assert set(got) == set(spam) and got.count(1000) == 2
    assert X.stuffed_pages(df.where("false")).count() == 0 and X.stuffed_pages(df.where("doc_id < 300")).count() == 0


def test_long_text_is_judged_whole(spark):
    t = "The soup was warm and the owner showed us around before we left. " * 3 + "cheap pizza car wash " * 30000
    docs = [(k, f"Honest words about visit number {k} to the garden and its soup") for k in range(50)] + [(99, t)]
    assert [r.doc_id for r in X.stuffed_pages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [99]


@pytest.mark.parametrize("word", ["Ｃａｆé", "café", "CAFE"])
def test_odd_spellings_meet_the_plain_form(word):
    assert X.words(word + "​ 12x") == ["cafe", "0x"]


def test_rare_words_and_pairs_share_one_count(spark, monkeypatch):
    import numpy as np

    docs = spark.createDataFrame([(k, "alpha beta gamma delta " * 5 + f"odd{chr(97 + k)}") for k in range(20)], "doc_id bigint, text string")
    tokens = docs.select("doc_id", "text").mapInPandas(X._tokenise, "doc_id bigint, toks array<bigint>, tags int").cache()
    c = X.corpus_counts(tokens)
    assert len(c.word) == 24 and c.total == 420 and sorted(c.word_n)[-4:] == [100.0] * 4 and c.total_pairs == 400
    assert sorted(c.pair_n)[-4:] == [80.0, 100.0, 100.0, 100.0] and len(c.pair) == 24
    monkeypatch.setattr(X, "HEADS", 20)
    few = X.corpus_counts(tokens)
    assert len(few.word) == 4 and few.total == 420 and len(few.pair) == 4 and few.total_pairs == 400
    assert few.n(few.ids(np.array([X._code("alpha"), X._code("odda")]))).tolist() == [100.0, 420 / 20 / 2]
    tokens.unpersist()


def test_page_scores_show_pmi_and_repetition(spark):
    docs = [(1, "cheap shoes " * 20, None), (2, None, None), (3, "", None), (4, "one two", None)]
    got = {r.doc_id: r for r in X.page_scores(spark.createDataFrame(docs, "doc_id bigint, text string, score string")).collect()}
    assert set(got) == {1, 4} and got[1].repeated > 0.9 and got[1].n_words == 40 and got[4].score == 0


def test_scores_do_not_depend_on_which_words_and_pairs_are_heads(spark, monkeypatch):
    rng = random.Random(8)
    honest = [f"we came to the {rng.choice(['inn', 'bar', 'pier'])} and my {rng.choice(['brother', 'aunt'])} said the odd{k} soup was warm, so we stayed for hours" for k in range(60)]
    keys = ["cheap pizza", "car wash", "nail salon", "dentist near me"]
    stuffed = [" ".join(f"{rng.choice(keys)} town{k} code{chr(97 + k)}{chr(97 + j % 9)}" for j in range(30)) for k in range(12)]
    docs = spark.createDataFrame([*enumerate([*honest, *stuffed, "lone", "", None, stuffed[0]])], "doc_id bigint, text string").repartition(3)

    def run():
        return sorted((r.doc_id, r.n_words, round(r.mean_pmi, 9), round(r.repeated, 9), round(r.share, 6), round(r.score, 6)) for r in X.page_scores(docs).collect())

    whole = run()
    assert len(whole) == 74 and {i for i, *_, s in whole if s > 0.5} == {*range(60, 72), 75}
    for heads, pairs in [(20, 1 << 21), (1 << 20, 20), (1, 1)]:
        monkeypatch.setattr(X, "HEADS", heads)
        monkeypatch.setattr(X, "HEAD_PAIRS", pairs)
        assert run() == whole
