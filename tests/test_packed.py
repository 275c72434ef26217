from hypothesis import given, settings
from hypothesis import strategies as st

from minegrid.operators.packed import _kind, _open, _sig_kind, _value, best_reading, by_rule, checked, explode_packed, learn, reading_report, signature, tokens, unwrapped
from minegrid.util import WHITE


def items(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, f string, s string, item string")
    return sorted(tuple(r) for r in explode_packed(df, "id", ["f"], **kw).collect())


def test_delimiters_quotes_and_empty_slots(spark):
    rows = [
        (1, '["a,b"; c ;NULL;]', None, "x"), (2, ", -x", None, None), (3, '"say ""hi"" now" | \'it\'\'s\'', None, None), (4, "None", None, None), (5, None, None, None), (6, "  ", None, None), (7, "[]", None, None),
        (8, "a  b\tc", None, None), (9, "a/b , c", None, None), (10, '""', None, None), (11, '"None"', None, None), (12, "a_b-c", None, None), (1, "z", None, None),
    ]
    got = [(i, p, v) for i, _, p, v in items(spark, rows)]
    assert got == sorted([(1, 1, "a,b"), (1, 2, "c"), (1, 1, "z"), (2, 2, "-x"), (3, 1, 'say "hi" now'), (3, 2, "it's"), (8, 1, "a"), (8, 2, "b"), (8, 3, "c"), (9, 1, "a"), (9, 2, "b"), (9, 3, "c"), (10, 1, ""), (11, 1, "None"), (12, 1, "a_b-c")])


def test_quoted_slots_after_blank_tab_and_line_end(spark):
    rows = [(1, 'a "b c" d', None, None), (2, "a\t'b, c'\td", None, None), (3, 'a\n"b | ""c"""', None, None), (4, 'a "b', None, None), (5, "O'Brien, x", None, None)]
    got = [(i, p, v) for i, _, p, v in items(spark, rows)]
    assert got == [(1, 1, "a"), (1, 2, "b c"), (1, 3, "d"), (2, 1, "a"), (2, 2, "b, c"), (2, 3, "d"), (3, 1, "a"), (3, 2, 'b | "c"'), (4, 1, "a"), (4, 2, "b"), (5, 1, "O"), (5, 2, "Brien"), (5, 3, "x")]


def test_empty_table_and_long_text(spark):
    assert items(spark, []) == []
    got = items(spark, [(1, ";".join(f"v{k}" for k in range(20000)), None, None)])
    assert len(got) == 20000 and max(p for _, _, p, _ in got) == 20000


def closes(t, i):
    j = i + 1
    while j < len(t) and (t[j] != t[i] or t[j : j + 2] == t[i] * 2):
        j += 2 if t[j] == t[i] else 1
    return j if j < len(t) else 0


def by_characters(text):
    """The rule read one character at a time."""
    t, out, cur, i = unwrapped(text), [], None, 0
    while True:
        if cur is None:
            cur = ""
            if i < len(t) and t[i] in "\"'" and (j := closes(t, i)):
                cur, i = t[i : j + 1], j + 1
        if i >= len(t):
            return [*out, cur]
        if t[i].isalnum() or t[i] in "-_":
            cur, i = cur + t[i], i + 1
            continue
        white = t[i] in WHITE
        while i < len(t) and t[i] in WHITE:
            i += 1
        if not (t[i].isalnum() or t[i] in "-_" or (white and t[i] in "\"'" and closes(t, i))):
            i += 1
            while i < len(t) and t[i] in WHITE:
                i += 1
        out.append(cur)
        cur = None


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1,; |'\"-_\t", max_size=30))
def test_the_rule_reads_as_by_characters(text):
    t = tokens(unwrapped(text))
    assert "".join(t) == unwrapped(text)
    if t:
        assert ["".join(t[i:j]) for i, j, _ in by_rule(t)] == by_characters(text)
        assert by_rule(signature(t, {}).split("\x1f"), _sig_kind) == by_rule(t)


def test_learnt_model_splits_at_every_delimiter_of_the_rule(spark):
    texts = ["abc,def", "abc;ghi", "def ghi", "abc", "ghi|def|abc"] * 20
    heads = {"abc": 0, "def": 1, "ghi": 2}
    df = spark.createDataFrame([(signature(tokens(t), heads), 1) for t in texts], "sig string, n bigint").groupBy("sig").sum("n").toDF("sig", "n")
    m = learn(df, 240)
    for t in texts:
        assert best_reading(signature(tokens(t), heads), m) == by_rule(tokens(t))


def test_without_the_check_frequent_values_keep_blanks(spark):
    rows = [(k, "New York", None, None) for k in range(60)] + [(100 + k, f"v{k} w{k}x, Oslo", None, None) for k in range(20)]
    free = {v for *_, v in items(spark, rows, exact=False, strength=0.0, rounds=5)}
    assert "New York" in free and not free & {"New", "York"}  # the model decides: New and York never stand alone
    assert {v for *_, v in items(spark, rows, strength=0.0, rounds=5)} >= {"New", "York", "Oslo"}  # the check mends
    df = spark.createDataFrame(rows, "id bigint, f string, s string, item string")
    report = reading_report(df, "id", ["f"], 5, 0.0).first()
    assert report["n_strings"] == 80 and report["n_mended"] >= 60


def test_the_rule_as_prior_outweighs_frequencies(spark):
    rows = [(k, "New York", None, None) for k in range(60)]
    assert {v for *_, v in items(spark, rows, exact=False, strength=1e6)} == {"New", "York"}


def test_value_of_a_quoted_span():
    t = tokens('"a ""b"""')
    assert _value(t, by_rule(t)[0]) == 'a "b"'


def test_the_model_decides_where_the_rule_is_silent(spark):
    odd = [(900, "'Ann, Bob, O'Neil", None, None), (901, "'Ann, Bob, ONeil'", None, None)]
    known = [(k, "Ann, Bob, Cid", None, None) for k in range(40)] + [(100 + k, "O'Neil, Ann", None, None) for k in range(20)] + [(200 + k, ", Bob", None, None) for k in range(10)]
    unknown = [(k, f"p{k} q", None, None) for k in range(60)]
    read = lambda rows: [(i, p, v) for i, _, p, v in items(spark, rows + odd) if i >= 900]
    whole = (901, 1, "Ann, Bob, ONeil")
    assert read(known) == [(900, 2, "Ann"), (900, 3, "Bob"), (900, 4, "O"), (900, 5, "Neil"), whole]
    assert read(unknown) == [(900, 1, "'Ann, Bob, O'Neil"), whole]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab,; '\"\t", max_size=16), st.lists(st.tuples(st.integers(0, 16), st.integers(0, 16), st.booleans()), max_size=8))
def test_any_reading_is_mended_where_the_rule_speaks(text, reading):
    t = tokens(unwrapped(text))
    if t:
        got = checked(t, _kind, reading)
        if not any(_open(t, _kind, i) for i in range(len(t))):
            assert got == by_rule(t)
        assert checked(t, _kind, got) == got  # what is right is left as it is
