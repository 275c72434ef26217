from datetime import datetime

from pyspark.sql import functions as F

from minegrid.operators.references import Reference, coded, key_runs, orphan_report, orphans, parent_lives, run_report

T = [datetime(2020, m, 1) for m in range(1, 13)]
PARENT = "id string, seen timestamp, gone timestamp, at timestamp, key string"


def found(spark, rows, parents, integers=False):
    r = spark.createDataFrame(rows, "row_id bigint, ref string, at timestamp, kind string")
    p = spark.createDataFrame(parents, PARENT)
    return {tuple(x) for x in orphans(r, "row_id", F.col("at"), [Reference("ref", p, "id", "seen", "gone")], integers).select("row_id", "ref_column", "kind").collect()}


def test_kinds_nulls_repeats_and_clashing_columns(spark):
    parents = [("a", T[2], None, None, None), (" a ", T[1], T[8], None, None), ("b", None, None, None, "x"), (None, T[0], None, None, None), ("  ", T[0], None, None, None), ("c", T[9], T[3], None, None)]
    rows = [(1, "a", T[0], "x"), (2, "a\t", T[1], None), (3, "a", T[8], None), (4, "b", T[0], None), (5, "zz", None, None), (6, None, T[0], None), (7, " ", T[0], None), (8, "a", None, None), (9, "c", T[5], None), (5, "zz", None, None)]
    assert found(spark, rows, parents) == {(1, "ref", "late"), (3, "ref", "deleted"), (5, "ref", "missing"), (9, "ref", "late"), (9, "ref", "deleted")}


def test_integer_keys_form_runs(spark):
    parents = [(str(k), T[0], None, None, None) for k in [*range(1, 600), *range(1000, 1010), 5000, -3]]
    rows = [(k, str(k), T[3], None) for k in (1, 256, 599, 600, 999, 1000, 1009, 1010, 5000, 5001, -3, -4)] + [(99, "007", T[3], None), (98, "seven", T[3], None)]
    assert {r for r, _, _ in found(spark, rows, parents, True)} == {600, 999, 1010, 5001, -4, 99, 98}
    p = spark.createDataFrame(parents, PARENT)
    lives = parent_lives([Reference("ref", p, "id", "seen", "gone")])
    runs = key_runs(coded(lives, lives.limit(0).select("ref_column", "key"), True)[0])
    assert runs.count() < 20 and runs.agg(F.sum(F.size("members"))).first()[0] == 611


def test_empty_tables_and_report(spark):
    assert found(spark, [], [("a", T[0], None, None, None)]) == set()
    assert found(spark, [(1, "a", T[0], None)], []) == {(1, "ref", "missing")}
    r = spark.createDataFrame([(1, "ref", "missing", T[0]), (2, "ref", "missing", T[0]), (3, "ref", "late", None)], "row_id bigint, ref_column string, kind string, at timestamp")
    assert {tuple(x) for x in orphan_report(r).collect()} == {("ref", "missing", "2020-01", 2), ("ref", "late", None, 1)}


def test_hot_key_is_one_row_before_the_join(spark):
    rows = [(k, "hot" if k % 3 else f"k{k}", T[5], None) for k in range(3000)]
    got = found(spark, rows, [("hot", T[6], None, None, None)])
    assert sum(k == "late" for _, _, k in got) == 2000 and sum(k == "missing" for _, _, k in got) == 1000


def test_text_keys_form_runs_and_orphans_are_gaps(spark):
    parents = [(f"p{k:04d}", T[0], T[8] if k == 77 else None, None, None) for k in range(500) if k not in (100, 300)]
    rows = [(k, f"p{k:04d}", T[3], None) for k in (5, 100, 300, 499, 501)] + [(77, "p0077", T[9], None)]
    assert found(spark, rows, parents) == {(100, "ref", "missing"), (300, "ref", "missing"), (501, "ref", "missing"), (77, "ref", "deleted")}
    r = spark.createDataFrame(rows, "row_id bigint, ref string, at timestamp, kind string")
    p = spark.createDataFrame(parents, PARENT)
    got = run_report(r, [Reference("ref", p, "id", "seen", "gone")]).first()
    assert got.n_parents == 498 and got.n_runs < 30 and got.longest > 30 and got.n_references == 6 and got.n_matched == 3
