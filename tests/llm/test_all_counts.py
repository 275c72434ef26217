from datetime import datetime

import pytest

from minegrid.llm import queries as Q


def test_users_of_several_days_count_once(spark, tmp_path):
    """u1 comes on both days with two apps, so the counts of days or apps don't add up."""
    rows = [("u1", datetime(2020, 1, 1), "a", "x"), ("u1", datetime(2020, 1, 2), "b", "x"), ("u2", datetime(2020, 1, 2), "a", None)]
    spark.createDataFrame(rows, "user_id string, arrived_at timestamp, client_app string, home_city string").write.parquet(f"{tmp_path}/yelp_user.parquet")
    lines = [("2020-01-01", "2020-01-02"), ("2020-01-02", "2020-01-05"), ("2020-02-01", "2020-02-02"), (None, "2020-01-01")]
    spark.createDataFrame(lines, "day_from string, day_to string").write.parquet(f"{tmp_path}/task2.parquet")
    out = Q.QUERIES["p4_all_counts"](spark, str(tmp_path)).collect()
    got = {(r.kind, r.day_from, r.day_to, r.client_app, r.home_city): r.n for r in out}
    assert len(got) == len(out)
    whole = {(None, None): 2, ("a", None): 2, ("b", None): 1, (None, "x"): 1, ("a", "x"): 1, ("b", "x"): 1}
    assert {k[3:]: n for k, n in got.items() if k[0] == "all"} == whole
    assert {k[3:]: n for k, n in got.items() if k[:3] == ("run", "2020-01-01", "2020-01-02")} == whole
    assert {k[3:]: n for k, n in got.items() if k[:3] == ("run", "2020-01-02", "2020-01-05")} == {(None, None): 2, ("a", None): 1, ("b", None): 1, (None, "x"): 1, ("b", "x"): 1}
    assert {k[1] for k in got if k[0] == "run"} == {"2020-01-01", "2020-01-02"} and got[("day", "2020-01-01", "2020-01-01", None, None)] == 1
    assert all(r.max_error == pytest.approx(r.n * (r.n - 1) / 2**65) for r in out)
