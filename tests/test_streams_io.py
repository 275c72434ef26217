import hashlib
import random

from pyspark.sql import functions as F

from minegrid.sources import readers, writers
from minegrid.streaming import live, sketches


def stream(spark, n=500, size=50):
    rng = random.Random(1)
    rows = [(k, f"k{rng.randint(0, 200)}") for k in range(n)]
    return rows, sketches.batches(spark.createDataFrame(rows, "event_id bigint, key string"), ["event_id"], size)


def test_batches_bloom_and_reservoir(spark):
    rows, s = stream(spark)
    assert {r.batch: r["count"] for r in s.groupBy("batch").count().collect()} == dict.fromkeys(range(10), 50)
    # brute force with the same hashes
    from minegrid.functions.scalars import hash_family

    fam, bits, seen, want = hash_family(10, sketches.PRIME), set(), set(), {}
    num = lambda k: int.from_bytes(k.encode(), "big") % sketches.PRIME
    marks = lambda k, m: {(a * num(k) + b) % sketches.PRIME % m for a, b in fam}
    for b in range(10):
        own = [k for _, k in rows[b * 50 : b * 50 + 50]]
        pos = [marks(k, 997) <= bits for k in own]
        fp, neg = sum(p and k not in seen for p, k in zip(pos, own)), sum(not p for p in pos)
        want[b] = (fp, neg)
        assert all(p for p, k in zip(pos, own) if k in seen)  # no false negatives
        for k in own:
            bits |= marks(k, 997)
        seen |= set(own)
    assert {r.batch: (r.fp, r.negatives) for r in sketches.bloom_fpr(s, "key", bits=997).collect()} == want
    snap = {r.batch: r for r in sketches.reservoir_snapshots(s, "key", 20, (0, 7)).collect()}
    draw = lambda t, n: int(hashlib.md5(f"r1{t}:{n}".encode()).hexdigest()[:12], 16)
    slots = {}
    for n, (_, k) in enumerate(rows, 1):
        if n <= 20:
            slots[n - 1] = k
        elif draw("a", n) * n < 20 << 48:
            slots[draw("b", n) % 20] = k
        if n % 50 == 0:
            assert (snap[n // 50 - 1].slot_0, snap[n // 50 - 1].slot_7, snap[n // 50 - 1].seq) == (slots[0], slots[7], n)
    assert sketches.fm_estimates(s, "key").count() == 10 and sketches.bottom_k(s, "event_id", 30).count() == 30


def test_live_streams_equal_batch(spark, tmp_path):
    rows, s = stream(spark, 300, 100)
    df = s.select("event_id", "key", "batch")
    for b in range(3):
        df.where(F.col("batch") == b).drop("batch").coalesce(1).write.parquet(f"{tmp_path}/in/part{b}")
    src = lambda: live.file_stream(spark, f"{tmp_path}/in/*", df.drop("batch").schema)
    bloom, distinct, sample = live.LiveBloom(spark, "key"), live.LiveDistinct("key"), live.LiveSample(spark, "event_id", 25)
    for each in (bloom, distinct, sample):
        live.run_available(src(), each)
    batches = sorted(sketches.bloom_fpr(s, "key").collect(), key=lambda r: r.batch)
    assert [bloom.results[b][:2] for b in range(3)] == [(r.fp, r.negatives) for r in batches]
    assert len(distinct.results) == 3 and all(t > 0 for t, _ in distinct.results.values())
    assert {r.event_id for r in sample.sample().collect()} == {r.event_id for r in sketches.bottom_k(df, "event_id", 25).collect()}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('user_id,business_id,stars\nu1,"b,1",4.5\nu2,b2,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "r.csv"), "rating").collect()] == [("u1", "b,1", 4.5), ("u2", "b2", None)]
    (tmp_path / "t.csv").write_text('"D","C","x","y","z","P"\n"11/1/2000","077","a","b","c","0042"\n')
    assert readers.read_transactions(spark, str(tmp_path / "t.csv")).collect()[0] == ("11/1/2000-077", "42")
    (tmp_path / "v.csv").write_text("7,0,1.5,2.5\n")
    assert readers.read_vectors(spark, str(tmp_path / "v.csv")).collect()[0] == (7, [1.5, 2.5])
    (tmp_path / "b.json").write_text('{"business_id":"b1","attributes":{"A":"True"},"stars":4}\nbroken\n')
    assert readers.read_json(spark, str(tmp_path / "b.json"), "business").where("business_id is not null").first()["attributes"] == {"A": "True"}
    u = readers.read_union(spark, {"x": str(tmp_path / "b.json"), "y": str(tmp_path / "b.json")}, {"x": "business", "y": "photo"})
    assert {r.table_name for r in u.collect()} == {"x", "y"}
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    writers.write_itemset_report(sets, sets.where("size(items) = 1"), str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines == ["Candidates:", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "('a'),('b')", ""]
    writers.write_communities(spark.createDataFrame([(["u2", "u3"],), (["u1"],)], "members array<string>"), str(tmp_path / "com"))
    assert [r.value for r in spark.read.text(str(tmp_path / "com")).collect()] == ["'u1'", "'u2', 'u3'"]
    writers.write_betweenness(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "u string, v string, betweenness double"), str(tmp_path / "bet"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bet")).collect()] == ["('a', 'c'),2.5", "('a', 'b'),1.0"]
    rounds = spark.createDataFrame([(1, 9, 0, 0, 1)], "round int, ds_points bigint, cs_clusters bigint, cs_points bigint, rs_points bigint")
    writers.write_clustering_report(rounds, spark.createDataFrame([(3, 0), (1, -1)], "index bigint, label bigint"), str(tmp_path / "clu"))
    assert [r.value for r in spark.read.text(str(tmp_path / "clu")).collect()] == ["9,0,0,1", "", "1,-1", "3,0"]
    writers.write_json_object(rounds, str(tmp_path / "j"))
    writers.write_csv(rounds, str(tmp_path / "c"), one_file=True)
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
