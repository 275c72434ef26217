"""All similar pairs of sets by metric pivot partitioning under Jaccard distance; exact.

Records (sets of 64-bit hashed members, equal sets folded into one class) are assigned to cells around pivots:

1. Pivots come from the records themselves. Rounds of sampling with growing rates pick pivots; a record within
   half the distance limit of a sampled pivot joins the cell of its nearest one and leaves the
   pool, so dense regions are covered by few pivots. What no pivot covers becomes a pivot with a cell of its own.
2. A record z must meet cell q (radius r_q, the largest distance of its members) only if d(z, q) <= limit + r_q: by the
   triangle inequality no member of q can otherwise be near enough. Those cells get a replica of z. A pair is met in
   the smaller of its two home cells only.
3. Within a cell pairs are decided exactly. The triangle inequality saves most work there too: two records with
   d(y, q) + d(z, q) <= limit are similar without looking, with |d(y, q) - d(z, q)| > limit they aren't.

Distances to pivots are found by an inverted index with prefix bounds: ordered from rare to frequent, two sets with
similarity >= s share one of their first |x| - ceil(s |x|) + 1 members. The size bound (s |x| <= |y|) and the position bound
discard a meeting before it is shuffled. Members come in bounded chunks (``CHUNK``), so a set of millions of
members is intersected chunk by chunk. Nothing is capped or sampled away; sampling only places pivots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import clean_key, written

CHUNK = 4096
LARGE = 1 << 17  # members above which a set is ordered by several tasks
RATES = (64, 8)  # one in so many records is tried as a pivot, round by round


def sets_of(df: DataFrame, record: str, member: str) -> DataFrame:
    """Distinct (id, m); m is the hash of the trimmed member key."""
    rows = df.select(clean_key(record).alias("id"), clean_key(member).alias("k")).where("id is not null and k is not null")
    return rows.select("id", F.xxhash64("k").alias("m")).distinct()


def _need(n: Column, s: float) -> Column:
    """Members x must share with any set of similarity >= s: ceil(s n), safe against rounding of s n."""
    return F.ceil(n * F.lit(s) - 1e-9)


def _prefix(n: Column, s: float) -> Column:
    return n - _need(n, s) + 1


class _Sets:
    """Classes of equal sets: ``members`` (id, c, n), ``tokens`` (c, n, m, pos by rising frequency, w_i), ``chunks`` (c, n, mod, chunk, ms).

    w_i is the order of the last prefix member for the i-th of the similarities asked for.
    """

    def __init__(self, rows: DataFrame, least: int, sims: list[float], apart: float) -> None:
        rows = written(rows, "sets")
        prints = rows.groupBy("id").agg(F.count("*").alias("n"), F.bit_xor("m").alias("x1"), F.bit_xor(F.xxhash64("m", F.lit(7))).alias("x2")).where(F.col("n") >= least)
        self.members = written(prints.select("id", F.xxhash64("n", "x1", "x2").alias("c"), "n"), "classes")
        first = self.members.groupBy("c", "n").agg(F.min("id").alias("id"))
        # a set with no other of a size within the threshold has no partner; there are at most sqrt(2 rows) distinct sizes
        by_size = Window.orderBy("n")
        sizes = first.groupBy("n").agg(F.count("*").alias("k")).select("n", "k", F.lag("n").over(by_size).alias("lo"), F.lead("n").over(by_size).alias("hi"))
        company = sizes.where((F.col("k") > 1) | (F.col("lo") >= F.col("n") * apart - 1e-9) | (F.col("n") >= F.col("hi") * apart - 1e-9)).select("n")
        reps = rows.join(first.join(company, "n"), "id").select("c", "n", "m")
        freq = reps.groupBy("m").agg(F.count("*").alias("f"))
        # order of members: rare first; the low hash bits break ties
        ordered = reps.join(freq, "m").withColumn("o", F.shiftleft(F.col("f"), 32) + F.col("m").bitwiseAND(F.lit(0xFFFFFFFF)))
        self.sims = sims
        small, big = ordered.where(F.col("n") <= LARGE), ordered.where(F.col("n") > LARGE)
        w = Window.partitionBy("c")
        small = small.withColumn("pos", F.row_number().over(w.orderBy("o", "m")))
        small = small.select("c", "n", "m", "pos", *[F.max(self._last(s)).over(w).alias(f"w{i}") for i, s in enumerate(sims)])
        self.tokens = written(small.unionByName(self._spread(written(big, "large"))), "tokens")
        mod = F.expr(f"shiftleft(1, cast(greatest(0, floor(log2(n / {CHUNK}))) as int))")
        parts = self.tokens.select("c", "n", "m", mod.alias("mod"), F.pmod(F.col("m"), mod).cast("int").alias("chunk"))
        self.chunks = written(parts.groupBy("c", "n", "mod", "chunk").agg(F.collect_list("m").alias("ms")), "chunks")

    @staticmethod
    def _last(s: float) -> Column:
        return F.when(F.col("pos") <= _prefix(F.col("n"), s), F.col("o"))

    def _spread(self, big: DataFrame) -> DataFrame:
        """Positions in sets of more than ``LARGE`` members, whose members no task holds all: ranked by ranges, ranges by their sizes."""
        ranged = written(big.repartitionByRange("c", "o", "m").withColumn("p", F.spark_partition_id()), "large-ranges")
        local = ranged.withColumn("r", F.row_number().over(Window.partitionBy("c", "p").orderBy("o", "m")))
        sizes = ranged.groupBy("c", "p").agg(F.count("*").alias("k"))
        before = sizes.select("c", "p", F.coalesce(F.sum("k").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = written(local.join(before, ["c", "p"]).select("c", "n", "m", "o", (F.col("r") + F.col("before")).cast("int").alias("pos")), "large-places")
        ends = placed.groupBy("c").agg(*[F.max(self._last(s)).alias(f"w{i}") for i, s in enumerate(self.sims)])
        return placed.join(ends, "c").select("c", "n", "m", "pos", *[f"w{i}" for i in range(len(self.sims))])

    def meetings(self, left: DataFrame, right: DataFrame, sim: int) -> DataFrame:
        """Distinct (a, b), a from left and b from right, that may reach the similarity ``sims[sim]``.

        Sizes and positions are tested at every meeting of two prefixes; of a pair's meetings the number counts: the
        set whose prefix ends first has all it shares within that prefix among them.
        """
        s, n = self.sims[sim], F.col("n")
        inside = F.col("pos") <= _prefix(n, s)
        l = left.where(inside).select("m", F.col("c").alias("a"), n.alias("na"), F.col("pos").alias("pa"), F.col(f"w{sim}").alias("wa"))
        r = right.where(inside).select("m", F.col("c").alias("b"), n.alias("nb"), F.col("pos").alias("pb"), F.col(f"w{sim}").alias("wb"))
        need = (F.col("na") + F.col("nb")) * (s / (1 + s)) - 1e-9
        most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        met = l.join(r, "m").where((F.col("a") != F.col("b")) & (F.col("na") >= F.col("nb") * s - 1e-9) & (F.col("nb") >= F.col("na") * s - 1e-9) & (most >= need))
        met = met.groupBy("a", "b").agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("na", "nb", "wa", "wb")])
        after_a, after_b = _need(F.col("na"), s) - 1, _need(F.col("nb"), s) - 1
        rest = F.when(F.col("wa") < F.col("wb"), after_a).when(F.col("wa") > F.col("wb"), after_b).otherwise(F.greatest(after_a, after_b))
        return met.where(F.col("k") + rest >= need).select("a", "b")

    def jaccard(self, pairs: DataFrame) -> DataFrame:
        """Exact distances of (a, b, …) pairs of classes: adds na, nb, inter. Finer chunks of one meet the coarser chunk of the other."""
        ca = self.chunks.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("mod").alias("ma"), F.col("chunk").alias("ka"), F.col("ms").alias("xs"))
        cb = self.chunks.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("mod").alias("mb"), F.col("chunk").alias("kb"), F.col("ms").alias("ys"))
        keep = [c for c in pairs.columns]
        j = pairs.join(ca, "a").join(cb, "b").where((F.col("ma") == F.col("mb")) & (F.col("ka") == F.col("kb")) | (F.col("ma") > F.col("mb")) & (F.pmod("ka", "mb") == F.col("kb")) | (F.col("ma") < F.col("mb")) & (F.pmod("kb", "ma") == F.col("ka")))
        return j.select(*keep, "na", "nb", F.size(F.array_intersect("xs", "ys")).alias("i")).groupBy(*keep, "na", "nb").agg(F.sum("i").alias("inter"))


def _distance() -> Column:
    return 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))


def cell_radius(limit: float) -> float:
    """Half the limit, or less where limit + radius would leave nothing to share."""
    return min(limit / 2, (1 - limit) / 2)


class PivotCells:
    """Home cells: ``home`` (c, q, d) of every class that has company in size."""

    def __init__(self, sets: _Sets, limit: float) -> None:
        self.sets, self.limit = sets, limit
        self.radius = radius = cell_radius(limit)
        pool, homes = sets.tokens, None
        for k, rate in enumerate(RATES):
            drawn = F.pmod(F.xxhash64(F.col("c"), F.lit(k)), F.lit(rate)) == 0
            # a sampled pivot stays a pivot; the rest of the pool looks for the nearest one
            near = sets.jaccard(sets.meetings(pool.where(~drawn), pool.where(drawn), 0)).select("a", "b", _distance().alias("d")).where(F.col("d") <= radius + 1e-12)
            got = written(near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.col("a").alias("c"), F.col("x.b").alias("q"), F.col("x.d").alias("d")), "homes")
            used = got.select(F.col("q").alias("c")).distinct().select("c", F.col("c").alias("q"), F.lit(0.0).alias("d"))
            own = got.unionByName(used)
            homes = own if homes is None else homes.unionByName(own)
            pool = pool.join(own.select("c"), "c", "left_anti")
        rest = pool.where("pos = 1").select("c", F.col("c").alias("q"), F.lit(0.0).alias("d"))
        self.home = written(homes.unionByName(rest), "home")

    def visits(self) -> DataFrame:
        """Replicas (z, q, radius, d): cells a class must meet by the triangle bound, of those before its own."""
        t = self.sets.tokens
        cells = self.home.groupBy("q").agg(F.max("d").alias("radius")).withColumnRenamed("q", "c")
        wide = cells.where("radius > 0")
        lone = t.join(wide.select("c"), "c", "left_anti").join(self.home.where("c = q").select("c"), "c", "left_semi")
        # lone pivots need similarity 1 - limit; cells with members what is left of it for their radius
        met = self.sets.meetings(t, lone, 1).withColumn("radius", F.lit(0.0))
        met = met.unionByName(self.sets.meetings(t, t.join(wide.select("c"), "c", "left_semi"), 2).join(wide.withColumnRenamed("c", "b"), "b").select("a", "b", "radius"))
        mine = self.home.select(F.col("c").alias("a"), F.col("q").alias("hq"))
        met = met.join(mine, "a").where("b < hq").select("a", "b", "radius")
        d = self.sets.jaccard(met).select(F.col("a").alias("z"), F.col("b").alias("q"), "radius", "na", "nb", "inter", _distance().alias("d"))
        return written(d.where(F.col("d") <= self.limit + F.col("radius") + 1e-12), "visits")

    def similar(self, num: int, den: int) -> DataFrame:
        """Distinct pairs (a < b) of classes with |a n b| / |a u b| >= num/den, decided in integers."""
        sure = (F.col("na") + F.col("nb") - F.col("inter")) * num <= F.col("inter") * den
        visits = self.visits()
        direct = visits.where(sure).select(F.col("z").alias("a"), F.col("q").alias("b"))  # with the pivot itself
        guests = self.home.where("c != q").select(F.col("c").alias("y"), "q", F.col("d").alias("dy"))
        # members of one cell: each within half the limit of the pivot, hence similar to it, and to each other by the triangle
        with_pivot = guests.select(F.col("y").alias("a"), F.col("q").alias("b"))
        g2 = guests.select(F.col("y").alias("z"), "q", F.col("dy").alias("dz"))
        inside = guests.join(g2, "q").where("y < z").select(F.col("y").alias("a"), F.col("z").alias("b"), "dy", "dz")
        across = guests.join(visits.select("z", "q", F.col("d").alias("dz")), "q").select(F.col("y").alias("a"), F.col("z").alias("b"), "dy", "dz")
        todo = inside.unionByName(across)
        eps = 1e-9
        clear = todo.where(F.col("dy") + F.col("dz") <= self.limit - eps).select("a", "b")
        open_ = todo.where((F.col("dy") + F.col("dz") > self.limit - eps) & (F.abs(F.col("dy") - F.col("dz")) <= self.limit + eps)).select("a", "b").distinct()
        judged = self.sets.jaccard(open_).where(sure).select("a", "b")
        pairs = direct.unionByName(with_pivot).unionByName(clear).unionByName(judged)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_classes(df: DataFrame, record: str, member: str, num: int = 1, den: int = 2, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(membership id, c, n; similar pairs of classes a, b) of records whose member sets have Jaccard >= num/den.

    Sets are of trimmed distinct members; rows without either key are ignored, records with fewer than ``least``
    members take no part. Records with equal sets form one class and are all similar to each other. Empty tables
    give empty results; repeated rows change nothing; a threshold of 0 is refused.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    limit = 1 - num / den
    sims = [1 - cell_radius(limit), 1 - limit, 1 - limit - cell_radius(limit)]
    sets = _Sets(sets_of(df, record, member), least, sims, 1 - limit)
    return sets.members, PivotCells(sets, limit).similar(num, den)


def similar_pairs(df: DataFrame, record: str, member: str, num: int = 1, den: int = 2, least: int = 1) -> DataFrame:
    """All pairs id_1 < id_2 of records, copies spelt out."""
    members, pairs = similar_classes(df, record, member, num, den, least)
    m = members.select("id", "c")
    l, r = m.select(F.col("id").alias("x"), F.col("c").alias("a")), m.select(F.col("id").alias("y"), F.col("c").alias("b"))
    apart = pairs.join(l, "a").join(r, "b").select("x", "y")
    shared = members.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
    own = m.join(shared, "c")
    equal = own.select("c", F.col("id").alias("x")).join(own.select("c", F.col("id").alias("y")), "c").where("x < y").select("x", "y")
    both = apart.unionByName(equal)
    return both.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))
