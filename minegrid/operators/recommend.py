"""Rating prediction: item neighbourhoods, features for boosted trees, blends and their search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attribute_score, clamp, list_length, number_at, total, years_until
from ..util import clean_key, scope, tidy, written


def ratings(df: DataFrame, user: str, item: str, stars: str, order: str) -> DataFrame:
    """One rating per (user, item): the last by ``order``; rows without a key or stars left out."""
    r = df.select(clean_key(user).alias("user"), clean_key(item).alias("item"), F.col(stars).cast("double").alias("stars"), F.col(order).alias("o"))
    return r.where("user is not null and item is not null and stars is not null").groupBy("user", "item").agg(F.max_by("stars", "o").alias("stars"))


def means(train: DataFrame, key: str) -> DataFrame:
    return train.groupBy(key).agg(F.avg("stars").alias(f"{key}_mean"), F.count("*").alias(f"{key}_n"))


def item_similarity(train: DataFrame, pairs: DataFrame | None = None, places: int = 9) -> DataFrame:
    """(i, j, sim, raters) for i < j that share a rater: deviations from each item's overall mean, over common raters; 0 if one doesn't vary.

    With ``pairs`` (i < j) only those are computed: the rarer item of a pair brings its raters and looks them up in the
    other, so a popular item costs no more than its partners.
    """
    im = means(train, "item")
    dev = train.join(im, "item").select("item", "user", (F.col("stars") - F.col("item_mean")).alias("d"), F.col("item_n").alias("n"))
    if pairs is None:
        a, b = dev.select("user", F.col("item").alias("i"), F.col("d").alias("x")), dev.select("user", F.col("item").alias("j"), F.col("d").alias("y"))
        co = a.join(b, "user").where("i < j")
    else:
        n = im.select("item", "item_n")
        p = pairs.join(n.select(F.col("item").alias("i"), F.col("item_n").alias("ni")), "i").join(n.select(F.col("item").alias("j"), F.col("item_n").alias("nj")), "j")
        small = F.when(F.col("ni") <= F.col("nj"), F.col("i")).otherwise(F.col("j"))
        p = p.select(small.alias("s"), F.when(small == F.col("i"), F.col("j")).otherwise(F.col("i")).alias("l"))
        d = dev.select("item", "user", "d")
        co = p.join(d.select(F.col("item").alias("s"), "user", F.col("d").alias("x")), "s").join(d.select(F.col("item").alias("l"), "user", F.col("d").alias("y")), ["l", "user"])
        co = co.select(F.least("s", "l").alias("i"), F.greatest("s", "l").alias("j"), "x", "y")
    den = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    s = co.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("num"), den.alias("den"), F.count("*").alias("raters"))
    return s.select("i", "j", (F.round(F.when(F.col("den") > 1e-12, F.col("num") / F.col("den")).otherwise(0.0), places) + F.lit(0.0)).alias("sim"), "raters")


#: Entries of raters' lists that one task takes at once.
ENTRIES = 250_000


def _coded(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written with numbers for names: items (item, item_mean, item_n, code; codes sort as the items do), the distinct test pairs (q, user, item, …) and the ratings (user, code, n, stars, d: off the item's mean)."""
    items = written(means(train, "item").orderBy("item").withColumn("code", F.monotonically_increasing_id()), "item-codes")
    t = written(test.select("user", "item").distinct().join(items, "item", "left").withColumn("q", F.monotonically_increasing_id()), "targets")
    dev = train.join(items, "item").select("user", "code", F.col("item_n").alias("n"), "stars", (F.col("stars") - F.col("item_mean")).alias("d"))
    dev = written(dev, "deviations")
    tidy(dev.sparkSession)
    return items, t, dev


def _sums(lists: pa.Table, rated: pa.Table) -> pa.Table:
    """The rows of ``rated`` whose pair (a, b) has a common rater, with the sums over these; ``lists`` has for a rating of a what its rater gave to more popular items."""
    names = ["q", "code", "stars", "num", "xx", "yy", "raters"]
    ra, rb = rated["a"].to_numpy(), rated["b"].to_numpy()
    lists = lists.filter(pa.array(np.isin(lists["a"].to_numpy(), ra)))
    if not lists.num_rows:
        return pa.table([rated[c].slice(0, 0) for c in names[:3]] + [pa.array([], pa.float64())] * 3 + [pa.array([], pa.int64())], names)
    ua, pa_at = np.unique(ra, return_inverse=True)
    ub, pb_at = np.unique(rb, return_inverse=True)
    pairs, at = np.unique(pa_at * len(ub) + pb_at, return_inverse=True)
    held = lists["bs"].combine_chunks()
    k = held.value_lengths().to_numpy()
    b, y = held.flatten().to_numpy(), lists["ys"].combine_chunks().flatten().to_numpy()
    ib = np.minimum(np.searchsorted(ub, b), len(ub) - 1)
    key = np.repeat(np.searchsorted(ua, lists["a"].to_numpy()), k) * len(ub) + ib
    place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    use = np.flatnonzero((ub[ib] == b) & (pairs[place] == key))
    x, y, place = np.repeat(lists["x"].to_numpy(), k)[use], y[use], place[use]
    n = np.bincount(place, minlength=len(pairs))
    num, xx, yy = (np.bincount(place, w, len(pairs)) for w in (x * y, x * x, y * y))
    met = np.flatnonzero(n[at] > 0)
    at = at[met]
    return pa.table([rated[c].take(pa.array(met)) for c in names[:3]] + [pa.array(z[at]) for z in (num, xx, yy, n)], names)


def _near(t: DataFrame, dev: DataFrame, top: int, list_cost: float = 0.25) -> DataFrame:
    """(q, code, stars, sim, rank), written: of the user's rated items that share a rater with the target, the ``top`` most similar; ties by item.

    Every rating of an item goes, with what its rater gave to more popular items, to the task that has the wanted pairs with
    that item as the rarer one, and is summed up there. Only where users with very many ratings make these lists longer than
    a look-up of the raters of every wanted pair (counted first; an entry costs ``list_cost`` of a look-up) the raters are looked up.
    """
    mine, n = t.where("code is not null").select("user", "q", F.col("code").alias("c"), F.col("item_n").alias("m")), F.col("n")
    rated = mine.join(dev.select("user", "code", "n", "stars"), "user").where("c != code")
    rarer = (F.col("m") < n) | ((F.col("m") == n) & (F.col("c") > F.col("code")))
    rated = rated.select("q", "code", "stars", F.when(rarer, F.col("c")).otherwise(F.col("code")).alias("a"), F.when(rarer, F.col("code")).otherwise(F.col("c")).alias("b"), F.least("m", "n").alias("few"))
    rated = written(rated, "rated")
    tidy(rated.sparkSession)
    looks = rated.agg(F.sum("few")).first()[0] or 0
    k = F.col("k").cast("double")
    entries = dev.groupBy("user").agg(F.count("*").alias("k")).agg(F.sum(k * (k - 1) / 2)).first()[0] or 0
    if entries * list_cost <= looks:
        parts = max(1, int(entries / ENTRIES))
        part = F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part")
        given = dev.groupBy("user").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "code", "d"))).alias("x")).where(F.size("x") > 1)
        given = given.select(F.col("x.code").alias("i"), F.col("x.d").alias("y"), F.explode(F.sequence(F.lit(1), F.size("x") - 1)).alias("at"))
        lists = given.select(F.col("i")[F.col("at")].alias("a"), F.col("y")[F.col("at")].alias("x"), F.slice("i", F.lit(1), F.col("at")).alias("bs"), F.slice("y", F.lit(1), F.col("at")).alias("ys"))
        both = lists.select(part, "*").groupBy("part").cogroup(rated.select(part, "q", "code", "stars", "a", "b").groupBy("part"))
        s = both.applyInArrow(_sums, "q bigint, code bigint, stars double, num double, xx double, yy double, raters bigint")
        den = F.sqrt("xx") * F.sqrt("yy")
        s = s.select("q", "code", "stars", (F.round(F.when(den > 1e-12, F.col("num") / den).otherwise(0.0), 9) + F.lit(0.0)).alias("sim"))
    else:
        r = rated.select("q", "code", "stars", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
        sim = item_similarity(dev.select("user", F.col("code").alias("item"), "stars"), r.select("i", "j").distinct())
        s = r.join(sim.select("i", "j", "sim"), ["i", "j"]).select("q", "code", "stars", "sim")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "code")
    return written(s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top), "near")


def neighbours(train: DataFrame, test: DataFrame, top: int = 20) -> DataFrame:
    """(user, item, other, stars, sim, rank): of the user's rated items that share a rater with the target, the ``top`` most similar; ties by item."""
    items, t, dev = _coded(train, test)
    with scope(keep=1):
        near = _near(t, dev, top)
    named = near.join(t.select("q", "user", "item"), "q").join(items.select("code", F.col("item").alias("other")), "code")
    return named.select("user", "item", "other", "stars", "sim", "rank")


def item_cf(train: DataFrame, test: DataFrame, top: int = 20, places: int = 6) -> DataFrame:
    """(user, item, prediction) of the distinct test pairs.

    Unknown item: the user's mean; unknown user: the item's; both unknown: the global mean; a user who rated only this
    item: that rating; no weight among the neighbours: the mean of both means; else
    0.1 weighted neighbours + 0.5 item mean + 0.4 user mean, kept in [0, 5].
    """
    _, t, dev = _coded(train, test)
    with scope(keep=1):
        near = _near(t, dev, top)
    nb = near.groupBy("q").agg(F.sum(F.col("stars") * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den"))
    own = dev.select("user", "code", F.col("stars").alias("own"))
    x = t.join(means(dev, "user"), "user", "left").join(nb, "q", "left").join(own, ["user", "code"], "left")
    x = x.join(F.broadcast(train.agg(F.avg("stars").alias("all_mean"))))  # one row
    um, im = F.col("user_mean"), F.col("item_mean")
    p = (
        F.when(um.isNull() & im.isNull(), F.col("all_mean")).when(im.isNull(), um).when(um.isNull(), im)
        .when((F.col("user_n") == 1) & F.col("own").isNotNull(), F.col("own"))
        .when(F.coalesce("den", F.lit(0.0)) == 0, (im + um) / 2)
        .otherwise(clamp(0.1 * F.col("num") / F.col("den") + 0.5 * im + 0.4 * um, 0.0, 5.0))
    )
    return x.select("user", "item", F.round(p, places).alias("prediction"))


def user_features(users: DataFrame, order: str, train: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Per user (last delivery by ``order``): counts, means, list lengths, years, compliments, spread of their stars, tip likes."""
    compliments = [c for c in users.columns if c.startswith("compliment_")]
    u = users.select(
        clean_key("user_id").alias("user"), F.col(order).alias("o"), F.col("review_count").cast("double").alias("user_reviews"), F.col("fans").cast("double").alias("fans"), F.col("average_stars").alias("user_stars"),
        list_length(F.col("friends")).cast("double").alias("friends"), total(["useful", "funny", "cool"]).cast("double").alias("social"), years_until(F.col("yelping_since")).cast("double").alias("years"),
        list_length(F.col("elite")).cast("double").alias("elite"), total(compliments).cast("double").alias("compliments"),
    ).where("user is not null")
    cols = [c for c in u.columns if c not in ("user", "o")]
    last = u.groupBy("user").agg(F.max_by(F.struct(*cols), "o").alias("x")).select("user", "x.*")
    out = last.join(train.groupBy("user").agg(F.var_pop("stars").alias("user_var")), "user", "left")
    if tips is not None:
        out = out.join(tips.groupBy(clean_key("user_id").alias("user")).agg(F.sum("likes").cast("double").alias("user_likes")), "user", "left")
    else:
        out = out.withColumn("user_likes", F.lit(0.0))
    return out.na.fill(0.0, ["user_var", "user_likes"])


def business_features(business: DataFrame, order: str, train: DataFrame, photos: DataFrame | None = None, checkins: DataFrame | None = None, tips: DataFrame | None = None) -> DataFrame:
    """Per business (last listing): stars, reviews, price range, attribute score, spread of its stars, non-menu photos, check-in slots, tip likes."""
    b = business.select(
        clean_key("business_id").alias("item"), F.struct(order, F.xxhash64(*[c for c in business.columns if c not in (order, "attributes")])).alias("o"), F.col("stars").alias("item_stars"), F.col("review_count").cast("double").alias("item_reviews"),
        number_at(F.col("attributes"), "RestaurantsPriceRange2").alias("price"), attribute_score(F.col("attributes")).cast("double").alias("score"),
    ).where("item is not null")
    cols = [c for c in b.columns if c not in ("item", "o")]
    out = b.groupBy("item").agg(F.max_by(F.struct(*cols), "o").alias("x")).select("item", "x.*")
    out = out.join(train.groupBy("item").agg(F.var_pop("stars").alias("item_var")), "item", "left")
    key = clean_key("business_id").alias("item")
    extra = {
        "photos": photos.where(~F.col("label").eqNullSafe("menu")).groupBy(key).agg(F.count("*").cast("double").alias("photos")) if photos is not None else None,
        "slots": checkins.groupBy(key).agg(F.max(F.size("time")).cast("double").alias("slots")) if checkins is not None else None,
        "item_likes": tips.groupBy(key).agg(F.sum("likes").cast("double").alias("item_likes")) if tips is not None else None,
    }
    for c, df in extra.items():
        out = out.join(df, "item", "left") if df is not None else out.withColumn(c, F.lit(0.0))
    return out.na.fill(0.0, ["item_var", *extra])


#: Features whose default for unknown keys is the global mean over the feature table; all others default to 0.
MEAN_DEFAULTS = ("user_reviews", "fans", "user_stars", "friends", "social", "item_stars", "item_reviews", "price")


def assemble(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with both sides' features; unknown users and items get global means or 0."""
    out = pairs
    for side, key in ((users, "user"), (items, "item")):
        cols = [c for c in side.columns if c != key]
        m = [c for c in cols if c in MEAN_DEFAULTS]
        out = out.join(side, key, "left")
        if m:
            out = out.join(F.broadcast(side.agg(*[F.avg(c).alias(f"_{c}") for c in m])))  # one row
        if cols:
            out = out.withColumns({c: F.coalesce(c, F.col(f"_{c}") if c in m else F.lit(0.0), F.lit(0.0)) for c in cols}).drop(*[f"_{c}" for c in m])
    return out


NOT_FEATURES = ("user", "item", "stars", "prediction")


def fit_trees(train: DataFrame, features: Sequence[str], label: str = "stars", depth: int = 5, rounds: int = 20, step: float = 0.1, subsample: float = 0.8, subset: str = "0.4", seed: int = 0):
    """Gradient-boosted regression trees on the named columns (a fitted pipeline; ``transform`` adds ``prediction``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="vector", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=subset, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="vector", handleInvalid="keep"), gbt]).fit(train)


def predict_trees(model, pairs: DataFrame) -> DataFrame:
    return model.transform(pairs).select("user", "item", "prediction")


def blend(model: DataFrame, items: DataFrame, weight: float = 0.97) -> DataFrame:
    """weight * model + (1 - weight) * item neighbourhood, for pairs both predict."""
    j = model.withColumnRenamed("prediction", "m").join(items.withColumnRenamed("prediction", "i"), ["user", "item"])
    return j.select("user", "item", (F.col("m") * weight + F.col("i") * (1 - weight)).alias("prediction"))


def search_blend(model: DataFrame, items: DataFrame, truth: DataFrame, low: float = 0.8, high: float = 1.0, steps: int = 20) -> DataFrame:
    """(weight, rmse) over an even grid, in one pass: the squared error is a quadratic in the weight; best first."""
    j = model.withColumnRenamed("prediction", "m").join(items.withColumnRenamed("prediction", "i"), ["user", "item"]).join(truth.select("user", "item", F.col("stars").alias("y")), ["user", "item"])
    e, d = F.col("i") - F.col("y"), F.col("m") - F.col("i")
    s = j.agg(F.avg(e * e).alias("c"), F.avg(2 * e * d).alias("b"), F.avg(d * d).alias("a"))
    w = F.explode(F.array(*[F.lit(low + (high - low) * k / (steps - 1)) for k in range(steps)])).alias("weight")
    g = s.select(w, "a", "b", "c")
    return g.select("weight", F.sqrt(F.greatest(F.lit(0.0), F.col("a") * F.col("weight") ** 2 + F.col("b") * F.col("weight") + F.col("c"))).alias("rmse")).orderBy("rmse", "weight")


def tune(train: DataFrame, features: Sequence[str], grid: dict[str, list], folds: int = 5, label: str = "stars", seed: int = 0):
    """Cross-validated grid search over tree parameters; the fitted CrossValidatorModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    gbt = GBTRegressor(featuresCol="vector", labelCol=label, seed=seed)
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(gbt.getParam(k), v)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="vector", handleInvalid="keep"), gbt])
    return CrossValidator(estimator=pipe, estimatorParamMaps=b.build(), evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(train)


def eliminate(train: DataFrame, held_out: DataFrame, features: Sequence[str], least: int = 1, **params) -> list[tuple[list[str], float]]:
    """Recursive feature elimination: drops the least important feature each round; (features, held-out rmse) per round."""
    from pyspark.ml.evaluation import RegressionEvaluator

    left, out = list(features), []
    while len(left) >= least:
        m = fit_trees(train, left, **params)
        out.append((list(left), RegressionEvaluator(labelCol="stars").evaluate(m.transform(held_out))))
        if len(left) == 1:
            break
        imp = m.stages[-1].featureImportances.toArray()
        left.pop(int(imp.argmin()))
    return out
