"""Collaborative filtering, features, models and the hybrid."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.scalar import ratio_or_zero
from quarry.operators import explore, models, neural, recommend
from quarry.plans.registry import query
from quarry.plans.roles import TEST_SQL, TODAY, TRAIN_SQL, kept_ratings, ratings
from quarry.sources.readers import table
from quarry.sources.scratch import cut

_PAIRS = "pairs as (select p.item_id, q.item_id as other, p.stars as x, q.stars as y from train p join train q on p.user_id = q.user_id and p.item_id <> q.item_id)"
_WEIGHTS = """means as (select item_id, other, count(*) as n, avg(x) as mx, avg(y) as my from pairs group by 1, 2 having count(*) >= 5),
  sums as (select item_id, other, n, sum((x - mx) * (y - my)) as xy, sum((x - mx) * (x - mx)) as xx, sum((y - my) * (y - my)) as yy from pairs join means using (item_id, other) group by 1, 2, 3),
  weights as (select item_id, other, n, case when sqrt(xx) * sqrt(yy) > 0 then xy / (sqrt(xx) * sqrt(yy)) else 0.0 end as weight from sums)"""
_NEAR = """asked as (select distinct user_id, item_id from test), cand as (select a.user_id, a.item_id, t.item_id as other, t.stars, w.weight from asked a join train t on a.user_id = t.user_id join weights w on w.item_id = a.item_id and w.other = t.item_id where w.weight <> 0),
  near as (select * from (select *, row_number() over (partition by user_id, item_id order by round(weight, 9) desc, other) as rank from cand) where rank <= 4)"""
_PREDICT = """u as (select user_id, avg(stars) as um from train group by 1), i as (select item_id, avg(stars) as im from train group by 1), g as (select avg(stars) as gm from train),
  cf as (select a.user_id, a.item_id, coalesce(p.w, (um + im) / 2, um, im, gm) as prediction from asked a left join (select user_id, item_id, sum(stars * weight) / sum(abs(weight)) as w from near group by 1, 2) p using (user_id, item_id) left join u using (user_id) left join i using (item_id) cross join g)"""
_CF = f"with {TRAIN_SQL}, {TEST_SQL}, {_PAIRS}, {_WEIGHTS}, {_NEAR}, {_PREDICT}"


@query("item_pearson", f"with {TRAIN_SQL}, {_PAIRS}, {_WEIGHTS} select item_id, other, n::bigint as n, round(weight, 6) + 0.0 as weight from weights")
def item_pearson(spark, d):
    train, _ = kept_ratings(spark, d)
    return recommend.pearson_weights(train).withColumn("weight", F.round("weight", 6) + 0.0)


@query("topn_neighbors", f"with {TRAIN_SQL}, {TEST_SQL}, {_PAIRS}, {_WEIGHTS}, {_NEAR} select user_id, item_id, other, stars, round(weight, 6) as weight, rank::int as rank from near")
def topn_neighbors(spark, d):
    train, test = kept_ratings(spark, d)
    return recommend.neighbours(test, train, recommend.pearson_weights(train, 5, test)).withColumn("weight", F.round("weight", 6))


@query("cf_predict", f"{_CF} select user_id, item_id, round(prediction, 4) as prediction from cf")
def cf_predict(spark, d):
    train, test = kept_ratings(spark, d)
    return recommend.predict(test, train).withColumn("prediction", F.round("prediction", 4))


def _scored(spark, d):
    train, test = kept_ratings(spark, d)
    return recommend.predict(test, train).join(test, ["user_id", "item_id"])


@query("cf_rmse", f"{_CF} select round(sqrt(avg(pow(stars - prediction, 2))), 4) as rmse from cf join test using (user_id, item_id)")
def cf_rmse(spark, d):
    return explore.rmse(_scored(spark, d), "stars", "prediction").withColumn("rmse", F.round("rmse", 4))


@query("error_histogram", f"{_CF} select floor(abs(stars - prediction))::bigint as low, floor(abs(stars - prediction))::bigint + 1 as high, count(*)::bigint as n from cf join test using (user_id, item_id) group by 1")
def error_histogram(spark, d):
    return explore.error_histogram(_scored(spark, d), "stars", "prediction")


_USER = f"""um as (select user_id, user_stars, n, (u_days)::double as days from (select user_id, avg(stars) as user_stars, count(*) as n, datediff('day', min(o_orderdate)::date, date '{TODAY}') as u_days from reviews where o_orderdate < timestamp '2000-06-01' group by 1)),
  user_m as (select user_id, user_stars, n::double as user_reviews, n * 365.0 / (days - (select min(days) from um) + 1) as reviews_per_year from um)"""
_ITEM = "item_m as (select item_id, avg(stars) as item_stars, count(*)::double as item_reviews from train group by 1)"


@query("user_metrics", f"with {TRAIN_SQL}, {_USER} select user_id, round(user_stars, 6) as user_stars, user_reviews, round(reviews_per_year, 6)::double as reviews_per_year from user_m")
def user_metrics(spark, d):
    out = _user_metrics(spark, d)
    return out.select("user_id", F.round("user_stars", 6).alias("user_stars"), "user_reviews", F.round("reviews_per_year", 6).alias("reviews_per_year"))


def _user_metrics(spark, d):
    from quarry.operators.features import user_metrics as metrics
    from quarry.plans.roles import CUTOFF, reviews

    rows = reviews(spark, d).filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"))
    users = rows.groupBy("user_id").agg(F.avg("stars").alias("average_stars"), F.count("*").alias("review_count"), F.min("o_orderdate").alias("yelping_since"))
    users = users.withColumn("compliment_cool", F.lit(0)).withColumn("compliment_funny", F.lit(0))
    return metrics(users, TODAY).select("user_id", "user_stars", "user_reviews", "reviews_per_year")


def _item_metrics(train):
    return train.groupBy("item_id").agg(F.avg("stars").alias("item_stars"), F.count("*").cast("double").alias("item_reviews"))


@query("business_metrics", f"with {TRAIN_SQL}, {_ITEM} select item_id, round_even(2 * item_stars, 0)::double / 2 as item_stars, item_reviews from item_m")
def business_metrics(spark, d):
    from quarry.functions.scalar import nearest_half

    return _item_metrics(ratings(spark, d)[0]).withColumn("item_stars", nearest_half(F.col("item_stars")))


FEATURES = ["item_stars", "item_reviews", "user_stars", "user_reviews", "reviews_per_year"]


def _matrix(spark, d, rows, train):
    # the metrics are read for their means and once a table, so they are written
    return _joined(rows, cut(_item_metrics(train), "items"), cut(_user_metrics(spark, d), "users"))


def _joined(rows, items, users):
    mean = lambda df, cols: {c: F.lit(v) for c, v in df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict().items()}  # noqa: E731  one row
    out = explore.joined_or_default(rows, items, "item_id", mean(items, FEATURES[:2]))
    return explore.joined_or_default(out, users, "user_id", mean(users, FEATURES[2:]))


@query(
    "feature_matrix",
    f"""with {TRAIN_SQL}, {TEST_SQL}, {_USER}, {_ITEM}, du as (select avg(user_stars) as a, avg(user_reviews) as b, avg(reviews_per_year) as c from user_m), di as (select avg(item_stars) as e, avg(item_reviews) as f from item_m)
    select user_id, item_id, stars, round(coalesce(item_stars, e), 6) as item_stars, round(coalesce(item_reviews, f), 6) as item_reviews, round(coalesce(user_stars, a), 6) as user_stars, round(coalesce(user_reviews, b), 6) as user_reviews,
    round(coalesce(reviews_per_year, c), 6)::double as reviews_per_year from test left join item_m using (item_id) left join user_m using (user_id) cross join du cross join di""",
)
def feature_matrix(spark, d):
    train, test = kept_ratings(spark, d)
    out = _matrix(spark, d, test, train)
    return out.select("user_id", "item_id", "stars", *[F.round(c, 6).alias(c) for c in FEATURES])


def _model(spark, d):
    """The matrices to learn from and to predict, written once: a model reads them at every step."""
    train, test = kept_ratings(spark, d)
    items, users = cut(_item_metrics(train), "items"), cut(_user_metrics(spark, d), "users")
    return cut(_joined(train, items, users), "known"), cut(_joined(test, items, users), "asked")


@query("gbt_predict")
def gbt_predict(spark, d):
    known, asked = _model(spark, d)
    model = models.fit(known, FEATURES)
    return models.predict(model, asked, FEATURES, 1.0, 50.0).select("user_id", "item_id", "prediction")


@query("random_search")
def random_search(spark, d):
    """Three random points of the grid, each judged on a fifth that is held out."""
    known, _ = _model(spark, d)
    _, scores = models.search(known, FEATURES, {"maxDepth": [2, 3, 4, 5], "stepSize": [0.05, 0.1, 0.3]}, folds=1, tries=3)
    return spark.createDataFrame([(int(s["maxDepth"]), float(s["stepSize"]), float(s["rmse"])) for s in scores], "max_depth int, step_size double, rmse double")


@query("mlp_predict")
def mlp_predict(spark, d):
    """The feed-forward network with 25 epochs of Adam."""
    known, asked = _model(spark, d)
    return neural.predict(neural.fit(known, FEATURES), asked, FEATURES).select("user_id", "item_id", "prediction")


@query("rfe_select")
def rfe_select(spark, d):
    known, asked = _model(spark, d)
    steps = models.eliminate(known, asked, FEATURES)
    return spark.createDataFrame([(len(s["features"]), ",".join(s["features"]), float(s["rmse"])) for s in steps], "n int, features string, rmse double")


@query("cv_search")
def cv_search(spark, d):
    known, _ = _model(spark, d)
    _, scores = models.search(known, FEATURES, {"maxDepth": [2, 3, 5], "maxIter": [2, 20]})
    return spark.createDataFrame([(int(s["maxDepth"]), int(s["maxIter"]), float(s["rmse"])) for s in scores], "max_depth int, max_iter int, rmse double")


@query("hybrid_predict", f"{_CF}, model as (select user_id, item_id, coalesce(um, gm) as m from asked left join u using (user_id) cross join g) select user_id, item_id, round(0.01 * prediction + 0.99 * m, 4) as prediction from cf join model using (user_id, item_id)")
def hybrid_predict(spark, d):
    """The hybrid with the user's mean as a stand-in model."""
    train, test = kept_ratings(spark, d)
    user = recommend.averages(train, "user_id").select("user_id", F.col("mean").alias("prediction"))
    overall = train.agg(F.avg("stars").alias("m")).first()["m"]  # one row
    model = test.select("user_id", "item_id").distinct().join(user, "user_id", "left").fillna(overall, subset=["prediction"])
    return recommend.hybrid(recommend.predict(test, train), model).withColumn("prediction", F.round("prediction", 4))


@query("hybrid_gbt_predict")
def hybrid_gbt_predict(spark, d):
    """The hybrid of collaborative filtering and the tree model of ``gbt_predict``."""
    train, test = kept_ratings(spark, d)
    return recommend.hybrid(recommend.predict(test, train), gbt_predict(spark, d)).withColumn("prediction", F.round("prediction", 4))


@query("compliment_ratio", "select user_id, round(case when count(*) filter (event_type = 'purchase') > 0 then count(*) filter (event_type = 'click')::double / count(*) filter (event_type = 'purchase') else 0.0 end, 6) as ratio from events group by 1")
def compliment_ratio(spark, d):
    e = table(spark, d, "events")
    a, b = F.count_if(F.col("event_type") == "click").cast("double"), F.count_if(F.col("event_type") == "purchase")
    return e.groupBy("user_id").agg(F.round(ratio_or_zero(a, b), 6).alias("ratio"))
