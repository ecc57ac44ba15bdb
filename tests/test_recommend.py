import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import encode, explore, features, models, recommend


@pytest.fixture(scope="module")
def ratings(spark):
    r = random.Random(5)
    rows = [(u, i, float(r.randint(1, 5))) for u in range(25) for i in r.sample(range(8), 6)]
    return spark.createDataFrame(rows, "user_id long, item_id long, stars double").cache()


def test_weights_equal_numpy(spark, ratings):
    table = {(r["user_id"], r["item_id"]): r["stars"] for r in ratings.collect()}
    for r in recommend.pearson_weights(ratings).collect():
        both = [u for u in range(25) if (u, r["item_id"]) in table and (u, r["other"]) in table]
        x, y = (np.array([table[(u, i)] for u in both]) for i in (r["item_id"], r["other"]))
        assert len(both) == r["n"] >= 5
        below = np.sqrt(((x - x.mean()) ** 2).sum()) * np.sqrt(((y - y.mean()) ** 2).sum())
        assert r["weight"] == pytest.approx(((x - x.mean()) * (y - y.mean())).sum() / below if below else 0.0, abs=1e-9)


def test_pair_sums_by_blocks_and_slices_equal_brute_force(spark, ratings):
    from quarry.operators.pairs import pair_sums

    table, want = {}, {}
    for r in ratings.collect():
        table.setdefault(r["user_id"], []).append((r["item_id"], r["stars"]))
    for rated in table.values():
        for a, x in rated:
            for b, y in rated:
                if a < b:
                    want.setdefault((a, b), []).append((x, y))
    for block, rows in ((512, 10**6), (3, 10**6), (3, 7)):
        got = {(r["a"], r["b"]): r for r in pair_sums(ratings, "user_id", "item_id", "stars", 2, block, rows).collect()}
        assert got.keys() == {k for k, v in want.items() if len(v) >= 2}
        for key, r in got.items():
            x, y = np.array(want[key]).T
            assert (r["n"], r["sx"], r["sy"], r["sxy"], r["sxx"], r["syy"]) == (len(x), x.sum(), y.sum(), x @ y, x @ x, y @ y)
            assert (r["lx"], r["hx"], r["ly"], r["hy"]) == (x.min(), x.max(), y.min(), y.max())
        texts = ratings.withColumn("item_id", F.concat(F.lit("i"), F.col("item_id").cast("string")))
        assert {(r["a"], r["b"], r["n"]) for r in pair_sums(texts, "user_id", "item_id", None, 2, block, rows).collect()} == {(f"i{a}", f"i{b}", r["n"]) for (a, b), r in got.items()}
    assert pair_sums(ratings.limit(0), "user_id", "item_id").count() == 0


def test_no_row_is_made_for_a_co_rating_or_a_candidate(spark, ratings):
    plan = recommend.predict(ratings.select("user_id", "item_id"), ratings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join Inner, (user_id" not in plan


def test_covariance_of_nothing_but_rounding_is_no_weight(spark):
    a, b = (1 / 3, 1 / 3, 2 / 3, 2 / 3, 1.1, 1.1), (0.7, 1.9, 0.7, 1.9, 0.7, 1.9)
    rows = [(u, i, v[u]) for u in range(6) for i, v in ((0, a), (1, b))]
    got = recommend.pearson_weights(spark.createDataFrame(rows, "user_id long, item_id long, stars double")).collect()
    assert [r["weight"] for r in got] == [0.0, 0.0]


def test_constant_ratings_weigh_zero(spark):
    rows = [(u, i, 3.0 if i == 0 else float(u % 5)) for u in range(8) for i in (0, 1)]
    got = recommend.pearson_weights(spark.createDataFrame(rows, "user_id long, item_id long, stars double")).collect()
    assert [r["weight"] for r in got] == [0.0, 0.0]


def test_cold_start_ladder(spark):
    train = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 5.0)], "user_id long, item_id long, stars double")
    asked = spark.createDataFrame([(9, 99), (1, 99), (9, 10), (2, 11)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict(asked, train).collect()}
    assert got[(9, 99)] == pytest.approx(11 / 3)
    assert got[(1, 99)] == 3.0 and got[(9, 10)] == 4.5
    assert got[(2, 11)] == pytest.approx((5.0 + 2.0) / 2)


def test_neighbours_give_the_weighted_mean(spark, ratings):
    asked = ratings.select("user_id", "item_id").limit(20)
    weights = recommend.pearson_weights(ratings)
    near = recommend.neighbours(asked, ratings, weights).toPandas()
    assert near.groupby(["user_id", "item_id"]).size().max() <= 4 and (near.weight != 0).all()
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict(asked, ratings).collect()}
    for key, part in near.groupby(["user_id", "item_id"]):
        assert got[key] == pytest.approx((part.stars * part.weight).sum() / part.weight.abs().sum())


def test_hybrid_rmse_and_histogram(spark):
    cf = spark.createDataFrame([(1, 1, 5.0)], "user_id long, item_id long, prediction double")
    model = spark.createDataFrame([(1, 1, 3.0)], "user_id long, item_id long, prediction double")
    out = recommend.hybrid(cf, model, 0.25)
    assert out.first()["prediction"] == 3.5
    scored = spark.createDataFrame([(1.0, 1.5), (4.0, 2.0)], "t double, p double")
    assert explore.rmse(scored, "t", "p").first()[0] == pytest.approx(np.sqrt((0.25 + 4) / 2))
    assert {tuple(r) for r in explore.error_histogram(scored, "t", "p").collect()} == {(0, 1, 1), (2, 3, 1)}


def test_user_and_tip_features(spark):
    users = spark.createDataFrame([("a", 4.0, 0, "2020-10-28", 3, 4), ("b", 3.0, 10, "2022-10-27", 5, 5)], "user_id string, average_stars double, review_count long, yelping_since string, compliment_cool long, compliment_funny long")
    got = {r["user_id"]: r for r in features.user_metrics(users, "2022-10-28").collect()}
    assert got["a"]["compliments"] == 0.0 and got["b"]["compliments"] == 1.0
    assert got["b"]["reviews_per_year"] == 3650.0
    tips = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("b", "x", 2)], "user_id string, business_id string, likes long")
    user, business, pair = features.tip_features(tips)
    assert {tuple(r) for r in user.collect()} == {("a", 4, 2.0, 3), ("b", 2, 2.0, 2)}
    assert business.first()["business_likes"] == 6 and pair.count() == 2


def test_feature_matrix_loses_no_row(spark):
    rows = spark.createDataFrame([("u", "b", 1.0), ("new", "b", 2.0), ("u", "new", 3.0)], "user_id string, business_id string, stars double")
    business = features.business_metrics(spark.createDataFrame([("b", 3.74, float("nan"), 2.0)], "business_id string, stars double, latitude double, longitude double"))
    users = spark.createDataFrame([("u", 4.0, 5.0, 0.5, 1.0)], "user_id string, user_stars double, user_reviews double, compliments double, reviews_per_year double")
    tips = spark.createDataFrame([("u", "b", 7)], "user_id string, business_id string, pair_likes long")
    got = features.feature_matrix(rows, business, users, [(tips, ["user_id", "business_id"])]).collect()
    assert len(got) == 3 and {r["business_stars"] for r in got} == {3.5} and sorted(r["pair_likes"] for r in got) == [0, 0, 7]


def test_partitioning_and_profiles(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit("None").alias("s"), F.lit(0.0).alias("z"))
    out = explore.compare_partitioning(df, "k", 3)
    assert sum(out["default"]["n_items"]) == sum(out["customized"]["n_items"]) == 100 and out["customized"]["n_partition"] <= 3
    got = {r["column"]: r for r in explore.sentinel_profile(df, ["k", "s", "z"]).collect()}
    assert got["s"]["n_none"] == 100 and got["z"]["n_zero"] == 100 and got["k"]["n_zero"] == 15
    assert explore.summary(df.select("k")).filter("summary = 'count'").first()["k"] == "100"


def test_business_attributes_and_encoding(spark):
    rows = spark.createDataFrame([("1", "n2", "c", "s", {"HasTV": "True"}), ("2", "n1", "a", "s", None)], "business_id string, name string, city string, state string, attributes map<string,string>")
    got = {r["business_id"]: r for r in features.business_attributes(rows).collect()}
    assert got["1"]["has_tv"] == 1 and got["2"]["has_tv"] == 0
    assert (got["1"]["place_code"], got["2"]["place_code"]) == (1, 0)
    assert encode.one_hot(rows, "city", ["a", "c"], "city_").select("city_0", "city_1").collect()[0][1] == 1
    assert encode.multi_hot(spark.createDataFrame([("1", "A, B, A"), ("2", None)], "id string, c string"), "id", "c").count() == 2


def test_models_learn_and_reload(spark, tmp_path):
    from quarry.sources import writers

    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), F.rand(1).alias("noise"), (F.col("id") % 10 * 2.0).alias("stars"))
    model = models.fit(df, ["x", "noise"], trees=5, depth=3)
    assert explore.rmse(models.predict(model, df, ["x", "noise"]), "stars", "prediction").first()[0] < 2
    writers.save_model(model, str(tmp_path / "m"))
    again = models.predict(writers.load_model(str(tmp_path / "m")), df, ["x", "noise"], 1.0, 5.0)
    assert again.agg(F.max("prediction")).first()[0] <= 5.0
    steps = models.eliminate(df, df, ["x", "noise"], trees=2, depth=2)
    assert len(steps) == 2 and "x" in min(steps, key=lambda s: s["rmse"])["features"]
    _, scores = models.search(df, ["x", "noise"], {"maxDepth": [1, 3], "maxIter": [2]}, folds=1)
    assert min(scores, key=lambda s: s["rmse"])["maxDepth"] == 3


def test_registered_models_use_the_operators_defaults(spark, monkeypatch):
    from quarry.plans import recommenders

    asked = {}
    monkeypatch.setattr(recommenders, "_model", lambda *a: (None, spark.range(1)))
    monkeypatch.setattr(models, "fit", lambda *a, **b: asked.update(fit=b))
    monkeypatch.setattr(models, "predict", lambda *a, **b: spark.range(1).selectExpr("id as user_id", "id as item_id", "0.0 as prediction"))
    monkeypatch.setattr(models, "eliminate", lambda *a, **b: asked.update(eliminate=b) or [{"features": ["x"], "rmse": 1.0}])
    monkeypatch.setattr(models, "search", lambda known, features, grid, **b: asked.update(search=b, grid=grid) or (None, [{"maxDepth": 5, "maxIter": 20, "rmse": 1.0}]))
    for q in (recommenders.gbt_predict, recommenders.rfe_select, recommenders.cv_search):
        q(spark, "")
    assert asked["fit"] == asked["eliminate"] == asked["search"] == {}
    assert 5 in asked["grid"]["maxDepth"] and 20 in asked["grid"]["maxIter"]


def test_registered_hybrid_mixes_filtering_and_trees(spark):
    from quarry.plans import registry, roles

    d = "/root/testdata/sf0.001"
    got, model = ({(r["user_id"], r["item_id"]): r["prediction"] for r in registry.queries()[q](spark, d).collect()} for q in ("hybrid_gbt_predict", "gbt_predict"))
    train, test = roles.ratings(spark, d)
    cf = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict(test, train).collect()}
    assert got.keys() == cf.keys() == model.keys() and len(got) > 0
    for key, p in got.items():
        assert p == pytest.approx(0.01 * cf[key] + 0.99 * model[key], abs=1e-4)


def test_network_gradient_and_learning(spark):
    import numpy as np

    from quarry.operators import neural

    rng = np.random.default_rng(3)
    x = rng.random((400, 2)) * [10, 3]
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(1.0, 2.0, None), (None, 1.0, 1.0)], "a double, b double, stars double")
    net = neural.fit(rows, ["a", "b"], epochs=2)
    flat, _ = net.gradient(x, y)
    for at in rng.integers(0, len(flat), 12):
        e = np.zeros(len(flat))
        e[at] = 1e-5
        up, down = net.moved(e).gradient(x, y)[1], net.moved(-e).gradient(x, y)[1]
        assert abs((up - down) / 2e-5 - flat[at]) <= 1e-3 * max(1.0, abs(flat[at]))
    rmse = lambda n: float(np.sqrt(np.mean((n.forward(x)[-1][:, 0] - y) ** 2)))
    assert rmse(neural.fit(rows, ["a", "b"], epochs=40)) < 0.6 * float(y.std())
    out = neural.predict(net, rows.withColumn("prediction", rows["a"]), ["a", "b"])
    assert out.columns == ["a", "b", "stars", "prediction"] and out.count() == 402
    assert neural.predict(net, rows.limit(0), ["a", "b"]).count() == 0


def test_random_search_tries_points_of_the_grid(spark):
    from quarry.operators import models

    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7)) for i in range(80)], "a double, b double, stars double")
    _, scores = models.search(rows, ["a", "b"], {"maxDepth": [1, 2, 3], "maxIter": [1, 2]}, folds=1, tries=3)
    assert len({(s["maxDepth"], s["maxIter"]) for s in scores}) == 3


def test_models_read_written_matrices(spark):
    from quarry.plans import recommenders

    for frame in recommenders._model(spark, "/root/testdata/sf0.001"):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
