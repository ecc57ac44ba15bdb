"""Round trips: what the sinks write, the scans read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.functions.hashing import optimal_hash_count
from quarry.operators import clustering, explore, features, graph, models
from quarry.plans.registry import query
from quarry.plans.roles import REVIEWS_SQL, TEST_SQL, TRAIN_SQL, ratings, reviews
from quarry.sources import readers, writers
from quarry.sources.readers import table
from quarry.sources.scratch import root


def _path(spark, kind: str) -> str:
    return f"{root(spark)}/quarry-{kind}-{uuid.uuid4().hex}"


def _lines(spark, path: str) -> DataFrame:
    """The lines of a report file with their places; a report is one small file, so its rows are one task's."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))


def _numbered(sql_lines: str) -> str:
    """SQL of (n, line) from a query that gives ordered lines, with the empty rest that ends the file."""
    return f"with lines as ({sql_lines}) select (row_number() over (order by k) - 1)::int as n, line from (select k, line from lines union all select 1000000, '')"


@query("scan_json_reviews", f"with {REVIEWS_SQL} select user_id::varchar as user_id, item_id::varchar as business_id, stars, strftime(o_orderdate, '%Y-%m-%d') as date from reviews")
def scan_json_reviews(spark, d):
    rows, path = reviews(spark, d), _path(spark, "reviews")
    rows.select(F.col("user_id").cast("string"), F.col("item_id").cast("string").alias("business_id"), "stars", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).write.json(path)
    return readers.json_lines(spark, path, "review")


@query("scan_json_tips", "select l_partkey::varchar as user_id, sum(l_linenumber)::bigint as user_likes, round(avg(l_linenumber), 6) as user_mean_likes, max(l_linenumber)::bigint as user_max_likes from lineitem group by 1")
def scan_json_tips(spark, d):
    path = _path(spark, "tips")
    table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("user_id"), F.col("l_suppkey").cast("string").alias("business_id"), F.col("l_linenumber").alias("likes")).write.json(path)
    user, _, _ = features.tip_features(readers.json_lines(spark, path, "tip"))
    return user.withColumn("user_mean_likes", F.round("user_mean_likes", 6))


@query("scan_json_members", "select c_custkey::varchar as user_id, c_acctbal as user_stars, (c_custkey % 9)::double as user_reviews, case when c_custkey % 9 > 0 then (c_nationkey + 1)::double / (c_custkey % 9) else 0.0 end as compliments from customer where c_custkey in (select o_custkey from orders)")
def scan_json_members(spark, d):
    """Only the users that the ratings name are read on."""
    path, c = _path(spark, "users"), table(spark, d, "customer")
    c.select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_acctbal").alias("average_stars"), (F.col("c_custkey") % 9).alias("review_count"), F.lit("2010-05-01").alias("yelping_since"),
        F.col("c_nationkey").cast("long").alias("compliment_cool"), F.lit(1).cast("long").alias("compliment_funny"),
    ).write.json(path)
    asked = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"))
    return features.user_metrics(readers.json_lines(spark, path, "user"), "2022-10-28", asked).drop("reviews_per_year")


@query("scan_json_attributes", "select s_suppkey::varchar as business_id, (s_suppkey % 5)::int as price_range, case when s_suppkey % 3 = 0 then 1 else 0 end as bike_parking, 0 as has_tv, case when s_suppkey % 2 = 0 then 1 else 0 end as garage, 0 as lot, case when s_suppkey % 4 = 0 then 1 else 0 end as lunch from supplier")
def scan_json_attributes(spark, d):
    """Attributes as maps of texts; flags read as 'true', literals by their keys, missing ones as 0."""
    path, s, k = _path(spark, "business"), table(spark, d, "supplier"), F.col("s_suppkey")
    said = lambda when: F.when(when, F.lit("True")).otherwise(F.lit("False"))
    some = F.create_map(
        F.lit("RestaurantsPriceRange2"), (k % 5).cast("string"), F.lit("BikeParking"), said(k % 3 == 0),
        F.lit("BusinessParking"), F.concat(F.lit("{u'garage': "), said(k % 2 == 0), F.lit(", 'lot': False}")), F.lit("GoodForMeal"), F.concat(F.lit("{'lunch': "), said(k % 4 == 0), F.lit(", 'dinner': None}")),
    )
    s.select(k.cast("string").alias("business_id"), F.col("s_name").alias("name"), F.lit("x").alias("city"), F.lit("y").alias("state"), some.alias("attributes")).write.json(path)
    out = features.business_attributes(readers.json_lines(spark, path, "business"), "true")
    return out.select("business_id", "price_range", "bike_parking", "has_tv", "garage", "lot", "lunch")


@query("attributes_present", "select s_suppkey::varchar as business_id, case when s_suppkey % 3 = 0 then 1 else 0 end as has_tv, (dense_rank() over (order by 'x-' || (s_nationkey % 4)) - 1)::bigint as place_code from supplier")
def attributes_present(spark, d):
    """A flag that means 'present' holds whatever the value says; a business without attributes has none."""
    k = F.col("s_suppkey")
    some = F.when(k % 3 == 0, F.create_map(F.lit("HasTV"), F.lit("False"))).when(k % 3 == 1, F.create_map(F.lit("HasTV"), F.lit("")))
    rows = table(spark, d, "supplier").select(k.cast("string").alias("business_id"), F.col("s_name").alias("name"), F.lit("x").alias("city"), (F.col("s_nationkey") % 4).cast("string").alias("state"), some.alias("attributes"))
    return features.business_attributes(rows).select("business_id", "has_tv", "place_code")


@query("nan_as_missing", "select s_suppkey as business_id, round_even(2 * s_acctbal / 1000, 0)::double / 2 + 0.0 as business_stars, case when s_suppkey % 3 = 0 then null else s_acctbal end as latitude, 1.5::double as longitude from supplier")
def nan_as_missing(spark, d):
    k, x = F.col("s_suppkey"), F.col("s_acctbal")
    rows = table(spark, d, "supplier").select(k.alias("business_id"), (x / 1000).alias("stars"), F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(x).alias("latitude"), F.lit(1.5).alias("longitude"))
    return features.business_metrics(rows).withColumn("business_stars", F.col("business_stars") + 0.0)


@query("scan_csv_ratings", "select s_name as user_id, s_nationkey::varchar as business_id, s_acctbal as stars from supplier")
def scan_csv_ratings(spark, d):
    path = _path(spark, "ratings")
    table(spark, d, "supplier").select(F.col("s_name").alias(" user"), F.col("s_nationkey").alias(" item"), F.col("s_acctbal").alias(" rating")).write.csv(path, header=True)
    return readers.csv(spark, path, "rating")


@query("scan_csv_staged", f"with {TRAIN_SQL}, {TEST_SQL} select user_id::varchar as user_id, item_id::varchar as business_id, round(stars, 4) as stars from test")
def scan_csv_staged(spark, d):
    """Staged feature rows: written as CSV, read by position."""
    path = _path(spark, "staged")
    ratings(spark, d)[1].withColumn("stars", F.round("stars", 4)).write.csv(path, header=True)
    return readers.csv(spark, path, "rating")


@query("scan_csv_orientation", "select l_suppkey::varchar as basket, count(distinct l_partkey)::bigint as items from lineitem group by 1")
def scan_csv_orientation(spark, d):
    path = _path(spark, "baskets")
    table(spark, d, "lineitem").select(F.col("l_partkey").alias("user_id"), F.col("l_suppkey").alias("business_id")).write.csv(path, header=True)
    return readers.baskets_csv(spark, path, 2).groupBy("basket").agg(F.count_distinct("item").alias("items"))


@query("scan_csv_numeric", "select s_suppkey as point_id, s_nationkey::bigint as label, s_acctbal as f0, (s_suppkey % 7)::double as f1 from supplier")
def scan_csv_numeric(spark, d):
    path = _path(spark, "points")
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.col("s_suppkey") % 7).write.csv(path, header=False)
    return readers.numeric_csv(spark, path, 2).select("point_id", "label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("scan_csv_transactions", "select strftime(o_orderdate, '%m/%d/%Y') || '-' || ltrim(o_custkey::varchar, '0') || case when o_custkey = 0 then '0' else '' end as basket, o_orderkey::varchar as item from orders")
def scan_csv_transactions(spark, d):
    """Quoted transactions to (date-customer, product), ids without leading zeros."""
    path, o = _path(spark, "transactions"), table(spark, d, "orders")
    wide = [F.date_format("o_orderdate", "MM/dd/yyyy"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("a"), F.lit("b, c"), F.lit("d"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("1"), F.lit("2"), F.lit("3")]
    o.select(*[c.alias(f"h{i}") for i, c in enumerate(wide)]).write.csv(path, header=True, quoteAll=True)
    rows = readers.transactions_csv(spark, path)
    return rows.select(scalar.joined_key(F.col("date"), scalar.strip_leading_zeros(F.col("customer_id"))).alias("basket"), scalar.strip_leading_zeros(F.col("product_id")).alias("item"))


@query("in_memory_rows", "select * from (values (1::bigint, 'a', 0.5::double), (2, 'b', null), (3, null, -1.5)) t(id, name, value)")
def in_memory_rows(spark, d):
    return spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (3, None, -1.5)], "id long, name string, value double")


@query("resampled_stream", "select b as batch, 50::bigint as n, 50::bigint as known, 49::bigint as last_seq from range(0, 4) r(b)")
def resampled_stream(spark, d):
    """Batches of 50 draws with replacement: all drawn values are lines of the source."""
    lines = table(spark, d, "customer").select(F.col("c_name").alias("value"))
    drawn = readers.resampled_batches(lines, 4, 50)
    known = drawn.join(lines.withColumn("hit", F.lit(1)), "value", "left")
    return known.groupBy("batch").agg(F.count("*").alias("n"), F.count("hit").alias("known"), F.max("seq").alias("last_seq"))


@query("sink_json_object", "select (select count(*) from orders)::bigint as n_orders, (select count(distinct o_custkey) from orders)::bigint as n_users, (select min(o_orderpriority) from orders) as first_priority")
def sink_json_object(spark, d):
    path = _path(spark, "object")
    row = table(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_users"), F.min("o_orderpriority").alias("first_priority")).first()
    writers.write_json_object(row.asDict(), spark, path)
    return spark.read.schema("n_orders long, n_users long, first_priority string").json(path)


_SETS = "one as (select r_name as a from region), two as (select x.a, y.a as b from one x join one y on x.a < y.a)"


@query(
    "sink_itemset_report",
    f"""with {_SETS}, l1 as (select string_agg('(''' || a || ''')', ',' order by a) as s from one), l2 as (select string_agg('(''' || a || ''', ''' || b || ''')', ',' order by a, b) as s from two),
    f1 as (select string_agg('(''' || a || ''')', ',' order by a) as s from one where a < 'B'), lines as (select 0 as k, 'Candidates:' as line union all select 1, s from l1 union all select 2, '' union all select 3, s from l2 union all select 4, ''
    union all select 5, 'Frequent Itemsets:' union all select 6, s from f1 union all select 7, '' union all select 8, '') select k as n, line from lines""",
)
def sink_itemset_report(spark, d):
    path, r = _path(spark, "itemsets"), table(spark, d, "region").select(F.col("r_name").alias("a"))
    pairs = r.agg(scalar.pairs(F.collect_list("a")).alias("p")).select(F.inline("p"))
    writers.write_itemset_report(r.select(F.array("a").alias("items")).unionByName(pairs.select(F.array("a", "b").alias("items"))), r.filter("a < 'B'").select(F.array("a").alias("items")), path)
    return _lines(spark, path)


@query(
    "sink_community_report",
    _numbered("select row_number() over (order by count(*), min(n_name)) as k, string_agg('''' || n_name || '''', ', ' order by n_name) as line from nation group by n_regionkey"),
)
def sink_community_report(spark, d):
    path = _path(spark, "communities")
    writers.write_lines(writers.community_lines(graph.communities(table(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("label")))), path)
    return _lines(spark, path)


@query(
    "sink_betweenness_report",
    _numbered("select row_number() over (order by x.n_nationkey * 1.25 desc, x.n_name) as k, '(''' || x.n_name || ''', ''' || y.n_name || '''),' || (x.n_nationkey * 1.25)::double as line from nation x join nation y on y.n_nationkey = x.n_nationkey + 1"),
)
def sink_betweenness_report(spark, d):
    path, n = _path(spark, "betweenness"), table(spark, d, "nation")
    ends = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("k")).join(n.select(F.col("n_name").alias("b"), (F.col("n_nationkey") - 1).alias("k")), "k")
    writers.write_lines(writers.betweenness_lines(ends.select("a", "b", (F.col("k") * 1.25).alias("betweenness"))), path)
    return _lines(spark, path)


@query(
    "sink_clustering_report",
    _numbered("select 0 as k, 'The intermediate results:' as line union all select 1, 'Round 1: 10,2,3,4' union all select 2, 'Round 2: 20,2,2,1' union all select 3, '' union all select 4, 'The clustering results:' union all select 5 + s_suppkey, s_suppkey || ',' || (s_suppkey % 4 - 1) from supplier"),
)
def sink_clustering_report(spark, d):
    path = _path(spark, "clusters")
    rounds = spark.createDataFrame([(1, 10, 2, 3, 4), (2, 20, 2, 2, 1)], "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    points = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 4 - 1).alias("cluster"))
    writers.write_lines(writers.clustering_lines(rounds, points), path)
    return _lines(spark, path)


@query("model_round_trip", "select s_suppkey, 0.0::double as off from supplier")
def model_round_trip(spark, d):
    """A fitted model, saved and loaded again, predicts the same; features are scaled to [0, 1]."""
    path, rows = _path(spark, "model"), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 5).cast("double").alias("y"), F.col("s_acctbal").alias("stars"))
    model = models.fit(rows, ["x", "y"], trees=2, depth=2, scaled=True)
    writers.save_model(model, path)
    again = models.predict(writers.load_model(path), rows, ["x", "y"]).select("s_suppkey", F.col("prediction").alias("p"))
    return models.predict(model, rows, ["x", "y"]).join(again, "s_suppkey").select("s_suppkey", F.abs(F.col("prediction") - F.col("p")).alias("off"))


@query("min_max_scaled", "with r as (select min(s_acctbal) as a, max(s_acctbal) as b from supplier) select s_suppkey, round((s_acctbal - a) / (b - a), 9) as scaled from supplier, r")
def min_max_scaled(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    out = models.scaler(["x"]).fit(rows).transform(rows)
    return out.select("s_suppkey", F.round(vector_to_array("_features")[0], 9).alias("scaled"))


@query("bloom_hash_counts", "select m, n, greatest(1, round(m / n * ln(2)))::bigint as k from (values (69997::bigint, 10000::bigint), (69997, 4000), (1000, 100000), (8, 1)) t(m, n)")
def bloom_hash_counts(spark, d):
    sizes = [(69_997, 10_000), (69_997, 4_000), (1_000, 100_000), (8, 1)]
    return spark.createDataFrame([(m, n, optimal_hash_count(m, n)) for m, n in sizes], "m long, n long, k long")


@query("band_slices", "select p_partkey, concat_ws(',', p_partkey % 10, p_size, p_partkey % 3) as first, (p_partkey % 7)::varchar as last from part")
def band_slices(spark, d):
    k = F.col("p_partkey")
    cut = scalar.bands(F.array(k % 10, F.col("p_size").cast("long"), k % 3, k % 7), 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(cut[0], ",").alias("first"), F.array_join(cut[1], ",").alias("last"))


@query("baskets_with_items", "select l_orderkey from lineitem group by 1 having count(distinct l_linestatus) = 2 and count(*) filter (l_returnflag = 'R') > 0")
def baskets_with_items(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("s"), F.collect_set("l_returnflag").alias("f"))
    wanted = sets.filter(scalar.contains_all(F.concat("s", "f"), F.array(F.lit("R"), F.lit("F"), F.lit("O"))))
    return wanted.select("l_orderkey")


@query("groups_of_two", "select l_partkey, l_suppkey, array_to_string(list_sort(list(l_linenumber)), ',') as lines from lineitem group by 1, 2 having count(*) >= 2")
def groups_of_two(spark, d):
    """Groups of at least two members, each as a sorted list."""
    groups = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("lines"))
    return groups.filter(F.size("lines") >= 2).withColumn("lines", F.array_join("lines", ","))


@query("summary_columns", "select 'count' as summary, count(s_acctbal)::varchar as s_acctbal from supplier union all select 'min', min(s_acctbal)::varchar from supplier union all select 'max', max(s_acctbal)::varchar from supplier")
def summary_columns(spark, d):
    return explore.summary(table(spark, d, "supplier").select("s_acctbal")).filter("summary in ('count', 'min', 'max')")


_BLOBS = "blobs as (select o_orderkey as point_id, o_orderkey % 3 as blob from orders)"


@query("bfr_blobs", f"with {_BLOBS} select blob, count(*)::bigint as n, 1::bigint as clusters from blobs group by 1")
def bfr_blobs(spark, d):
    """Blobs far apart: the clustering gives each blob one cluster, and leaves no point out."""
    o, blob = table(spark, d, "orders"), F.col("o_orderkey") % 3
    near = lambda salt: F.pmod(F.xxhash64("o_orderkey", F.lit(salt)), F.lit(1000)) / 1000.0
    points = o.select(F.col("o_orderkey").alias("point_id"), F.array(blob * 100 + near(1), blob * -50 + near(2)).alias("features"), blob.alias("blob"))
    found = clustering.bfr(points.select("point_id", "features"), k=3)[0]
    return points.join(found, "point_id").groupBy("blob").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


@query("girvan_newman_cliques", "select n_nationkey as id, min(n_nationkey) over (partition by n_regionkey) as component from nation")
def girvan_newman_cliques(spark, d):
    """Nations of a region are a clique, and a chain joins the regions: its links go first, and the regions are left."""
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("r"))
    inside = a.join(b, "r").filter("src <> dst").select("src", "dst")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    chain = first.select(F.col("k").alias("src"), F.col("n_regionkey").alias("r")).join(first.select(F.col("k").alias("dst"), (F.col("n_regionkey") - 1).alias("r")), "r").select("src", "dst")
    return graph.girvan_newman(inside.unionByName(chain).unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
