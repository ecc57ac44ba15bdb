"""Exploration and the relational core: counts, joins, set operations, text, dates, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import encode, explore, features, itemsets
from quarry.plans.registry import query
from quarry.plans.roles import BUSINESS_SQL, REVIEWS_SQL, TODAY, business, reviews
from quarry.sources.readers import table


@query("review_count", "select count(*)::bigint as n_review from lineitem join orders on l_orderkey = o_orderkey")
def review_count(spark, d):
    return explore.count_rows(reviews(spark, d), "n_review")


@query("review_count_year", f"with {REVIEWS_SQL} select count(*)::bigint as n_review_1998 from reviews where strftime(o_orderdate, '%Y-%m-%d') like '%1998%'")
def review_count_year(spark, d):
    return explore.count_rows(reviews(spark, d), "n_review_1998", F.date_format("o_orderdate", "yyyy-MM-dd").contains("1998"))


@query("distinct_users", "select count(distinct o_custkey)::bigint as n_user from lineitem join orders on l_orderkey = o_orderkey")
def distinct_users(spark, d):
    return explore.count_distinct(reviews(spark, d), "user_id", "n_user")


@query("distinct_businesses", "select count(distinct l_suppkey)::bigint as n_business from lineitem join orders on l_orderkey = o_orderkey")
def distinct_businesses(spark, d):
    return explore.count_distinct(reviews(spark, d), "item_id", "n_business")


@query("top10_users", f"with {REVIEWS_SQL} select user_id, count(*)::bigint as n from reviews group by 1 order by n desc, user_id limit 10")
def top10_users(spark, d):
    return explore.top_counts(reviews(spark, d), "user_id")


@query("top10_businesses", f"with {REVIEWS_SQL} select item_id, count(*)::bigint as n from reviews group by 1 order by n desc, item_id limit 10")
def top10_businesses(spark, d):
    return explore.top_counts(reviews(spark, d), "item_id")


@query(
    "top_customers",
    """select c_mktsegment, n_name, count(*)::bigint as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey group by 1, 2""",
)
def top_customers(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("avg_stars_by_city", f"with {REVIEWS_SQL}, {BUSINESS_SQL} select city, avg(stars) as avg_stars from reviews join business on item_id = s_suppkey group by 1")
def avg_stars_by_city(spark, d):
    facts = reviews(spark, d).withColumnRenamed("item_id", "s_suppkey")
    return explore.mean_by(facts, business(spark, d), "s_suppkey", "city", "stars", "avg_stars")


@query("top10_cities", f"with {REVIEWS_SQL}, {BUSINESS_SQL} select city, avg(stars) as avg_stars from reviews join business on item_id = s_suppkey group by 1 order by avg_stars desc, city limit 10")
def top10_cities(spark, d):
    return avg_stars_by_city(spark, d).orderBy(F.desc("avg_stars"), "city").limit(10)


@query("partition_report")
def partition_report(spark, d):
    """Rows of each partition of the reviews dealt by item; the layout is the engine's own."""
    return explore.partition_report(reviews(spark, d).select("item_id").repartition(8, "item_id"))


@query("partition_total", "select count(*)::bigint as n_items from lineitem join orders on l_orderkey = o_orderkey")
def partition_total(spark, d):
    return partition_report(spark, d).agg(F.sum("n_items").alias("n_items"))


@query("semi_join_users", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def semi_join_users(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("anti_join_missing", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def anti_join_missing(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


_RICH = "select s_suppkey as item_id, s_acctbal as balance from supplier where s_acctbal > 5000"


@query(
    "left_join_defaults",
    f"""with {REVIEWS_SQL}, rich as ({_RICH}), m as (select avg(balance) as mean from rich)
    select user_id, r.item_id, count(*)::bigint as n, round(max(coalesce(balance, mean)), 6) as balance from reviews r left join rich using (item_id) cross join m group by 1, 2""",
)
def left_join_defaults(spark, d):
    rich = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("item_id"), F.col("s_acctbal").alias("balance"))
    mean = rich.agg(F.avg("balance").alias("mean")).first()["mean"]  # one row
    rows = explore.joined_or_default(reviews(spark, d), rich, "item_id", {"balance": F.lit(mean)})
    return rows.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.round(F.max("balance"), 6).alias("balance"))


@query(
    "union_matched_default",
    f"""with rich as ({_RICH}) select s_suppkey as item_id, s_acctbal as balance, 'matched' as origin from supplier join rich on s_suppkey = item_id
    union all select s_suppkey, 0.0::double, 'default' from supplier where s_suppkey not in (select item_id from rich)""",
)
def union_matched_default(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_acctbal").alias("balance"))
    rich = supplier.filter("balance > 5000")
    hit = supplier.join(rich.select("item_id"), "item_id", "left_semi").withColumn("origin", F.lit("matched"))
    miss = supplier.join(rich.select("item_id"), "item_id", "left_anti").select("item_id", F.lit(0.0).alias("balance"), F.lit("default").alias("origin"))
    return hit.unionByName(miss)


def _sets(spark, d):
    lines = table(spark, d, "lineitem")
    a = lines.filter("l_returnflag = 'A'").select("l_partkey")
    return a, lines.filter("l_linestatus = 'O' and l_quantity > 40").select("l_partkey")


_A, _B = "select l_partkey from lineitem where l_returnflag = 'A'", "select l_partkey from lineitem where l_linestatus = 'O' and l_quantity > 40"


@query("set_intersection", f"{_A} intersect {_B}")
def set_intersection(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query("set_difference", f"{_A} except {_B}")
def set_difference(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


@query("set_union", f"{_A} union {_B}")
def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("collect_set_baskets", "select l_orderkey as basket, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as items from lineitem group by 1")
def collect_set_baskets(spark, d):
    rows = itemsets.rows_of(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    return itemsets.baskets(rows).select("basket", F.array_join("items", ",").alias("items"))


@query("longest_basket", "select max(n)::bigint as longest from (select count(distinct l_suppkey) as n from lineitem group by l_orderkey)")
def longest_basket(spark, d):
    return itemsets.longest_basket(itemsets.rows_of(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


@query("basket_filter_k", "select distinct l_orderkey as basket, l_suppkey::varchar as item from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(distinct l_suppkey) > 5)")
def basket_filter_k(spark, d):
    return itemsets.larger_than(itemsets.rows_of(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"), 5)


@query(
    "transaction_key_build",
    """select strftime(o_orderdate, '%Y-%m-%d') || '-' || regexp_replace(lpad(o_custkey::varchar, 12, '0'), '^0+(.)', '\\1') as basket, l_partkey as item, count(*)::bigint as n
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
)
def transaction_key_build(spark, d):
    rows = reviews(spark, d).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.format_string('"%s"', F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("customer"), F.col("l_partkey").cast("string").alias("product"))
    return itemsets.transaction_rows(rows, "date", "customer", "product").groupBy("basket", "item").agg(F.count("*").alias("n"))


@query("label_encode", f"with {BUSINESS_SQL} select s_suppkey, city || '-' || state as place, (dense_rank() over (order by city || '-' || state) - 1)::bigint as place_code from business")
def label_encode(spark, d):
    rows = business(spark, d).select("s_suppkey", F.concat_ws("-", "city", "state").alias("place"))
    return encode.label_encode(rows, "place", "place_code").select("s_suppkey", "place", "place_code")


@query("multi_hot", "select distinct p_partkey, unnest(string_split(p_type, ' ')) as value from part")
def multi_hot(spark, d):
    return encode.multi_hot(table(spark, d, "part"), "p_partkey", "p_type", " ")


@query(
    "date_metrics",
    f"""with u as (select o_custkey as user_id, min(o_orderdate) as since, count(*) as n from orders group by 1),
    v as (select user_id, n, datediff('day', since::date, date '{TODAY}') as days from u)
    select user_id, days::bigint as days, round(n * 365.0 / (days - (select min(days) from v) + 1), 6)::double as per_year from v""",
)
def date_metrics(spark, d):
    users = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderdate").alias("since"), F.count("*").alias("n"))
    rows = users.withColumn("days", scalar.days_since(F.col("since"), F.lit(TODAY).cast("date")).cast("long"))
    least = F.broadcast(rows.agg(F.min("days").alias("least")))  # one row
    return rows.join(least).select("user_id", "days", F.round(F.col("n") * 365.0 / (F.col("days") - F.col("least") + 1), 6).cast("double").alias("per_year"))


@query(
    "attr_json_features",
    "select event_id, coalesce((props->>'$.k')::bigint, 0) as k, case when props->>'$.k' is not null then 1 else 0 end as has_k, case when props->>'$.missing' is not null then 1 else 0 end as has_missing from events",
)
def attr_json_features(spark, d):
    k, missing = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.missing")
    return table(spark, d, "events").select("event_id", F.coalesce(k.try_cast("long"), F.lit(0)).alias("k"), k.isNotNull().cast("int").alias("has_k"), missing.isNotNull().cast("int").alias("has_missing"))


def _tips(spark, d):
    e = table(spark, d, "events")
    return features.tip_features(e.select("user_id", F.col("event_type").alias("business_id"), F.col("value").alias("likes")))


def _rounded(df, keys, tag):
    return df.select(*keys, *[F.round(f"{tag}_{name}", 6).alias(name) for name in ("likes", "mean_likes", "max_likes")])


@query("tip_user_likes", "select user_id, round(sum(value), 6) as likes, round(avg(value), 6) as mean_likes, round(max(value), 6) as max_likes from events group by 1")
def tip_user_likes(spark, d):
    return _rounded(_tips(spark, d)[0], ["user_id"], "user")


@query("tip_business_likes", "select event_type as business_id, round(sum(value), 4) as likes, round(avg(value), 6) as mean_likes, round(max(value), 6) as max_likes from events group by 1")
def tip_business_likes(spark, d):
    return _rounded(_tips(spark, d)[1], ["business_id"], "business").withColumn("likes", F.round("likes", 4))


@query("tip_pair_likes", "select user_id, event_type as business_id, round(sum(value), 6) as likes, round(avg(value), 6) as mean_likes, round(max(value), 6) as max_likes from events group by 1, 2")
def tip_pair_likes(spark, d):
    return _rounded(_tips(spark, d)[2], ["user_id", "business_id"], "pair")


@query(
    "profile_columns",
    " union all ".join(
        f"select '{c}' as \"column\", count(*)::bigint as n_rows, count(*) filter ({c} is null)::bigint as n_null, count(*) filter ({c}::varchar = '')::bigint as n_empty, count(*) filter (try_cast({c}::varchar as double) = 0)::bigint as n_zero, count(*) filter ({c}::varchar = 'None')::bigint as n_none from lineitem"
        for c in ("l_discount", "l_tax", "l_returnflag", "l_linenumber")
    ),
)
def profile_columns(spark, d):
    return explore.sentinel_profile(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_returnflag", "l_linenumber"])


@query(
    "feature_corr",
    " union all ".join(f"select '{c}' as feature, round(coalesce(corr({c}::double, l_quantity), 0.0), 6) as corr from lineitem" for c in ("l_extendedprice", "l_discount", "l_tax", "l_linenumber")),
)
def feature_corr(spark, d):
    out = explore.correlations(table(spark, d, "lineitem"), ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "l_quantity")
    return out.select("feature", (F.round("corr", 6) + 0.0).alias("corr"))


@query("tumbling_window_counts", "select time_bucket(interval '1 day', ts) as day, event_type, count(*)::bigint as n, count(distinct user_id)::bigint as users from events group by 1, 2")
def tumbling_window_counts(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("scalar_text", "select page_id, length(url) as n, lower(url) as low, contains(url, 'example') as hit, lpad(bin(page_id % 64), 6, '0') as bits, hex(left(url, 4)) as hexed from pages")
def scalar_text(spark, d):
    from quarry.functions.hashing import binary_text

    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.length(u).cast("long").alias("n"), F.lower(u).alias("low"), u.contains("example").alias("hit"), binary_text(F.col("page_id") % 64).alias("bits"), F.hex(F.encode(F.left(u, F.lit(4)), "utf-8")).alias("hexed"))


@query(
    "scalar_math",
    "select l_orderkey, l_linenumber, l_extendedprice, ceil(l_extendedprice) as up, floor(l_extendedprice) as down, abs(l_discount - 0.05) as off, round(sqrt(l_extendedprice), 6) as root, round(ln(l_extendedprice), 6) as log, case when l_tax > 0 then round(l_discount / l_tax, 6) else 0.0 end as ratio, l_quantity % 7 as rest from lineitem",
)
def scalar_math(spark, d):
    p = F.col("l_extendedprice")
    ratio = F.round(scalar.ratio_or_zero(F.col("l_discount"), F.col("l_tax")), 6)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.ceil(p).cast("double").alias("up"), F.floor(p).cast("double").alias("down"), F.abs(F.col("l_discount") - 0.05).alias("off"),
        F.round(F.sqrt(p), 6).alias("root"), F.round(F.ln(p), 6).alias("log"), ratio.alias("ratio"), (F.col("l_quantity") % 7).alias("rest"),
    )


@query("top_n_per_group", "select l_suppkey, l_partkey, n, rank from (select l_suppkey, l_partkey, count(*)::bigint as n, row_number() over (partition by l_suppkey order by count(*) desc, l_partkey)::int as rank from lineitem group by 1, 2) where rank <= 4")
def top_n_per_group(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 4")


@query("row_index", "select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as \"index\" from orders")
def row_index(spark, d):
    return encode.row_index(table(spark, d, "orders"), "o_orderkey")
