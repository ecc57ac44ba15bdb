"""Itemsets, MinHash similarity and sketches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.hashing import COEFFICIENTS_SQL
from quarry.operators import itemsets, similarity, sketches
from quarry.plans.registry import query
from quarry.sources.readers import table
from quarry.sources.scratch import cut

#: Least share of the baskets.
SHARE = 0.0017
_ROWS = "rows as (select distinct l_orderkey as basket, p_brand as item from lineitem join part on l_partkey = p_partkey)"
_LEAST = f"least as (select greatest(1, ceil({SHARE} * count(distinct basket))) as s from rows)"
_PAIRS = "pairs as (select a.item as a, b.item as b, count(*)::bigint as n from rows a join rows b on a.basket = b.basket and a.item < b.item group by 1, 2 having count(*) >= (select s from least))"


def _rows(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return cut(itemsets.rows_of(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand"), "rows")


def _support(rows) -> int:
    from math import ceil

    return max(1, ceil(SHARE * rows.select("basket").distinct().count()))


def _joined(df):
    return df.select(F.array_join("items", ",").alias("items"), F.col("n").cast("long").alias("n"))


@query("freq_singletons", f"with {_ROWS}, {_LEAST} select item as items, count(*)::bigint as n from rows group by 1 having count(*) >= (select s from least)")
def freq_singletons(spark, d):
    rows = _rows(spark, d)
    return _joined(itemsets.apriori(rows, _support(rows), 1))


@query("freq_pairs", f"with {_ROWS}, {_LEAST}, {_PAIRS} select a || ',' || b as items, n from pairs")
def freq_pairs(spark, d):
    rows = _rows(spark, d)
    return _joined(itemsets.apriori(rows, _support(rows), 2).filter("size(items) = 2"))


_TRIPLES = "select a.item || ',' || b.item || ',' || c.item as items, count(*)::bigint as n from rows a join rows b on a.basket = b.basket and a.item < b.item join rows c on a.basket = c.basket and b.item < c.item group by a.item, b.item, c.item having count(*) >= (select s from least)"


@query("freq_triples", f"with {_ROWS}, {_LEAST} {_TRIPLES}")
def freq_triples(spark, d):
    rows = _rows(spark, d)
    return _joined(itemsets.apriori(rows, _support(rows), 3).filter("size(items) = 3"))


@query("son_itemsets", f"with {_ROWS}, {_LEAST}, {_PAIRS} select a || ',' || b as items, n from pairs union all select item, count(*)::bigint from rows group by 1 having count(*) >= (select s from least) union all ({_TRIPLES})")
def son_itemsets(spark, d):
    rows = _rows(spark, d)
    return _joined(itemsets.son(rows, _support(rows))[1].filter("size(items) <= 3"))


@query("fpgrowth_itemsets", f"with {_ROWS}, {_LEAST}, {_PAIRS} select a || ',' || b as items, n from pairs")
def fpgrowth_itemsets(spark, d):
    rows = _rows(spark, d)
    return _joined(itemsets.fp_growth(rows, _support(rows)).filter("size(items) = 2"))


_EVERY = f"with recursive {_ROWS}, {_LEAST}, held as (select basket, item as last, item as items from rows union all select h.basket, r.item, h.items || ',' || r.item from held h join rows r on h.basket = r.basket and r.item > h.last) select items, count(*)::bigint as n from held group by 1 having count(*) >= (select s from least)"


@query("son_itemsets_all", _EVERY)
def son_itemsets_all(spark, d):
    """Frequent itemsets of every size; ``son_itemsets`` shows those of up to three items."""
    rows = _rows(spark, d)
    return _joined(itemsets.son(rows, _support(rows))[1])


@query("fpgrowth_itemsets_all", _EVERY)
def fpgrowth_itemsets_all(spark, d):
    """Frequent itemsets of every size; ``fpgrowth_itemsets`` shows the pairs."""
    rows = _rows(spark, d)
    return _joined(itemsets.fp_growth(rows, _support(rows)))


_MEMBERS = "rows as (select distinct l_suppkey as item, o_custkey as member from lineitem join orders on l_orderkey = o_orderkey)"
_SIGNATURE = f"""coef as ({COEFFICIENTS_SQL.format(n=100)}), idx as (select member, dense_rank() over (order by member) - 1 as x from (select distinct member from rows)),
  m as (select count(*) as m from idx), sig as (select item, j::bigint as j, min(((a::hugeint * x + b) % 4294967311) % m)::bigint as minhash from rows join idx using (member) cross join coef cross join m group by 1, 2)"""
_JACCARD = """size as (select item, count(*) as n from rows group by 1), common as (select a.item as a, b.item as b, count(*) as c from rows a join rows b on a.member = b.member and a.item < b.item group by 1, 2),
  jac as (select common.a, common.b, c / (x.n + y.n - c) as similarity from common join size x on common.a = x.item join size y on common.b = y.item)"""
#: Least similarity of two suppliers' customer sets.
SIMILAR = 0.2


def _members(spark, d):
    from quarry.plans.roles import reviews

    return reviews(spark, d).select("item_id", "user_id").distinct()


@query("minhash_signature", f"with {_MEMBERS}, {_SIGNATURE} select item, j, minhash from sig")
def minhash_signature(spark, d):
    return similarity.signatures(_members(spark, d), "item_id", "user_id")


@query("lsh_candidate_pairs", f"with {_MEMBERS}, {_SIGNATURE} select distinct p.item as a, q.item as b from sig p join sig q on p.j = q.j and p.minhash = q.minhash and p.item < q.item")
def lsh_candidate_pairs(spark, d):
    return similarity.candidate_pairs(similarity.signatures(_members(spark, d), "item_id", "user_id"))


@query(
    "lsh_similar_pairs",
    f"with {_MEMBERS}, {_SIGNATURE}, {_JACCARD}, cand as (select distinct p.item as a, q.item as b from sig p join sig q on p.j = q.j and p.minhash = q.minhash and p.item < q.item) select a, b, round(similarity, 6) as similarity from cand join jac using (a, b) where similarity >= {SIMILAR}",
)
def lsh_similar_pairs(spark, d):
    return similarity.similar_pairs(_members(spark, d), "item_id", "user_id", SIMILAR).withColumn("similarity", F.round("similarity", 6))


@query("jaccard_pairs", f"with {_MEMBERS}, {_JACCARD} select a, b, round(similarity, 6) as similarity from jac")
def jaccard_pairs(spark, d):
    return similarity.all_jaccard(_members(spark, d), "item_id", "user_id").withColumn("similarity", F.round("similarity", 6))


# Sketches over the event stream: user ids in order of event id, 100 events a batch.

_STREAM = "stream as (select event_id as seq, user_id::varchar as value, event_id // 100 as batch from events)"
_HORNER = "list_reduce(list_prepend(0::bigint, list_transform(range(1, length(hex(value)) // 2 + 1), lambda i: ('0x' || substring(hex(value), (2 * i - 1)::int, 2))::bigint)), lambda p, q: (p * 256 + q) % 4294967311)"
BITS, BLOOM_HASHES = 997, 3


def _stream(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("value"), F.floor(F.col("event_id") / 100).alias("batch"))


_BLOOM = f"""with {_STREAM}, coef as ({COEFFICIENTS_SQL.format(n=BLOOM_HASHES)}), f as (select value, min(seq) as first, any_value({_HORNER}) as x from stream group by 1),
    spot as (select value, first, j, ((a::hugeint * x + b) % 4294967311 % {BITS})::bigint as position from f cross join coef),
    ready as (select value, max(s) as ready from spot join (select position, min(first) as s from spot group by 1) using (position) group by 1)"""
_SEEN = "select seq, value, batch::bigint as batch, ready < seq as seen from stream join ready using (value)"


@query("bloom_seen", f"{_BLOOM} {_SEEN}")
def bloom_seen(spark, d):
    return sketches.bloom_seen(_stream(spark, d), "seq", "value", BITS, BLOOM_HASHES).select("seq", "value", "batch", "seen")


@query(
    "bloom_ratios",
    f"""{_BLOOM}, marked as (select *, min(seq) over (partition by value) = seq as fresh from ({_SEEN})),
    firsts as (select batch, value, min_by(seen, seq) as seen, min_by(fresh, seq) as fresh from marked group by 1, 2)
    select batch, count(*)::bigint as n_distinct, avg(seen::int::double) as seen_ratio, coalesce(avg(seen::int::double) filter (fresh), 0.0) as false_positive_rate from firsts group by 1""",
)
def bloom_ratios(spark, d):
    return sketches.seen_ratios(bloom_seen(spark, d), "seq", "value", "batch")


@query(
    "fm_estimate",
    f"""with {_STREAM}, coef as ({COEFFICIENTS_SQL.format(n=100)}), u as (select distinct batch, value from stream), x as (select batch, value, {_HORNER} as x from u),
    h as (select batch, j, ((a::hugeint * x + b) % 4294967311 % 300)::bigint as h from x cross join coef),
    r as (select batch, j, max(case when h = 0 then 6 else bit_count((h & -h) - 1) end) as r from h group by 1, 2),
    g as (select batch, j // 20 as g, avg(pow(2.0, r)) as mean from r group by 1, 2)
    select batch::bigint as batch, n_distinct, median(mean) as estimate from g join (select batch, count(*)::bigint as n_distinct from u group by 1) using (batch) group by 1, 2""",
)
def fm_estimate(spark, d):
    return sketches.flajolet_martin(_stream(spark, d), "batch", "value")


@query("hll_estimate")
def hll_estimate(spark, d):
    return sketches.hll(_stream(spark, d), "batch", "value")


@query("reservoir_sample", f"with {_STREAM} select seq, value, batch::bigint as batch from stream order by md5(seq::varchar || '-553'), seq limit 100")
def reservoir_sample(spark, d):
    return sketches.reservoir(_stream(spark, d), "seq")


@query("reservoir_history")
def reservoir_history(spark, d):
    return sketches.reservoir_history(_stream(spark, d), "seq", "value")


@query("running_counts", "select event_id, user_id, count(*) over (partition by user_id order by event_id)::bigint as n_so_far from events")
def running_counts(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.count("*").over(Window.partitionBy("user_id").orderBy("event_id")).alias("n_so_far"))
