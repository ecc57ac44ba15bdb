"""Frequent itemsets: baskets, level-wise Apriori, two-pass partitioned mining, FP-growth.

Items compare as texts.  Itemsets are sorted arrays.  A basket counts once for
an itemset, however often a row repeats.  Supports are whole numbers of baskets.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import joined_key, strip_leading_zeros, unquote
from quarry.sources.scratch import cut


def rows_of(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item) rows without nulls; items as texts."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item"))
    return rows.filter("basket is not null and item is not null").distinct()


def baskets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def longest_basket(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.count_distinct("item").alias("n")).agg(F.max("n").alias("longest"))


def transaction_rows(df: DataFrame, date: str, customer: str, product: str) -> DataFrame:
    """(basket, item): ``date-customer`` without the customer's leading zeros, and the product as a number."""
    who = strip_leading_zeros(unquote(F.col(customer)))
    return df.select(joined_key(unquote(F.col(date)), who).alias("basket"), unquote(F.col(product)).cast("long").alias("item"))


def larger_than(rows: DataFrame, k: int) -> DataFrame:
    """Rows of baskets with more than ``k`` distinct items."""
    big = rows.groupBy("basket").agg(F.count_distinct("item").alias("n")).filter(F.col("n") > k).select("basket")
    return rows.join(big, "basket", "left_semi")


def singletons(rows: DataFrame, support: int) -> DataFrame:
    return rows.groupBy("item").agg(F.count_distinct("basket").alias("n")).filter(F.col("n") >= support)


def _candidates(level: DataFrame, k: int) -> DataFrame:
    """Itemsets of size k whose subsets of size k - 1 are all in ``level`` (prefix self-join, then subset test)."""
    a = level.select("items", F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    b = a.select("prefix", F.col("last").alias("next"))
    made = a.join(b, "prefix").filter("last < next").select(F.concat("items", F.array("next")).alias("items"))
    if k == 2:
        return made
    parts = made.withColumn("sub", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(k))))))
    found = parts.join(level.select(F.col("items").alias("sub")), "sub", "left_semi")
    return found.groupBy("items").count().filter(F.col("count") == k).select("items")


def _weighted(rows: DataFrame) -> DataFrame:
    """(basket, item, times): baskets of the same items as one, named by their items, with their number."""
    sets = cut(baskets(rows).groupBy("items").agg(F.count("*").alias("times")), "baskets")
    return sets.select(F.col("items").alias("basket"), F.explode("items").alias("item"), "times")


def apriori(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(items, n): all itemsets in at least ``support`` baskets, level by level.

    Equal baskets are taken once with their number.  A level's occurrences (basket,
    itemset) grow by larger items of the same basket, kept only where the result is a
    candidate; so a basket is never tested against itemsets it cannot hold, and no pair
    of unrelated items is made.
    """
    rows = _weighted(rows)
    one = rows.groupBy("item").agg(F.sum("times").alias("n")).filter(F.col("n") >= support)
    level = cut(one.select(F.array("item").alias("items"), "n"), "level")
    if max_size == 1:
        return level
    rows = cut(rows.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi"), "rows")
    held = rows.select("basket", "times", F.array("item").alias("items"))
    out, k = level, 1
    while (max_size is None or k < max_size) and level.limit(2).count() > 1:
        k += 1
        wanted = cut(_candidates(level.select("items"), k), "candidates")
        grown = held.alias("h").join(rows.select("basket", "item").alias("r"), "basket").filter(F.col("r.item") > F.element_at("h.items", -1))
        grown = grown.select("basket", "times", F.concat("h.items", F.array("r.item")).alias("items")).join(wanted, "items", "left_semi")
        grown = cut(grown, "held")
        level = cut(grown.groupBy("items").agg(F.sum("times").alias("n")).filter(F.col("n") >= support), "level")
        held = grown.join(level.select("items"), "items", "left_semi")
        out = out.unionByName(level)
    return out


def _local(support: int, total: int):
    """Itemsets frequent within one part: each item's baskets are the bits of one integer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {b: i for i, b in enumerate(pdf["basket"].unique())}
        least = max(1, ceil(support * len(place) / total))
        bits: dict[tuple, int] = {}
        for basket, item in zip(pdf["basket"], pdf["item"], strict=True):
            bits[(item,)] = bits.get((item,), 0) | 1 << place[basket]
        level = {c: x for c, x in bits.items() if x.bit_count() >= least}
        found: list[tuple] = []
        while level:
            found += level
            tails: dict[tuple, list] = {}
            for c in level:
                tails.setdefault(c[:-1], []).append(c[-1])
            grown = {}
            for head, ends in tails.items():
                for a, b in combinations(sorted(ends), 2):
                    both = level[(*head, a)] & level[(*head, b)]
                    if both.bit_count() >= least:
                        grown[(*head, a, b)] = both
            level = grown
        return pd.DataFrame({"items": [list(c) for c in found]})

    return run


def _recount(wanted: list[tuple]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {b: i for i, b in enumerate(pdf["basket"].unique())}
        bits: dict[str, int] = {}
        for basket, item in zip(pdf["basket"], pdf["item"], strict=True):
            bits[item] = bits.get(item, 0) | 1 << place[basket]
        out = []
        for c in wanted:
            both = bits.get(c[0], 0)
            for item in c[1:]:
                both &= bits.get(item, 0)
            if both:
                out.append((list(c), both.bit_count()))
        return pd.DataFrame(out, columns=["items", "n"])

    return run


def son(rows: DataFrame, support: int, parts: int | None = None, small: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Two passes: itemsets frequent in some part of the baskets, then a true recount.

    Returns (candidates, frequent).  A part is a bounded slice of the baskets by hash;
    with more data there are more parts, so a part always fits a task.  Up to ``small``
    candidates travel with the tasks of the second pass; more are matched by a join.
    """
    total = rows.select("basket").distinct().count()
    parts = parts or max(1, ceil(total / 20_000))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("basket"), F.lit(parts)))
    local = dealt.groupBy("part").applyInPandas(_local(support, max(1, total)), "items array<string>")
    candidates = cut(local.distinct(), "candidates")
    if candidates.limit(small + 1).count() <= small:
        wanted = [tuple(r["items"]) for r in candidates.collect()]
        counts = dealt.groupBy("part").applyInPandas(_recount(wanted), "items array<string>, n long")
    else:
        each = candidates.select("items", F.explode("items").alias("item"), F.size("items").alias("k"))
        held = rows.join(each, "item").groupBy("items", "k", "basket").agg(F.count("*").alias("hits")).filter("hits = k")
        counts = held.groupBy("items").agg(F.count("*").alias("n"))
    return candidates, counts.groupBy("items").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)


def fp_growth(rows: DataFrame, support: int) -> DataFrame:
    """The same itemsets by MLlib's parallel FP-growth, which reads the baskets several times: they are written once."""
    from pyspark.ml.fpm import FPGrowth

    sets = cut(baskets(rows), "baskets")
    total = max(1, sets.count())
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / total)).fit(sets).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
