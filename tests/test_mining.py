import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quarry.operators import itemsets, similarity, sketches
from quarry.sources import writers


def make_rows(spark, n=120, seed=3):
    r = random.Random(seed)
    data = [(b, i) for b in range(n) for i in r.sample("abcdefgh", r.randint(1, 5))]
    data += data[:40]  # repeated rows count once
    return itemsets.rows_of(spark.createDataFrame(data, "b long, i string"), "b", "i")


def brute(rows, support):
    baskets = {}
    for r in rows.collect():
        baskets.setdefault(r["basket"], set()).add(r["item"])
    out = {}
    for k in range(1, 9):
        for c in combinations("abcdefgh", k):
            n = sum(set(c) <= s for s in baskets.values())
            if n >= support:
                out[c] = n
    return out


def test_itemsets_equal_brute_force(spark):
    rows = make_rows(spark)
    want = brute(rows, 14)
    as_dict = lambda df: {tuple(r["items"]): r["n"] for r in df.collect()}
    assert as_dict(itemsets.apriori(rows, 14)) == want
    candidates, frequent = itemsets.son(rows, 14, parts=3)
    assert as_dict(frequent) == want
    assert {tuple(r["items"]) for r in candidates.collect()} >= set(want)
    assert as_dict(itemsets.son(rows, 14, parts=3, small=0)[1]) == want
    assert as_dict(itemsets.fp_growth(rows, 14)) == want


def test_exact_support_is_kept(spark):
    data = [(b, "x" if b < 3 else f"y{b}") for b in range(297)]
    rows = itemsets.rows_of(spark.createDataFrame(data, "b long, i string"), "b", "i")
    assert [tuple(r) for r in itemsets.singletons(rows, 3).collect()] == [("x", 3)]


def test_transactions(spark):
    df = spark.createDataFrame([('"11/1/2000"', '"00100"', '"4710000"')] * 2, "d string, c string, p string")
    got = itemsets.transaction_rows(df, "d", "c", "p").first()
    assert tuple(got) == ("11/1/2000-100", 4710000)


def test_itemset_report(spark, tmp_path):
    rows = make_rows(spark, 30)
    got = itemsets.apriori(rows, 8)
    writers.write_itemset_report(got, got, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "Candidates:" and "Frequent Itemsets:" in lines
    assert lines[1].startswith("('a')")


def test_lsh_pairs_are_exact_jaccard_pairs(spark):
    r = random.Random(1)
    base = r.sample(range(200), 40)
    data = [(k, u) for k in range(12) for u in (base if k < 3 else r.sample(range(200), 40))]
    rows = spark.createDataFrame(data, "item long, user long")
    sets = {}
    for k, u in data:
        sets.setdefault(k, set()).add(u)
    want = {(a, b) for a, b in combinations(range(12), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {(x["a"], x["b"]) for x in similarity.similar_pairs(rows, "item", "user", 0.5).collect()}
    assert got == want


def test_jaccard_of_pairs_is_the_same_both_ways(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(k, u) for k in range(15) for u in r.sample(range(60), 20)], "item long, user long")
    want = {(x["a"], x["b"]): x["similarity"] for x in similarity.all_jaccard(rows, "item", "user").collect()}
    for n in (2, 105):
        pairs = spark.createDataFrame(sorted(want)[:n], "a long, b long")
        got = {(x["a"], x["b"]): x["similarity"] for x in similarity.jaccard_of_pairs(pairs, rows, "item", "user").collect()}
        assert got == {p: want[p] for p in sorted(want)[:n]}


def test_bloom_has_no_false_negatives(spark):
    r = random.Random(2)
    data = [(i, f"u{r.randint(0, 60)}") for i in range(400)]
    df = spark.createDataFrame(data, "seq long, value string")
    got = {x["seq"]: x["seen"] for x in sketches.bloom_seen(df, "seq", "value", 997, 3).collect()}
    before = set()
    for i, v in data:
        assert got[i] or v not in before
        before.add(v)
    ratios = sketches.seen_ratios(sketches.bloom_seen(df.withColumn("batch", F.floor(F.col("seq") / 100)), "seq", "value", 97, 2), "seq", "value", "batch").collect()
    assert len(ratios) == 4 and all(0 <= x["false_positive_rate"] <= 1 for x in ratios)


def test_distinct_estimate_is_near(spark):
    df = spark.range(900).select(F.floor(F.col("id") / 300).alias("batch"), F.concat(F.lit("user"), (F.col("id") % 150).cast("string")).alias("value"))
    for r in sketches.flajolet_martin(df, "batch", "value", buckets=4096, zero=0).collect():
        assert r["n_distinct"] == 150 and 60 < r["estimate"] < 400


def test_reservoir(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("value"))
    assert sketches.reservoir(df, "seq", 100).count() == 100
    got = sketches.reservoir_history(df, "seq", "value").orderBy("seqnum").collect()
    assert [r["seqnum"] for r in got] == list(range(100, 1001, 100))
    assert tuple(got[0])[1:] == ("0", "20", "40", "60", "80")
    for r in got:
        assert all(int(v) < r["seqnum"] for v in tuple(r)[1:])


def test_registered_miners_return_every_size(spark):
    from quarry.plans import mining

    rows = mining._rows(spark, "/root/testdata/sf0.001")
    sets, least = {}, mining._support(rows)
    for r in rows.collect():
        sets.setdefault(r["basket"], set()).add(r["item"])
    counts = Counter(c for s in sets.values() for k in range(1, len(s) + 1) for c in combinations(sorted(s), k))
    want = {",".join(c): n for c, n in counts.items() if n >= least}
    assert max(i.count(",") for i in want) >= 3
    for q in (mining.son_itemsets_all, mining.fpgrowth_itemsets_all):
        assert {r["items"]: r["n"] for r in q(spark, "/root/testdata/sf0.001").collect()} == want


def test_registered_miner_leaves_parts_to_the_operator(spark, monkeypatch):
    from quarry.plans import mining

    asked, son = [], itemsets.son
    monkeypatch.setattr(itemsets, "son", lambda *a, **b: asked.append(b.get("parts")) or son(*a, **b))
    for q in (mining.son_itemsets, mining.son_itemsets_all):
        q(spark, "/root/testdata/sf0.001")
    assert asked == [None, None]


def test_least_hashes_run_on_from_batch_to_batch(spark):
    import numpy as np
    import pyarrow as pa

    from quarry.functions.hashing import PRIME, coefficients
    from quarry.operators import similarity

    rng = np.random.default_rng(4)
    items = np.sort(rng.integers(0, 6, 300))
    for top in (1 << 20, PRIME - 1):  # beyond 2 ** 30 products are taken in two steps
        index = rng.integers(0, top, 300)
        whole = pa.RecordBatch.from_arrays([pa.array(items), pa.array(index)], names=["item", "index"])
        for size in (300, 7, 1):
            out = [b for b in similarity._least(12, 977)(iter([whole.slice(i, size) for i in range(0, 300, size)]))]
            got = {i: m for b in out for i, m in zip(b.column("item").to_pylist(), b.column("minhashes").to_pylist(), strict=True)}
            assert sum(b.num_rows for b in out) == len(got) == 6
            for i in got:
                assert got[i] == [min((a * int(x) + b) % PRIME % 977 for x in index[items == i]) for _, a, b in coefficients(12)]


def test_similar_pairs_are_the_same_by_either_way(spark, monkeypatch):
    import random

    from quarry.operators import similarity

    r = random.Random(8)
    rows = spark.createDataFrame([(i, m) for i in range(14) for m in r.sample(range(30), 12)], "item long, member long")
    exact = {(x["a"], x["b"]): x["similarity"] for x in similarity.all_jaccard(rows, "item", "member").collect()}
    for band in (1, 2):
        signs = similarity.signatures(rows, "item", "member", 6)
        found = {(x["a"], x["b"]) for x in similarity.candidate_pairs(signs, band).collect()}
        want = {p: s for p, s in exact.items() if s >= 0.3 and p in found}
        assert 0 < len(want) < sum(s >= 0.3 for s in exact.values()) or band == 1
        for meetings in (0.0, 1e18):
            monkeypatch.setattr(similarity, "_meetings", lambda rows, n=meetings: n)
            assert {(x["a"], x["b"]): x["similarity"] for x in similarity.similar_pairs(rows, "item", "member", 0.3, 6, band).collect()} == want


def test_pairs_and_signatures_make_no_row_for_a_meeting(spark):
    from quarry.operators import similarity

    rows = spark.createDataFrame([(1, 1), (2, 1)], "item long, member long")
    plans = [similarity.signatures(rows, "item", "member")._jdf.queryExecution().optimizedPlan().toString(), similarity.all_jaccard(rows, "item", "member")._jdf.queryExecution().optimizedPlan().toString()]
    assert all("MapInArrow" in p for p in plans) and "inline" not in plans[0].lower()


def test_equal_baskets_are_one_row_with_their_number(spark):
    from quarry.operators import itemsets

    rows = spark.createDataFrame([(b, i) for b in range(60) for i in ("xyz" if b % 3 else "xz")] + [(0, "x")], "basket long, item string")
    assert {(tuple(r["basket"]), r["item"], r["times"]) for r in itemsets._weighted(rows).collect()} == {(("x", "z"), i, 20) for i in "xz"} | {(("x", "y", "z"), i, 40) for i in "xyz"}
    assert {("".join(r["items"]), r["n"]) for r in itemsets.apriori(rows, 30).collect()} == {("x", 60), ("y", 40), ("z", 60), ("xy", 40), ("xz", 60), ("yz", 40), ("xyz", 40)}


def test_fp_growth_reads_written_baskets(spark, monkeypatch):
    from quarry.operators import itemsets

    written, cut = [], itemsets.cut
    monkeypatch.setattr(itemsets, "cut", lambda df, tag="step": written.append(tag) or cut(df, tag))
    rows = spark.createDataFrame([(b, i) for b in range(4) for i in "xy"], "basket long, item string")
    assert itemsets.fp_growth(rows, 4).count() == 3 and written == ["baskets"]


def test_large_tables_are_not_written_by_one_task(spark, monkeypatch):
    from quarry.plans import registry
    from quarry.sources import writers

    monkeypatch.setattr(writers, "write_csv", None)
    for q in ("scan_csv_orientation", "scan_csv_staged"):
        assert registry.queries()[q](spark, "/root/testdata/sf0.001").count() > 0
