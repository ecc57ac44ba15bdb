import random

from pyspark.sql import functions as F

from quarry.operators import clustering
from quarry.sources import readers, writers
from quarry.streaming import sketches, windows


def test_bfr_finds_blobs(spark):
    r = random.Random(4)
    rows, k = [], 0
    for c, (x, y) in enumerate(((0, 0), (50, 0), (0, 50))):
        for _ in range(60):
            rows.append((k, [x + r.gauss(0, 1), y + r.gauss(0, 1), 1.0], c))
            k += 1
    rows += [(k, [500.0, 500.0, 1.0], -1), (k + 1, rows[0][1], 0)]
    points = spark.createDataFrame(rows, "point_id long, features array<double>, truth int")
    found, log = clustering.bfr(points, 3)
    got = {x["point_id"]: x["cluster"] for x in found.collect()}
    assert len(got) == len(rows)  # every point once
    for c in range(3):
        own = [got[p] for p, _, t in rows if t == c]
        main = max(set(own), key=own.count)
        assert main != -1 and own.count(main) >= 0.8 * len(own)
    last = log.orderBy(F.desc("round")).first()
    assert last["n_ds"] + last["n_cs"] + last["n_rs"] == len(rows)
    text = [x["line"] for x in writers.clustering_lines(log, found).collect()]
    assert text[0] == "The intermediate results:" and text[1].startswith("Round 1: ") and "The clustering results:" in text


def test_merged_stats_equal_stats_of_all(spark):
    points = spark.createDataFrame([(i, [float(i), 2.0 * i], i % 2) for i in range(10)], "point_id long, features array<double>, cluster long")
    a, b = points.filter("point_id < 4"), points.filter("point_id >= 4")
    whole = {r["cluster"]: (r["n"], r["total"], r["squares"]) for r in clustering.cluster_stats(points).collect()}
    both = clustering.merge_stats(clustering.cluster_stats(a), clustering.cluster_stats(b)).collect()
    assert {r["cluster"]: (r["n"], r["total"], r["squares"]) for r in both} == whole


def _folder(tmp_path, batches):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(batches):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "in")


def test_stateful_sketches(spark, tmp_path):
    path = _folder(tmp_path, [[f"u{i}" for i in range(50)], [f"u{i}" for i in range(25, 75)]])
    stream = readers.text_stream(spark, path)
    out = windows.run_available(sketches.bloom_stream(stream, "value", 9_973, 100), str(tmp_path / "c1")).toPandas()
    assert len(out) == 100 and out.seen.sum() >= 25
    out = windows.run_available(sketches.reservoir_stream(readers.text_stream(spark, path), "value", 10, 50, (0, 5)), str(tmp_path / "c2")).toPandas()
    assert sorted(out.seqnum.unique()) == [50, 100] and len(out) == 4
    got = sketches.micro_batches(readers.text_stream(spark, path), "value", str(tmp_path / "c3"))
    assert [r["n_distinct"] for r in sorted(got, key=lambda r: r["batch"])] == [50, 50]


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4.0, "date": "2018-01-02", "extra": 1}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.json"), "review").first()["stars"] == 4.0
    (tmp_path / "b.csv").write_text("user_id, business_id\nu1,b1\nu2,b1\n")
    assert {tuple(r) for r in readers.baskets_csv(spark, str(tmp_path / "b.csv"), 2).collect()} == {("b1", "u1"), ("b1", "u2")}
    (tmp_path / "n.csv").write_text("0,1,1.5,2.5\n")
    assert readers.numeric_csv(spark, str(tmp_path / "n.csv"), 2).first()["features"] == [1.5, 2.5]
    (tmp_path / "t.csv").write_text('"d","c","a","e","f","p"\n"11/1/2000","0001","x","y","z","0471"\n')
    assert tuple(readers.transactions_csv(spark, str(tmp_path / "t.csv")).first()) == ("11/1/2000", "0001", "0471")
    lines = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    got = readers.resampled_batches(lines, 3, 20).toPandas()
    assert len(got) == 60 and set(got["value"]) <= {"a", "b"} and got.groupby("batch").size().tolist() == [20, 20, 20]
    writers.write_json_object({"n_review": 3}, spark, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first()["n_review"] == 3
    writers.write_csv(lines, str(tmp_path / "o2"))
    assert spark.read.csv(str(tmp_path / "o2"), header=True).count() == 3


def test_streams_run_again_give_the_same_table(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("a\nb\n" * (k + 1))
    counts = sketches.counts_stream(readers.text_stream(spark, str(tmp_path / "in")), "value")
    for _ in range(2):
        assert {r["value"]: r["n"] for r in windows.run_available(counts, str(tmp_path / "c3"), "complete").collect()} == {"a": 6, "b": 6}


def test_short_numbers_do_not_share_their_hashes():
    from quarry.functions.hashing import coefficients

    family = coefficients(22)
    assert sketches._hashes("31040", family, 1 << 22) != sketches._hashes("1013", family, 1 << 22)
    assert len({tuple(sketches._hashes(str(i), family[:3], 1 << 40)) for i in range(40_000)}) == 40_000


def test_reservoir_draws_are_uniform_and_the_same_in_any_frame():
    import numpy as np

    n = np.arange(100_000)
    u, w = sketches._draws(553, 0, n)
    again = [sketches._draws(553, 0, n[i : i + 1]) for i in (0, 77, 99_999)]
    assert [(float(a[0]), float(b[0])) for a, b in again] == [(float(u[i]), float(w[i])) for i in (0, 77, 99_999)]
    for x in (u, w, sketches._draws(553, 1, n)[0]):
        assert 0 <= x.min() and x.max() < 1 and np.abs(np.histogram(x, 20, (0, 1))[0] / 5000 - 1).max() < 0.08
    assert abs(np.corrcoef(u, w)[0, 1]) < 0.02 and abs(np.corrcoef(u, sketches._draws(553, 1, n)[0])[0, 1]) < 0.02
