from pyspark.sql import functions as F

from quarry.functions import hashing, scalar


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_hashes_match_big_integers(spark):
    words = ["a", "user-17", "héllo wörld", "0123456789abcdef", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["x"] for r in df.select(hashing.text_to_int_mod(F.col("w")).alias("x")).collect()]
    assert got == [int.from_bytes(w.encode(), "big") % hashing.PRIME for w in words]
    a, b = hashing.PRIME - 2, 977
    got = [r["x"] for r in df.select(hashing.universal_hash(F.lit(2**62 + 11), F.lit(a), F.lit(b), 300).alias("x")).collect()]
    assert set(got) == {(a * (2**62 + 11) + b) % hashing.PRIME % 300}


def test_trailing_zeros(spark):
    got = spark.range(0, 9).select(hashing.trailing_zeros(F.col("id"), 6).alias("z")).collect()
    assert [r["z"] for r in got] == [6, 0, 1, 0, 2, 0, 1, 0, 3]


def test_hash_count():
    assert hashing.optimal_hash_count(69_997, 30_000) == 2
    assert hashing.optimal_hash_count(1, 10**9) == 1


def test_strip_keeps_inner_and_trailing_zeros(spark):
    df = spark.createDataFrame([("00100",), ("100",), ("1",), ("000",), (None,)], "s string")
    assert [r["x"] for r in df.select(scalar.strip_leading_zeros(F.col("s")).alias("x")).collect()] == ["100", "100", "1", "0", None]


def test_rounding_is_half_even(spark):
    assert one(spark, scalar.nearest_half(F.col("v")), v=2.25) == 2.0
    assert one(spark, scalar.nearest_half(F.col("v")), v=2.75) == 3.0


def test_attributes(spark):
    values = {"A": "False", "B": "True", "C": "", "P": "{'garage': True, u'lot': False, 'valet': None}"}
    df = spark.createDataFrame([(values,), (None,)], "m map<string,string>")
    m = F.coalesce("m", F.create_map().cast("map<string,string>"))
    cols = [scalar.attr_present(m, k) for k in "ABCZ"] + [scalar.attr_true(m, k) for k in "AB"] + [scalar.literal_flag(m["P"], k) for k in ("garage", "lot", "valet", "none")]
    got = df.select(*[c.alias(str(i)) for i, c in enumerate(cols)]).collect()
    assert tuple(got[0]) == (1, 1, 0, 0, 0, 1, 1, 0, 0, 0)
    assert set(got[1]) == {0}
    assert len(scalar.attribute_features(m)) == 30


def test_sets_and_bands(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r["j"] for r in df.select(scalar.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0]
    assert df.select(scalar.bands(F.col("a"), 2).alias("x")).first()["x"] == [[1, 2], [3]]
    assert [tuple(p) for p in df.select(scalar.pairs(F.col("a")).alias("x")).first()["x"]] == [(1, 2), (1, 3), (2, 3)]
    assert df.select(scalar.contains_all(F.col("a"), F.array(F.lit(1), F.lit(3))).alias("x")).first()["x"]
