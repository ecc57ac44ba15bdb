"""Near-duplicate vectors and documents, repeated byte strings and the pipeline, against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import _memory, _shingles, _triggers, components, embedding_dedup, minhash_dedup, queries, substring_dedup

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    pairs += [(2500, i) for i in range(1000, 3600)] + [(450, 1700), (3600, 3601)]  # a hub
    u = Union()
    for a, b in pairs:
        if a != b:
            u.join(a, b)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: u.find(n) for n in u.p}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_links(rows):
    unit = {}
    for k, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = (x / np.linalg.norm(x), label)
    u, n = Union(), collections.Counter()
    keys = sorted(unit)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98:
                n[a] += 1
                n[b] += 1
                u.join(a, b)
    return {k: (n[k], u.find(k)) for k, _, _ in rows}


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 16 * 24 * 8}])
def test_vectors_equal_brute_force(spark, limits):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(4):
            centre = rng.standard_normal(24)
            for _ in range(30):
                rows.append((k, (centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.15])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k + i, rows[5][1], 0) for i in range(20)]  # copies
    k += 20
    rows += [(k, None, 0), (k + 1, [0.0] * 24, 0), (k + 2, [float("nan")] * 24, 0), (k + 3, [None] * 24, 0), (k + 4, rows[0][1], None), (k + 5, [], 0), (k + 6, [1e30] * 24, 1), (k + 7, [2e30] * 24, 1), (k + 8, [1.0, 2.0], 0), (k + 9, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, KEPT int")
    want = brute_links([(a, None if v is None else v, c) for a, v, c in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(df, **limits).collect()}
    assert got == want


def test_vectors_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link(empty).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0)] * 2 + [(None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.link(twice).collect()
    assert len(got) == 3 and all(r["kept"] for r in got)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    near = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02], [0.0, 1.0]]
    rows = [(1, near[0], 0), (1, near[1], 0), (2, near[2], 0), (2, near[3], 0), (3, near[2], 0)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    have = sorted((r["vec_id"], r["embedding"][1], r["n_links"], r["component_id"]) for r in got)
    assert have == [(1, 0.0, 3, 1), (1, 0.01, 3, 1), (2, 0.02, 3, 1), (2, 1.0, 0, 2), (3, 0.02, 3, 1)]


def test_register_agreement_estimates_the_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(1, 2**62, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(1, 2**62, 60, dtype=np.uint64)])
    wa, wb = rng.integers(1, 4, 300), rng.integers(1, 4, 300)
    wb[:240] = wa[:240]
    sig = [minhash_dedup.registers(np.zeros(300, np.int64), x, w, 1, 4096)[0] for x, w in ((a, wa), (b, wb))]
    oa, ob = np.argsort(a), np.argsort(b)
    assert (sig[0] == sig[1]).mean() == pytest.approx(_shingles.similarity(a[oa], wa[oa], b[ob], wb[ob]), abs=0.03)


def plain_similarity(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[k], y.get(e, 0) / y[k]) for e in keys) for k in set(x) & set(y))


def bag(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def near_docs():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, k = [], 0
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        if r.random() < 0.3:
            words = words[:20] * 4
        for _ in range(r.randint(1, 6)):
            new = list(words)
            for _ in range(r.randint(0, 4)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            docs.append((k, " ".join(new)))
            k += 1
    docs += [(k + i, docs[3][1]) for i in range(5)]
    k += 5
    return docs + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "a b"), (k + 4, "a  b"), (k + 5, "a b c d e"), (k + 6, "z " * 20_000), (k + 7, "z " * 19_000)]


def brute_classes(docs):
    u, bags = Union(), [(k, bag(t)) for k, t in docs]
    for i, (a, x) in enumerate(bags):
        u.find(a)
        for b, y in bags[i + 1 :]:
            if x and y and plain_similarity(x, y) >= 0.8:
                u.join(a, b)
    return {k: u.find(k) for k, _ in docs}


@pytest.mark.parametrize("limits", [{}, {"block": 3}, {"block_bytes": 1500}])
def test_near_documents_equal_brute_force(spark, limits):
    docs = near_docs()
    got = minhash_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string"), **limits).collect()
    assert {r["id"]: r["class_id"] for r in got} == brute_classes(docs)
    assert all(r["kept"] == (r["id"] == r["class_id"]) for r in got)


@pytest.mark.parametrize("room", [1, 1 << 20])
def test_alike_equals_all_pairs(room, monkeypatch):
    monkeypatch.setattr(minhash_dedup.common, "__defaults__", (room,))
    held = [minhash_dedup._contents(pa.array([t]), 5)[0] for _, t in near_docs()[:60]]
    left, right = np.arange(0, 60, 2), np.arange(60)
    able = (left[:, None] < right[None]) & (right % 7 > 0)[None]
    got = set(zip(*minhash_dedup.alike(held, able.copy(), left, right, 0.8), strict=True))
    want = {(i, j) for i, j in zip(*np.nonzero(able), strict=True) if _shingles.similarity(*held[left[i]], *held[right[j]]) >= 0.8}
    assert got == want and want


def test_spanning_tree_takes_the_heaviest_edges():
    keys = np.random.default_rng(2).integers(0, 2, (12, 20))
    child, parent = minhash_dedup.tree(keys)
    weight = (keys[:, None] == keys[None]).sum(2)
    heaviest, u = 0, Union()
    for _, i, j in sorted(((-weight[i, j], i, j) for i in range(12) for j in range(i))):
        if u.find(i) != u.find(j):
            heaviest += weight[i, j]
            u.join(i, j)
    assert len(child) == 11 and weight[child, parent].sum() == heaviest


def test_near_documents_edges(spark):
    assert minhash_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and [r["kept"] for r in got if r["id"] == 2] == [False] and [r["kept"] for r in got if r["id"] is None] == [True]


def test_repeated_ids_are_judged_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, b + " x"), (4, "c d e f g h")]
    got = {(r["id"], r["class_id"], r["kept"]) for r in minhash_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_similarity_equals_the_definition():
    r = random.Random(1)
    for _ in range(50):
        x = {k: r.randint(1, 4) for k in r.sample(range(12), 7)}
        y = {k: r.randint(1, 4) for k in r.sample(range(12), 7)}
        pack = lambda z: (np.array(sorted(z), np.uint64), np.array([z[k] for k in sorted(z)]))
        assert _shingles.similarity(*pack(x), *pack(y)) == pytest.approx(plain_similarity(x, y))


def brute_repeats(docs, n=50):
    first, out = {}, []
    for k, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            w = b[j : j + n]
            first.setdefault(w, k)
    for k, t in docs:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for j in range(len(b) - n + 1):
            f = first[b[j : j + n]]
            if f is not None and (k is None or f < k):
                mark[j : j + n] = b"\1" * n
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((k, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = df.select("doc_id", n, n - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def repeat_docs():
    r = random.Random(12)
    prose = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    passages = [prose(n) for n in (49, 50, 51, 60, 200, 1500)]
    docs = []
    for k in range(40):
        text = prose(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            text += r.choice(passages) + prose(r.randint(0, 80))
        docs.append((k, text))
    docs += [(40 + i, docs[i % 3][1]) for i in range(12)]
    docs += [(60, None), (61, ""), (62, "a" * 49), (63, "a" * 50), (64, "a" * 3000), (65, "b" + "a" * 400 + "c"), (66, "ab" * 100), (67, "ba" * 90), (None, docs[4][1]), (None, "a" * 60)]
    return docs


LIMITS = [{}, {"HOT_PHRASES": 2, "BLOCK": 256, "FLUSH_ROWS": 50}, {"WINDOWS": 40}]


@pytest.mark.parametrize("limits, parts", [(x, {}) for x in LIMITS] + [(LIMITS[1], {"bucket_bytes": 500, "most_parts": 3})])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, limits, parts):
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    docs = repeat_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, KEPT string, key int").repartition(5)
    assert digests(substring_dedup.remove_repeats(df, **parts)) == brute_repeats(docs)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 256, "FLUSH_ROWS": 50, "WINDOWS": 100}, {"_digest": lambda words, extra=0: words[:, 0] % np.uint64(2)}])
def test_parse_and_resolve_in_one_process(monkeypatch, limits):
    """Small blocks, and hashes that nearly always collide: bytes decide."""
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    docs = [d for d in repeat_docs() if d[0] is not None][:50]
    marked = {k: bytearray(len((t or "").encode())) for k, t in docs}
    packed = []
    for part in (docs[::2], docs[1::2]):
        batch = pa.record_batch({"key": [k for k, _ in part], "tkey": [0] * len(part), "text": [t for _, t in part]})
        packed += substring_dedup._parse(50, 3, False)([batch])
    rows = pa.Table.from_batches(packed).sort_by("bucket").to_batches()
    for batch in substring_dedup._resolve(50, False, True)(rows):
        for whole, key, _, lo, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            assert whole
            marked[key][lo : lo + n + 49] = b"\1" * (n + 49)
    got = [(k, len(m), sum(m)) for k, m in marked.items()]
    assert sorted(got) == [x[:3] for x in sorted(brute_repeats(docs))]


def test_corpus_order_is_the_suffix_array():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, 9).astype(np.uint8)) for _ in range(60)]
    rows = np.zeros((60, 16), np.uint8)
    for k, t in enumerate(texts):
        rows[k, :9] = list(t)
    least = rng.integers(0, 1000, 60)
    phrase, j, first = substring_dedup.corpus_order(rows, np.full(60, 4), least, 6)
    suffixes = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(4):
            suffixes[t[i : i + 6]].append((k, i))
    got = [texts[k][i : i + 6] for k, i in zip(phrase, j, strict=True)]
    assert got == sorted(got) and sorted(zip(phrase, j, strict=True)) == sorted(x for v in suffixes.values() if len(v) > 1 for x in v)
    assert all(f == min(least[k] for k, _ in suffixes[s]) for s, f in zip(got, first, strict=True))


def test_repeated_rows_and_empty_table(spark):
    docs = [(3, "x" * 80), (3, "x" * 80), (3, "y" * 70 + "x" * 60), (1, "y" * 64), (9, "y" * 64 + "x" * 64)]
    assert digests(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_repeats(docs)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_triggers_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(3)
    a, b = rng.integers(97, 102, 400, dtype=np.uint8), rng.integers(97, 102, 300, dtype=np.uint8)

    def windows(block, span=50):
        _, lo, n, h, _ = _triggers.phrases(block, np.array([len(block)]), span, 16)
        assert (lo[1:] == lo[:-1] + n[:-1]).all() and n.sum() == len(block) - span + 1
        return {block[s + j : s + j + span].tobytes(): int(x) for s, m, x in zip(lo, n, h, strict=True) for j in range(m)}

    alone, inside = windows(a), windows(np.concatenate([b, a, b]))
    assert all(inside[w] == x for w, x in alone.items())


def test_whole_table_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op10_substring_dedup(spark, SMALL).collect()), key=str)
    assert got == brute_repeats(rows)


def test_pipeline(spark):
    import corpus_pipeline as p
    from quarry.llm import pii
    from quarry.llm.common import materialize

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out, seen = docs.columns, docs, []
    for k, (name, stage) in enumerate(p.STAGES):
        out = materialize(stage(spark, out, SMALL), f"test{k}")
        seen.append(out)
        if k + 1 < len(p.STAGES):
            assert out.columns == columns, name
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert ids[0] >= ids[1] == ids[2] == ids[3] == ids[4]
    kept = [(r["doc_id"], r["text"]) for r in seen[0].collect()]
    assert ids[1] == set(brute_classes(kept).values())
    assert not any(pii.base_spans(r["text"] or "") for r in seen[2].collect())
    copies = {r["doc_id"]: r["n"] for r in seen[3].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert min(copies.values()) >= 1
    pieces = seen[4].filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == copies


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = "the of and to in is that it for was on with as by this are " * 8 + " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "en", "s", 9), (1, good, "en", "s", 9), (None, good + " x", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        out = p.near_dedup(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert out.filter("doc_id = 1").count() == min(1, docs.count())
        assert p.redact_pii(spark, docs, SMALL).count() == docs.count()
        assert p.quality_rules(spark, docs, SMALL).filter("text is null or text = ''").count() == 0
        assert p.pack(spark, docs, SMALL).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()



def test_signatures_take_little_memory_and_leave_none():
    """A Python worker stays beside the JVM in the executor's memory."""
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(500)) for _ in range(1500)]  # 4 MB
    digests = [i.to_bytes(16, "big") for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(digests), pa.array(texts)], names=["id", "fold", "text"])
    tracemalloc.start()
    try:
        got = [k for b in _memory.trimmed(minhash_dedup._signatures(5, 32, 5))([batch]) for k in b.column("keys").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not _triggers._POWERS
    assert peak < 64 << 20, peak
    alone = [next(minhash_dedup._signatures(5, 32, 5)([batch.slice(i, 1)])).column("keys").to_pylist()[0] for i in (0, 700, 1499)]
    assert [got[i] for i in (0, 700, 1499)] == alone
