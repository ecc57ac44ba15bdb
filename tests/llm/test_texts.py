"""Language ID, personal data, mixing and packing."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import _tokens, langid, mixing, packing, pii, queries

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_language_accuracy_on_held_out_documents(spark):
    got = queries.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id])
    assert (held == got.held_out).all()
    assert (got[held].lang == got[held].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def brute_decode(model, raw):
    """Loss-weighted decoding with plain loops over the n-grams of one text."""
    from quarry.llm import _grams

    text = b"    " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in raw) + b"    "
    share = {}
    for n in _grams.ORDERS:
        for i in range(len(text) - n + 1):
            at = int.from_bytes(text[i : i + n], "big") * 2654435761 % 2**32 >> 19
            share[at] = share.get(at, 0) + 1
    whole, losses = sum(share.values()), []
    margin = [sum(c / whole * langid.SCALE * float(model.weights[at, bit]) for at, c in share.items()) + float(model.bias[bit]) for bit in range(model.code.shape[1])]
    for word, trust in zip(model.code, model.trust, strict=True):
        losses.append(sum(float(t) * np.log1p(np.exp(-float(c) * m)) for c, t, m in zip(word, trust, margin, strict=True)))
    return losses


def test_decoding_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null and lang is not null").toPandas()
    model = langid.fit([t.encode() for t in docs.text[:100]], list(docs.lang[:100]))
    raws = [t.encode()[:4000] for t in docs.text[100:140]] + [b"a", b"the of and"]
    best, score, lead = langid.decode(model, raws)
    for k, raw in enumerate(raws):
        losses = brute_decode(model, raw)
        p = np.exp(-4 * (np.array(losses) - min(losses)))
        p = np.sort(p / p.sum())
        assert score[k] == pytest.approx(p[-1], abs=1e-3) and lead[k] == pytest.approx(p[-1] - p[-2], abs=2e-3)
        assert losses[best[k]] == pytest.approx(min(losses), abs=1e-4)


def test_training_sample_is_bounded_and_the_same_in_every_run(spark):
    rows = [(i % 50, f"text {i}", "ab"[i % 2]) for i in range(400)]
    take = lambda n: [tuple(r) for r in langid.sample(spark.createDataFrame(rows, "k long, t string, l string").repartition(n), "l", "t", "k", 20, 5, 100)]
    assert take(1) == take(7) and 0 < len(take(3)) <= 80
    with pytest.raises(ValueError):
        langid.sample(spark.createDataFrame(rows, "k long, t string, l string"), "l", "t", "k", 20, 1, 100)


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the and of that with", "en"), (2, "le et que des pour", "fr"), (3, None, "de"), (4, "xx", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 34 !!", 5), (4, "the of and", 5), (4, "the of and", 5), (5, "le et " * 100_000, 5)], "doc_id long, text string, SCORE int")
    got = {r["doc_id"]: r for r in langid.identify(docs, train).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "en" and got[5]["lang_pred"] == "fr"
    assert langid.identify(docs, train.limit(0)).filter("lang_pred <> 'und'").isEmpty()
    assert langid.identify(docs.limit(0), train).count() == 0


def test_codebook_separates():
    for n in (2, 3, 4, 5, 9):
        code = langid.codebook(n)
        far = ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)]
        assert far.min() >= 1


KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted(((m.start(), m.end(), k) for k, p in KINDS.items() for m in p.finditer(text) if ok(k, m[0])), key=lambda x: (x[0], list(KINDS).index(x[2])))


def test_base_spans_equal_plain_patterns(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("0123456789019..@+-() ab%") for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["1" * 30 + ".2.3.4", "a@b@c.de", "x" * 2000 + "@y.z", "+1 (234) 567-8901 4111111111111111", "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_edges(spark):
    docs = [(1, None), (2, ""), (3, "no data here"), (4, "é\U0001f600 joe@x.org é"), (4, "é\U0001f600 joe@x.org é"), (5, "x " * 200_000 + "10.0.0.1"), (6, "call (555) 123-4567 now, or 4111.1111.1111.1111")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, SPANS int")
    got = {r["doc_id"]: r for r in pii.find(df, redact=True).collect()}
    assert got[1]["text"] is None and got[1]["spans"] == [] and got[3]["spans"] == []
    assert got[4]["text"] == "é\U0001f600 [EMAIL] é" and [(s["start"], s["end"]) for s in got[4]["spans"]] == [(3, 12)]
    assert got[5]["spans"][0]["start"] == 400_000
    assert [s["kind"] for s in got[6]["spans"]] == ["phone", "card"] and not any(s["base"] for s in got[6]["spans"])
    assert pii.find(df.limit(0)).count() == 0


def test_runs_are_closed_by_the_tagger_at_every_place():
    class Lines:  # tags whole lines as e-mail, surely
        def marginals(self, ids):
            return np.eye(1 + 2 * len(pii.KINDS))[np.where((ids == 0) | (ids == 6), 0, 2)]

    def found(model, address, between):
        for k in range(64):
            text = (between * 200)[: 99 + k] + between[-1] + address + between[-1] + (between[::-1] * 100)[:200]
            got = pii.added_spans(model, [text], [pii.base_spans(text)])[0]
            yield [(100 + k, 100 + k + len(address), "email")] == [x[:3] for x in got]

    assert all(found(Lines(), "b" * 150 + " @ " + "c" * 150 + ".org", "\n"))
    assert all(found(pii.fit(), "name @ mailserver.example.com", "the one then "))
    end = "\n" * 100 + "b" * 150 + " @ " + "c" * 150 + ".org"
    assert [x[:2] for x in pii.added_spans(Lines(), [end, end[100:]], [[], []])[0] + pii.added_spans(Lines(), [end[100:]], [[]])[0]] == [(100, 407), (0, 307)]


def test_tagger_on_held_out_spans():
    ids, tags = pii.windows_of(pii.labelled_spans(200, 4242))
    found = pii.fit().marginals(ids).argmax(2)
    assert (found == tags).mean() > 0.97 and (found == tags)[tags > 0].mean() > 0.9


def test_tagger_finds_the_base_spans_of_documents(spark):
    """The tagger alone, on texts that its generator did not write."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null and length(text) < 20000").limit(3000).collect()]
    own, hit, base = pii.added_spans(pii.fit(), texts, [[] for _ in texts]), {}, {}
    for text, found in zip(texts, own, strict=True):
        for a, b, kind in pii.base_spans(text):
            base[kind] = base.get(kind, 0) + 1
            hit[kind] = hit.get(kind, 0) + any(x[0] < b and a < x[1] and x[2] == kind for x in found)
    print("found by the tagger alone", hit, "of", base)
    assert all(hit[k] > 0.9 * n for k, n in base.items()) and sum(base.values()) > 100


def test_gradients_of_the_tagger():
    from quarry.llm._bilstm import Tagger

    rng = np.random.default_rng(0)
    model = Tagger(5, 3, embed=3, hidden=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, tags = rng.integers(0, 5, (6, 2)), rng.integers(0, 3, (6, 2))

    def loss():
        emit = model._forward(ids)[-1]
        total = 0.0
        for b in range(2):
            path = model.p["s"][tags[0, b]] + emit[np.arange(6), b, tags[:, b]].sum() + sum(model.p["t"][tags[t - 1, b], tags[t, b]] for t in range(1, 6))
            total += model._chain(emit)[2][b] - path
        return total / 2

    grad = model._step(ids, tags)
    for name in model.p:
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        model.p[name][at] += 1e-3
        up = loss()
        model.p[name][at] -= 2e-3
        down = loss()
        model.p[name][at] += 1e-3
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-2)


def test_mixing_meets_its_targets(spark):
    got = queries.op3_mixing(spark, DATA).toPandas()
    total = got.n_tokens.sum()
    for d, w in queries.TARGETS.items():
        assert (got.n_tokens * got[f"p_{d}"] * got.rate).sum() / total == pytest.approx(w, abs=2e-3)
    assert (got.rate >= 0).all() and got.gap.nunique() == 1 and got.gap[0] <= 1e-4


def test_mixing_of_targets_out_of_reach_is_the_least_squares_solution(spark):
    labels = spark.createDataFrame([(i, "the and of " * 5, "en") for i in range(5)] + [(9 + i, "le et que " * 5, "fr") for i in range(5)], "doc_id long, text string, domain string")
    docs = spark.createDataFrame([(i, "the and of it " * (i + 1)) for i in range(4)] + [(5, "the le and et"), (6, "of le que")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="missed"):
        out = mixing.mix(docs, labels, {"en": 0.05, "fr": 0.95}, total_factor=3.0, least=1.0).toPandas()
    p = np.array([[m["en"], m["fr"]] for m in out.posteriors])
    a = (p * out.n_tokens.to_numpy()[:, None]).T / out.n_tokens.sum()  # domain, document
    half = np.linalg.cholesky(np.linalg.inv((p * out.n_tokens.to_numpy()[:, None]).T @ p / out.n_tokens.sum())).T
    goal = np.array([0.05, 0.95]) * 3.0
    best = 1.0 + packing.nnls(half @ a, half @ (goal - a.sum(1)))
    off = lambda r: float(np.sum((half @ (a @ r - goal)) ** 2))
    assert off(out.rate.to_numpy()) == pytest.approx(off(best), rel=1e-3) and (out.rate >= 1).all()
    assert out.gap[0] == pytest.approx(np.abs(a @ out.rate.to_numpy() - goal).max(), abs=1e-6)


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(i, "the and of " * 5, "en") for i in range(5)] + [(9 + i, "le et que " * 5, "fr") for i in range(5)], "doc_id long, text string, domain string")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the of and the", "x"), (3, "the of and the", "x"), (None, "et le que", "x")], "doc_id long, text string, Rate string")
    out = mixing.mix(docs, labels, {"en": 0.5, "fr": 0.5}).toPandas()
    assert len(out) == 5 and out.n_tokens.tolist().count(0) == 2 and out.rate.notna().all()
    twice = out[out.doc_id == 3].rate
    assert twice.nunique() == 1
    least = mixing.mix(docs, labels, {"en": 0.5, "fr": 0.5}, total_factor=None, least=1.0).toPandas()
    assert (least.rate >= 1).all()
    assert mixing.mix(docs.limit(0), labels, {"en": 1.0, "fr": 1.0}).count() == 0
    unlabelled = mixing.mix(docs, labels.limit(0), {"en": 1.0}).toPandas()
    assert unlabelled.rate.tolist() == [1.0] * 5 and not any(unlabelled.posteriors)
    assert mixing.mix(docs, labels.limit(0), {}, total_factor=None, least=2.0).toPandas().rate.tolist() == [2.0] * 5
    with pytest.raises(ValueError):
        mixing.mix(docs, labels, {"xx": 1.0})


def test_tokens_equal_the_library():
    tok = _tokens.Tokeniser(queries.tokenizer_path(), cap=50)
    odd = ["don't stop", "Ünï ÇÖDÉ 12,5 'tis 'S x'll \x1c İstanbul Σας <|endoftext|> a<|b", "", "  ", "!!'s '' \"'re\"", "aΣ e\u0301", "x" * 3000]
    for texts in (odd, odd[::-1], ["the quick"] * 3, [f"w{i} z" for i in range(200)], odd):
        flat, n = tok.encode(texts)
        want = [e.ids for e in tok.whole.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_tokens_of_other_files_go_through_the_library():
    import public_tokenizers

    tok = _tokens.Tokeniser(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["The quick Brown fox", "don't  stop\n12"]
    flat, n = tok.encode(texts)
    want = [e.ids for e in tok.whole.encode_batch(texts, add_special_tokens=False)]
    assert not tok.by_word and n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def check_packing(got, lengths, capacity):
    pieces = got.sort_values(["sequence_id", "offset"])
    for _, seq in pieces.groupby("sequence_id"):
        ends = (seq.offset + seq.length).tolist()
        assert seq.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= capacity


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    got = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.tokenizer_path()).toPandas()
    check_packing(got, None, 4096)
    whole = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for doc, part in got.sort_values("piece").groupby("id"):
        ids = [*whole.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert [i for x in part.ids for i in x] == ids
        assert part.start.tolist() == list(range(0, len(ids), 4096)) and (part.length.iloc[:-1] == 4096).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in part.ids] == part.crc.tolist()
    assert got.sequence_id.nunique() <= got.length.sum() / 4096 + 1


def test_frequent_lengths_are_dealt_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3)
    docs = spark.createDataFrame([(i, "the cat" if i % 5 else "the cat " * 5000) for i in range(60)], "doc_id long, text string").repartition(3)
    got = packing.pack(docs, queries.tokenizer_path(), keep_ids=False).toPandas()
    assert got.id.nunique() == 60 and got.groupby("id").length.sum().isin([3, 10001]).all()
    check_packing(got, None, 4096)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "the cat " * 6000), (None, "x")]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer_path(), keep_ids=False).toPandas()
    assert len(got) == 5 + 3 and got[got.id == 1].length.tolist() == [1]
    check_packing(got, None, 4096)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


def test_plan_places_every_piece_once():
    r = random.Random(6)
    for hist in ({4096: 3}, {1: 10_000}, {2049: 7}, {r.randint(1, 4096): r.randint(1, 50) for _ in range(400)}, {}):
        rows, n = packing.plan(dict(hist))
        seen, fill = {}, {}
        for length, first, count, seq, per, offset in rows.tolist():
            for k in range(count):
                seen.setdefault(length, set()).add(first + k)
                fill.setdefault(seq + k // per, []).append((offset + k % per * length, length))
        assert {k: len(v) for k, v in seen.items()} == hist and all(v == set(range(hist[k])) for k, v in seen.items())
        assert len(fill) == n
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        if hist:
            assert n <= 1.05 * sum(k * v for k, v in hist.items()) / 4096 + max(1, hist.get(2049, 0))


def test_patterns_never_cost_sequences():
    r = random.Random(8)
    for top in (400, 1500, 4096):
        for _ in range(6):
            hist = {r.randint(1, top): r.randint(1, 30) for _ in range(r.randint(5, 300))}
            alone = packing._filled(hist, [], 4096, 128)[1]
            assert packing.plan(hist)[1] <= alone


def test_nnls_equals_enumeration():
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 4)), rng.random(6)
    best = min((float(np.sum((a[:, s] @ (z := np.linalg.lstsq(a[:, s], b, rcond=None)[0]) - b) ** 2)), s) for m in range(1, 16) if (s := [i for i in range(4) if m >> i & 1]) and (np.linalg.lstsq(a[:, s], b, rcond=None)[0] >= 0).all())
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.sum((a @ x - b) ** 2) == pytest.approx(best[0], abs=1e-9)


def test_repeats_follow_the_rate(spark):
    got = spark.range(4000).select(mixing.repeats(F.lit(1.25), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1.25, abs=0.03) and tuple(got)[1:] == (1, 2)
