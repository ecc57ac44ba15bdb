"""Exact removal of byte strings that an earlier document already holds.

Method: prefix-free parsing.  Rolling-hash triggers cut every text into phrases
(``_triggers``); equal passages give equal phrases, so a dictionary of distinct
phrases and a parse, the phrases' occurrences in the corpus, stand for all texts.
Phrases overlap by ``min_len - 1`` bytes, so every window of ``min_len`` bytes lies
in one phrase, and equal windows lie in phrases of one trigger.  Each trigger's part
of the dictionary and of the parse is resolved on its own:

* the suffix array of the parse: occurrences in the order of their phrase and
  then of their document.  Order beyond one phrase cannot matter, as no window goes on
  into the next.  A phrase that also stands in an earlier document is removed whole;
* the suffix array of the dictionary: all suffixes of its phrases of at least
  ``min_len`` bytes in the order of their bytes, cut off after ``min_len``.  Suffixes whose
  hash occurs once cannot have an equal and are left out;
* corpus order: suffixes that agree in ``min_len`` bytes (compared as bytes) are
  neighbours, and the least of their phrases' first documents keeps the window.

Nothing is removed on the equality of hashes; they only bring candidates together.

Scale: texts are parsed where they are read; what is shuffled is the phrases, packed
by bucket of triggers, after each task has settled what its own documents repeat.
So a passage that many documents share reaches a bucket once for each task, however
often it stands.  A trigger with more than ``HOT_PHRASES`` different phrases is dealt out
window by window instead.  A bucket stands for ``bucket_bytes`` of text; beyond
``most_parts`` buckets a task takes several, one after the other.  Intermediate
decisions are written to the shared folder.

Defined results: a null or empty text has no bytes and nothing removed; texts
shorter than ``min_len`` are kept.  Rows with equal ids never remove each other's
bytes.  A null id counts as larger than all others.  Repeated rows give
repeated results.  Extra columns pass through; input columns named ``kept`` or
``spans`` give way.  Very long texts are parsed in overlapping blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _blobs, _triggers
from ._grams import groups
from ._memory import trimmed
from .common import materialize

TRIGGER = 16
BLOCK = 1 << 19
FLUSH_ROWS = 300_000
HOT_PHRASES = 16_384
WINDOWS = 400_000
LAST = 2**63 - 1

_FOUND = T.StructType(
    [
        T.StructField("whole", T.BooleanType()),
        T.StructField("key", T.LongType()),
        T.StructField("tkey", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
_PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def _blocks(batches, span: int):
    """Blocks of about BLOCK bytes: (bytes, ends, key, tkey and base offset of each piece)."""
    parts, meta, size = [], [], 0
    for batch in batches:
        keys, tkeys = batch.column("key").to_pylist(), batch.column("tkey").to_pylist()
        for key, tkey, text in zip(keys, tkeys, batch.column("text"), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else b""
            for base in range(0, max(0, len(raw) - span + 1), BLOCK):
                piece = raw[base : base + BLOCK + span - 1]
                parts.append(piece)
                meta.append((key, tkey, base))
                size += len(piece)
                if size >= BLOCK:
                    yield _laid(parts, meta)
                    parts, meta, size = [], [], 0
    if parts:
        yield _laid(parts, meta)


def _laid(parts, meta):
    ends = np.cumsum([len(p) for p in parts])
    key, tkey, base = (np.array(x, np.int64) for x in zip(*meta, strict=True))
    return np.frombuffer(b"".join(parts), np.uint8), ends, key, tkey, base


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal keys (rows are sorted by them)."""
    first = np.zeros(len(keys[0]), bool)
    if len(first):
        first[0] = True
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
    return first


_F = np.random.default_rng(41).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return rows.view(np.uint64)


def _digest(words: np.ndarray, extra: np.ndarray | int = 0) -> np.ndarray:
    total = np.zeros(len(words), np.uint64) + np.asarray(extra).astype(np.uint64) * _F[-1]
    for k in range(words.shape[1]):
        total += words[:, k] * _F[k]
    return _triggers.mix(total)


def _cut_rows(flat: np.ndarray, at: np.ndarray, width: int, size: np.ndarray | int) -> np.ndarray:
    """Rows of ``width`` bytes from each place, with zeros after the first ``size``."""
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    if np.ndim(size):
        rows[np.arange(width)[None] >= size[:, None]] = 0
    else:
        rows[:, size:] = 0
    return rows


def _width(span: int) -> int:
    """Bytes of a row that holds the longest phrase."""
    return -(-(2 * span - TRIGGER) // 8) * 8


def _send(rows, buckets: int, span: int, wide: bool):
    """Settle what the task's own rows repeat, then pack the rest by bucket."""
    h, key, tkey, lo, n, off, raw = (np.concatenate(x) for x in zip(*rows, strict=True))
    f = _digest(_words(raw), n)
    order = np.lexsort((key, f, h))
    h, f, key, tkey, lo, n, off, raw = (x[order] for x in (h, f, key, tkey, lo, n, off, raw))
    first = _groups(h, f)
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    settled = (key > key[head]) & (n == n[head]) & (_words(raw) == _words(raw)[head]).all(1)
    left = np.flatnonzero(~settled)
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    out = []
    left = left[np.argsort(bucket[left], kind="stable")]
    own = bucket[left]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, int)
    reach = np.arange(raw.shape[1])[None]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = left[a:b]
        least, text = key[at].min(), raw[at][reach < (n[at] + span - 1)[:, None]]
        cols = [np.array([least]), _blobs.narrow(key[at] - least), _blobs.narrow(lo[at]), _blobs.narrow(n[at]), _blobs.narrow(off[at]), text]
        out.append((int(own[a]), _blobs.pack(*cols, *([tkey[at]] if wide else []))))
    if settled.any():  # stretches that are removed for sure, joined where they touch
        key, tkey, lo, n = key[settled], tkey[settled], lo[settled], n[settled]
        order = np.lexsort((lo, tkey, key))
        key, tkey, lo, end = key[order], tkey[order], lo[order], (lo + n)[order]
        top = _running_max(end, _groups(key, tkey))
        new = _groups(key, tkey)
        new[1:] |= lo[1:] > top[:-1]
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(lo)]]) - 1
        out.append((int(lo[0] + key[0]) % buckets, _blobs.pack(key[at], tkey[at], lo[at], top[stop] - lo[at])))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])


def _running_max(end: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running maximum that starts afresh at each marked row."""
    group = np.cumsum(new) - 1
    step = int(end.max()) + 1 if len(end) else 1
    return np.maximum.accumulate(end + group * step) - group * step


def _parse(span: int, buckets: int, wide: bool):
    width = _width(span)

    def run(batches):
        rows, held = [], 0
        for block, ends, key, tkey, base in _blocks(batches, span):
            text, lo, n, h, off = _triggers.phrases(block, ends, span, TRIGGER)
            if not len(lo):
                continue
            start = np.concatenate([[0], ends[:-1]])
            rows.append((h, key[text], tkey[text], lo - start[text] + base[text], n, off, _cut_rows(block, lo, width, n + (span - 1))))
            held += len(lo)
            if held >= FLUSH_ROWS:
                yield _send(rows, buckets, span, wide)
                rows, held = [], 0
        if rows:
            yield _send(rows, buckets, span, wide)

    return run


def _found(whole, key, tkey, lo, n):
    for a in range(0, max(len(key), 1), 100_000):
        arrays = [np.full(len(key), whole), key, tkey, lo, n]
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in arrays], names=_FOUND.names)


def _buckets(batches, one_by_one: bool):
    """The unpacked blobs of each bucket (sorted input), or of all rows, which then are one bucket's."""
    held, last = [], None
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if one_by_one and bucket != last and held:
                yield held
                held = []
            last = bucket
            held.append(_blobs.unpack(memoryview(blob.as_buffer()).tobytes()))
    if held:
        yield held


def corpus_order(rows: np.ndarray, n: np.ndarray, least: np.ndarray, span: int):
    """Repeated suffixes of the dictionary in the order of their bytes.

    ``rows`` are phrases of ``n`` windows, ``least`` the first document of each.  Gives phrase and start of each suffix that
    equals another in ``span`` bytes, and the first document of all its equals.
    """
    width = -(-span // 8) * 8
    phrase = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    words = _words(_cut_rows(rows.reshape(-1), phrase * rows.shape[1] + j, width, span))
    h = _digest(words)
    order = np.argsort(h, kind="stable")
    again = ~_groups(h[order])
    again[:-1] |= again[1:]
    at = np.sort(order[again])
    words, phrase, j = words[at].byteswap(), phrase[at], j[at]  # numbers in the order of their bytes
    array = np.lexsort(words.T[::-1])
    words, phrase, j = words[array], phrase[array], j[array]
    if not len(array):
        return phrase, j, least[:0]
    new = np.concatenate([[True], (words[1:] != words[:-1]).any(1)])
    return phrase, j, np.minimum.reduceat(least[phrase], np.flatnonzero(new))[np.cumsum(new) - 1]


def _stretches(phrase: np.ndarray, j: np.ndarray):
    """Neighbouring windows of a phrase joined: (phrase, first window, number of windows)."""
    order = np.lexsort((j, phrase))
    phrase, j = phrase[order], j[order]
    new = _groups(phrase)
    new[1:] |= j[1:] != j[:-1] + 1
    at = np.flatnonzero(new)
    return phrase[at], j[at], np.diff(np.concatenate([at, [len(j)]]))


def _parse_order(key: np.ndarray, n: np.ndarray, off: np.ndarray, raw: np.ndarray):
    """Order of occurrences by trigger, phrase and document, and marks of new triggers and new phrases in it."""
    words = _words(raw)
    trigger = _words(_cut_rows(raw.reshape(-1), np.arange(len(raw)) * raw.shape[1] + off, TRIGGER, TRIGGER))
    t, f = _digest(trigger), _digest(words, n)
    order = np.lexsort((key, f, t))

    def marks():
        k, x, m = trigger[order], words[order], n[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
        return new, new | np.concatenate([[True], (x[1:] != x[:-1]).any(1) | (m[1:] != m[:-1])])

    by_trigger, by_phrase = marks()
    if (by_trigger != _groups(t[order])).any() or (by_phrase != _groups(t[order], f[order])).any():  # unlike bytes of one hash: by the bytes themselves
        order = np.lexsort((key, n, *words.T, *trigger.T))
        by_trigger, by_phrase = marks()
    return order, by_trigger, by_phrase


def _resolve(span: int, wide: bool, one_by_one: bool):
    """One bucket: its triggers' parts of the dictionary and of the parse (local repeats are gone already)."""
    width = _width(span)

    def occurrences(got):
        least, key, lo, n, off, text = got[:6]
        n = n.astype(np.int64)
        raw = np.zeros((len(n), width), np.uint8)
        raw[np.arange(width)[None] < (n + span - 1)[:, None]] = text
        return key.astype(np.int64) + least[0], got[6] if wide else np.zeros(len(n), np.int64), lo.astype(np.int64), n, off.astype(np.int64), raw

    def run(batches):
        for held in _buckets(batches, one_by_one):
            rows = []
            for got in held:
                if len(got) == 4:
                    yield from _found(True, *got)
                else:
                    rows.append(occurrences(got))
            held.clear()
            if rows:
                yield from bucket(*(np.concatenate(x) for x in zip(*rows, strict=True)))

    def bucket(key, tkey, lo, n, off, raw):
        order, by_trigger, by_phrase = _parse_order(key, n, off, raw)
        key, tkey, lo, n, raw = (x[order] for x in (key, tkey, lo, n, raw))
        phrase = np.cumsum(by_phrase) - 1
        whole = key > key[by_phrase][phrase]
        yield from _found(True, key[whole], tkey[whole], lo[whole], n[whole])
        at, group = np.flatnonzero(by_trigger), np.cumsum(by_trigger) - 1
        kinds = np.bincount(group[by_phrase], minlength=len(at))
        apart = (kinds > 1) & (np.minimum.reduceat(key, at) < np.maximum.reduceat(key, at))
        hot = ~whole & (apart & (kinds > HOT_PHRASES))[group]
        yield from _found(False, key[hot], tkey[hot], lo[hot], n[hot])
        heads = np.flatnonzero(by_phrase & (apart & (kinds <= HOT_PHRASES))[group])  # the dictionary
        windows = np.cumsum(n[heads])
        ends = np.flatnonzero(np.concatenate([by_trigger[heads][1:], [True]])) if len(heads) else heads
        done = 0
        while done < len(heads):  # some triggers at a time
            fit = ends[windows[ends] <= (windows[done - 1] if done else 0) + WINDOWS]
            end = int(fit[-1]) + 1 if len(fit) and fit[-1] >= done else int(ends[np.searchsorted(ends, done)]) + 1
            own = heads[done:end]
            done = end
            which, j, least = corpus_order(raw[own], n[own], key[own], span)
            goes = least < key[own][which]
            which, j, size = _stretches(which[goes], j[goes])
            first = own[which]
            times = np.bincount(phrase[~whole], minlength=int(phrase[-1]) + 1)[phrase[first]]  # occurrences in the phrase's first document
            spot = np.repeat(first, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            yield from _found(True, key[spot], tkey[spot], lo[spot] + np.repeat(j, times), np.repeat(size, times))

    return run


def _cut_out(span: int, buckets: int):
    """Windows of phrases of hot triggers, packed by bucket."""

    def send(rows):
        key, tkey, lo, bucket, raw = zip(*rows, strict=True)
        bucket = np.array(bucket)
        order = np.argsort(bucket, kind="stable")
        cols = [np.array(x, np.int64)[order] for x in (key, tkey, lo)]
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        blobs = [_blobs.pack(*[x[a:b] for x in cols], np.frombuffer(b"".join(raw[i] for i in order[a:b]), np.uint8)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        rows = []
        for batch in batches:
            keys, tkeys, texts, lists = (batch.column(c) for c in ("key", "tkey", "text", "open"))
            for key, tkey, text, opened in zip(keys.to_pylist(), tkeys.to_pylist(), texts, lists, strict=True):
                raw, v = memoryview(text.as_buffer()), opened.values
                for lo, n in zip(*(v.field(i).to_pylist() for i in range(2)), strict=True):
                    for j in range(lo, lo + n):
                        piece = raw[j : j + span].tobytes()
                        rows.append((key, tkey, j, zlib.crc32(piece) % buckets, piece))
                    if len(rows) >= 80_000:
                        yield send(rows)
                        rows = []
        if rows:
            yield send(rows)

    return run


def _compare(span: int, one_by_one: bool):
    """One bucket of windows: those that an earlier document holds too."""

    def run(batches):
        for held in _buckets(batches, one_by_one):
            key, tkey, lo, raw = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            which, _, least = corpus_order(_cut_rows(raw, np.arange(len(key)) * span, -(-span // 8) * 8, span), np.ones(len(key), np.int64), key, span)
            at = which[least < key[which]]
            yield from _found(True, key[at], tkey[at], lo[at], np.ones(len(at), np.int64))

    return run


def _cut(span: int, names: list[str]):
    def parts(batches):
        for batch in batches:
            for a, b in groups(batch.column("text"), 8 << 20, 4096):
                yield batch.slice(a, b - a)

    def run(batches):
        for batch in parts(batches):
            kept, spans = [], []
            for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else b""
                if not marks.is_valid or not len(marks.values):
                    kept.append(raw)
                    spans.append([])
                    continue
                v = marks.values
                lo = v.field(0).to_numpy(zero_copy_only=False)
                end = lo + v.field(1).to_numpy(zero_copy_only=False) + (span - 1)
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], lo[1:] > end[:-1]])
                at = np.flatnonzero(new)
                a, b = lo[at], end[np.concatenate([at[1:], [len(lo)]]) - 1]
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            extra = [pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + extra, names=[*names, "kept", "spans"])

    return run


def _dealt(df: DataFrame, buckets: int, parts: int) -> DataFrame:
    """One bucket in a partition, or several in order."""
    out = df.repartitionById(parts, F.col("bucket") % parts)
    return out.sortWithinPartitions("bucket") if buckets > parts else out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, bucket_bytes: int = 8 << 20, most_parts: int = 20_000) -> DataFrame:
    """Adds ``kept`` (the remaining bytes) and ``spans`` (removed stretches, merged, in bytes) to every row."""
    if min_len <= TRIGGER:
        raise ValueError(f"min_len must be above {TRIGGER}")
    spark = docs.sparkSession
    rename = {c: c for c in docs.columns if c.lower() not in ("kept", "spans")}
    inner = ("key", "tkey", "text", "marks", "open")
    for i, c in enumerate(rename):  # inner names do not clash with the input's
        rename[c] = f"c{i}_{c}" if c != text_col else "text"
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in rename.items()])
    assert not set(rename.values()) & (set(inner) - {"text"})
    ident = F.col(f"`{rename[id_col]}`").cast("long")
    size = docs.agg(F.sum(F.octet_length(f"`{text_col}`")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    parts = min(buckets, most_parts)
    wide = not docs.groupBy(F.col(f"`{id_col}`")).count().filter("count > 1").isEmpty()  # equal ids: told apart by their texts
    keyed = base.withColumn("key", F.coalesce(ident, F.lit(LAST)))
    keyed = keyed.withColumn("tkey", F.xxhash64("text") if wide else F.lit(0).cast("long"))

    parsed = keyed.select("key", "tkey", "text").mapInArrow(trimmed(_parse(min_len, buckets, wide)), _PACKED)
    found = materialize(_dealt(parsed, buckets, parts).mapInArrow(trimmed(_resolve(min_len, wide, buckets > parts)), _FOUND), "repeats")

    on = ["key", "tkey"] if wide else ["key"]
    if not wide:
        found = found.drop("tkey")
    marks = found.filter("whole").select(*on, "lo", "n")
    hot = found.filter("not whole")
    if not hot.isEmpty():
        opened = hot.groupBy(*on).agg(F.collect_list(F.struct("lo", "n")).alias("open"))
        pieces = keyed.select("key", "tkey", "text").join(opened, on).mapInArrow(_cut_out(min_len, buckets), _PACKED)
        partly = _dealt(pieces, buckets, parts).mapInArrow(_compare(min_len, buckets > parts), _FOUND)
        marks = marks.unionByName(partly.select(*on, "lo", "n"))
    marks = marks.groupBy(*on).agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    names = list(rename.values())
    schema = T.StructType([T.StructField(n, base.schema[n].dataType) for n in names])
    schema.add("kept", T.BinaryType())
    schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    out = keyed.join(marks, on, "left").mapInArrow(_cut(min_len, names), schema)
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in rename.items()], "kept", "spans")
