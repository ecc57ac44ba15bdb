"""Personal data in texts: exact base patterns, and a BiLSTM-CRF that adds spans.

The base patterns (e-mail, IP, card, phone) are matched leftmost and without
overlap over the whole text.  A character-level bidirectional LSTM with CRF
transitions, trained in numpy from labelled spans that a seeded generator writes,
then reads the places the patterns leave open: overlapping windows around every
digit and ``@`` outside the base spans, and on from there while a tagged run goes
up to the edge of what is read.  Each character takes its tag
posteriors from the window in which it stands most centrally, so windows are
reconciled into one tagging of the text; stretches that are sure enough and hold what
their kind needs (digits, ``@``) become added spans unless they touch a base span.
All kinds need a digit or ``@``, so a text without either has no span.

Scale: no shuffle; texts are read in place; windows are scored in batches of a
fixed size.  The model is a few kilobytes in the task closure.

Defined results: a null text is empty and has no spans.  Repeated rows get equal
results; extra columns pass through, an input column named like an output column
gives way.  Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bilstm import Tagger
from ._memory import trimmed

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 64, 32
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only start where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, in order of start and then of kind."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m[0].split("."))
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SYMBOLS = "@.+-()_%/:#*=\"',;"
_TABLE = np.full(256, 25, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _TABLE[_c] = 1 if _ch in "0123456789" else 2 if _ch in "abcdef" else 3 if _ch.islower() else 4 if _ch.isupper() else 5 if _ch == " " else 6 if _ch.isspace() else 7 + _SYMBOLS.index(_ch) if _ch in _SYMBOLS else 25
N_SYMBOLS = 27


def symbols(text: str) -> np.ndarray:
    """One small number a character; 0 pads a window."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 256, _TABLE[np.minimum(code, 255)], 26).astype(np.uint8)


def labelled_spans(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled texts written by rule: personal data in usual and unusual forms among look-alikes."""
    r = random.Random(seed)
    words = "house river garden market office travel summer winter paper window maison jardin livre travail haus stadt garten zeit casa tiempo mundo trabajo ana peter maria jones smith info sales support".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(k))
    word = lambda: r.choice(words) if r.random() < 0.5 else letters(r.randint(2, 10))
    name = lambda: r.choice(words) + r.choice(["", r.choice(words)]) if r.random() < 0.5 else "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 12)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def email():
        return f"{name()}{r.choice(['.', '_', '', '+'])}{digits(r.randint(0, 2))}{r.choice([' @ ', '@', ' (at) @'])}{name()}{r.choice(['.', ' . '])}{r.choice(['com', 'net', 'org'])}"

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"0{digits(3)} {digits(6)}"])

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        g = [digits(4) for _ in range(4)]
        return r.choice([" ".join(g), "-".join(g), "".join(g), ".".join(g), "_".join(g)])

    makers = {"email": email, "phone": phone, "ip": ip, "card": card}
    decoys = [
        lambda: f"{word()}-{hexes(8)}-{hexes(4)}-{hexes(4)}",
        lambda: hexes(r.randint(8, 64)),
        lambda: f"{word()} {r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"{digits(r.randint(1, 3))} {word()} {digits(r.randint(1, 4))}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1, 99999)}",
        lambda: f"{r.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
        lambda: f"@{word()}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: f"page {r.randint(1, 400)} of {r.randint(400, 900)}",
        lambda: f"/{word()}/{digits(r.randint(2, 6))}.html",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(3, 7)):
            u = r.random()
            if u < 0.25:
                kind = r.choice(KINDS)
                made = makers[kind]()
                spans.append((len(text), len(text) + len(made), kind))
            else:
                made = r.choice(decoys)() if u < 0.5 else word()
                if r.random() < 0.1:
                    made = made.capitalize()
            text += made + r.choice([" ", " ", " ", ", ", ". ", "\n", "\n\n", " | ", "; "])
        out.append((text, spans))
    return out


def windows_of(rows) -> tuple[np.ndarray, np.ndarray]:
    """Training windows [WINDOW, n] of symbols and tags (0 outside, 1 + 2 k begins kind k, 2 + 2 k goes on)."""
    ids, tags = [], []
    for text, spans in rows:
        s, t = symbols(text), np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            t[a:b] = 2 + 2 * KINDS.index(kind)
            t[a] -= 1
        for at in range(0, max(1, len(text) - STEP), STEP):
            pad = WINDOW - len(s[at : at + WINDOW])
            ids.append(np.pad(s[at : at + WINDOW], (0, pad)))
            tags.append(np.pad(t[at : at + WINDOW], (0, pad)))
    return np.stack(ids, 1).astype(np.int64), np.stack(tags, 1)


@functools.lru_cache(maxsize=4)
def fit(rows: int = 1500, steps: int = 260, seed: int = 11) -> Tagger:
    """The tagger, trained on ``rows`` generated texts; kept for the life of the process."""
    ids, tags = windows_of(labelled_spans(rows, seed))
    model = Tagger(N_SYMBOLS, 1 + 2 * len(KINDS))
    model.train(ids, tags, steps)
    return model


def _fits(kind: str, piece: str) -> bool:
    n = sum(c in "0123456789" for c in piece)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:\(at\) ?)?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+", piece))
    if kind == "ip":
        return n >= 4 and piece.count(".") == 3 and all(p.isdigit() and int(p[-4:]) <= 255 and len(p) <= 3 for p in piece.split("."))
    if kind == "card":
        return 12 <= n <= 19 and n >= 0.75 * len(piece) and luhn("".join(c for c in piece if c in "0123456789"))
    return 9 <= n <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", piece))


def _beside(read: dict, n: int, reach: int) -> list[int]:
    """Windows next to a stretch of ``read`` ones whose tags go on up to its edge."""
    last, more = max(0, (n - STEP // 2 - 1) // STEP), set()
    for g, (_, tags, _) in read.items():
        if tags[0] and g - 1 not in read:
            more.update(range(max(0, g - reach), g))
        if tags[-1] and g + 1 not in read:
            more.update(range(g + 1, min(last, g + reach) + 1))
    return sorted(more - read.keys())


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, str]]], sure: float = 0.9, at_once: int = 512):
    """For each text the spans (start, end, kind, score) that the tagger adds to its base spans."""
    need: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        grid, covered, k = set(), base[i], 0
        for m in _CUE.finditer(text):
            p = m.start()
            while k < len(covered) and covered[k][1] <= p:
                k += 1
            if k < len(covered) and covered[k][0] <= p:
                continue
            grid.update(range(max(0, (p - 48) // STEP), p // STEP + 1))
        need += [(i, g) for g in sorted(grid) if g == 0 or g * STEP + STEP // 2 < len(text)]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    tail: dict[int, dict] = {}
    reach = 1
    while need:  # until the tagger, not a window's edge, closes every run
        for a in range(0, len(need), at_once):
            part = need[a : a + at_once]
            ids = np.zeros((WINDOW, len(part)), np.int64)
            for j, (i, g) in enumerate(part):
                s = symbols(texts[i][g * STEP : g * STEP + WINDOW])
                ids[: len(s), j] = s
            post = model.marginals(ids)
            best, top = post.argmax(2), post.max(2)
            for j, (i, g) in enumerate(part):  # a window speaks for its middle half, and for the text's start
                lo = 0 if g == 0 else STEP // 2
                hi = min(STEP // 2 + STEP, len(texts[i]) - g * STEP)
                tail.setdefault(i, {})[g] = (g * STEP + lo, best[lo:hi, j], top[lo:hi, j])
        need = [(i, g) for i in sorted({i for i, _ in need}) for g in _beside(tail[i], len(texts[i]), reach)]
        reach *= 2
    for i, found in tail.items():
        held, start, kind, score = base[i], None, 0, []
        end_of_last = None

        def close(end, i=i, held=held):
            if start is None or kind == 0:
                return
            text, a, b = texts[i], start, end
            while b > a and text[b - 1] in " .,;|%\n":
                b -= 1
            free = all(e <= a or s >= b for s, e, _ in held)
            if free and b > a and np.mean(score) >= sure and _fits(KINDS[kind - 1], text[a:b]) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                out[i].append((a, b, KINDS[kind - 1], float(np.mean(score))))

        for _, (at, tags, top) in sorted(found.items()):
            if end_of_last is not None and at != end_of_last:
                close(end_of_last)
                start, kind, score = None, 0, []
            for k, (tag, p) in enumerate(zip(tags.tolist(), top.tolist(), strict=True)):
                now = (tag + 1) // 2
                if tag == 0 or tag % 2 == 1 or now != kind:
                    close(at + k)
                    start, kind, score = (at + k, now, []) if tag else (None, 0, [])
                score.append(p)
            end_of_last = at + len(tags)
        if end_of_last is not None:
            close(min(end_of_last, len(texts[i])))
    return out


def find(docs: DataFrame, text_col: str = "text", model: Tagger | None = None, redact: bool = False) -> DataFrame:
    """Adds ``spans`` (kind, start, end, base, score) in order; with ``redact`` the text's spans become ``[KIND]``."""
    model = model or fit()
    names = [c for c in docs.columns if c.lower() != "spans"]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        from ._grams import groups

        for batch in batches:
            for a, b in groups(batch.column(at), 1 << 22, 4096):
                raw = batch.column(at)[a:b].to_pylist()
                texts = [t or "" for t in raw]
                base = [base_spans(t) for t in texts]
                more = added_spans(model, texts, base)
                rows, clean = [], []
                for t, old, new in zip(texts, base, more, strict=True):
                    every = [(s, e, k, True, 1.0) for s, e, k in old] + [(s, e, k, False, p) for s, e, k, p in new]
                    every.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                    rows.append([{"kind": k, "start": s, "end": e, "base": own, "score": p} for s, e, k, own, p in every])
                    if redact:
                        clean.append(redacted(t, every))
                cols = {c: batch.column(c)[a:b] for c in batch.schema.names}
                if redact:
                    cols[at] = pa.array([c if r is not None else None for c, r in zip(clean, raw, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(rows, pa.list_(span))], names=[*cols, "spans"])

    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*src.schema.fields, T.StructField("spans", T.ArrayType(kind))])
    return src.mapInArrow(trimmed(run), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "spans")


def redacted(text: str, spans) -> str:
    """The text with each span's characters replaced by its kind's mark; spans that overlap share the first one's mark."""
    out, at = [], 0
    for s, e, kind, *_ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def joined(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    some = F.filter(spans, lambda x: x["base"]) if base_only else spans
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
