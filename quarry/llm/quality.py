"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes good (+1), bad (-1) or
abstains (0).  Expectation-maximisation over the distinct vote patterns of the
*whole* corpus (a group-by, at most ``3 ** rules`` rows) estimates how each rule
behaves on good and on bad documents; a document is kept if its posterior
probability of being good reaches ``threshold`` and no base rule fails.

Main path: DataFrame expressions only.  Nothing is shuffled but the pattern
counts.  The counts of a document are written once to the shared folder (without
its text, unless asked to carry it), so the texts are read once.

Defined results: a null or empty text has no words, all counts are 0 and it
fails the base rules.  Repeated rows are judged alike.  An empty table gives an
empty result.  Extra columns named in ``carry`` pass through; an input column
named like an output column gives way to it.  A text of any length is
processed whole, in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, let, materialize

WS = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Frequent words of the four languages; fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "this", "are",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "pour", "pas", "est", "sur", "du",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "auf", "dem", "sich",
    "el", "los", "las", "en", "del", "con", "por", "para", "una", "se", "no", "y",
)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array of words.

    Windows are compared by a 64-bit hash.  Only arrays that hold a repeated
    window (found by one hash-set pass) pay for the sort that locates it.
    """

    def located(t: Column) -> Column:  # t: one hash a window
        pairs = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(z: Column) -> Column:
            again = F.filter(
                z,
                lambda x, k: (x["h"] == F.get(z, k - 1)["h"]).eqNullSafe(F.lit(True)) | (x["h"] == F.get(z, k + 1)["h"]).eqNullSafe(F.lit(True)),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def covered(p: Column) -> Column:  # each window covers 3 words, or up to the next one's start
            reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(reach, F.lit(0), lambda a, v: a + v)

        return let(let(pairs, positions), covered)

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    found = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), located(t)).otherwise(F.lit(0)))
    return F.when(F.size(words) > 3, found).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and two more that only the voting rules use."""
    t, w = hidden(docs, "_t"), hidden(docs, "_w")
    new = (*COUNTS, "n_upper", "n_stop", "n_lines")
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in new]
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    df = df.select(*kept, t, F.array_remove(F.split(F.col(t), WS + "+"), "").alias(w))
    words, body = F.col(w), F.col(t)
    return df.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]", ""))).cast("long").alias("n_upper"),
        F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in STOP_WORDS]))).cast("long").alias("n_stop"),
        F.regexp_count(body, F.lit("\n")).cast("long").alias("n_lines"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules: +1 good, -1 bad, 0 abstains.  A document without words abstains everywhere but on length."""
    n = F.col("n_words")
    some = n > 0
    ratio = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    mean, upper = ratio("word_chars"), F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "v_length": _vote(n < 20, n >= 50),
        "v_word_length": _vote(some & ((mean < 3) | (mean > 8)), some & (mean >= 4) & (mean <= 7)),
        "v_symbols": _vote(some & (ratio("n_symbols") > 0.1), F.lit(False)),
        "v_upper": _vote((n >= 5) & (upper > 0.3), F.lit(False)),
        "v_dup_lines": _vote(F.col("n_dup_lines") * 10 > (F.col("n_lines") + 1) * 3, F.lit(False)),
        "v_repeats": _vote(some & (ratio("n_repeat_words") > 0.3), F.lit(False)),
        "v_stop": _vote((n >= 50) & (F.col("n_stop") < 2), F.col("n_stop") >= 3),
    }


def _log_odds(model: dict, j: int, x: int) -> float:
    """What vote ``x`` of rule ``j`` adds to the log odds of good."""
    return math.log(max(model["tables"]["good"][j][x], 1e-9)) - math.log(max(model["tables"]["bad"][j][x], 1e-9))


def posterior(model: dict, vote: tuple[int, ...]) -> float:
    z = math.log(model["good"]) - math.log(1 - model["good"]) + sum(_log_odds(model, j, x) for j, x in enumerate(vote))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 5000, prior_good: float = 0.85, accuracy: float = 0.9, anchor: float = 20.0) -> dict:
    """EM for a two-class model whose rules vote independently given the class.

    ``patterns`` are distinct vote tuples with their counts.  A rule starts at
    ``accuracy`` when it speaks.  ``anchor`` pseudo-documents of each class hold
    that start: few enough to leave the estimate to any corpus of some hundreds
    of documents, and enough that a tiny one neither swaps the classes nor gives
    certainty.  Stops when no table entry moves by 1e-6; not to settle is an error.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(c for _, c in patterns)
    right = {"good": {1: accuracy, -1: 1 - accuracy}, "bad": {1: 1 - accuracy, -1: accuracy}}
    speak = [sum(c for v, c in patterns if v[j]) / max(1, total) for j in range(n_rules)]
    start = {k: [{1: s * right[k][1], -1: s * right[k][-1], 0: 1 - s} for s in speak] for k in right}
    model = {"good": prior_good, "tables": start}
    for _ in range(rounds if total else 0):
        mass = dict.fromkeys(right, 0.0)
        seen = {k: [{1: 0.0, -1: 0.0, 0: 0.0} for _ in range(n_rules)] for k in right}
        for v, c in patterns:
            p = posterior(model, v)
            for k, q in (("good", p * c), ("bad", (1 - p) * c)):
                mass[k] += q
                for j, x in enumerate(v):
                    seen[k][j][x] += q
        tables = {k: [{x: (seen[k][j][x] + anchor * start[k][j][x]) / (mass[k] + anchor) for x in (1, -1, 0)} for j in range(n_rules)] for k in right}
        moved = max((abs(tables[k][j][x] - model["tables"][k][j][x]) for k in right for j in range(n_rules) for x in (1, -1, 0)), default=0.0)
        model = {"good": (mass["good"] + anchor * prior_good) / (total + anchor), "tables": tables}
        if moved < 1e-6:
            return model
    if total:
        raise RuntimeError(f"expectation-maximisation did not settle in {rounds} rounds")
    return model


def posterior_column(model: dict, names: list[str]) -> Column:
    """The posterior probability of good as an expression over the vote columns."""
    z = F.lit(math.log(model["good"]) - math.log(1 - model["good"]))
    for j, name in enumerate(names):
        gain = {x: _log_odds(model, j, x) for x in (1, -1, 0)}
        z = z + F.when(F.col(name) == 1, F.lit(gain[1])).when(F.col(name) == -1, F.lit(gain[-1])).otherwise(F.lit(gain[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``carry`` columns (default: all), the counts, base_failed, p_good and kept of every row."""
    carry = list(docs.columns) if carry is None else carry
    counted = counts(docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, text])]), text)
    new = (*COUNTS, "n_upper", "n_stop", "n_lines")
    kept = [f"`{c}`" for c in carry if c.lower() not in new]
    rules = votes()
    held = materialize(counted.select(*kept, *new), "quality")
    rows = held.select(*[c.alias(k) for k, c in rules.items()]).groupBy(*rules).count().collect()  # at most 3 ** 7 rows
    model = fit(sorted((tuple(r[k] for k in rules), r["count"]) for r in rows) or [((0,) * len(rules), 0)])
    late = ("base_failed", "p_good", "kept")
    kept = [f"`{c}`" for c in held.columns if c.lower() not in late]
    inner = [hidden(held, k) for k in rules]  # the votes' names do not clash with the input's
    voted = held.select(*kept, base_failed().alias("base_failed"), *[c.alias(k) for k, c in zip(inner, rules.values(), strict=True)])
    out = voted.select(*kept, "base_failed", posterior_column(model, [f"`{k}`" for k in inner]).alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
