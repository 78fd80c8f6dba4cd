"""Quality rules with thresholds whose false rejections are bounded.

Signals of a text are compared with cutoffs. A cutoff is taken only if the labelled holdout proves, by an exact
binomial bound, that among good texts of its stratum at most a stated share is rejected; the bounds of all
cutoffs that are tried hold at the same time (Bonferroni over strata, signals and cutoffs).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import PLAIN, append, checkpoint, texts, words

_SYMBOLS, _CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
#: Share of good texts that all rules of a stratum together may reject, and the chance that a bound is wrong.
RISK, ERROR = 0.02, 0.05
#: Signals, larger is worse. Cutoffs are the numbers n / GRID; a text fails where its signal is above the cutoff.
SIGNALS = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)"}
GRID = 20

FIELDS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"


def repeat_words(found: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = len(found) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    # Ranks of pairs, fours and then windows: equal ranks are equal words, nothing is hashed.
    base = len(numbers)
    have, span = ids, 1
    for step in range(1, width):
        joined = have[:-1] * base + ids[step:] if step < width else have
        if len(joined) == 0:
            return 0
        _, have = np.unique(joined, return_inverse=True)
        span += 1
        if have.max() + 1 == len(have):  # all windows differ already
            return 0
    counts = np.bincount(have)
    starts = np.flatnonzero(counts[have] > 1)
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measures(text: str | None) -> tuple[int, ...]:
    """Values of ``FIELDS`` for one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    raw = text.encode()
    found = words(text, PLAIN)
    blank = sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    symbols, capitals = (len(raw) - len(raw.translate(None, some)) for some in (_SYMBOLS, _CAPITALS))
    return len(found), len(text) - blank, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(found), capitals


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FIELDS`` and base_failed; null and empty texts have zeros and fail. No shuffle."""

    def start():
        def batch(rows):
            return [list(c) for c in zip(*map(measures, texts(rows, text)))] or [[] for _ in range(7)]

        return batch

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return append(docs, FIELDS, start).withColumn("base_failed", failed)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share of which n trials showed k: P(at most k) falls to ``error`` there."""
    if k >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < 1 and at_most(mid) > error else (low, mid)
    return high


def _stratum(n_words):
    """Texts by length: 1 below 100 words, 2 below 1000, 3 beyond."""
    return F.when(n_words < 100, 1).when(n_words < 1000, 2).otherwise(3)


def choose_cutoffs(measured: DataFrame, labelled: DataFrame, risk: float = RISK, error: float = ERROR, key: str = "doc_id") -> dict[tuple[int, str], int]:
    """{(stratum, signal): cutoff} of cutoffs that are proven to reject few good texts.

    ``labelled`` has a key and ``good``, true or false, per text. For each stratum, signal and cutoff the good and
    bad texts above the cutoff are counted (one aggregation whose result has at most 2 x strata x signals x GRID rows).
    Each signal may use an equal share of ``risk``, so the rules of a stratum together keep within it; ``error`` is
    shared by all bounds that are tried. Of the proven cutoffs the one that rejects most bad texts is taken, of equals
    the mildest; a signal without a proven cutoff that rejects any gets none, so few labels mean fewer rules.
    """
    step = lambda s: F.least(F.ceil(F.expr(SIGNALS[s]) * GRID), F.lit(GRID)).cast("int")
    rows = measured.where("not base_failed").join(labelled.select(key, "good"), key).select(
        "good", _stratum(F.col("n_words")).alias("stratum"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), step(s).alias("step")) for s in SIGNALS])).alias("x"))
    counts = {(r[0], r[1], r[2], r[3]): r[4] for r in rows.groupBy("good", "stratum", "x.signal", "x.step").count().collect()}
    tests = 3 * len(SIGNALS) * GRID
    out = {}
    for stratum in (1, 2, 3):
        for signal in SIGNALS:
            # A text is above cutoff / GRID exactly if its step is a greater number.
            above = lambda good, cutoff: sum(v for (g, st, si, step_), v in counts.items() if (g, st, si) == (good, stratum, signal) and step_ > cutoff)  # noqa: B023, E731
            n = above(True, -1)
            proven = [(above(False, c), c) for c in range(GRID) if n and upper_bound(above(True, c), n, error / tests) <= risk / len(SIGNALS)]
            if proven and max(proven)[0] > 0:
                out[stratum, signal] = max(proven)[1]
    return out


def judge(measured: DataFrame, cutoffs: dict[tuple[int, str], int]) -> DataFrame:
    """``measured`` with kept: not base_failed, and no signal above its stratum's cutoff."""
    fails = F.lit(False)
    for (stratum, signal), cutoff in sorted(cutoffs.items()):
        fails = fails | ((_stratum(F.col("n_words")) == stratum) & (F.expr(SIGNALS[signal]) * GRID > cutoff))
    return measured.withColumn("kept", ~F.col("base_failed") & ~fails)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the text, measured and judged; cutoffs are chosen on texts that ``labels`` calls good (quality 1, toxic not 1).

    Labels with null keys or null quality say nothing; texts of quality 0 are bad ones; a key labelled more than once
    is good if no label says otherwise; repeated rows count as often as they stand. Without labels only the base rule
    holds. The texts are read once: their measures are written to the checkpoint folder and read for the cutoffs and for
    the verdicts.
    """
    each = labels.groupBy(key).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    labelled = each.where("q = 0 or q = 1 and t = 0").select(key, (F.col("q") == 1).alias("good"))
    measured = checkpoint(measure(docs, text).drop(text))
    return judge(measured, choose_cutoffs(measured, labelled, key=key))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
