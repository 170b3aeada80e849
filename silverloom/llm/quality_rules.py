"""Quality rules whose cutoffs are certified on labelled documents (operator 6).

Each rule rejects a document whose ratio (symbols a word, words in repeated windows, ...) exceeds a
cutoff. In a stratum (a language) sets of cutoffs are tried one after the other, each a notch of one
rule stricter than the one before, in an order that the bad documents alone tell: by how many more
of them a notch rejects. A set is certified if the exact binomial (Clopper-Pearson) upper bound of the
share of good documents that it rejects, whichever rule does, stays within ``max_false_rejection``;
the first set that isn't ends the sequence, and the last certified one holds. As the order doesn't
depend on the good documents and stops at the first failure, no correction is due within a stratum
(fixed-sequence testing); the confidence is shared out over the strata (Bonferroni, weighted by 1 / good
documents, so that small strata needn't go without). So with probability 1 - ``delta`` the joint verdict
of the rules keeps its bound in all strata at once. Cutoffs come from a fixed grid, so all labelled
documents are holdouts, and a stratum with too few stays with the base rule.

Defined results: a null text is an empty one; a null language is a stratum of its own; an empty
table gives an empty result; without labels no rule is certified and only the base verdict holds;
repeated rows each get their row; a document labelled more than once is good if any label says so;
columns other than doc_id, text, lang (and doc_id, quality of the labels) are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, schema_with, settle, text_bytes

#: The ratios that rules look at (per 100 words, or per word), and their cutoffs.
RATIOS = {
    "symbols": "100.0 * n_symbols / n_words",
    "dup_lines": "100.0 * n_dup_lines / n_lines",
    "repeats": "100.0 * n_repeat_words / n_words",
    "long_words": "1.0 * word_chars / n_words",
    "shouting": "100.0 * n_upper / word_chars",
    "bangs": "100.0 * n_bangs / n_words",
}
CUTOFFS = {
    "symbols": [2, 5, 10, 15, 20, 30, 50, 100],
    "dup_lines": [5, 10, 15, 20, 30, 40, 50],
    "repeats": [5, 10, 15, 20, 25, 30, 40],
    "long_words": [7, 8, 9, 10, 12, 15],
    "shouting": [5, 10, 15, 20, 30, 50],
    "bangs": [2, 5, 10, 20, 50, 90],
}
MAX_FALSE_REJECTION = 0.01
DELTA = 0.05
BASE_WORDS, BASE_REPEATS = 50, 50

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bangs long"
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))


def count_repeats(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def count_dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    seen: set[bytes] = set()
    dup = full = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            full += 1
            dup += line in seen
            seen.add(line)
    return dup, full


def text_stats(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    packed = text.translate(None, SPACE)
    dup, lines = count_dup_lines(text)
    drop = lambda chars: len(text) - len(text.translate(None, chars))
    return len(words), len(packed.decode()), drop(SYMBOLS), dup, count_repeats(words), lines, drop(UPPER), drop(b"!")


def document_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document and the counts of its whole text."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def each(batch: pa.RecordBatch) -> dict:
        rows = [text_stats(x) for x in text_bytes(batch.column("text"))]
        return {c: batch.column(c) for c in keep} | dict(zip(names, zip(*rows)))

    kept = docs.select(*keep, "text")
    return map_batches(kept, schema_with(kept, keep, STATS), each)


def rule_ratio(rule: str) -> Column:
    return F.coalesce(F.try_divide(*(F.expr(x) for x in RATIOS[rule].split(" / "))), F.lit(0.0))


def log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p), k < n * p: from the largest term down, until none counts."""
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return first + math.log(total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p at which k or fewer of n have probability delta or more."""
    if not n or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or log_tail(k, n, mid) > math.log(delta):
            low = mid
        else:
            high = mid
    return high


def notch(rule: str) -> Column:
    """How many of the rule's cutoffs a document's ratio exceeds."""
    ratio = rule_ratio(rule)
    return sum(((ratio > c).cast("int") for c in CUTOFFS[rule]), F.lit(0))


def order_of_notches(bad: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sets of notches, each stricter than the one before: a rule rejects at its notch (from 1) and above;
    beyond its cutoffs it is off. bad: rows of notches, and how many documents have them. Each
    step goes to the notch of one rule that rejects most more bad documents a cutoff passed."""
    at = np.array([len(CUTOFFS[r]) + 1 for r in RATIOS])
    left, path = np.ones(len(bad), bool), []
    while True:
        best = (0.0, 0, 0, 0)
        for r in range(len(at)):
            for to in range(at[r] - 1, 0, -1):
                gain = float(counts[left & (bad[:, r] >= to)].sum())
                best = max(best, (gain / (at[r] - to), gain, -r, to))
        if not best[1]:
            return path
        at = at.copy()
        at[-best[2]] = best[3]
        path.append(at)
        left &= ~(bad >= at).any(1)


def certified(good: np.ndarray, counts: np.ndarray, path: list[np.ndarray], delta: float, most: float) -> np.ndarray | None:
    """The last of the sets, tried in their order, before the first whose bound fails."""
    n, held = int(counts.sum()), None
    for at in path:
        k = int(counts[(good >= at).any(1)].sum())
        if not n or k > most * n or upper_bound(k, n, delta) > most:
            break
        held = at
    return held


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, and for each rule its cutoff (null: off). A row for each stratum with labels.
    Documents are counted by their notches: a stratum's counts are bounded by the grid, not by the table."""
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("mark"))
    told = stats.join(marks, F.col("doc_id") == F.col("label_id")).filter(F.col("mark").isin(0, 1))
    by = settle(told.groupBy("stratum", "mark", *(notch(r).alias(f"n_{r}") for r in RATIOS)).agg(F.count("*").alias("n")), "rule-notches")
    sizes = by.filter("mark = 1").groupBy("stratum").agg(F.sum("n").alias("n_good"))
    shares = sizes.agg(F.sum(1 / F.col("n_good"))).first()[0] or 1.0
    names = [f"n_{r}" for r in RATIOS]

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        good, bad = frame[frame["mark"] == 1], frame[frame["mark"] == 0]
        n = int(good["n"].sum())
        path = order_of_notches(bad[names].to_numpy(), bad["n"].to_numpy())
        held = certified(good[names].to_numpy(), good["n"].to_numpy(), path, delta / (max(n, 1) * shares), max_false_rejection)
        out = {"stratum": [frame["stratum"].iloc[0]], "n_good": [n]}
        for i, r in enumerate(RATIOS):
            out[f"cut_{r}"] = [float(CUTOFFS[r][held[i] - 1]) if held is not None and held[i] <= len(CUTOFFS[r]) else None]
        return pd.DataFrame(out).astype({f"cut_{r}": float for r in RATIOS})

    return by.groupBy("stratum").applyInPandas(choose, "stratum string, n_good long, " + ", ".join(f"cut_{r} double" for r in RATIOS))


def with_verdict(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed, broken_rules and kept; stats has a stratum."""
    broken = F.array_compact(F.array(*(F.when(rule_ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RATIOS)))
    cuts = cuts.drop("n_good").withColumnRenamed("stratum", "cut_stratum")
    out = stats.join(cuts, F.col("stratum") == F.col("cut_stratum"), "left").withColumn("base_failed", base_failed())
    return out.withColumn("broken_rules", F.array_join(broken, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def stratified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"))


def apply_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """Counts, base verdict, the rules that reject a document, and whether it is kept."""
    stats = settle(document_stats(stratified(docs), ["doc_id", "stratum"]), "rule-stats")
    cuts = settle(fit_cutoffs(stats, labels, max_false_rejection, delta), "rule-cutoffs")
    return with_verdict(stats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


def keep_rows(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep. The texts pass through the counts once more beside
    their verdict, so that they needn't be shuffled to meet it."""
    stats = settle(document_stats(stratified(docs), ["doc_id", "stratum"]), "rule-stats")
    cuts = settle(fit_cutoffs(stats, labels, max_false_rejection, delta), "rule-cutoffs")
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(c).alias(n) for c, n in names.items()), "text", F.coalesce("lang", F.lit("")).alias("stratum"))
    passed = with_verdict(document_stats(own, [*names.values(), "stratum"]), cuts).filter("kept")
    return passed.select(*(F.col(n).alias(c) for c, n in names.items()))
