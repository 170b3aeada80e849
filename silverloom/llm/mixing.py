"""Mixing to target weights with soft domain membership (operator 7).

A multinomial logistic model, fitted on a labelled table, gives each document a posterior p over
domains. With n_d tokens in document d, rates r_d >= 0 are sought so that the expected tokens of each
domain, sum of r_d * n_d * p_dk, equal target weight k times the token budget. The least-squares
residual (whitened by the Gram matrix sum of n_d p_d p_d') is descended from r = 1 by projected
gradients in the metric of the token counts: r <- r - p . step, held at 0 or more. Rates then depend on a
document through p alone and on the history of steps, so each iteration is one pass over (n, p)
that returns K + K * K sums; nothing else reaches the driver, and nothing need be stored in between.

Decisions: a document is taken floor(rate) times, and once more if its hash falls below the rest.

The targets are met as they are given, however often that takes a document. With ``repeat`` a target
that would take a domain's documents more often is lowered (see ``attainable``), and no rate is above
twice ``repeat``. ``mix`` gives for each domain the goal that was sought and the share that the rates
meet, so that a lowered target or an end of the ``ITERATIONS`` before the tolerance shows.

The model's fit uses at most ``sample`` labelled documents of each domain (in hash order of their
ids) and the ``VOCABULARY`` words that tell domains apart best; posteriors, totals and rates use every document.

Defined results: null and empty texts have no tokens and the posterior of the intercepts; a null
language or label is ignored; without labels the posterior is even and the rates meet no target; a
domain without documents can't be met; repeated rows each get their row and the same rate;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, schema_with, settle, text_bytes

SAMPLE, VOCABULARY, ITERATIONS, TOLERANCE, DAMPING = 3000, 5000, 60, 1e-4, 0.01
#: So many steps without progress are the end: nothing nearer can be met.
STALLED = 4
#: In the pipeline a target is lowered if it needs documents more often than this.
STAGE_REPEAT = 2.0
#: Production targets: share of tokens by domain of the labels table.
TARGETS = {"clean": 0.93, "toxic": 0.04, "poor": 0.03}
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def label_domain() -> Column:
    """The domain that a row of the labels table names."""
    return F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


@dataclass
class DomainModel:
    """Posterior over ``domains`` from the set of known words in a text."""

    domains: list[str]
    words: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (words + 4, domains): words, then intercept and three ratios

    def posterior(self, text: bytes, extra: tuple[float, ...]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(self.domains), 1 / len(self.domains))
        get = self.words.get
        known = [i for i in map(get, set(text.translate(LETTERS).split())) if i is not None]
        score = self.weights[known].sum(0) + np.array(extra) @ self.weights[len(self.words) :]
        score -= score.max()
        out = np.exp(score)
        return out / out.sum()


def text_extra(text: bytes, words: list[bytes]) -> tuple[float, ...]:
    """Intercept, share of distinct words, of symbols a word, of capitals."""
    n = max(len(words), 1)
    drop = lambda chars: len(text) - len(text.translate(None, chars))
    return 1.0, len(set(words)) / n, min(drop(b"#*$%&|<>!") / n, 3.0), drop(bytes(range(65, 91))) / max(len(text), 1)


def telling_words(words: list[bytes], flat: np.ndarray, doc: np.ndarray, y: np.ndarray, most: int) -> list[int]:
    """Numbers of words whose presence and a domain depend on each other: G statistic above
    2 ln(words), which by chance no word of so many reaches, the strongest first. flat, doc: the
    numbers of the words in each document, and whose they are."""
    both = np.stack([np.bincount(flat, y[doc, k], len(words)) for k in range(y.shape[1])], 1)
    has, n, of = both.sum(1, keepdims=True), len(y), y.sum(0)
    g = np.zeros_like(both)
    for seen, row, column in ((both, has, of), (has - both, has, n - of), (of - both, n - has, of), (n - has - of + both, n - has, n - of)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(seen > 0, 2 * seen * np.log(seen * n / (row * column)), 0)
    best = g.max(1)
    told = np.flatnonzero(best > 2 * np.log(max(len(words), 1)) + 4)
    return sorted(told.tolist(), key=lambda i: (-best[i], words[i]))[:most]


def fit_domains(texts: list[bytes], marks: list[str], shares: dict[str, float], vocabulary: int = VOCABULARY, steps: int = 200) -> DomainModel:
    """Multinomial ridge regression, weighted so that the domains have their shares."""
    domains = sorted(shares)
    if len(set(marks)) < 2:
        return DomainModel(domains)
    place: dict[bytes, int] = {}
    sets = [np.array([place.setdefault(w, len(place)) for w in set(x.translate(LETTERS).split())], np.int32) for x in texts]
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    y = np.array([[m == d for d in domains] for m in marks], float)
    words = list(place)
    kept = telling_words(words, flat, doc, y, vocabulary)
    new = np.full(len(words), -1)
    new[kept] = np.arange(len(kept))
    ids = {words[i]: k for k, i in enumerate(kept)}
    flat, doc = new[flat][new[flat] >= 0], doc[new[flat] >= 0]
    del place, sets, words
    extra = np.array([text_extra(x, x.split()) for x in texts])
    share = (y * np.array([shares[d] for d in domains]) / np.maximum(y.mean(0), 1e-9)).sum(1)
    w = np.zeros((len(kept) + extra.shape[1], len(domains)))
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        score = extra @ w[len(kept) :]
        for k in range(len(domains)):
            score[:, k] += np.bincount(doc, w[flat, k], len(y))
        p = np.exp(score - score.max(1, keepdims=True))
        miss = share[:, None] * (p / p.sum(1, keepdims=True) - y) / len(y)
        gradient = np.concatenate([np.stack([np.bincount(flat, miss[doc, k], len(kept)) for k in range(len(domains))], 1), extra.T @ miss]) + 2e-4 * w
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return DomainModel(domains, ids, w)


def train_domains(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = SAMPLE) -> DomainModel:
    """labels: doc_id, domain. A document with several domains has the first by name."""
    marks = labels.filter(F.col("domain").isin(*targets) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    picked = None
    for domain in sorted(targets):
        some = marks.filter(F.col("domain") == domain).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # len(targets) x sample ids at most
    rows = sorted(texts.groupBy("label_id").agg(F.min("domain").alias("domain"), F.min("text").alias("text")).collect(), key=lambda r: r["label_id"])
    total = max(1, sum(counts.values()))
    return fit_domains([r["text"].encode() for r in rows], [r["domain"] for r in rows], {d: counts.get(d, 0) / total for d in targets})


def memberships(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_tokens (words) and p, the posterior over the model's domains."""

    def each(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in keep}
        n, p = [], []
        for text in text_bytes(batch.column("text")):
            words = text.split()
            n.append(len(words))
            p.append(model.posterior(text, text_extra(text, words)))
        return out | {"n_tokens": n, "p": p}

    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    return map_batches(kept, schema_with(kept, keep, "n_tokens long, p array<double>"), each)


@dataclass
class Fit:
    """The steps from r = 1, the greatest rate allowed, the shares sought, and the shares met."""

    steps: list[np.ndarray]
    most: float
    goal: np.ndarray
    met: np.ndarray


def rates_of(p: np.ndarray, history: list[np.ndarray], most: float = np.inf) -> np.ndarray:
    """The rates after the steps so far, from r = 1; p has a row for each document."""
    rate = np.ones(len(p))
    for step in history:
        rate = np.clip(rate - p @ step, 0.0, most)
    return rate


def attainable(targets: np.ndarray, shares: np.ndarray, repeat: float) -> np.ndarray:
    """The targets, but for domains of which the corpus has so little that its documents would have
    to be taken more than ``repeat`` times: those grow no more than the domain that has most room."""
    goal, short = targets.copy(), np.zeros(len(targets), bool)
    while True:
        lack = ~short & (targets > repeat * shares)
        if not lack.any():
            return goal
        short |= lack
        free = ~short
        grown = free & (targets >= shares)
        pool = short | (grown if grown.any() else free)  # these share what the rest leaves, as they stand
        left = 1 - targets[~pool].sum()
        goal = targets.copy()
        goal[pool] = left * shares[pool] / max(shares[pool].sum(), 1e-12)


def fit_steps(members: DataFrame, targets: np.ndarray, repeat: float | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Fit:
    """The steps after which expected domain totals match the targets (shares)."""
    k, most = len(targets), np.inf if repeat is None else 2 * repeat
    narrow, fit = members.select("n_tokens", "p"), Fit([], most, targets, np.zeros(k))

    def sums(history: list[np.ndarray]) -> np.ndarray:
        def each(batch: pa.RecordBatch) -> dict:
            n = batch.column("n_tokens").to_numpy().astype(float)
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            rate = rates_of(p, history, most)
            live = n * ((rate > 0) & (rate < most))
            return {"v": [np.concatenate([(n * rate) @ p, ((p * live[:, None]).T @ p).ravel(), [n.sum()]])]}

        parts = map_batches(narrow, "v array<double>", each)
        row = parts.agg(*(F.sum(F.col("v")[i]) for i in range(k + k * k + 1))).first()
        return np.array([x or 0.0 for x in row])

    least, stalled = np.inf, 0
    for _ in range(iterations):
        got = sums(fit.steps)
        total = got[-1]
        if not total:
            break
        if not fit.steps and repeat is not None:
            fit.goal = attainable(targets, got[:k] / total, repeat)
        fit.met = got[:k] / total
        miss = got[:k] - fit.goal * total
        far = float(np.abs(miss).max()) / total
        stalled = 0 if far < 0.99 * least else stalled + 1
        least = min(least, far)
        if far <= tolerance or stalled >= STALLED:
            break
        gram = got[k : k + k * k].reshape(k, k)
        step = np.linalg.solve(gram + np.diag(DAMPING * gram.sum(1) + 1e-9 * total), miss)
        fit.steps.append(step)
    else:
        fit.met = sums(fit.steps)[:k] / total
    return fit


def goals(model: DomainModel, targets: dict[str, float]) -> np.ndarray:
    goal = np.array([targets[d] for d in model.domains])
    return goal / goal.sum()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, repeat: float | None = None) -> DataFrame:
    """doc_id, n_tokens, a posterior column p_<domain> for each, rate, copies to take, and, the same in
    every row, goal_<domain> and met_<domain>: the share of tokens sought, and that the rates meet."""
    model = train_domains(docs, labels, targets, sample)
    members = settle(memberships(docs, model, ["doc_id"]), "memberships")
    fit = fit_steps(members, goals(model, targets), repeat)
    told = [F.lit(float(x)).alias(f"{c}_{d}") for c, xs in (("goal", fit.goal), ("met", fit.met)) for d, x in zip(model.domains, xs)]
    return with_copies(members, fit, ["doc_id"]).select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate", "copies", *told)


def chance() -> Column:
    """A document's even draw from [0, 1), the same whenever it is made."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def with_copies(members: DataFrame, fit: Fit, keep: list[str]) -> DataFrame:
    def each(batch: pa.RecordBatch) -> dict:
        p = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1)
        return {c: batch.column(c) for c in [*keep, "n_tokens", "p"]} | {"rate": rates_of(p, fit.steps, fit.most)}

    rated = map_batches(members, schema_with(members, keep, "n_tokens long, p array<double>, rate double"), each)
    return rated.withColumn("copies", (F.floor("rate") + (chance() < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, repeat: float | None = None) -> DataFrame:
    """docs itself, each row as often as its rate says; texts pass through one worker, once."""
    model = train_domains(docs, labels, targets, sample)
    fit = fit_steps(settle(memberships(docs, model, []), "memberships"), goals(model, targets), repeat)
    names = docs.columns

    def each(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("text"))
        rate = rates_of(np.array([model.posterior(x, text_extra(x, x.split())) for x in texts]), fit.steps, fit.most)
        copies = np.floor(rate) + (batch.column(len(names)).to_numpy() < rate - np.floor(rate))
        rows = pa.array(np.repeat(np.arange(len(texts)), copies.astype(np.int64)))
        return {c: batch.column(i).take(rows) for i, c in enumerate(names)}

    return map_batches(docs.select(*names, chance().alias("a draw of its own")), docs.schema, each)
