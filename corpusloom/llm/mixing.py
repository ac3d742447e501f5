"""Mixing sources to target weights by soft membership.

A classifier learnt from a labelled table gives every document its domain posteriors p. The
tokens of a domain that a mix is expected to have are sum(rate * tokens * p). Least squares fits one
rate >= 0 a document so that these totals meet the targets, and of all such rates takes those
nearest to 1: it minimises |miss|^2 + PULL * (token-weighted mean of (rate - 1)^2), the miss being
in shares of all tokens. At the least, a projected gradient step leaves the rates as they are:
rate = max(0, 1 - p . force) with PULL * force = miss, one force a domain. So the fit looks for the
forces: from 0 on it takes steps along the projected gradient, scaled by the moments
sum(tokens * p * p') of the documents whose rate is above 0 (Newton's step), halved until the
squares decrease. It ends when the gradient is 0 (TOLERANCE), as also happens with targets that
no rates can meet. Fit.miss says how far the totals are from the targets; if no step gets on or
MAX_STEPS are done, Fit.converged is false and a warning says so.

Each step is one pass over the table of tokens and posteriors; only sums, k + 1 + k * k numbers
for k domains, come to the driver.

Defined results: null and empty texts have no tokens, get the prior as posteriors and a rate by
the same formula; without labelled rows there is no domain and every rate is 1; domains that no
document can be in are left out of the targets; equal texts get equal rates.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io as io
from . import _text as tx

#: Labelled rows that the classifier may see, taken in the order of a hash of doc_id.
SAMPLE_ROWS = 3000
FEATURES = 1 << 15
#: Passes of a fit; it needs about ten. One that comes to the end of them says so.
MAX_STEPS = 200
#: Largest part of the gradient, in shares of all tokens, at which the fit ends.
TOLERANCE = 1e-6
#: Weight of keeping rates near 1 against meeting the targets.
PULL = 1e-7


@dataclass
class Classifier:
    """Multinomial naive Bayes over hashed words; `heat` divides the evidence of a text."""

    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray
    heat: float

    def posteriors(self, w: tx.Words) -> np.ndarray:
        n = len(w.first) - 1
        slot = (w.hash >> np.uint64(64 - 15)).astype(np.int64)
        evidence = np.zeros((n, len(self.domains)))
        some = np.flatnonzero(w.counts)
        if len(some):
            for k in range(len(self.domains)):
                evidence[some, k] = np.add.reduceat(self.weights[k][slot], w.first[:-1][some])
        z = self.prior + evidence / (self.heat * np.sqrt(np.maximum(1, w.counts))[:, None])
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _words(texts: list[str | None]) -> Iterator[tx.Words]:
    for _, _, data, at in tx.slices(pa.array(texts, pa.string())):
        yield tx.words(data, at, tx.ALNUM_ANY_CASE, fold=True)


def fit_classifier(sample: list[tuple[str | None, str]]) -> Classifier | None:
    """From (text, domain) rows; a fifth of them sets the heat."""
    domains = sorted({d for _, d in sample})
    if not domains:
        return None
    number = np.array([domains.index(d) for _, d in sample])
    train = np.arange(len(sample)) % 5 != 4
    counts = np.full((len(domains), FEATURES), 0.5)
    row = 0
    for w in _words([t for t, _ in sample]):
        n = len(w.first) - 1
        own = tx.owner(w.first)
        slot = (w.hash >> np.uint64(64 - 15)).astype(np.int64)
        use = train[row + own]
        np.add.at(counts, (number[row + own[use]], slot[use]), 1.0)
        row += n
    log = np.log(counts / counts.sum(1, keepdims=True))
    share = np.bincount(number, minlength=len(domains)) / len(number)
    model = Classifier(domains, np.log(share), log - log.mean(0), 1.0)
    best = (np.inf, 1.0)
    for heat in (10.0, 3.0, 1.0, 0.3, 0.1):  # of equally good ones the softest
        model.heat, row, loss = heat, 0, 0.0
        for w in _words([t for t, _ in sample]):
            n = len(w.first) - 1
            held = np.flatnonzero(~train[row : row + n])
            p = model.posteriors(w)
            loss -= np.log(np.maximum(p[held, number[row + held]], 1e-9)).sum()
            row += n
        if loss < best[0] - 1e-3 * len(sample):
            best = (loss, heat)
    model.heat = best[1]
    return model


def labelled_sample(docs: DataFrame, domain: str, most: int = SAMPLE_ROWS) -> list[tuple[str | None, str]]:
    """At most `most` rows (text, domain) whose domain is known, in the order of a hash of doc_id."""
    known = docs.select("doc_id", "text", F.col(domain).cast("string").alias("_domain")).where("doc_id is not null and _domain is not null")
    some = known.select("doc_id", "_domain").orderBy(F.xxhash64("doc_id"), "doc_id", "_domain").limit(most)
    rows = known.join(F.broadcast(some), ["doc_id", "_domain"], "left_semi").collect()
    return [(r["text"], r["_domain"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["_domain"], r["text"] or ""))]


def memberships(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, tokens, posterior (array, in the order of model.domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            tokens, posteriors = [], []
            for _, _, data, at in tx.slices(batch.column(1)):
                w = tx.words(data, at, tx.ALNUM_ANY_CASE, fold=True)
                tokens.append(w.counts)
                posteriors += own.posteriors(w).tolist() if own else [[]] * len(w.counts)
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(posteriors, pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    return io.in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, tokens long, posterior array<double>")


def _rate(force: np.ndarray) -> Column:
    """The rate that a document has under these forces (one a domain)."""
    along = F.aggregate(F.zip_with(F.array(*[F.lit(float(x)) for x in force]), F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.greatest(F.lit(0.0), 1 - along)


@dataclass
class Fit:
    rows: DataFrame
    domains: list[str]
    targets: np.ndarray
    totals: np.ndarray
    steps: int
    #: Whether the rates are at the least of the squares.
    converged: bool = True

    @property
    def miss(self) -> float:
        """Largest distance of a domain's total from its target, as a share of all tokens."""
        return float(np.abs(self.totals - self.targets).max(initial=0.0) / max(1.0, self.totals.sum(), self.targets.sum()))


def _sums(members: DataFrame, force: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Totals by domain, sum(tokens * rate^2) and the moments of the documents whose rate is above 0."""
    k = len(force)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k + 1 + k * k)
        for batch in batches:
            t = np.asarray(batch.column(0).fill_null(0), dtype=float)
            p = np.asarray(batch.column(1).flatten(), dtype=float).reshape(len(t), k)
            rate = np.maximum(0.0, 1.0 - p @ force)
            out[:k] += (t * rate) @ p
            out[k] += t @ rate**2
            out[k + 1 :] += ((p * (t * (rate > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], names=["at", "value"])

    parts = io.in_batches(members.select("tokens", "posterior"), run, "at int, value double")
    found = dict(parts.groupBy("at").agg(F.sum("value")).collect())
    out = np.array([found.get(i, 0.0) for i in range(k + 1 + k * k)])
    return out[:k], float(out[k]), out[k + 1 :].reshape(k, k)


def fit_rates(members: DataFrame, domains: list[str], shares: dict[str, float] | None = None) -> Fit:
    """Rates whose expected domain totals come to the targets: shares of all tokens (equal ones
    unless given). `members` is the table of `memberships`, read once a step."""
    k = len(domains)
    force = np.zeros(k)
    if not k:
        return Fit(members.withColumn("rate", F.lit(1.0)), domains, np.zeros(0), np.zeros(0), 0)
    total, square, moments = _sums(members, force)
    tokens = max(total.sum(), 1e-300)  # all rates are 1 here, and posteriors add up to 1
    share = np.array([(shares or {}).get(d, 1.0 if shares is None else 0.0) for d in domains]) * (total > 0)
    target = share / share.sum() if share.sum() > 0 else np.zeros(k)

    def height(force: np.ndarray, square: float) -> float:
        return 0.5 * square / tokens + target @ force + 0.5 * PULL * force @ force

    steps, converged = 0, False
    while total.sum() or steps:
        slope = target - total / tokens + PULL * force
        if converged := bool(np.abs(slope).max() <= TOLERANCE):
            break
        step = np.linalg.solve(moments / tokens + PULL * np.eye(k), -slope)
        here, size = height(force, square), 1.0
        while steps < MAX_STEPS and size > 1e-9:
            steps += 1
            then = _sums(members, force + size * step)
            if height(force + size * step, then[1]) <= here + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        force, (total, square, moments) = force + size * step, then
    converged = converged or not tokens > 1e-300
    if not converged:
        warnings.warn(f"rates have not converged after {steps} steps: shares {(total / tokens).tolist()} for targets {target.tolist()}", RuntimeWarning, stacklevel=2)
    tokens = tokens if tokens > 1e-300 else 0.0
    return Fit(members.withColumn("rate", _rate(force)), domains, tokens * target, total, steps, converged)


def mixed(docs: DataFrame, labelled: DataFrame, domain: str, shares: dict[str, float] | None = None, most: int = SAMPLE_ROWS) -> Fit:
    """Classifier from `labelled` (doc_id, text, domain), posteriors and rates for all of `docs`."""
    model = fit_classifier(labelled_sample(labelled, domain, most))
    members = io.written(memberships(docs, model), "memberships")
    return fit_rates(members, model.domains if model else [], shares)
