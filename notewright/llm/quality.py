"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Method (Friedman and Popescu, 2008). Small boosted trees over text statistics are
grown on a labelled sample; every path from a root becomes a conjunctive rule; a
lasso logistic regression over the rules keeps few of them with weights. The result is
a sum of CASE expressions over statistics, which are columns too: scoring is one
projection inside the JVM, without a shuffle or Python.

Scale. Only fitting sees the driver, with at most SAMPLE labelled rows in hash order
(the documented bound; they are chosen among all labelled rows). Scoring reads whole
texts of all rows.

Edge cases. Null text: empty; empty texts have statistics of 0 and a score. Without
labelled rows the score is 0.5, with one class only that class's share (bounded away
from 0 and 1). A null label is no label; of repeated labels the least counts. Statistics
use the text alone. Rows that repeat an id are scored each for itself; other columns pass through, names that
begin with nw_ are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse

#: Labelled rows used to fit; trees and their depth; lasso weight; quantiles tried as thresholds.
SAMPLE, TREES, DEPTH, LASSO, CUTS = 20_000, 40, 3, 2e-3, 48
THRESHOLD = 0.3

#: Marks whose share of the text is a statistic.
MARKS = {"pipe": "|", "bang": "!", "hash": "#", "dollar": "$", "percent": "%", "and": "&", "star": "*", "stop": ".", "comma": ",", "at": "@", "less": "<", "brace": "{", "slash": "/", "under": "_", "line": "\n"}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as double columns."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), of), F.lit(0.0))
    n = F.size(words).cast("double")
    out = {k: share(size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))), size) for k, c in MARKS.items()}
    return out | {
        "words": F.log1p(n),
        "word_size": share(size, n),
        "distinct": share(F.size(F.array_distinct(words)), n),
        "upper": share(F.regexp_count(text, F.lit("[A-Z]")), size),
        "digit": share(F.regexp_count(text, F.lit("[0-9]")), size),
        "beyond_ascii": share(size - F.char_length(text), size),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold), and its weight."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, of: Column) -> Column:
        every = None
        for name, above, cut in self.parts:
            one = of[name] > cut if above else of[name] <= cut
            every = one if every is None else every & one
        return F.when(every, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[n] > c) if above else (x[n] <= c) for n, above, c in self.parts])


@dataclass(frozen=True)
class RuleEnsemble:
    names: tuple[str, ...]
    bias: float
    rules: tuple[Rule, ...]

    def score_column(self, of: Column) -> Column:
        """Over a struct of the statistics."""
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + r.column(of)
        return 1 / (1 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Grows a tree on gradients; collects its paths in out; returns its values."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if path:
        out.append(path)
    if depth == 0 or len(g) < 40:
        return value
    best, gain0 = None, g.sum() ** 2 / (h.sum() + 1.0) + 1e-6
    for f in columns:
        if not len(cuts[f]):
            continue
        at = np.searchsorted(cuts[f], x[:, f], side="left")  # at <= i: x <= cuts[i]
        gl = np.cumsum(np.bincount(at, g, len(cuts[f]) + 1))[:-1]
        hl = np.cumsum(np.bincount(at, h, len(cuts[f]) + 1))[:-1]
        nl = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - gain0
        gain[(nl < 10) | (nl > len(g) - 10)] = -1
        i = int(gain.argmax())
        if gain[i] > 0 and (best is None or gain[i] > best[0]):
            best = gain[i], f, cuts[f][i]
    if best is None:
        return value
    _, f, cut = best
    left = x[:, f] <= cut
    for side, above in ((left, False), (~left, True)):
        value[side] = _tree(x[side], cuts, g[side], h[side], columns, depth - 1, (*path, (int(f), above, float(cut))), out)
    return value


def _tidy(path: tuple) -> tuple:
    """The tightest bound of each statistic and side."""
    tight: dict = {}
    for f, above, cut in path:
        old = tight.get((f, above))
        tight[f, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple(sorted((f, above, cut) for (f, above), cut in tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Trees to rules to lasso. x: rows by statistics; y: 0 or 1."""
    if not len(y):
        return RuleEnsemble(names, 0.0, ())
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleEnsemble(names, bias, ())
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    cuts = [c[(c >= col.min()) & (c < col.max())] for c, col in zip(cuts, x.T, strict=True)]
    z, paths = np.full(len(y), bias), []
    for _ in range(trees):
        rows = rng.permutation(len(y))[: max(min(len(y), 100), len(y) // 2)]
        columns = rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        p = _sigmoid(z)
        found: list = []
        _tree(x[rows], cuts, (y - p)[rows], (p * (1 - p))[rows], columns, depth, (), found)
        paths += found
        hold = _holding(x, found)
        leaf = [i for i, f in enumerate(found) if not any(len(o) > len(f) and o[: len(f)] == f for o in found)]
        for i in leaf:
            on = hold[:, i] > 0
            p_on = p[on]
            z[on] += 0.3 * (y[on] - p_on).sum() / ((p_on * (1 - p_on)).sum() + 1.0)
    rules = sorted(set(map(_tidy, paths)))
    m = _holding(x, rules)
    keep = (m.mean(axis=0) > 0) & (m.mean(axis=0) < 1)
    m, rules = m[:, keep], [r for r, k in zip(rules, keep, strict=True) if k]
    _, first = np.unique(m, axis=1, return_index=True)
    m, rules = m[:, np.sort(first)], [rules[i] for i in np.sort(first)]
    bias, weight = _lasso(m, y.astype(float), lasso, bias)
    made = tuple(Rule(tuple((names[f], above, cut) for f, above, cut in r), float(w)) for r, w in zip(rules, weight, strict=True) if w != 0)
    return RuleEnsemble(names, bias, made)


def _holding(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for i, r in enumerate(rules):
        for f, above, cut in r:
            out[:, i] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _lasso(m: np.ndarray, y: np.ndarray, lasso: float, bias: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient."""
    n, k = m.shape
    w = v = np.zeros(k)
    b = vb = bias
    square = np.linalg.norm(m[: min(n, 2000)].T @ m[: min(n, 2000)], 2) / min(n, 2000) if k else 1.0
    step, t = 1 / (0.25 * (square * 1.2 + 1)), 1.0
    for _ in range(rounds):
        r = _sigmoid(m @ v + vb) - y
        new = v - step * (m.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        nb = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return float(b), w


def train_quality(docs: DataFrame, labels: DataFrame, keep: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fits on at most sample labelled rows, those of least hash, among rows of labels where keep is true."""
    chosen = labels.filter(keep & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    names = tuple(statistics(F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id").select("id", "y", *[c.alias(k) for k, c in statistics(F.col("t")).items()])
    got = rows.orderBy(F.xxhash64("id"), "id", *names).limit(sample).toPandas()
    return fit_rules(got[list(names)].to_numpy(float).reshape(len(got), len(names)), got["y"].to_numpy(int), names)


def quality_scores(docs: DataFrame, model: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with nw_score and nw_predicted; one projection.

    The statistics are the one element of an array that the rules run over, so that each is computed once a row."""
    refuse(docs)
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col(text_col)).items()])
    scored = docs.withColumn("nw_score", F.transform(F.array(stats), model.score_column)[0])
    return scored.withColumn("nw_predicted", F.when(F.col("nw_score") >= threshold, 1).otherwise(0))
