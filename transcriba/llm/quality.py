"""Quality scores by a sparse ensemble of rules (rule paths of trees, lasso logistic weights).

Statistics of the whole text are Spark expressions. A bounded sample of labelled rows grows shallow
boosted trees; every path from a root to a node is a conjunctive rule over the statistics; an L1
logistic fit keeps few of them; those compile into one Spark column. Scoring runs inside Catalyst.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, named

#: Labelled rows that the fit reads at most, taken by the order of a hash of their id.
MAX_FIT_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Scale-free statistics of a whole text; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(t)
    n = F.greatest(chars, F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)).cast("double"), F.size(lines).cast("double")

    def without(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(t, pattern, ""))) / n

    def less(char: str) -> Column:
        return (chars - F.length(F.replace(t, F.lit(char), F.lit("")))) / n

    return {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": n / n_words,
        "upper": without("[A-Z]+"),
        "digit": without("[0-9]+"),
        "symbol": without(r"[#$%&*@^~<>{}\[\]\\/=+_]+"),
        "sentence_mark": without("[.,;:?]+"),
        "bang": less("!"),
        "pipe": less("|"),
        "line_break": less("\n"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 2)) / n_words,
        "marked_words": F.size(F.filter(words, lambda w: w.rlike(r"[^\p{L}\p{N}.,;:'’)\"-]$"))) / n_words,
        "log_line_chars": F.log1p(chars / n_lines),
    }


Condition = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    names: list[str]
    bias: float
    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The model as a Spark expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for i, above, at in rule:
                c = stats[self.names[i]]
                holds = holds & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * rule_holds(x, rule)
        return 1 / (1 + np.exp(-z))


def rule_holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, at in rule:
        out &= (x[:, i] > at) if above else (x[:, i] <= at)
    return out


def _tree_rules(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Grows one regression tree on binned statistics; all its paths, and its fitted values."""
    rules, fitted = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        y = target[rows]
        fitted[rows] = y.mean()
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-12, None, None)
        total, n = y.sum(), len(rows)
        for i, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[rows, i]
            left_n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            left_y = np.cumsum(np.bincount(b, weights=y, minlength=len(c) + 1))[:-1]
            ok = (left_n >= least) & (n - left_n >= least)
            if not ok.any():
                continue
            right_n = np.maximum(n - left_n, 1)
            gain = np.where(ok, left_y**2 / np.maximum(left_n, 1) + (total - left_y) ** 2 / right_n - total**2 / n, -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], i, j)
        if best[1] is None:
            continue
        _, i, j = best
        goes_left = bins[rows, i] <= j
        at = float(cuts[i][j])
        todo += [((*path, (i, False, at)), rows[goes_left]), ((*path, (i, True, at)), rows[~goes_left])]
    return rules, fitted


def _lasso(r: np.ndarray, y: np.ndarray, lam: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic weights by accelerated proximal gradient; the bias is free."""
    n, k = r.shape
    w, b, v, vb, t = np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(k), 0.0, 1.0
    vb = b
    u = np.random.default_rng(0).random(k)
    for _ in range(30):  # the largest eigenvalue bounds the step
        u = r.T @ (r @ u)
        norm = np.linalg.norm(u)
        u /= max(norm, 1e-12)
    step = 1 / (0.25 * (norm / n + 1) + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + vb)))
        g = (p - y) / n
        nw = v - step * (r.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lam, 0)
        nb = vb - step * g.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, seed: int = 7) -> RuleModel:
    """Trees, their paths as rules, and lasso weights whose strength is chosen on a third of the rows.

    Without rows, or with one class alone, the model is that class's share (one half without rows).
    """
    if len(y) < 12 or y.min() == y.max():
        m = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return RuleModel(names, math.log(m / (1 - m)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.01, 0.99, 48))) for i in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)])
    rules: dict[tuple[Condition, ...], None] = {}
    f = np.zeros(len(y))
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(12, len(y) // 2), replace=False))
        p = 1 / (1 + np.exp(-f))
        found, _ = _tree_rules(x[rows], bins[rows], cuts, (y - p)[rows], depth, max(4, len(rows) // 400))
        rules.update(dict.fromkeys(found))
        leaves = [q for q in found if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in found)]
        for q in leaves:
            own = rule_holds(x, q)
            use = own[rows]
            if use.any():
                pr = p[rows][use]
                f[own] += 0.3 * np.clip((y[rows][use] - pr).sum() / max((pr * (1 - pr)).sum(), 1e-3), -4, 4)
    kept = list(rules)
    r = np.column_stack([rule_holds(x, q) for q in kept]).astype(np.float64)
    unique = np.unique(r, axis=1, return_index=True)[1]  # rules that hold on the same rows are one
    unique = unique[(r[:, unique].std(0) > 0)]
    kept, r = [kept[i] for i in sorted(unique)], r[:, sorted(unique)]
    part = rng.permutation(len(y)) % 3 == 0
    best, best_loss = 0.001, math.inf
    for lam in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005):
        w, b = _lasso(r[~part], y[~part], lam, 200)
        z = r[part] @ w + b
        loss = float(np.mean(np.logaddexp(0, z) - y[part] * z))
        if loss < best_loss - 1e-4:
            best, best_loss = lam, loss
    w, b = _lasso(r, y, best)
    on = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(names, float(b), [kept[i] for i in on], [float(w[i]) for i in on])


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fits the rules on at most max_rows labelled documents that are not held out, taken by a hash of their id.

    Labels other than 0 and 1 count as absent; of several labels of one id the least counts. An id that
    stands for several texts gives one row, the one of the least statistics. Null ids, and ids without a
    document, teach nothing; without any row, or with labels of one kind alone, the model is a constant.
    """
    ok = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = ok.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    stats = statistics(F.col("text"))
    rows = docs.select(named(id_col).cast("long").alias("_id"), named(text_col).alias("text")).join(F.broadcast(sample), "_id")  # max_rows bounds the broadcast
    found = rows.select("_id", F.col("_y").cast("double").alias("_y"), F.struct(*[c.cast("double").alias(k) for k, c in stats.items()]).alias("s"))
    found = found.groupBy("_id", "_y").agg(F.min("s").alias("s")).select("_id", "_y", "s.*").orderBy("_id").toPandas()  # max_rows rows at most
    x = found[list(stats)].to_numpy(np.float64)
    return fit_rules(x, found["_y"].to_numpy(np.float64), list(stats))


def quality_scores(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (0 to 1, higher: label 1 likelier).

    Every row gets one by its text alone: repeated rows and equal texts score alike, empty, null and
    very long texts too; an empty table stays empty. Input columns keep their values whatever their
    names, but for one already named score_col: the score takes its place, so name another score_col
    to keep both.
    """
    docs = docs.select(*[named(c) for c in docs.columns if c.lower() != score_col.lower()])
    stats = statistics(named(text_col))
    used = sorted({model.names[i] for rule in model.rules for i, _, _ in rule})
    own = {k: fresh(docs, f"_stat_{k}") for k in used}
    rows = docs.select(*columns(docs), *[stats[k].cast("double").alias(own[k]) for k in used])
    return rows.select(*columns(docs), model.column({k: F.col(own[k]) for k in used}).alias(score_col))
