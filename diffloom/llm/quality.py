"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees on a bounded sample of labelled rows propose rules (every path from a
root is a conjunction of thresholds); a lasso logistic regression keeps few of them; those
are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bytes_np import LOWER, RangeHash, buffers, chunks, weighted_set, word_spans
from .common import as_col, fresh

MAX_SAMPLE = 20_000
STATS = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "spaces",
         "beyond_ascii", "log_line_words", "repeated_neighbours", "distinct_words")
OTHER, LOWERCASE, UPPERCASE, DIGIT, SPACE, NEWLINE, STOP, BANG, BAR, BEYOND = range(10)
CLASS = np.full(256, OTHER, np.int32)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWERCASE, UPPERCASE, DIGIT, BEYOND
CLASS[[9, 11, 12, 13, 32]], CLASS[10], CLASS[33], CLASS[124] = SPACE, NEWLINE, BANG, BAR
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = STOP


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """``STATS`` of texts; null counts as empty, and all statistics of an empty text are 0."""
    buf, off = buffers(texts)
    out = {k: np.zeros(len(off) - 1) for k in STATS}
    for i, j in chunks(off):
        part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        n, size = j - i, np.diff(o)
        code = CLASS[part] + np.repeat(np.arange(n, dtype=np.int32) * 10, size)
        c = np.bincount(code, minlength=10 * n).reshape(n, 10).astype(float)
        start, end, doc = word_spans(part, o)
        words = np.bincount(doc, minlength=n).astype(float)
        h = RangeHash(LOWER[part]).of(start, end)
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        _, d, _ = weighted_set(h, doc)
        size, w = np.maximum(size, 1), np.maximum(words, 1)
        letters = np.maximum(c[:, LOWERCASE] + c[:, UPPERCASE], 1)
        for k, v in {"log_bytes": np.log1p(np.diff(o)), "log_words": np.log1p(words),
                     "word_bytes": np.bincount(doc, end - start, minlength=n) / w, "upper": c[:, UPPERCASE] / letters,
                     "digits": c[:, DIGIT] / size, "symbols": c[:, OTHER] / size, "bangs": c[:, BANG] / size,
                     "bars": c[:, BAR] / size, "stops": c[:, STOP] / size, "spaces": c[:, SPACE] / size,
                     "beyond_ascii": c[:, BEYOND] / size, "log_line_words": np.log1p(words / (c[:, NEWLINE] + 1)),
                     "repeated_neighbours": np.bincount(doc[1:][same], minlength=n) / w,
                     "distinct_words": np.bincount(d, minlength=n) / w}.items():
            out[k][i:j] = v
    return out


@F.arrow_udf(StructType([StructField(k, DoubleType()) for k in STATS]))
def text_statistics(texts: pa.Array) -> pa.Array:
    s = statistics_of(texts)
    return pa.StructArray.from_arrays([pa.array(s[k]) for k in STATS], list(STATS))


# --- rules ------------------------------------------------------------------------

Condition = tuple[str, bool, float]  # statistic, above?, threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """Score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: str) -> Column:
        """The ensemble as one expression over a struct of statistics; a number from 0 to 1."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in conditions:
                v = F.col(f"{stats}.{name}")
                holds = holds & ((v > at) if above else (v <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(stats.values())))
        total = np.full(n, self.intercept)
        for conditions, weight in self.rules:
            holds = np.ones(n, bool)
            for name, above, at in conditions:
                holds &= (stats[name] > at) if above else (stats[name] <= at)
            total += weight * holds
        return 1 / (1 + np.exp(-total))


def _tree_rules(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int,
                least: int) -> tuple[list[tuple[tuple[int, bool, int], ...]], np.ndarray]:
    """Paths of one tree on binned statistics, and its step for every row."""
    step, rules = np.zeros(len(grad)), []

    def grow(rows: np.ndarray, path: tuple, level: int):
        g, h = grad[rows], hess[rows]
        if path:
            rules.append(path)
        best = (1e-9, None)
        if level < depth and len(rows) >= 2 * least:
            score = g.sum() ** 2 / (h.sum() + 1)
            for f, c in enumerate(cuts):
                b = bins[rows, f]
                k = len(c) + 1
                n, gs, hs = (np.cumsum(np.bincount(b, w, minlength=k))[:-1] for w in (None, g, h))
                ok = (n >= least) & (n <= len(rows) - least)
                gain = np.where(ok, gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - score, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            step[rows] = g.sum() / (h.sum() + 1)
            return
        f, at = best[1]
        below = bins[rows, f] <= at
        grow(rows[below], (*path, (f, False, at)), level + 1)
        grow(rows[~below], (*path, (f, True, at)), level + 1)

    grow(np.arange(len(grad)), (), 0)
    return rules, step


def fit_rules(stats: dict[str, np.ndarray], labels: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3,
              penalty: float = 2e-4, rounds: int = 600, seed: int = 7) -> RuleEnsemble:
    """Fit on arrays.  Without rows every score is 0.5; with one class only, it is near that class."""
    y = np.asarray(labels, float)
    if not len(y):
        return RuleEnsemble(0.0, ())
    base = float(np.clip(y.mean(), 0.005, 0.995))
    intercept = float(np.log(base / (1 - base)))
    if y.min() == y.max():
        return RuleEnsemble(intercept, ())
    names = list(STATS)
    x = np.stack([stats[k] for k in names], axis=1)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, total, paths = np.random.Generator(np.random.PCG64(seed)), np.full(len(y), intercept), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        if not len(rows):
            continue
        found, _ = _tree_rules(bins[rows], cuts, (y - p)[rows], (p * (1 - p))[rows], depth, max(5, len(y) // 400))
        for path in found:
            paths.setdefault(path)
        _, step = _tree_rules(bins, cuts, y - p, p * (1 - p), depth, max(5, len(y) // 400))
        total += rate * step
    paths = list(paths)
    m = np.ones((len(y), len(paths)), np.float32)
    for r, path in enumerate(paths):
        for f, above, at in path:
            m[:, r] *= (bins[:, f] > at) if above else (bins[:, f] <= at)
    weights, b = _lasso(m, y, intercept, penalty, rounds)
    rules = tuple((tuple((names[f], above, float(cuts[f][at])) for f, above, at in paths[r]), float(weights[r]))
                  for r in np.flatnonzero(np.abs(weights) > 1e-4))
    return RuleEnsemble(float(b), rules)


def _lasso(m: np.ndarray, y: np.ndarray, intercept: float, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept is free."""
    n, k = m.shape
    v = np.ones(k + 1)
    for _ in range(20):  # largest eigenvalue of the design, for the step
        u = m @ v[:k].astype(np.float32) + v[k]
        v = np.append(m.T @ u.astype(np.float32), u.sum())
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / (1.05 * norm)
    w, z, t = np.append(np.zeros(k), intercept), np.append(np.zeros(k), intercept), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(m @ z[:k].astype(np.float32) + z[k])))
        g = np.append(m.T @ (p - y).astype(np.float32), (p - y).sum()) / n
        new = z - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:k], w[k]


# --- Spark --------------------------------------------------------------------------

def held_out(id_) -> Column:
    """Rows that training never sees: crc32 of the identifier as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(as_col(id_).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = MAX_SAMPLE, seed: str = "quality") -> RuleEnsemble:
    """Fit on at most about ``max_rows`` labelled documents, drawn by identifier.

    Of contradicting labels of one identifier the smaller counts; null labels and identifiers
    are left out, as are labels without a document.  Texts stay on the executors: only the
    sample's statistics come to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label_col).alias("_y"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    # Bounded by max_rows.
    sample = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(
        F.broadcast(known.withColumnRenamed(id_col, "_i")), "_i")
    got = sample.select(F.col("_y").cast("double").alias("y"), text_statistics("_t").alias("s")).select("y", "s.*").toArrow()
    return fit_rules({k: np.asarray(got.column(k)) for k in STATS}, np.asarray(got.column("y")))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (null counts as empty); a column named ``out`` is replaced."""
    keep, stats = [c for c in docs.columns if c.lower() != out.lower()], fresh(docs, "_stats")
    return docs.withColumn(stats, text_statistics(text_col)).select(*keep, model.column(stats).alias(out))
