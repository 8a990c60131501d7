"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text statistics gives each document's evidence. Grouped sums of it over hosts and
the paths below them, shrunk towards the global mean by how much such groups differ, give posteriors
that move the document's log-odds: much where a site has many documents and differs, little elsewhere.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import column, saved, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Quality:
    """The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of their id.
    Documents with a posterior below ``reject`` go."""

    sample: int = 20_000
    ridge: float = 1.0
    steps: int = 30
    reject: float = 0.3
    pull: float = 0.5


SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
LETTERS = bytes(c for c in range(128) if chr(c).isalpha()) + bytes(range(128, 256))
FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all zero for a null text or one without words."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return out
    counts = Counter(words)
    size = len(raw)
    symbols = size - len(raw.translate(None, SYMBOLS))
    letters = size - len(raw.translate(None, LETTERS))
    lines = [x for x in raw.split(b"\n") if x]
    upper = sum(1 for w in counts if w.isupper() and len(w) > 1)
    bare = sum(counts[w] for w in counts if not w.strip(SYMBOLS + b".,'-"))
    marked = sum(counts[w] for w in counts if w[-1:] not in b".,'-" and w[-1] in SYMBOLS)
    most = max(counts.values())
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    out[:] = (
        1.0, np.log1p(n), symbols / size, letters / size, bare / n, marked / n, most / n, len(counts) / n, same / n,
        upper / len(counts), len(lines) / n, len(set(lines)) / len(lines), np.log(size / n), raw.count(b".") / n,
    )
    return out


def widen(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their capped squares, and a constant."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def fit(x: np.ndarray, y: np.ndarray, conf: Quality):
    """Ridge logistic regression by Newton steps."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = widen(x, centre, scale)
    w = np.zeros(z.shape[1])
    for _ in range(conf.steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - conf.ridge * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + conf.ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, conf: Quality):
    """The model, or None where the labelled rows do not hold both classes.

    It is fitted on ``conf.sample`` labels, chosen by a hash of their id, and on at most twice as many rows:
    where documents share a labelled id, each counts until that bound is reached.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    marks = labels.select(column(labels, id_col).cast("long").alias("id"), column(labels, label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.orderBy(F.xxhash64("id"), "id", "y").limit(conf.sample)

    def measure(batches):
        for b in batches:
            x = [features(t.as_py()).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    chosen = small_batches(rows.join(marks, "id")).select("y", "text").mapInArrow(measure, "y int, x array<double>").limit(2 * conf.sample).collect()
    y = np.array([r.y for r in chosen], float)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.array([r.x for r in chosen]), (y > 0).astype(float), conf)


def evidence(docs: DataFrame, model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(``id``, ``version``, ``host``, ``path``, ``z``): every document's log-odds by the model."""

    def score(batches):
        for b in batches:
            if model is None:
                z = np.zeros(b.num_rows)
            else:
                centre, scale, w = model
                z = np.clip(widen(np.array([features(t.as_py()) for t in b.column("text")]), centre, scale) @ w, -12, 12) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "version", "host", "path")), pa.array(z)], ["id", "version", "host", "path", "z"])

    text = column(docs, text_col).cast("string")
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), column(docs, host_col).cast("string").alias("host"), column(docs, path_col).cast("string").alias("path"), text.alias("text"))
    return small_batches(rows).mapInArrow(score, "id long, version long, host string, path string, z double")


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior documents of a level: within-group variance over the variance between true group means."""
    m = F.col("sum") / F.col("n")
    within = F.greatest(F.col("squares") - F.col("n") * m * m, F.lit(0.0))
    rows, k, inside, spread, squares = groups.agg(F.sum("n"), F.count("*"), F.sum(within), F.sum(F.col("n") * (m - mean) * (m - mean)), F.sum(F.col("n") * F.col("n"))).first()
    if not rows or k < 2 or rows <= k:
        return 1e9
    noise = inside / (rows - k)
    between = (spread - (k - 1) * noise) / (rows - squares / rows)
    return float(min(1e9, noise / between)) if between > 0 and noise > 0 else (1e9 if between <= 0 else 1e-3)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
          label_col: str = "quality", conf: Quality = Quality()) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``version`` (hash of the text), ``evidence``, ``host_prior``,
    ``path_prior``, ``posterior`` and ``kept``.

    A null host or path is a group of its own. A null text, or one without words, has no evidence of
    quality and is rejected. Without labels of both classes all evidence is even and everything else is
    kept. Repeated rows give a row each and count as often; a posterior at the threshold is kept; texts are
    read whole; other columns are not looked at; an empty table gives none.
    """
    model = train(docs, labels, id_col, text_col, label_col, conf)
    rows = saved(evidence(docs, model, id_col, text_col, host_col, path_col), "evidence")
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("sum"), F.sum(p * p).alias("squares"))
    paths = saved(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    n, total = paths.agg(F.sum("n"), F.sum("sum")).first()
    mean = min(max((total or 0.0) / (n or 1), 1e-6), 1 - 1e-6) if n else 0.5
    far, near = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("sum") + far * mean) / (F.col("n") + far)).alias("host_prior"))
    priors = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    priors = priors.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_prior", ((F.col("sum") + near * F.col("host_prior")) / (F.col("n") + near)).alias("path_prior"))
    both = rows.join(priors, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    logit = lambda x: F.log(x / (1 - x))
    bounded = F.least(F.greatest("path_prior", F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("z") + conf.pull * (logit(bounded) - float(np.log(mean / (1 - mean)))))))
    out = both.select("id", "version", F.col("z").alias("evidence"), "host_prior", "path_prior", posterior.alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= conf.reject)
