"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Features cos(w.x + b) of standardised document statistics x approximate a
Gaussian kernel.  Partitions of the fitting part of a bounded labelled sample
sum Z'Z and Z'y, which add up in a shuffle; the driver solves the ridge system of
D + 1 unknowns.  The scores of the held-back part, rounded to a grid, give the
isotonic map from score to the probability of being good (pool adjacent violators).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy import ndarray as Arr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import STATISTICS, labelled, statistics, summed
from .textkit import chunks, cut, with_column, without

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-2
#: At most so many labelled documents are used to fit and calibrate.
SAMPLE = 20_000
CALIBRATION = 0.3
#: A document goes if its calibrated probability of being good is below this.
KEEP_AT = 0.5
SEED = 7


@dataclass
class Model:
    mean: Arr
    scale: Arr
    omega: Arr
    phase: Arr
    beta: Arr
    knots: Arr
    levels: Arr

    def score(self, x: Arr) -> Arr:
        return lift((x - self.mean) / self.scale, self.omega, self.phase) @ self.beta

    def probability(self, x: Arr) -> Arr:
        s = self.score(x)
        return np.interp(s, self.knots, self.levels) if len(self.knots) else np.clip(s, 0, 1)


def lift(x: Arr, omega: Arr, phase: Arr) -> Arr:
    z = np.cos(x @ omega + phase) * np.sqrt(2 / omega.shape[1])
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(x: Arr, y: Arr, w: Arr) -> tuple[Arr, Arr]:
    """Knots and non-decreasing levels of the weighted least-squares fit, for x in ascending order."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a, a, b, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, m, v = blocks.pop()
            lo, _, n, u = blocks.pop()
            blocks.append([lo, hi, (m * v + n * u) / (u + v), u + v])
    ends = [e for lo, hi, m, _ in blocks for e in ([(lo, m), (hi, m)] if hi > lo else [(lo, m)])]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def _xy(f):
    """f(x, y) of an Arrow batch of (x array<double>, y)."""
    return lambda batch: f(np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("y")).astype(float))


def _described(batches):
    for batch in batches:
        for a, z in chunks(batch.column("text")):
            part = batch.slice(a, z - a)
            x = statistics(part.column("text"))
            off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("draw"), part.column("y"), pa.ListArray.from_arrays(off, pa.array(x.reshape(-1)))], names=["draw", "y", "x"]
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """The model of labels.quality for docs.  Without labelled documents every probability is 1."""
    d = len(STATISTICS)
    chosen = labelled(docs, labels, "quality", sample).select(F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(1000)).alias("draw"), "text", "y")
    rows = cut(chosen.mapInArrow(_described, "draw bigint, y int, x array<double>"))
    held = F.col("draw") < int(1000 * CALIBRATION)
    train, rest = rows.filter(~held), rows.filter(held)
    rng = np.random.default_rng(SEED)
    omega, phase = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features)
    first = summed(train, _xy(lambda x, y: np.stack([np.full(d, float(len(x))), x.sum(0), (x * x).sum(0)])))
    if first is None:
        return Model(np.zeros(d), np.ones(d), omega, phase, np.r_[np.zeros(features), 1.0], np.zeros(0), np.zeros(0))
    mean = first[1] / first[0]
    scale = np.sqrt(np.maximum(first[2] / first[0] - mean**2, 0))
    scale[scale < 1e-9] = 1

    def normal(x, y):
        z = lift((x - mean) / scale, omega, phase)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    m = summed(train, _xy(normal))
    penalty = ridge * first[0, 0] / features * np.eye(features + 1)
    penalty[-1, -1] = 0
    beta = np.linalg.solve(m[:, :-1] + penalty + 1e-9 * np.eye(features + 1), m[:, -1])
    model = Model(mean, scale, omega, phase, beta, np.zeros(0), np.zeros(0))
    grid = 2000

    def histogram(x, y):
        at = np.clip(np.round((model.score(x) + 0.5) / 2 * grid), 0, grid).astype(int)
        return np.stack([np.bincount(at, minlength=grid + 1), np.bincount(at, y, grid + 1)]).astype(float)

    h = summed(rest, _xy(histogram))
    if h is not None:
        some = h[0] > 0
        model.knots, model.levels = isotonic((np.arange(grid + 1) / grid * 2 - 0.5)[some], h[1][some] / h[0][some], h[0][some])
    return model


def _scored(model: Model, least: float | None, column: str | None):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, z in chunks(text):
                part = batch.slice(a, z - a)
                p = np.round(model.probability(statistics(part.column("text"))), 9)
                void = np.asarray(pc.equal(pc.coalesce(pc.utf8_length(part.column("text")), 0), 0))
                p[void] = 0
                out = with_column(part, column, pa.array(p)) if column else part
                yield out if least is None else out.filter(pa.array(p >= least))

    return run


def score(docs: DataFrame, model: Model, least: float | None = None, column: str | None = "quality_score") -> DataFrame:
    """docs with quality_score, the calibrated probability of being good; with least, those that reach it.

    Null and empty texts score 0; very long ones are scored whole.  A score equal to
    least stays.  All columns come through, whatever their names, but one that clashes
    with column, the scores' name; with column None there are no scores, and all do.
    Equal rows score alike; an empty table gives one.
    """
    base = without(docs, column or "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_scored(model, least, column), schema + (f", `{column}` double" if column else ""))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP_AT, column: str | None = "quality_score", **how) -> DataFrame:
    """The documents that the classifier fitted to labels doesn't reject, with their scores, as score gives them.

    Null and empty texts go, a score of exactly least stays; very long texts, repeated
    rows, empty tables and other columns fare as in score.  Labels that are null, that
    contradict each other or whose document isn't there don't count; without any, all
    texts but null and empty ones stay.
    """
    return score(docs, fit(docs, labels, **how), least, column)
