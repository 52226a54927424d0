"""Sequential search of parameters with Parzen estimators; trials of a batch run side by side as Spark jobs.

Trials so far are parted into the better ones and the rest. For each parameter a mixture of kernels at the better trials'
values is compared with one at the others', and of a number of draws from the first the one whose ratio of densities is
greatest is tried next. A batch is drawn before any of it is scored, so a search depends on its seed alone, not on which
job ends first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Draws of which the best is tried, and share of trials that count as the better ones.
DRAWS, BETTER = 24, 0.25


@dataclass(frozen=True)
class Range:
    """A parameter from ``low`` to ``high``, whole or not, on a logarithmic scale or not."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def at(self, x: float) -> float | int:
        """The value at the place ``x`` (0 to 1) of the scale."""
        if self.log:
            value = math.exp(math.log(self.low) + x * (math.log(self.high) - math.log(self.low)))
        else:
            value = self.low + x * (self.high - self.low)
        value = min(max(value, self.low), self.high)
        return round(value) if self.whole else value


@dataclass(frozen=True)
class Trial:
    number: int
    places: dict[str, float]
    parameters: dict[str, float | int]
    score: float | None = None


def density(x: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """Mixture of kernels at the points and a flat one, over 0 to 1."""
    kernels = np.exp(-0.5 * ((x[:, None] - points) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return (kernels.sum(1) + 1.0) / (len(points) + 1)


def propose(done: Sequence[Trial], space: dict[str, Range], rng: np.random.Generator) -> dict[str, float]:
    """Places of the next trial, from trials that have a score."""
    ranked = sorted(done, key=lambda t: (-t.score, t.number))
    cut = max(1, math.ceil(BETTER * len(ranked)))
    out = {}
    for name in space:
        good, rest = (np.array([t.places[name] for t in part]) for part in (ranked[:cut], ranked[cut:]))
        widths = [max(0.05, 1 / (1 + len(p))) for p in (good, rest)]
        # a draw comes from the flat part or from around one of the better values
        centre = rng.integers(0, len(good) + 1, DRAWS)
        near = good[np.minimum(centre, len(good) - 1)] + rng.normal(0, widths[0], DRAWS)
        x = np.where(centre == len(good), rng.random(DRAWS), np.clip(near, 0, 1))
        out[name] = float(x[np.argmax(density(x, good, widths[0]) / density(x, rest, widths[1]))])
    return out


def search(spark: SparkSession, space: dict[str, Range], score: Callable[[dict], float], trials: int = 10, first: int = 4, side_by_side: int = 2, seed: int = 42, pool: str = "search") -> list[Trial]:
    """Trials in their order; the best has the highest score. The ``first`` ones are drawn at random. ``score`` runs Spark
    jobs; those of one batch go to a pool of the scheduler, where they share executors if it is the fair one."""
    rng, done = np.random.default_rng(seed), []
    while len(done) < trials:
        batch = []
        for n in range(len(done), min(trials, len(done) + side_by_side)):
            places = {k: float(rng.random()) for k in space} if n < first or not done else propose(done, space, rng)
            batch.append(Trial(n, places, {k: r.at(places[k]) for k, r in space.items()}))

        def run(trial: Trial) -> float:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            return float(score(trial.parameters))

        with ThreadPoolExecutor(side_by_side) as threads:
            jobs = [threads.submit(inheritable_thread_target(spark)(run), t) for t in batch]
            done += [Trial(t.number, t.places, t.parameters, j.result()) for t, j in zip(batch, jobs, strict=True)]
    return done


def best(trials: Sequence[Trial]) -> Trial:
    return min(trials, key=lambda t: (-t.score, t.number))


def as_rows(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """``trial, parameter, value, score``, a row for each parameter."""
    rows = [(t.number, k, float(v), t.score) for t in trials for k, v in t.parameters.items()]
    return spark.createDataFrame(rows, "trial int, parameter string, value double, score double")
