"""Isolation forest for one numeric column (Liu, Ting and Zhou 2008).

On a single column every tree cuts the number line, so the mean path length of the
whole forest is a step function with at most trees * (sample - 1) edges. The steps are
fitted from a bounded sample; every row of the table is then scored by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.columns import known

TREES = 100
SAMPLE = 256
EULER_GAMMA = 0.5772156649


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, deep))


def tree_steps(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of one tree and the path length of each interval between them (value <= cut goes left)."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    cuts: list[float] = []
    depths: list[float] = []
    stack = [(np.sort(points), 0)]
    while stack:
        part, depth = stack.pop()
        if isinstance(part, float):
            cuts.append(part)
        elif depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            depths.append(depth + float(average_path(len(part))))
        else:
            cut = float(rng.uniform(part[0], part[-1]))
            split = int(np.searchsorted(part, cut, side="right"))
            stack += [(part[split:], depth + 1), (cut, depth), (part[:split], depth + 1)]
    return np.array(cuts), np.array(depths)


def forest_steps(sample: np.ndarray, size: int, seed: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Merged edges of all trees and the anomaly score of each interval (higher is stranger)."""
    rng = np.random.default_rng(seed)
    fitted = [tree_steps(rng.choice(sample, size=size, replace=False), rng) for _ in range(trees)]
    edges = np.unique(np.concatenate([cuts for cuts, _ in fitted]))
    probes = np.append(edges, np.inf)
    path = sum(depths[np.searchsorted(cuts, probes, side="left")] for cuts, depths in fitted) / trees
    return edges, 2.0 ** (-path / max(float(average_path(size)), 1e-12))


@dataclass(frozen=True)
class AnomalySteps:
    """Fitted steps: interval i lies between edges i-1 and i; flagged intervals are anomalous."""

    edges: tuple[float, ...]
    scores: tuple[float, ...]
    flags: tuple[bool, ...]

    def located(self, df: DataFrame, name: str) -> DataFrame:
        """Adds ``interval``. Bucketizer closes its buckets on the left, so the mirrored value is placed among mirrored edges."""
        splits = [-np.inf, *sorted(-e for e in self.edges), np.inf]
        mirrored = df.withColumn("__mirrored", -F.col(name))
        placed = Bucketizer(splits=splits, inputCol="__mirrored", outputCol="interval").transform(mirrored)
        return placed.withColumn("interval", (len(self.edges) - F.col("interval")).cast("int")).drop("__mirrored")

    def ranges(self) -> list[tuple[float | None, float | None]]:
        """Anomalous ranges (low, high], neighbours merged; None is open."""
        out: list[tuple[float | None, float | None]] = []
        for i, flag in enumerate(self.flags):
            if not flag:
                continue
            low = self.edges[i - 1] if i else None
            high = self.edges[i] if i < len(self.edges) else None
            if out and i and self.flags[i - 1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def anomalous(self, c: Column) -> Column:
        """A native predicate: the value lies in one of the anomalous ranges."""
        hit = F.lit(False)
        for low, high in self.ranges():
            inside = c.isNotNull()
            if low is not None:
                inside = inside & (c > F.lit(low))
            if high is not None:
                inside = inside & (c <= F.lit(high))
            hit = hit | inside
        return hit


def _samples(df: DataFrame, counts: dict[str, int], wanted: dict[str, int]) -> dict[str, np.ndarray]:
    """About ``2 * wanted`` known values of each column, at random, in one job; every value of a column that has no more."""
    cells = []
    for i, (name, n) in enumerate(counts.items()):
        v = known(name, df).cast("double")
        drawn = v if n <= 2 * wanted[name] else F.when(F.rand(i) < 2.0 * wanted[name] / n, v)
        cells.append(F.struct(F.lit(i).alias("item"), drawn.alias("v")))
    rows = df.select(F.explode(F.array(*cells)).alias("x")).where("x.v IS NOT NULL").select("x.*").toPandas()
    groups = dict(list(rows.groupby("item")["v"]))
    return {name: np.sort(groups[i].to_numpy(float)) if i in groups else np.empty(0) for i, name in enumerate(counts)}


def fit_many(df: DataFrame, wanted: dict[str, tuple[float, int]], trees: int = TREES, sample: int = SAMPLE) -> dict[str, tuple[AnomalySteps, int]]:
    """The fitted steps of each column (contamination, seed) and how many rows they flag.

    Three jobs whatever the number of columns: count, sample, exact counts per interval. Each column brings at most
    about ``2 * trees * sample`` sampled values and as many interval counts to the driver.
    """
    names = list(wanted)
    if not names:
        return {}
    row = df.agg(*[F.count(known(c, df)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(names)}
    out: dict[str, tuple[AnomalySteps, int]] = {c: (AnomalySteps((), (0.0,), (False,)), 0) for c in names}
    drawn = _samples(df, {c: n for c, n in counts.items() if n}, dict.fromkeys(names, trees * sample)) if any(counts.values()) else {}
    grown: dict[str, AnomalySteps] = {}
    for name, values in drawn.items():
        if len(values):
            edges, scores = forest_steps(values, min(sample, len(values)), wanted[name][1], trees)
            if len(edges):
                grown[name] = AnomalySteps(tuple(edges.tolist()), tuple(scores.tolist()), ())
    if not grown:
        return out
    table = df.select(*[known(c, df).cast("double").alias(f"__v{i}") for i, c in enumerate(grown)])
    for i, steps in enumerate(grown.values()):
        table = steps.located(table, f"__v{i}").withColumnRenamed("interval", f"__i{i}")
    cells = [F.when(F.col(f"__v{i}").isNotNull(), F.struct(F.lit(i).alias("item"), F.col(f"__i{i}").alias("interval"))) for i in range(len(grown))]
    # At most one row per interval comes back: bounded by trees * sample a column, whatever the table holds.
    counted = table.select(F.explode(F.array(*cells)).alias("x")).where("x IS NOT NULL").groupBy("x.item", "x.interval").agg(F.count(F.lit(1)).alias("n")).toPandas()
    for i, (name, steps) in enumerate(grown.items()):
        mine = counted[counted["item"] == i]
        scores, hits = np.array(steps.scores), np.zeros(len(steps.scores), dtype=np.int64)
        hits[mine["interval"].to_numpy(dtype=int)] = mine["n"].to_numpy(dtype=np.int64)
        flags = scores > _upper_quantile(scores, hits, wanted[name][0]) + 1e-12
        out[name] = (AnomalySteps(steps.edges, steps.scores, tuple(flags.tolist())), int(hits[flags].sum()))
    return out


def _upper_quantile(scores: np.ndarray, hits: np.ndarray, share: float) -> float:
    """The interpolated (1 - share) quantile of the scores of all rows, from the rows per interval."""
    order = np.argsort(scores)
    ends = np.cumsum(hits[order])
    position = (ends[-1] - 1) * (1.0 - share)
    low, high = (scores[order][np.searchsorted(ends, rank, side="right")] for rank in (np.floor(position), np.ceil(position)))
    return float(low + (high - low) * (position - np.floor(position)))
