"""Trend filter for business cycles: trend and cycle of each series.

The trend minimises the squared gap to the series plus lambda times the squared second
differences, which is one system of five bands per series. It is solved by substructures: a
series is cut into blocks, each block eliminates its inner points on its own, and what is
left is a small system in the two first points of every block but the first. Its solution
goes back to the blocks, which solve for their inner points between known ends. That is
plain elimination in another order, so a series of any length is solved exactly, in
parallel, and one of a single block has nothing to exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.plans.skew import HOT_ROWS, keyed_join, ordered, slice_keys
from episodica.session import durable

# Lambda per data frequency.
LAMBDA = {"annual": 100, "quarterly": 1600, "monthly": 14400}
BLOCK_POINTS = 20_000
LEAST_BLOCK = 8  # points, so that only neighbouring blocks meet


def lambda_of(frequency: Column) -> Column:
    return F.coalesce(*[F.when(frequency == name, float(v)) for name, v in LAMBDA.items()])


def bands(start: int, end: int, n: int, lamb: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``start`` to ``end`` of I + lambda D'D for ``n`` points: the diagonal, and the two bands above it."""
    at = np.arange(start, end)
    bent = n >= 3
    main = 1 + lamb * bent * ((at <= n - 3) + 4.0 * ((at >= 1) & (at <= n - 2)) + (at >= 2))
    near = -2 * lamb * bent * ((at <= n - 3).astype(float) + ((at >= 1) & (at <= n - 2)))
    far = lamb * bent * (at <= n - 3)
    return main, near, far.astype(float)


def solve(main: np.ndarray, near: np.ndarray, far: np.ndarray, sides: list[np.ndarray]) -> list[np.ndarray]:
    """Symmetric elimination over five bands for several right sides."""
    pivots, first, second = [], [], []
    p1 = p2 = f1 = s1 = s2 = 0.0  # values of the two rows above
    for a, b, c in zip(main.tolist(), near.tolist(), far.tolist()):
        pivot = a - f1 * f1 * p1 - s2 * s2 * p2
        f0, s0 = (b - f1 * s1 * p1) / pivot, c / pivot
        pivots.append(pivot)
        first.append(f0)
        second.append(s0)
        p2, p1, f1, s2, s1 = p1, pivot, f0, s1, s0
    found = []
    for side in sides:
        z, f1, s1, s2, z1, z2 = [], 0.0, 0.0, 0.0, 0.0, 0.0
        for v, f0, s0 in zip(side.tolist(), first, second):
            z0 = v - f1 * z1 - s2 * z2
            z.append(z0)
            f1, s2, s1, z2, z1 = f0, s1, s0, z1, z0
        out, x1, x2 = np.empty(len(z)), 0.0, 0.0
        for i in range(len(z) - 1, -1, -1):
            x0 = z[i] / pivots[i] - first[i] * x1 - second[i] * x2
            out[i] = x0
            x2, x1 = x1, x0
        found.append(out)
    return found


def trend(y: np.ndarray, lamb: float) -> np.ndarray:
    """The trend of a whole series at hand."""
    return solve(*bands(0, len(y), len(y), lamb), [y.astype(float)])[0]


class _Block:
    """Points ``start`` to ``end`` of a series of ``n``, between the two first points of this block and of the next."""

    def __init__(self, start: int, end: int, n: int, lamb: float):
        self.ends = [p for p in (start, start + 1) if start], [p for p in (end, end + 1) if end < n]
        self.inner = start + 2 * (start > 0)
        main, near, far = bands(start, min(end + 2, n), n, lamb)
        self.size = end - self.inner
        inside = slice(self.inner - start, end - start)
        self.main, self.near, self.far = main[inside], near[inside], far[inside]
        # Columns that couple the inner points to the ends; an end of the next block is 1 or 2 points off.
        self.columns = []
        for p in (*self.ends[0], *self.ends[1]):
            column = np.zeros(self.size)
            for i in range(max(self.inner, p - 2), min(end, p + 3)):
                column[i - self.inner] = (near, far)[abs(i - p) - 1][min(i, p) - start]
            self.columns.append(column)

    def eliminated(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inner points ``y`` take from the system of the ends: from its matrix and from its right side."""
        solved = solve(self.main, self.near, self.far, [y, *self.columns])
        c = np.array(self.columns)
        return c @ np.array(solved[1:]).T, c @ solved[0]

    def inner_trend(self, y: np.ndarray, ends: list[float]) -> np.ndarray:
        side = y - sum((e * c for e, c in zip(ends, self.columns)), np.zeros(self.size))
        return solve(self.main, self.near, self.far, [side])[0]


_TAKEN = ("start long", "end long", "n long", "lamb double", "m array<double>", "r array<double>", "y array<double>")


def _eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block of a series of several blocks."""
    pdf = pdf.sort_values("_pos")
    start, n, lamb = int(pdf["_pos"].iat[0]), int(pdf["_n"].iat[0]), float(pdf["lamb"].iat[0])
    y, block = pdf["value"].to_numpy(float), _Block(start, start + len(pdf), n, lamb)
    m, r = block.eliminated(y[block.inner - start :])
    row = [pdf["series_id"].iat[0], pdf["_block"].iat[0], start, start + len(pdf), n, lamb, m.ravel(), r, y[:2]]
    return pd.DataFrame([row], columns=["series_id", "_block", *[f.split()[0] for f in _TAKEN]])


def _solve_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ends of all blocks of a series: a system of two unknowns a block that meets its neighbours only."""
    pdf = pdf.sort_values("_block")
    rows, n, lamb = list(pdf.itertuples(index=False)), int(pdf["n"].iat[0]), float(pdf["lamb"].iat[0])
    taken = []  # (matrix, right side) with four places: both left ends, both right ends
    for k, r in enumerate(rows):
        places = [i for i, there in enumerate((k > 0, k > 0, k < len(rows) - 1, k < len(rows) - 1)) if there]
        m, side = np.zeros((4, 4)), np.zeros(4)
        m[np.ix_(places, places)], side[places] = np.reshape(r.m, (len(places), len(places))), r.r
        taken.append((m, side))
    diagonal, upper, right = [], [], []
    for k in range(1, len(rows)):
        main, near, _ = bands(rows[k].start, rows[k].start + 2, n, lamb)
        own = np.array([[main[0], near[0]], [near[0], main[1]]])
        diagonal.append(own - taken[k - 1][0][2:, 2:] - taken[k][0][:2, :2])
        upper.append(-taken[k][0][:2, 2:])
        right.append(np.asarray(rows[k].y, dtype=float) - taken[k - 1][1][2:] - taken[k][1][:2])
    for k in range(1, len(diagonal)):
        factor = np.linalg.solve(diagonal[k - 1].T, upper[k - 1]).T
        diagonal[k] = diagonal[k] - factor @ upper[k - 1]
        right[k] = right[k] - factor @ right[k - 1]
    ends = [np.zeros(2)] * (len(diagonal) + 1)
    for k in range(len(diagonal) - 1, -1, -1):
        after = upper[k] @ ends[k + 1] if k + 1 < len(diagonal) else 0.0
        ends[k] = np.linalg.solve(diagonal[k], right[k] - after)
    out = [
        (r.series_id, pdf["_block"].iat[k], [*(ends[k - 1] if k else ()), *(ends[k] if k < len(rows) - 1 else ())])
        for k, r in enumerate(rows)
    ]
    return pd.DataFrame(out, columns=["series_id", "_block", "ends"])


def _fill(points: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Trend and cycle of a block, between its ends if it has any."""
    points = points.sort_values("_pos")
    start, n, lamb = int(points["_pos"].iat[0]), int(points["_n"].iat[0]), float(points["lamb"].iat[0])
    y, block = points["value"].to_numpy(float), _Block(start, start + len(points), n, lamb)
    ends = list(known["ends"].iat[0]) if len(known) else []
    fitted = np.concatenate([ends[: len(block.ends[0])], block.inner_trend(y[block.inner - start :], ends)])
    points = points.assign(trend=fitted, cycle=y - fitted)
    return points[["series_id", "t", "value", "trend", "cycle"]]


def hp_filter(
    series: DataFrame, lamb: Column | float, block_points: int = BLOCK_POINTS, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """Trend and cycle per point of (series_id, t, value), points in order of ``t``.

    ``lamb`` may differ per series but not within one. A block holds ``block_points`` points,
    the last one of a series up to twice as many.
    """
    lamb = lamb if isinstance(lamb, Column) else F.lit(float(lamb))
    sliced = slice_keys(series.withColumn("lamb", lamb.cast("double")), ["series_id"], ["t"], slice_rows)
    points = ordered(sliced, ["series_id"], ["t"], number="_pos", total="_n")
    size = F.lit(max(block_points, LEAST_BLOCK))
    last = F.greatest(F.call_function("div", F.col("_n"), size) - 1, F.lit(0))
    points = points.withColumns({"_pos": F.col("_pos") - 1, "_n": F.col("_n").cast("long")})
    points = points.withColumn("_block", F.least(F.call_function("div", F.col("_pos"), size), last))
    kinds = dict(series.dtypes)
    key = f"series_id {kinds['series_id']}, _block long"
    taken = points.where(F.col("_n") >= 2 * size).groupBy("series_id", "_block").applyInPandas(_eliminate, f"{key}, {', '.join(_TAKEN)}")
    ends = taken.groupBy("series_id").applyInPandas(_solve_ends, f"{key}, ends array<double>")
    schema = f"series_id {kinds['series_id']}, t {kinds['t']}, value double, trend double, cycle double"
    return points.groupBy("series_id", "_block").cogroup(ends.groupBy("series_id", "_block")).applyInPandas(_fill, schema)


def cycle_correlation(
    series: DataFrame, pairs: DataFrame, lamb: Column | float, digits: int = 5, **sizes
) -> DataFrame:
    """Correlation of the log cycles of each pair (series_a, series_b), aligned on ``t``."""
    logs = series.withColumn("value", F.ln("value"))
    cycles = durable(hp_filter(logs, lamb, **sizes).select("series_id", "t", "cycle"))
    left = keyed_join(
        cycles.select(F.col("series_id").alias("series_a"), "t", F.col("cycle").alias("a")), pairs, ["series_a"]
    )
    right = cycles.select(F.col("series_id").alias("series_b"), "t", F.col("cycle").alias("b"))
    return (
        left.join(right, ["series_b", "t"])
        .groupBy("series_a", "series_b")
        .agg(F.round(F.corr("a", "b"), digits).alias("correlation"), F.count(F.lit(1)).alias("points"))
    )


def second_difference(series: DataFrame, slice_rows: int = HOT_ROWS) -> DataFrame:
    """value(t+1) - 2 value(t) + value(t-1), for inner points."""
    near = ordered(
        series, ["series_id"], ["t"], previous={"_before": F.col("value")},
        following={"_after": F.col("value")}, slice_rows=slice_rows,
    )
    bend = F.col("_after") - 2 * F.col("value") + F.col("_before")
    return near.withColumn("second_difference", bend).drop("_before", "_after").dropna(subset="second_difference")
