"""Problem 4: a sample that matches target category proportions, with floors and a report of gaps.

Weights come from the exponential-tilting dual of calibration, solved by Newton iterations over cell moments that Spark aggregates;
the driver only holds one number per quota cell. Rows are drawn by the pivotal method with the resulting probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stored

CELL = ["primary_category", "language", "difficulty"]


def spelled(col: str) -> Column:
    """A label whatever its case, outer spaces and choice between space, hyphen and underscore."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), "[\\s_-]+", "_")


def usable(cases: DataFrame, quota: DataFrame) -> DataFrame:
    """(case_id, cell labels as in quota): accepted cases, once each, whose three labels name a quota cell. Nulls name none."""
    cells = quota.select(*CELL, *[spelled(c).alias(f"_{c}") for c in CELL])
    given = cases.where("accepted and case_id is not null").select("case_id", *[spelled(c).alias(f"_{c}") for c in CELL]).dropDuplicates(["case_id", *[f"_{c}" for c in CELL]])
    return given.join(F.broadcast(cells), [f"_{c}" for c in CELL]).select("case_id", *CELL)  # quota: one row a cell, fixed


def gaps(cases: DataFrame, quota: DataFrame) -> DataFrame:
    """quota's cells with count, have (usable cases) and short (how many are missing, 0 where met)."""
    have = usable(cases, quota).groupBy(*CELL).agg(F.count_distinct("case_id").alias("have"))
    joined = quota.select(*CELL, F.col("count")).join(have, CELL, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return joined.withColumn("short", F.greatest(F.col("count") - F.col("have"), F.lit(0)))


def marginals(cells: list[tuple]) -> np.ndarray:
    """[cell, value]: which values of category, language and difficulty a cell has; the first column, of ones, stands for the total."""
    values = sorted({(i, v) for c in cells for i, v in enumerate(c)}, key=str)
    return np.array([[1.0] + [float(c[i] == v) for i, v in values] for c in cells]).reshape(len(cells), 1 + len(values))


def tilted(have: np.ndarray, target: np.ndarray, floor: float = 1.0, steps: int = 60, shares: np.ndarray | None = None, ridge: float = 0.01) -> np.ndarray:
    """Inclusion probability of each cell's rows: p = base * exp(constraints . lambda), capped at 1, by Newton on the tilting dual.

    Without shares every cell is a constraint of its own: expected counts meet min(target, have), and a cell that has any keeps at
    least floor. With shares, a matrix [cell, value] of overlapping constraints whose first column is the total, cells that are short
    are taken whole, and the others make up for them: base is their own target's, and lambda tilts them so that the expected count of
    every value comes as near its target as the rows allow and the total meets the sum of targets. The targets of values are met up to
    a penalty of ridge * lambda^2 / 2, which keeps the dual bounded where no sample can meet them all.
    """
    floor = np.minimum(np.where(have > 0, floor, 0.0), have)
    goal = np.clip(target, floor, have)
    if shares is None:
        shares, ridge, fixed = np.eye(len(have)), 0.0, have <= 0
    else:
        fixed = goal >= have
        if have.sum() <= target.sum():
            fixed[:] = True
            goal = have.astype(float)
    while not fixed.all():
        free = ~fixed
        x, base = shares[free], np.maximum(goal, 1e-9)[free]
        wanted = shares.T @ target - shares[fixed].T @ goal[fixed] if ridge else goal[free]
        x = x if ridge else np.eye(free.sum())
        lam, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[0] = 0.0  # the total is met
        for _ in range(steps):
            moment = base * np.exp(np.clip(x @ lam, -50, 50))
            gradient = x.T @ moment - wanted + penalty * lam
            step = np.linalg.lstsq(x.T @ (moment[:, None] * x) + np.diag(penalty), gradient, rcond=None)[0]
            lam -= np.clip(step, -2, 2)
            if np.abs(step).max(initial=0) < 1e-12:
                break
        moment = base * np.exp(np.clip(x @ lam, -50, 50))
        limited = np.clip(moment, floor[free], have[free])
        out = np.abs(limited - moment) > 1e-9
        goal[free] = limited if not ridge or not out.any() else goal[free]
        if not ridge or not out.any():
            break
        over = np.flatnonzero(free)[out]  # cells beyond their bounds stay at them; the rest is calibrated again
        goal[over], fixed[over] = limited[out], True
    return np.where(have > 0, np.minimum(1.0, goal / np.maximum(have, 1e-9)), 0.0)


def _pivotal(p: np.ndarray, u: np.ndarray, decide: bool = True) -> np.ndarray:
    """Sequential pivotal method: at most one of each dueling pair stays undecided; draws a fixed size when p sums to an integer.

    Without decide the probabilities left: 0, 1, and that of the row left undecided, if any.
    """
    p, eps = p.astype(float).copy(), 1e-9
    i = 0
    for j in range(1, len(p)):
        if p[i] < eps or p[i] > 1 - eps:
            i = j
            continue
        a, b = p[i], p[j]
        if b < eps or b > 1 - eps:
            continue
        if a + b < 1:
            win = u[j] < b / (a + b)
            p[i], p[j] = (0, a + b) if win else (a + b, 0)
        else:
            win = u[j] < (1 - b) / (2 - a - b)
            p[i], p[j] = (a + b - 1, 1) if win else (1, a + b - 1)
        if p[i] < eps or p[i] > 1 - eps:
            i = j
    if not decide:
        return np.where(p < eps, 0.0, np.where(p > 1 - eps, 1.0, p))
    if eps < p[i] < 1 - eps:
        p[i] = float(u[i] < p[i])
    return p > 0.5


def proportional_sample(cases: DataFrame, quota: DataFrame, seed: str = "quarry", block: int = 20_000, make_up: bool = False) -> DataFrame:
    """(case_id, cell labels, probability): a sample filling the cells in proportion to count, at least one from each that has any.

    Cells that are short give all they have. With make_up the others are calibrated on the marginals of category, language and
    difficulty, so that the sample keeps the total and comes as near the quota's shares of each value as the rows allow; without, each
    other cell gives its count. Every cell is drawn to its expected size, rounded up or down, whatever its number of rows. Cells of
    more than block rows are spread over blocks by a hash of the case_id, which run the pivotal method side by side; the one row a block
    leaves undecided duels with those of the cell's other blocks, and the one a cell leaves with those of other cells, with the
    probability it is left with. Repeated case_ids count once; null labels and null accepted name no cell; empty tables give an
    empty sample.
    """
    counts = [(tuple(r[c] for c in CELL), r["have"], r["count"]) for r in gaps(cases, quota).orderBy(*CELL).collect()]  # one row a quota cell
    have, target = np.array([h for _, h, _ in counts], float), np.array([float(t or 0) for _, _, t in counts])
    p = tilted(have, target, shares=marginals([c for c, _, _ in counts]) if make_up else None) if counts else []
    odds = cases.sparkSession.createDataFrame([(*c, float(x), int(h)) for (c, h, _), x in zip(counts, p)], "primary_category string, language string, difficulty string, probability double, have long")
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "case_id"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    pool = usable(cases, quota).dropDuplicates(["case_id"]).join(F.broadcast(odds), CELL).withColumn("u", u)
    pool = pool.withColumn("block", F.pmod(F.xxhash64("case_id"), F.greatest(F.ceil(F.col("have") / block), F.lit(1)).cast("long")))
    row = "case_id string, primary_category string, language string, difficulty string, probability double"
    state = f"{row}, u double, left double"

    def duel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", ignore_index=True)
        left = _pivotal(pdf.left.to_numpy(), pdf.u.to_numpy()[::-1].copy(), decide=False)
        left = np.where(np.abs(left - np.round(left)) < 1e-6, np.round(left), left)
        return pdf.assign(left=left)[left > 0][["case_id", *CELL, "probability", "u", "left"]]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CELL + ["u"], ignore_index=True)
        size = round(float(pdf.left.sum()))
        taken = _pivotal(pdf.left.to_numpy(), pdf.u.to_numpy()[::-1].copy())
        if taken.sum() != size:  # rounding left one row undecided
            taken = (np.argsort(np.argsort(~taken, kind="stable"), kind="stable") < size)
        return pdf[taken][["case_id", *CELL, "probability"]]

    first = stored(pool.withColumn("left", F.col("probability")).groupBy(*CELL, "block").applyInPandas(duel, state))
    # one undecided row a block, then one a cell, so the last duels are between as many rows as the quota has cells
    cells = first.where("left < 1").groupBy(*CELL).applyInPandas(duel, state)
    last = cells.where("left < 1").groupBy().applyInPandas(settle, row)
    names = ["case_id", *CELL, "probability"]
    return first.where("left = 1").select(names).unionByName(cells.where("left = 1").select(names)).unionByName(last)


def report(sample: DataFrame, cases: DataFrame, quota: DataFrame) -> DataFrame:
    """quota's cells with count, have (usable cases), drawn (cases in the sample) and short: what the sample lacks because the cell has
    no more, 0 where the cell could be filled."""
    drawn = sample.groupBy(*CELL).agg(F.count("*").alias("drawn"))
    out = gaps(cases, quota).drop("short").join(drawn, CELL, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return out.withColumn("short", F.when(F.col("drawn") >= F.col("have"), F.greatest(F.col("count") - F.col("drawn"), F.lit(0))).otherwise(F.lit(0)))
