"""Proportional-hazards regression with Efron ties and a ridge penalty.

Rows are range-sorted by duration once, latest first, and held that way. A
Newton step needs, at every duration with events, sums over all rows at least as
long: of exp(eta), x exp(eta) and x x' exp(eta). Each sorted part first sums up
its rows; running totals of these sums, one set per part, tell every part what
lies above it. The parts then scan their own durations with those totals to
start from and return what they add to the likelihood, its gradient and its
curvature. Rows of equal duration may be spread over parts: the first and last
duration of a part come with sums of their own and are completed on the driver,
which sees these sums and a p x p system, but never a table of durations. The
baseline hazard is a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pdengine.staging import materialise

_TAIL = 10_000
#: Groups of so many tied events or fewer are expanded term by term, all at once.
_FEW = 64
#: Rows of a duration, on average, from which they are summed up together.
_LONG = 64
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


@dataclass(frozen=True)
class CoxModel:
    """Coefficients and baseline.

    ``durations`` and ``cumulative_hazard`` are points of the baseline, the last
    of them the horizon; ``baseline(duration, hazard)`` holds the increment at
    every duration if it was fitted or loaded with the model.
    """

    covariates: list[str]
    beta: list[float]
    durations: list[float]
    cumulative_hazard: list[float]
    steps: int = 0
    log_likelihood: float = field(default=float("nan"))
    baseline: DataFrame | None = field(default=None, compare=False)

    @property
    def horizon(self) -> float:
        return max(self.durations)

    def hazard_at(self, time: float) -> float:
        """Cumulative hazard; one small aggregate over the baseline unless the points tell."""
        if time >= self.horizon:
            return self.cumulative_hazard[-1]
        if self.baseline is not None:
            reached = self.baseline.where(F.col("duration") <= float(time)).agg(F.sum("hazard").alias("h")).first()["h"]
            return float(reached or 0.0)
        reached = [h for t, h in zip(self.durations, self.cumulative_hazard) if t <= time]
        return reached[-1] if reached else 0.0

    def risk(self, time: float | None = None) -> Column:
        """Probability of the event by ``time`` (the horizon by default)."""
        base = self.hazard_at(self.horizon if time is None else time)
        return F.lit(1.0) - F.exp(-F.lit(base) * F.exp(linear_term(self.covariates, self.beta)))

    def document(self) -> dict:
        """What a stored model keeps beside the baseline's table."""
        return {k: getattr(self, k) for k in ("covariates", "beta", "durations", "cumulative_hazard", "steps", "log_likelihood")}


def linear_term(covariates: list[str], beta) -> Column:
    total = F.lit(0.0)
    for name, weight in zip(covariates, beta):
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def _tie_terms(a: np.ndarray, at_risk, tied) -> np.ndarray:
    """Rows: log u, 1/u, a/u, 1/u2, a/u2, a2/u2 with u = at_risk - a * tied."""
    u = at_risk - a * tied
    return np.array([np.log(u), 1 / u, a / u, 1 / u**2, a / u**2, a**2 / u**2])


def _tie_slopes(a: float, at_risk: float, tied: float) -> np.ndarray:
    u = at_risk - a * tied
    d = tied
    return np.array([
        -d / u, d / u**2, 1 / u + a * d / u**2, 2 * d / u**3,
        1 / u**2 + 2 * a * d / u**3, 2 * a / u**2 + 2 * a**2 * d / u**3,
    ])


def tied_sums(at_risk: float, tied: float, n: int) -> np.ndarray:
    """Sums of the tie terms over a = 0, 1/n, ..., (n-1)/n.

    All but the last terms are integrated (with the Euler-Maclaurin end
    corrections), so the work does not grow with the number of tied events.
    """
    head = max(n - _TAIL, 0)
    sums = _tie_terms(np.arange(head, n) / n, at_risk, tied).sum(axis=1)
    end = head / n
    left, integral = 0.0, np.zeros(6)
    while left < end:
        right = min((1 + left) / 2, end)
        points = left + (right - left) * (_NODES + 1) / 2
        integral += (right - left) / 2 * (_tie_terms(points, at_risk, tied) * _WEIGHTS).sum(axis=1)
        left = right
    ends = np.array([0.0, end])
    values = _tie_terms(ends, at_risk, tied)
    slopes = _tie_slopes(end, at_risk, tied) - _tie_slopes(0.0, at_risk, tied)
    return sums + n * integral + (values[:, 0] - values[:, 1]) / 2 + slopes / (12 * n)


def all_tied_sums(at_risk: np.ndarray, tied: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``tied_sums`` of many durations, a column each."""
    out = np.zeros((6, len(n)))
    few = np.flatnonzero(n <= _FEW)
    if len(few):
        size = n[few]
        which = np.repeat(np.arange(len(few)), size)
        a = (np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)) / size[which]
        terms = _tie_terms(a, at_risk[few][which], tied[few][which])
        out[:, few] = np.add.reduceat(terms, np.cumsum(size) - size, axis=1)
    for i in np.flatnonzero(n > _FEW):
        out[:, i] = tied_sums(float(at_risk[i]), float(tied[i]), int(n[i]))
    return out


class Sums:
    """Per duration: of all rows (count, w, w x, w x x') and of rows with the event (the same, and x)."""

    def __init__(self, p: int, durations: np.ndarray, values: np.ndarray):
        self.p, self.t, self.values = p, durations, values

    @staticmethod
    def width(p: int) -> int:
        return 2 * (2 + p + p * p) + p

    @classmethod
    def of(cls, t: np.ndarray, event: np.ndarray, x: np.ndarray, beta: np.ndarray) -> "Sums":
        """Sums of rows whose equal durations are next to each other."""
        n, p = x.shape
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if n else np.zeros(0, np.int64)
        if len(first) * _LONG < n:
            return cls.of_runs(t, event, x, np.exp(x @ beta), first)
        w = np.exp(x @ beta)[:, None]
        one = np.concatenate([np.ones((n, 1)), w, x * w, (x[:, :, None] * x[:, None, :]).reshape(n, -1) * w], axis=1)
        rows = np.concatenate([one, one * event[:, None], x * event[:, None]], axis=1)
        return cls(p, t[first], np.add.reduceat(rows, first, axis=0) if n else np.zeros((0, cls.width(p))))

    @classmethod
    def of_runs(cls, t: np.ndarray, event: np.ndarray, x: np.ndarray, w: np.ndarray, first: np.ndarray) -> "Sums":
        """The same where rows of one duration are many: a product of matrices for each, nothing as wide as the sums per row."""
        n, p = x.shape
        values = np.zeros((len(first), cls.width(p)))
        k = 2 + p + p * p
        for i, (start, end) in enumerate(zip(first, [*first[1:], n], strict=True)):
            of, some = x[start:end], event[start:end] > 0
            for at, rows, weight in ((0, of, w[start:end]), (k, of[some], w[start:end][some])):
                weighted = rows * weight[:, None]
                values[i, at : at + k] = np.concatenate([[len(rows), weight.sum()], weighted.sum(axis=0), (rows.T @ weighted).ravel()])
            values[i, 2 * k :] = of[some].sum(axis=0)
        return cls(p, t[first], values)

    def __getitem__(self, i) -> "Sums":
        return Sums(self.p, self.t[i], self.values[i])

    @staticmethod
    def joined(parts: list["Sums"]) -> "Sums":
        """Lists one after the other, equal neighbouring durations added up."""
        t, values = np.concatenate([s.t for s in parts]), np.concatenate([s.values for s in parts])
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        return Sums(parts[0].p, t[first], np.add.reduceat(values, first, axis=0) if len(t) else values)

    @property
    def at_risk(self) -> np.ndarray:
        """What each duration adds to the sums over all rows at risk."""
        return self.values[:, : 2 + self.p + self.p**2]

    def added(self, above: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Log-likelihood, gradient and curvature of these durations, latest first, in one row; ``above`` is at risk already."""
        p, k = self.p, 2 + self.p + self.p**2
        risk = above + np.cumsum(self.at_risk, axis=0)
        events = self.values[:, k : 2 * k]
        some = events[:, 0] > 0
        risk, events, x = risk[some], events[some], self.values[some, 2 * k :]
        logs, s1, s1a, s2, s2a, s2aa = all_tied_sums(risk[:, 1], events[:, 1], np.rint(events[:, 0]).astype(np.int64))
        risk_x, tied_x = risk[:, 2 : 2 + p], events[:, 2 : 2 + p]
        mixed = (risk_x * s2a[:, None]).T @ tied_x
        curvature = (
            s1 @ risk[:, 2 + p :] - s1a @ events[:, 2 + p :]
            - ((risk_x * s2[:, None]).T @ risk_x - mixed - mixed.T + (tied_x * s2aa[:, None]).T @ tied_x).ravel()
        )
        gradient = x.sum(axis=0) - (s1 @ risk_x - s1a @ tied_x)
        return np.concatenate([[(x @ beta).sum() - logs.sum()], gradient, curvature])


def _inner(batches, p: int, beta: np.ndarray):
    """Sums of a sorted part's durations in runs, every duration once and whole."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
        now = Sums.of(batch.column("t").to_numpy(), batch.column("e").to_numpy(), x, beta)
        now = now if held is None else Sums.joined([held, now])
        yield now[:-1]
        held = now[-1:]
    if held is not None:
        yield held


def _ends(p: int, beta: np.ndarray):
    """One row per part: its totals, and the sums of its first and last duration."""

    def task(batches):
        first = last = None
        total = np.zeros(2 + p + p * p)
        for run in _inner(batches, p, beta):
            if len(run.t):
                first = run[:1] if first is None else first
                last = run[-1:]
                total += run.at_risk.sum(axis=0)
        if first is not None:
            row = np.concatenate([total, first.t, first.values[0], last.t, last.values[0]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([row.tolist()])], names=["part", "v"])

    return task


def _between(runs, ends: tuple[float, float]):
    """Runs without the part's first and last duration."""
    for run in runs:
        yield run[(run.t != ends[0]) & (run.t != ends[1])]


def _scan(p: int, beta: np.ndarray, starts: dict[int, tuple[np.ndarray, tuple[float, float]]]):
    """What the durations inside a part, neither its first nor its last, add."""

    def task(batches):
        mine = TaskContext.get().partitionId()
        if mine in starts:
            above, ends = starts[mine]
            total, risk = np.zeros(1 + p + p * p), above.copy()
            for run in _between(_inner(batches, p, beta), ends):
                total += run.added(risk, beta)
                risk = risk + run.at_risk.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["i", "v"])

    return task


def _hazards(p: int, beta: np.ndarray, starts: dict):
    def task(batches):
        mine = TaskContext.get().partitionId()
        if mine in starts:
            above, ends = starts[mine]
            risk = above[1]
            for run in _between(_inner(batches, p, beta), ends):
                at_risk = risk + np.cumsum(run.values[:, 1])
                risk = at_risk[-1] if len(at_risk) else risk
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mine] * len(run.t), pa.int64()), pa.array(run.t), pa.array(run.values[:, 2 + p + p * p] / at_risk)],
                    names=["part", "duration", "hazard"],
                )

    return task


class _Sorted:
    """Rows sorted by falling duration, in parts that stay as they are between steps."""

    def __init__(self, rows: DataFrame, covariates: list[str], duration: str, event: str):
        self.p = len(covariates)
        narrow = rows.select(
            F.col(duration).cast("double").alias("t"), (F.col(event) > 0).cast("double").alias("e"),
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)],
        )
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the hash lets rows of one duration spread over parts
        dealt = narrow.withColumn("h", F.xxhash64(*narrow.columns)).repartitionByRange(parts, F.desc("t"), "h")
        self.rows = dealt.sortWithinPartitions(F.desc("t")).drop("h").persist(StorageLevel.MEMORY_AND_DISK)

    def parts(self, beta: np.ndarray) -> list[tuple[int, np.ndarray, Sums, Sums]]:
        """Of each part: number, totals, first and last duration; one row per part comes to the driver."""
        p, k, width = self.p, 2 + self.p + self.p**2, Sums.width(self.p)
        out = []
        for r in self.rows.mapInArrow(_ends(p, beta), "part long, v array<double>").orderBy("part").collect():
            v = np.array(r["v"])
            first, last = v[k : k + 1 + width], v[k + 1 + width :]
            out.append((r["part"], v[:k], *[Sums(p, s[:1], s[None, 1:]) for s in (first, last)]))
        return out

    def starts(self, parts: list) -> dict[int, tuple[np.ndarray, tuple[float, float]]]:
        """What is at risk when a part's own durations begin: all parts before it and its first duration."""
        found, above = {}, np.zeros(2 + self.p + self.p**2)
        for number, total, first, last in parts:
            found[number] = (above + first.at_risk[0], (float(first.t[0]), float(last.t[0])))
            above = above + total
        return found

    def seams(self, parts: list) -> list[tuple[Sums, np.ndarray]]:
        """The parts' first and last durations, each complete, with what is at risk above."""
        above, out = np.zeros(2 + self.p + self.p**2), []
        for _, total, first, last in parts:
            inside = total - first.at_risk[0] - (last.at_risk[0] if last.t[0] != first.t[0] else 0)
            for s, before in ((first, 0.0), (last, inside)):
                if s is last and last.t[0] == first.t[0]:
                    continue
                above = above + before
                if out and out[-1][0].t[0] == s.t[0]:
                    out[-1] = (Sums.joined([out[-1][0], s]), out[-1][1])
                else:
                    out.append((s, above))
                above = above + s.at_risk[0]
        return out

    def likelihood(self, beta: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, list]:
        """Penalised log-likelihood, gradient, curvature, and the parts' sums."""
        p, parts = self.p, self.parts(beta)
        rows = self.rows.mapInArrow(_scan(p, beta, self.starts(parts)), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(1 + p + p * p)
        for r in rows:
            total[r["i"]] = r["v"]
        for s, above in self.seams(parts):
            total += s.added(above, beta)
        return (
            total[0] - ridge / 2 * beta @ beta, total[1 : 1 + p] - ridge * beta,
            total[1 + p :].reshape(p, p) + ridge * np.eye(p), parts,
        )

    def baseline(self, beta: np.ndarray, parts: list) -> tuple[DataFrame, list[float], list[float]]:
        """Hazard of every duration, and the cumulative hazard at the parts' ends, earliest first."""
        k = 2 + self.p + self.p**2
        inside = self.rows.mapInArrow(_hazards(self.p, beta, self.starts(parts)), "part long, duration double, hazard double")
        seams = {float(s.t[0]): float(s.values[0, k] / (above[1] + s.values[0, 1])) for s, above in self.seams(parts)}
        ends = self.rows.sparkSession.createDataFrame([(None, t, h) for t, h in seams.items()], "part long, duration double, hazard double")
        table = materialise(inside.union(ends))
        sums = {r["part"]: r["h"] for r in table.where("part is not null").groupBy("part").agg(F.sum("hazard").alias("h")).collect()}
        at: dict[float, float] = {}
        cumulative = 0.0
        for number, _, first, last in reversed(parts):
            for t, before in ((float(last.t[0]), 0.0), (float(first.t[0]), sums.get(number, 0.0))):
                cumulative += before
                if t not in at:
                    cumulative += seams[t]
                at[t] = cumulative
        return table.select("duration", "hazard"), list(at), list(at.values())


def fit_cox(
    rows: DataFrame,
    covariates: list[str],
    duration: str = "duration",
    event: str = "event",
    penalizer: float = 0.1,
    max_steps: int = 30,
    tolerance: float = 1e-7,
) -> CoxModel:
    """Fit on z-scored covariates. The penalty is per row, as the likelihood grows with the rows.

    ``rows`` are sorted once and read twice per step. Rows without a duration or
    a covariate take no part; rows without event information count as censored.
    """
    known = rows.dropna(subset=[duration, *covariates]).withColumn(event, F.coalesce(F.col(event), F.lit(0)))
    if known.where(F.col(event) > 0).isEmpty():
        raise ValueError("no events: a hazard cannot be fitted")
    data = _Sorted(known, covariates, duration, event)
    try:
        beta = np.zeros(len(covariates))
        value, gradient, curvature, parts = data.likelihood(beta, 0.0)
        ridge = penalizer * sum(total[0] for _, total, _, _ in parts)
        curvature = curvature + ridge * np.eye(len(beta))
        steps = 0
        for steps in range(1, max_steps + 1):
            direction = np.linalg.solve(curvature, gradient)
            scale = 1.0
            while True:
                trial = beta + scale * direction
                trial_value, trial_gradient, trial_curvature, trial_parts = data.likelihood(trial, ridge)
                if trial_value >= value - 1e-12 * abs(value) or scale < 1e-4:
                    break
                scale /= 2
            gain = trial_value - value
            beta, value, gradient, curvature, parts = trial, trial_value, trial_gradient, trial_curvature, trial_parts
            if gain <= tolerance * abs(value) * 1e-3 or np.abs(scale * direction).max() < tolerance:
                break
        table, durations, hazards = data.baseline(beta, parts)
    finally:
        data.rows.unpersist()
    return CoxModel(list(covariates), [float(b) for b in beta], durations, hazards, steps, float(value), table)
