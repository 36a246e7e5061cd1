"""Exact tests and tails over whole Arrow batches. Their work follows the width of a distribution, not its support, so deep counts cost no more than shallow ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from methframe.session import shipped

_SMALL = 16
_FACTORIALS = np.array([math.lgamma(k + 1) for k in range(_SMALL)])
#: Tables whose log probability is within this of the observed one are as likely.
TIES = 1e-7
#: A sum stops at terms below this share of it.
_GONE = 1e-18


def ln_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!: exact below 16, else Stirling's series, whose error is under 1e-11 there. Any n; no table grows with the data."""
    x = np.maximum(n, 1).astype(float)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < _SMALL, _FACTORIALS[np.clip(n, 0, _SMALL - 1)], series)


def log_factorial(n: Column) -> Column:
    """The same as an expression."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < _SMALL, F.get(F.array(*[F.lit(float(v)) for v in _FACTORIALS]), n.cast("int"))).otherwise(series)


class _Tables:
    """Tables ((a, b), (c, d)) with fixed margins, by the count x in the place of a."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray):
        self.row, self.col, self.n = a + b, a + c, a + b + c + d
        self.low, self.high = np.maximum(0, self.row + self.col - self.n), np.minimum(self.row, self.col)
        self.mode = np.clip((self.row + 1) * (self.col + 1) // (self.n + 2), self.low, self.high)
        self.fixed = ln_factorial(self.row) + ln_factorial(self.n - self.row) + ln_factorial(self.col) + ln_factorial(self.n - self.col) - ln_factorial(self.n)

    def at(self, i: np.ndarray) -> _Tables:
        out = object.__new__(_Tables)
        out.__dict__ = {k: v[i] for k, v in self.__dict__.items()}
        return out

    def log_p(self, x: np.ndarray) -> np.ndarray:
        return self.fixed - ln_factorial(x) - ln_factorial(self.row - x) - ln_factorial(self.col - x) - ln_factorial(self.n - self.row - self.col + x)

    def edge(self, seen: np.ndarray, up: bool) -> np.ndarray:
        """The x nearest to the mode, on one side of it, that is no likelier than ``seen``; one beyond the support if there is none. By halving: the side is monotone."""
        near, far = (self.mode.copy(), self.high + 1) if up else (self.mode.copy(), self.low - 1)
        near = np.where(self.log_p(near) <= seen + TIES, far, near)  # no likelier at the mode itself: everything counts
        whole = near == far
        while (open_ := np.abs(far - near) > 1).any():
            middle = np.where(open_, (near + far) // 2, near)
            less = self.log_p(middle) <= seen + TIES
            far, near = np.where(open_ & less, middle, far), np.where(open_ & ~less, middle, near)
        return np.where(whole, self.mode, far)

    def tail(self, x: np.ndarray, up: bool) -> np.ndarray:
        """The sum from x outwards: each term from its neighbour, until the terms vanish."""
        inside = (x <= self.high) if up else (x >= self.low)
        total, left = np.zeros(len(x)), np.flatnonzero(inside)
        t, x = self.at(left), x[left].astype(float)
        term = np.exp(t.log_p(x.astype(np.int64)))
        while len(left):
            total[left] += term
            if up:
                term = term * (t.row - x) * (t.col - x) / ((x + 1) * (t.n - t.row - t.col + x + 1))
                x = x + 1
            else:
                term = term * x * (t.n - t.row - t.col + x) / np.maximum((t.row - x + 1) * (t.col - x + 1), 1)
                x = x - 1
            go = term > _GONE * total[left]
            left, t, x, term = left[go], t.at(go), x[go], term[go]
        return total


def fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The two-sided p of the tables ((a, b), (c, d)): all tables with the same margins that are no likelier than this one."""
    t = _Tables(a, b, c, d)
    seen = t.log_p(a)
    up, down = t.edge(seen, True), t.edge(seen, False)
    # where the mode itself is no likelier, both sides start there and it counts once
    return np.minimum(t.tail(up, True) + t.tail(np.where(down == up, down - 1, down), False), 1.0)


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    known = a.notna() & b.notna() & c.notna() & d.notna() & (pd.concat([a, b, c, d], axis=1).min(axis=1) >= 0)
    x = [s[known].to_numpy().astype(np.int64) for s in (a, b, c, d)]
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    out[known] = fisher_p(*x)
    return out.astype(object).where(known, None)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """``fisher_p`` of counts; null where one is null or negative."""
    shipped()
    return F.pandas_udf(_fisher, "double")(*(x.cast("bigint") for x in (a, b, c, d)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad/bc; infinity where only bc is 0, NaN where both are."""
    return F.when(b * c > 0, (a * d) / (b * c)).when(a * d > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated from the front (Lentz)."""
    tiny = 1e-300
    hold = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(x)), 1 / hold(1 - (a + b) * x / (a + 1))
    out = d.copy()
    left = np.arange(len(x))
    m = 1
    while len(left):
        p, q, z = a[left], b[left], x[left]
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d[left], c[left] = 1 / hold(1 + step * d[left]), hold(1 + step / c[left])
            change = d[left] * c[left]
            out[left] *= change
        left, m = left[np.abs(change - 1) > 1e-15] if m < 10_000 else left[:0], m + 1
    return out


def binomial_above(mc: np.ndarray, cov: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X > mc) for X ~ Bin(cov, p) with 0 < p < 1, as an incomplete beta function; 0 where mc reaches cov."""
    out = np.where(mc < 0, 1.0, 0.0)
    some = np.flatnonzero((mc < cov) & (mc >= 0))
    a, b, x = mc[some] + 1.0, (cov[some] - mc[some]).astype(float), p[some]
    n = cov[some]
    front = np.exp(ln_factorial(n) - ln_factorial(mc[some]) - ln_factorial(n - mc[some] - 1) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    value = np.where(low, front * _fraction(a, b, np.where(low, x, 0.5)) / a, 1 - front * _fraction(b, a, np.where(low, 0.5, 1 - x)) / b)
    out[some] = np.clip(value, 0.0, 1.0)
    return out


def _above(mc: pd.Series, cov: pd.Series, p: pd.Series) -> pd.Series:
    known = mc.notna() & cov.notna() & p.notna() & (p > 0) & (p < 1)
    out = pd.Series(np.nan, index=mc.index, dtype="float64")
    out[known] = binomial_above(mc[known].to_numpy().astype(np.int64), cov[known].to_numpy().astype(np.int64), p[known].to_numpy())
    return out.astype(object).where(known, None)


def binomial_tail(mc: Column, cov: Column, p: Column) -> Column:
    """``binomial_above`` of counts; null where one is null or p isn't strictly between 0 and 1."""
    shipped()
    return F.pandas_udf(_above, "double")(mc.cast("bigint"), cov.cast("bigint"), p)
