"""The p of the root mean square test for many tables at once.

A draw is a table of independent rows and columns, multinomial, as one draw at a time gives it; only the way there is shorter. Row totals are cut from
unit cells that tables share: a row of r counts takes r cells. For small totals the cells of a draw hold just that many counts. For larger ones they are
Poisson with a mean a little under one; given their sum, such counts are multinomial, so draws with a sum over the total are passed over and counts
drawn one by one fill up the others. A row's first column is binomial, looked up by a random number; what the whole shares of a lookup leave over is
drawn by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from methframe.functions.stats import ln_factorial

#: Draws of a round: many tables stop in the first.
_ROUNDS = (64, 448, 1536)
#: Totals up to which cells hold just as many counts.
_EXACT = 64
#: A table begins at one of so many unit cells, so that two tables have few draws in common.
_STARTS = 1024
_ROWS = 256
#: Rows of tables that are taken together, and places of their arrays of rows and draws.
_TOGETHER, _PLACES = 1024, 1 << 16
_LEFT = 0xFFFF


def _raw(rng: np.random.Generator, n: int, kind: type) -> np.ndarray:
    """Random integers over the whole of an unsigned type."""
    each = 8 // np.dtype(kind).itemsize
    return rng.bit_generator.random_raw(-(-n // each)).view(kind)[:n]


class _Lookup:
    """Draws from several distributions over 0, 1, …, the rows of ``chance``: each value has its whole shares of 2^bits."""

    def __init__(self, chance: np.ndarray, bits: int):
        self.bits, (k, width) = bits, chance.shape
        scaled = chance * (1 << bits)
        counts = np.empty((k, width + 1), np.int64)
        counts[:, :width] = scaled
        counts[:, width] = (1 << bits) - counts[:, :width].sum(1)
        rest = np.maximum(scaled - counts[:, :width], 0).cumsum(1)
        rest /= np.maximum(rest[:, -1:], 1e-300)
        rest += np.arange(k)[:, None]  # rows one after the other: one search finds row and value
        rest[:, -1] = np.arange(1, k + 1)
        self.rest, self.width = rest.ravel(), width
        values = np.arange(width + 1, dtype=np.uint16)
        values[width] = _LEFT
        self.of = np.repeat(np.broadcast_to(values, counts.shape).ravel(), counts.ravel())

    def draw(self, at: np.ndarray, shares: np.ndarray, chance: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """One value for each row number in ``at``, which is overwritten, by random 16 bits; ``chance`` gives numbers in [0, 1) for the places that need one."""
        at <<= self.bits
        at += shares >> (16 - self.bits)
        out = self.of.take(at)
        left = np.flatnonzero(out == _LEFT)
        row = at[left] >> self.bits
        out[left] = np.searchsorted(self.rest, row + chance(left), "right") - row * self.width
        return out


@lru_cache(maxsize=32)
def _log_ways(most: int) -> np.ndarray:
    """ln of n over x, for n and x up to ``most``."""
    f, i = ln_factorial(np.arange(most + 1)), np.arange(most + 1)
    return np.where(i[None, :] <= i[:, None], f[:, None] - f[None, :] - f[np.maximum(i[:, None] - i[None, :], 0)], -np.inf)


def _binomials(most: int, q: np.ndarray, bits: int) -> _Lookup:
    """For each q the counts of a first column by the total of the row, 0 to ``most``."""
    i, q = np.arange(most + 1.0), np.clip(q, 1e-300, 1 - 1e-16)[:, None, None]
    chance = np.exp(_log_ways(most) + i * (np.log(q) - np.log1p(-q)) + i[:, None] * np.log1p(-q))
    chance /= chance.sum(2, keepdims=True)
    return _Lookup(chance.reshape(-1, most + 1), bits)


def _chances(keys: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys (splitmix64)."""
    z = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class _Shares:
    """Random 16 bits by row and draw; a table begins at one of so many rows."""

    def __init__(self, rows: int):
        self.rows, self.rounds = rows + _ROWS, []

    def round(self, turn: int) -> np.ndarray:
        if turn == len(self.rounds):
            size = _ROUNDS[min(turn, len(_ROUNDS) - 1)]
            self.rounds.append(_raw(np.random.default_rng([7, turn]), self.rows * size, np.uint16).reshape(self.rows, size))
        return self.rounds[turn]


class _Cells:
    """Running sums of unit cells, a column for each draw, by rounds as they are asked for."""

    def __init__(self, total: int, level: int, most: int):
        self.total, self.level, self.most, self.rounds = total, level, most, []

    def round(self, turn: int) -> np.ndarray:
        if turn == len(self.rounds):
            size, rng = _ROUNDS[min(turn, len(_ROUNDS) - 1)], np.random.default_rng([self.total, self.level, turn])
            if self.total:
                held = np.bincount(rng.integers(0, self.total, self.total * size) * size + np.tile(np.arange(size), self.total), minlength=self.total * size).reshape(-1, size)
                cells = np.concatenate([held, held])
            else:
                x, mean = np.arange(24.0), 1 - 2 / 2**self.level
                poisson = np.exp(x * np.log(max(mean, 1e-300)) - mean - ln_factorial(x.astype(np.int64)))
                lookup, cells = _Lookup((poisson / poisson.sum())[None, :], 16), np.empty((_STARTS + self.most, size), np.uint16)
                for i in range(0, len(cells), 64):  # row after row: more cells leave those before as they are
                    values = lookup.of.take(_raw(rng, 64 * size, np.uint16))
                    left = np.flatnonzero(values == _LEFT)
                    values[left] = np.searchsorted(lookup.rest, rng.random(len(left)), "right")
                    cells[i : i + 64] = values.reshape(64, size)[: len(cells) - i]
            sums = np.zeros((len(cells) + 1, size), np.uint16)  # they wrap around, differences don't: a total is under 2^16
            for i in range(len(cells)):
                np.add(sums[i], cells[i], out=sums[i + 1], casting="unsafe", dtype=np.uint16)
            self.rounds.append(sums)
        return self.rounds[turn]


class _Table:
    def __init__(self, table: np.ndarray, seed: int):
        rows, self.first = table.sum(1), int(table[:, 0].sum())
        self.m = m = int(rows.sum())
        self.real = float(np.square((m * table[:, 0] - rows * self.first).astype(float)).sum()) * (1 - 1e-12)
        self.rows = rows[rows > 0]
        top = int(rows.max())
        self.most = int(top + 5 * top**0.5 + 6)
        self.level, self.bits = 0 if m <= _EXACT else math.ceil(math.log2(m) / 2), 10 if self.most < 192 else 12
        self.seed, self.hits, self.done = seed, 1, 0  # the table itself is a hit

    def more(self, far: np.ndarray, permutations: int, min_p: float) -> float | None:
        """The p, if these draws settle it."""
        far = far[: permutations - self.done]
        over = np.flatnonzero(far)
        allowed = math.floor(permutations * min_p) - self.hits  # further hits that are no reason to stop
        if len(over) > allowed:
            return (self.hits + allowed + 1) / (self.done + int(over[allowed]) + 2)
        self.hits, self.done = self.hits + len(over), self.done + len(far)
        return self.hits / permutations if self.done >= permutations else None


class _Block:
    """Tables with common unit cells, as one array of tables, rows and draws; rows that a table hasn't are empty."""

    def __init__(self, tables: list[_Table], cells: _Cells, shares: _Shares):
        self.tables, self.cells, self.shares, self.level, self.bits = tables, cells, shares, tables[0].level, tables[0].bits
        self.n = n = max(len(t.rows) for t in tables)
        self.m, self.first, self.real, self.seed = (np.array([getattr(t, k) for t in tables]) for k in ("m", "first", "real", "seed"))
        rows = np.zeros((len(tables), n + 1), np.int64)
        for i, t in enumerate(tables):
            rows[i, 1 : len(t.rows) + 1] = t.rows
        self.edges = rows.cumsum(1) + (self.seed % (_STARTS if self.level else self.m))[:, None]
        self.owner = [np.repeat(np.arange(len(t.rows)), t.rows) for t in tables] if self.level else []
        self.rngs = [np.random.Generator(np.random.SFC64(t.seed)) for t in tables] if self.level else []
        pairs, self.pair = np.unique(np.stack([self.first, self.m]), axis=1, return_inverse=True)
        self.pair, self.q = self.pair.ravel(), pairs[0] / pairs[1]
        self.widen(max(t.most for t in tables))

    def widen(self, most: int) -> None:
        self.most = -(-most // 16) * 16
        self.lookup = _binomials(self.most, self.q, self.bits)

    def far(self, part: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Which draws of the tables in ``part`` are at least as far from independence as the table, and which draws count."""
        sums, shares, edges, n, k, fit = self.cells.round(turn), self.shares.round(turn), self.edges[part], self.n, len(part), None
        size = sums.shape[1]
        at = sums[edges.ravel()].reshape(k, n + 1, size)
        rows = at[:, 1:] - at[:, :-1]
        if self.level:
            short = self.m[part][:, None] - (at[:, -1] - at[:, 0]).astype(np.int64)
            fit = short >= 0
            short *= fit
            each = short.sum(1)
            to = [(_raw(self.rngs[i], c, np.uint32).astype(np.uint64) * np.uint64(self.m[i]) >> np.uint64(32)).view(np.int64) for i, c in zip(part, each)]
            to = [self.owner[i].take(t) for i, t in zip(part, to)]
            at = (to[0] if k == 1 else np.concatenate([t + j * n for j, t in enumerate(to)])) * size
            at += np.repeat(np.tile(np.arange(size), k), short.ravel())
            np.add.at(rows.reshape(-1), at, np.uint16(1))
        if (most := int(rows.max())) > self.most:
            self.widen(most)
        at = rows.astype(np.intp)
        at += (self.pair[part] * (self.most + 1))[:, None, None]
        begin = self.seed[part] // _STARTS % _ROWS
        share = shares[begin[0] : begin[0] + n] if k == 1 else shares[(begin[:, None] + np.arange(n)).ravel()]
        key = self.seed[part].astype(np.uint64) << np.uint64(32)
        x = self.lookup.draw(at.ravel(), share.ravel(), lambda left: _chances(key[left // (n * size)] + (left % (n * size) + (turn << 26)).astype(np.uint64)))
        kind = np.float32 if int(self.m.max()) * self.most < 1 << 24 else np.float64  # whole numbers up to there are exact
        x, r, m = x.reshape(k, n, size).astype(kind), rows.astype(kind), self.m[part][:, None].astype(float)
        s, xx, xr, rr = (v.astype(float) for v in (x.sum(1), np.einsum("kij,kij->kj", x, x), np.einsum("kij,kij->kj", x, r), np.einsum("kij,kij->kj", r, r)))
        return m * m * xx - 2 * m * s * xr + s * s * rr >= self.real[part][:, None], fit

    def p(self, permutations: int, min_p: float) -> np.ndarray:
        out, open_, turn = np.ones(len(self.tables)), np.arange(len(self.tables)), 0
        while len(open_):
            step, left = max(1, _PLACES // (self.n * _ROUNDS[min(turn, len(_ROUNDS) - 1)])), []
            for i in range(0, len(open_), step):
                part = open_[i : i + step]
                far, fit = self.far(part, turn)
                for j, t in enumerate(part):
                    p = self.tables[t].more(far[j] if fit is None else far[j][fit[j]], permutations, min_p)
                    if p is None:
                        left.append(t)
                    else:
                        out[t] = p
            open_, turn = np.array(left, np.int64), turn + 1
        return out


def rms_p(tables: list[np.ndarray], seeds: list[int], permutations: int, min_p: float) -> np.ndarray:
    """The p of each (cells, 2) table of counts by ``permutations`` draws; a table stops when its hits are over permutations * min_p. 1 where fewer than two rows or no counts are left.

    Totals must be under 2^16. A p depends on its table and seed alone, not on the other tables.
    """
    out = np.ones(len(tables))
    todo = [(i, _Table(t, int(s))) for i, (t, s) in enumerate(zip(tables, seeds)) if len(t) > 1 and t.sum() > 0]
    common = lambda t: (t.level, 0 if t.level else t.m, t.bits)
    todo.sort(key=lambda x: (*common(x[1]), len(x[1].rows), x[1].m, x[1].first))
    shares, most = _Shares(max((len(t.rows) for _, t in todo), default=0)), {}
    for _, t in todo:
        most[t.level] = max(most.get(t.level, 0), t.m)
    cells, of, i = None, None, 0
    while i < len(todo):
        first = todo[i][1]
        if of != (of := common(first)[:2]):
            cells = _Cells(of[1], first.level, most[first.level])
        end = i
        while end < len(todo) and common(todo[end][1]) == common(first) and (end == i or (end - i + 1) * len(todo[end][1].rows) <= _TOGETHER):
            end += 1
        out[[k for k, _ in todo[i:end]]] = _Block([t for _, t in todo[i:end]], cells, shares).p(permutations, min_p)
        i = end
    return out
