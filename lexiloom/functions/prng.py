"""A counter-based 32-bit generator as a column expression, and the same in numpy.

Draw k of a seed is a function of (seed, k) alone, so that any draw is one
expression away from a row number: no state, no order, no single task. Products
are taken in halves of 16 bits, which stay below 2^49 and never overflow.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator.
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2^32, for columns below 2^32."""
    high = F.shiftrightunsigned(b, 16)
    low = b.bitwiseAND(F.lit(0xFFFF))
    return (a * low + (a * high).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(MASK))


def _scrambled(state: Column) -> Column:
    return _let(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), lambda a: _times(a, state.bitwiseOR(F.lit(1))))


def _spread(t: Column) -> Column:
    more = _let(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), lambda a: _times(a, t.bitwiseOR(F.lit(61))))
    return _let(t.bitwiseXOR((t + more).bitwiseAND(F.lit(MASK))), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)).bitwiseAND(F.lit(MASK)))


def draw(seed: Column | int, k: Column) -> Column:
    """The k-th (from 0) number in [0, 1) of ``seed``."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    # k is reduced first so that the product stays in range however far the counter goes.
    turn = F.pmod((k + 1).cast("long"), F.lit(1 << 32))
    state = _let(turn, lambda n: (_times(F.lit(STEP).cast("long"), n) + seed.cast("long").bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)))
    return _let(_let(state, _scrambled), _spread) / F.lit(4294967296.0)


def with_draw(rows: DataFrame, seed: int, k: Column, out: str) -> DataFrame:
    """``rows`` with the k-th number of ``seed``, by a chain of plain columns that stays in generated code.

    No step can be null, so that no test for null is pushed down the chain, where it would be written out in full.
    """
    low, wide = lambda c: c.bitwiseAND(F.lit(MASK)), lambda c, n: F.shiftrightunsigned(c, n)
    t, m, x = (F.col(f"_{c}_{out}") for c in "tmx")
    rows = rows.withColumn(f"_m_{out}", low(F.coalesce(k.cast("long"), F.lit(0)) + F.lit(1)))
    rows = rows.withColumn(f"_t_{out}", low(_times(F.lit(STEP).cast("long"), m) + F.lit(seed & MASK)))
    rows = rows.withColumn(f"_m_{out}", t.bitwiseXOR(wide(t, 15))).withColumn(f"_t_{out}", _times(m, t.bitwiseOR(F.lit(1))))
    rows = rows.withColumn(f"_m_{out}", t.bitwiseXOR(wide(t, 7))).withColumn(f"_m_{out}", _times(m, t.bitwiseOR(F.lit(61))))
    rows = rows.withColumn(f"_x_{out}", t.bitwiseXOR(low(t + m)))
    return rows.withColumn(out, low(x.bitwiseXOR(wide(x, 14))).cast("double") * F.lit(2.0**-32)).drop(f"_t_{out}", f"_m_{out}", f"_x_{out}")


def draws_at(seed: int, k: np.ndarray) -> np.ndarray:
    """Draws number ``k`` of ``seed``."""
    with np.errstate(over="ignore"):
        a = (np.uint64(seed & MASK) + (np.asarray(k).astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)).astype(np.uint32)
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
        return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """Draws ``start`` to ``start + n`` of ``seed``."""
    return draws_at(seed, np.arange(start, start + n, dtype=np.uint64))


class Stream:
    """Draws of a seed one after the other, made in blocks."""

    def __init__(self, seed: int, start: int = 0):
        self.seed, self.used, self._block, self._at = seed, start, np.zeros(0), 0

    def __call__(self) -> float:
        if self._at == len(self._block):
            self._block, self._at = draws(self.seed, self.used, 1024), 0
        self._at += 1
        self.used += 1
        return float(self._block[self._at - 1])


def quick(seed: int, block: int = 8192):
    """The same draws as those of :class:`Stream`, as a function that costs next to nothing a call."""
    return chain.from_iterable(draws(seed, block * k, block).tolist() for k in count()).__next__


def permutation(n: int, draw_of) -> list[int]:
    """0 to n - 1 in an order made of n - 1 exchanges, each of the last open place with one at or before it."""
    order = list(range(n))
    for last in range(n - 1, 0, -1):
        other = int(draw_of() * (last + 1))
        order[last], order[other] = order[other], order[last]
    return order


def permuted(n: int, seed: int, block: int = 1 << 16) -> np.ndarray:
    """:func:`permutation` by the draws of a seed, in as many bytes as the indices have."""
    order = array("i" if n < 1 << 31 else "q", bytes(0))
    for low in range(0, n, block):
        order.frombytes(np.arange(low, min(n, low + block), dtype=f"i{order.itemsize}").tobytes())
    return np.frombuffer(exchanged(order, seed, block), dtype=f"i{order.itemsize}")


def exchanged(items: array, seed: int, block: int = 1 << 16) -> array:
    """``items`` put in the order of :func:`permuted`, in place, so that nothing is held beside them."""
    n = len(items)
    for top in range(n - 1, 0, -block):
        lasts = np.arange(top, max(0, top - block), -1)
        others = (draws(seed, n - 1 - top, len(lasts)) * (lasts + 1)).astype(np.int64).tolist()
        for last, other in zip(lasts.tolist(), others, strict=True):
            items[last], items[other] = items[other], items[last]
    return items


class Picker:
    """Items by weight: the first whose running sum exceeds a draw times the whole."""

    def __init__(self, weights: dict):
        values = list(weights.values())
        if any(w < 0 for w in values) or not sum(values) > 0:
            raise ValueError("weights must be non-negative and not all zero")
        self.items = list(weights)
        self.sums = np.cumsum(values).tolist()
        self.whole, self.last = self.sums[-1], len(self.items) - 1

    def __call__(self, draw_of):
        at = bisect_right(self.sums, draw_of() * self.whole)
        return self.items[at if at < self.last else self.last]
