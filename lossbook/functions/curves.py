"""Monthly curves of one loan as array columns: hazards, survival, timing, balances.

A loan's months stay in its own row, so none of these needs a shuffle. Running products go through Arrow
batches of the curve alone; the rest are built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lossbook import fixed_values as V

NO_RATE = 1e-9      # a monthly rate up to this counts as zero


def months(term: Column) -> Column:
    return F.sequence(F.lit(1), term.cast("int"))


def clip_hazard(h: Column) -> Column:
    return F.least(F.greatest(h, F.lit(V.HAZARD_FLOOR)), F.lit(1 - V.HAZARD_FLOOR))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression so that it is evaluated once per row.

    A lambda body is evaluated per array element, with everything written inside it; binding
    keeps sums and curves out of the element loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_month(curves: pa.Array, missing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrow lists as (values one after the other, offsets, list of each value, month of each value from 0).

    A NULL list has no months; a NULL month counts as `missing`.
    """
    n = pc.fill_null(pc.list_value_length(curves), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(curves.flatten(), missing).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    return flat, ends, row, np.arange(len(flat)) - ends[row]


def _running(curves: pa.Array, months_: pa.Array, marginal: bool) -> pa.Array:
    """Running survival, or default probability by month, of a batch of hazard lists."""
    flat, ends, row, month = by_month(curves, V.HAZARD_FLOOR)
    h = np.fmin(np.maximum(flat, V.HAZARD_FLOOR), 1 - V.HAZARD_FLOOR)
    alive = np.ones((max(pc.max(months_).as_py() or 0, 0), len(ends) - 1))     # month-major: one product per month
    alive[month, row] = 1 - h
    out = np.cumprod(alive, axis=0)[month, row]
    if marginal:
        out = np.where(month > 0, np.roll(out, 1), 1.0) * h
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pc.is_null(curves))


@lru_cache(maxsize=2)
def _curve_udf(marginal: bool):
    """A running product over an array costs its length squared, interpreted, as a fold that appends; an Arrow batch costs its length."""
    def curve(hazards: pa.Array, months_: pa.Array) -> pa.Array:
        return _running(hazards, months_, marginal)

    function = F.arrow_udf(curve, "array<double>")
    # a column that is named twice stays a column of its own, whatever expression it stands for
    return lambda hazards: function(hazards.cast("array<double>"), F.size(hazards))


def survival_curve(hazards: Column) -> Column:
    """S(t) after each month, from an array of monthly hazards. NULL for NULL; a NULL hazard counts as the smallest.

    Spark does not plan fields of a lambda's variable inside the argument; make such hazards a column first.
    """
    return _curve_udf(False)(hazards)


def marginal_curve(hazards: Column) -> Column:
    """Default probability per month: S(t-1) * h(t). Sums to the lifetime probability."""
    return _curve_udf(True)(hazards)


def lifetime_pd(hazards: Column) -> Column:
    """1 - S(term); 0 for an empty curve."""
    return 1 - F.aggregate(hazards, F.lit(1.0), lambda s, h: s * (1 - clip_hazard(h)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def fallback_timing(bins: int = V.TIMING_BINS) -> list[float]:
    """Bump-shaped default-timing density for books that have no default history."""
    raw = [math.exp(-(((i + 0.5) / bins - V.TIMING_PEAK) ** 2) / (2 * V.TIMING_SPREAD ** 2)) for i in range(bins)]
    return [r / sum(raw) for r in raw]


def density_literal(density: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(d)) for d in density])


def timing_bin(month: Column, term: Column, bins: int) -> Column:
    """0-based bin of the middle of a month; whole-number arithmetic keeps bin borders exact."""
    return F.least(F.floor((2 * month - 1) * bins / (2 * term)), F.lit(bins - 1)).cast("int")


def _with_mass(curve: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body(curve, sum of curve)` with both evaluated once."""
    return let(curve, lambda c: let(total(c), lambda mass: body(c, mass)))


def timing_weights(term: Column, density: Column, bins: int) -> Column:
    """One weight per month, summing to 1; uniform when the density has no mass there."""
    raw = F.transform(months(term), lambda k: F.get(density, timing_bin(k, term, bins)))
    return _with_mass(raw, lambda c, mass: F.transform(c, lambda w: F.when(mass > 0, w / mass).otherwise(1 / term)))


def conform(curve: Column, term: Column) -> Column:
    """Cut a curve to `term` months, or pad it with zeros."""
    n = term.cast("int")
    return let(curve, lambda c: F.concat(
        F.slice(c, 1, n), F.array_repeat(F.lit(0.0), F.greatest(n - F.size(c), F.lit(0)))))


def level_on_shape(level: Column, shape: Column) -> Column:
    """Spread a headline probability over the months in proportion to a shape."""
    return _with_mass(shape, lambda c, mass: F.when(mass > 0, let(level / mass, lambda u: F.transform(c, lambda m: m * u))))


def spread(level: Column, weights: Column) -> Column:
    """A probability split over the months by weights."""
    return let(level, lambda p: F.transform(weights, lambda w: p * w))


def payment(amount: Column, rate: Column, term: Column) -> Column:
    """Fixed monthly payment at a monthly rate."""
    return F.when(rate <= NO_RATE, amount / term).otherwise(
        amount * rate / (1 - F.pow(1 + rate, -term)))


def balance(amount: Column, rate: Column, term: Column, month: Column) -> Column:
    """Owed at the start of a month, in closed form."""
    growth = F.pow(1 + rate, term)
    return F.when(rate <= NO_RATE, amount * (term - month + 1) / term).otherwise(
        amount * (growth - F.pow(1 + rate, month - 1)) / F.when(growth != 1, growth - 1))
