"""Split criteria in closed form over additive sums of each side.

A criterion is one function for NumPy arrays and for Spark columns alike: it gets the sums of the left side, of the right side
and of both, and a namespace with ``log`` and ``where``. All values are maximised. The deviances need no second pass over the rows,
as the rows' own logarithms cancel against the parent's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums kept for each level: name -> SQL over numerator, denominator and weight.
SUMS = {
    "c": "1.0D",
    "n": "numerator",
    "d": "denominator",
    "w": "weight",
    "q": "try_divide(numerator * numerator, denominator)",
    "r": "try_divide(numerator, denominator)",
    "r2": "pow(try_divide(numerator, denominator), 2)",
    "z": "if(numerator <> 0, 1.0D, 0.0D)",
}


@dataclass
class Side:
    """Sums of one side."""

    c: Any = None
    n: Any = None
    d: Any = None
    w: Any = None
    q: Any = None
    r: Any = None
    r2: Any = None
    z: Any = None


class ArrayMath:
    log = staticmethod(np.log)
    abs = staticmethod(np.abs)
    where = staticmethod(np.where)
    larger = staticmethod(np.maximum)

    @staticmethod
    def div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=np.asarray(b) != 0)


class ColumnMath:
    abs = staticmethod(F.abs)
    larger = staticmethod(F.greatest)
    div = staticmethod(F.try_divide)

    @staticmethod
    def log(a: Column) -> Column:
        return F.ln(a)

    @staticmethod
    def where(condition: Column, a: Any, b: Any) -> Column:
        return F.when(condition, a).otherwise(b)


def _difference(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return m.abs(m.div(l.n, l.d) - m.div(r.n, r.d))


def _poisson(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    def side(s: Side) -> Any:
        some = s.n > 0
        return m.where(some, s.n * m.log(m.where(some, m.div(s.n, s.d), 1.0)), s.n * 0.0)

    return side(l) + side(r) - side(t)


def _gamma(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    def side(s: Side) -> Any:
        some = s.n > 0
        mean = m.where(some, m.div(s.n, s.d), 1.0)
        return s.c - m.div(s.r, mean) + s.z * m.log(mean)

    return side(t) - side(l) - side(r)


def _sse(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return m.div(l.n * l.n, l.d) + m.div(r.n * r.n, r.d) - m.div(t.n * t.n, t.d)


def _mse(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return -(m.div(l.q - m.div(l.n * l.n, l.d), l.c - 1) + m.div(r.q - m.div(r.n * r.n, r.d), r.c - 1))


def _mse_pointwise(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    side = lambda s: m.div(s.r2, s.c) - m.div(s.r, s.c) * m.div(s.r, s.c)
    return -(side(l) + side(r))


def _max_value(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return m.larger(m.div(l.n, l.d), m.div(r.n, r.d))


def _max_abs(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return m.larger(m.abs(m.div(l.n, l.d)), m.abs(m.div(r.n, r.d)))


def _max_minus(l: Side, r: Side, t: Side, m: Any) -> Any:  # noqa: E741
    return m.larger(-m.div(l.n, l.d), -m.div(r.n, r.d))


@dataclass(frozen=True)
class Criterion:
    value: Callable[[Side, Side, Side, Any], Any]
    sums: tuple[str, ...]  # besides count, n, d and w


CRITERIA: dict[str, Criterion] = {
    "difference": Criterion(_difference, ()),
    "poissondeviance": Criterion(_poisson, ()),
    "gammadeviance": Criterion(_gamma, ("r", "z")),
    "sse": Criterion(_sse, ()),
    "mse": Criterion(_mse, ("q",)),
    "msepointwise": Criterion(_mse_pointwise, ("r", "r2")),
    "maxvalue": Criterion(_max_value, ()),
    "maxabsvalue": Criterion(_max_abs, ()),
    "maxminusvalue": Criterion(_max_minus, ()),
}
ALIASES = {"default": "difference", "poisson": "poissondeviance", "gamma": "gammadeviance"}


def canonical(name: str) -> str:
    name = str(name).lower()
    return ALIASES.get(name, name)


def register(name: str, value: Callable[[Side, Side, Side, Any], Any], sums: tuple[str, ...] = ()) -> None:
    """Add a criterion of one's own: a function of the two sides' and the total sums, and the further sums it needs."""
    if unknown := set(sums) - set(SUMS):
        raise ValueError(f"no such sums: {', '.join(sorted(unknown))}")
    CRITERIA[name] = Criterion(value, sums)
