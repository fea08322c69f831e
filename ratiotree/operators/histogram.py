"""Sums for each node, feature and level: the one aggregate that all split searches read.

Rows of equal codes add up to one, as all that a tree needs of rows are sums. Where that makes the table much smaller, trees grow on those sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.criteria import CRITERIA, SUMS
from ..sources.workspace import Workspace
from .prepare import code

#: Rows are summed to different codes if there are at least so many rows for each.
WORTH = 4


def level_sums(rows: DataFrame, features: list[str], node: Column | None = None, sums: tuple[str, ...] = (), coded: bool = True) -> DataFrame:
    """node, feature, level, c, n, d, w and further sums: one pass, combined before the shuffle, so that its size follows levels and not rows."""
    wanted = ["c", "n", "d", "w", *sums]
    base = rows.select((node if node is not None else F.lit(1)).cast("long").alias("node"), *[F.expr(SUMS[s]).alias(s) for s in wanted], *[F.col(f"`{code(f)}`" if coded else f"`{f}`").alias(f"_f{i}") for i, f in enumerate(features)])
    return long_sums(base.where("node is not null"), {f: f"_f{i}" for i, f in enumerate(features)}, wanted)


def long_sums(rows: DataFrame, columns: dict[str, str], wanted: list[str]) -> DataFrame:
    """node, feature, level and the sums of rows that have them already; ``columns``: what each feature's levels are called."""
    pairs = ", ".join(f"'{f}', `{c}`" for f, c in columns.items())
    long = rows.select("node", *wanted, F.expr(f"stack({len(columns)}, {pairs}) as (feature, level)"))
    return long.groupBy("node", "feature", "level").agg(*[F.sum(s).alias(s) for s in wanted])


def sums_of(criterion: str) -> tuple[str, ...]:
    return CRITERIA[criterion].sums


@dataclass
class Cells:
    """Codes (``<feature>#``) with sums, a row for each combination of codes, or for each row where that would save little. ``free`` gives back what it holds."""

    rows: DataFrame
    sums: list[str]
    free: Callable[[], None]
    summed: bool


def check(rows: DataFrame, criterion: str, features: list[str]) -> tuple[int, int]:
    """Rows, and about how many different combinations of codes. Raises ValueError for rows that the criterion can't take."""
    found = rows.agg(
        F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*[F.col(f"`{code(f)}`") for f in features])) if features else F.lit(0),
        F.count_if(F.col("numerator") < 0), F.count_if(F.col("denominator") == 0), F.count_if(F.col("denominator") < 0)).first()
    if found[2] and criterion in ("poissondeviance", "gammadeviance"):
        raise ValueError(f"{found[2]} rows have a negative numerator, which {criterion} can't take")
    if found[3] and criterion in ("mse", "sse", "msepointwise"):
        raise ValueError(f"{found[3]} rows have the denominator 0, which {criterion} can't take")
    if found[4] and criterion in ("poissondeviance", "gammadeviance"):
        raise ValueError(f"{found[4]} rows have a negative denominator, which {criterion} can't take")
    return found[0], found[1]


def cells(rows: DataFrame, features: list[str], criterion: str) -> Cells:
    """The sums of rows with roles and codes that trees by ``criterion`` need."""
    n, different = check(rows, criterion, features)
    wanted = ["c", "n", "d", "w", *CRITERIA[criterion].sums]
    codes = [f"`{code(f)}`" for f in features]
    base = rows.select(*codes, *[F.expr(SUMS[s]).alias(s) for s in wanted])
    if features and different * WORTH <= n:
        work = Workspace(rows.sparkSession)
        return Cells(work.write(base.groupBy(*codes).agg(*[F.sum(s).alias(s) for s in wanted])), wanted, work.delete, True)
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    return Cells(base, wanted, base.unpersist, False)


#: At most so many combinations of codes, some megabytes, are searched on the driver, which spares a job for each level of a tree; the tree is the same.
LOCAL_CELLS = 100_000
#: How sums follow a factor of all denominators.
_POWERS = {"d": 1, "q": -1, "r": -1, "r2": -2}


@dataclass
class LocalCells:
    """Combinations of codes with their sums, as arrays."""

    codes: dict[str, np.ndarray]
    sums: dict[str, np.ndarray]

    def scaled(self, factor: np.ndarray) -> LocalCells:
        return LocalCells(self.codes, {s: v * factor ** _POWERS[s] if s in _POWERS else v for s, v in self.sums.items()})


def at_hand(part: Cells, features: list[str]) -> LocalCells | None:
    """The cells as arrays, or None if they are too many."""
    if not part.summed or part.rows.count() > LOCAL_CELLS:
        return None
    table = part.rows.toArrow()
    return LocalCells({f: table[code(f)].to_numpy() for f in features}, {s: table[s].to_numpy().astype(float) for s in part.sums})


def scaled(part: Cells, factor: Column) -> Cells:
    """The same with each row's denominator times ``factor``, which must follow from the codes alone."""
    new = {s: F.col(s) * F.pow(factor, F.lit(p)) if p != 1 else F.col(s) * factor for s, p in _POWERS.items() if s in part.sums}
    return Cells(part.rows.withColumns(new), part.sums, part.free, part.summed)
