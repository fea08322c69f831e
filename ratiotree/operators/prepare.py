"""Flat tables made ready for modelling: roles, checks, rare levels, bins and level codes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import all_weighted_quantiles, first_at_least, ranked
from .sampling import sampled

ROLES = ("key", "numerator", "denominator", "weight", "is_train")
#: More levels than this in one feature are refused: the search state must stay small.
MOST_LEVELS = 2000


@dataclass
class Prepared:
    """``rows``: the roles, the features' values, and a code column ``<feature>#`` for each; ``levels``: feature, code, number, text.

    Codes start at 0 and follow the order of the bins or of the strings. A bin's number is its upper edge, which belongs to it.
    """

    rows: DataFrame
    levels: DataFrame
    numeric: list[str]
    categorical: list[str]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def where(self, condition: str | Column) -> Prepared:
        return Prepared(self.rows.where(condition), self.levels, self.numeric, self.categorical)


def code(feature: str) -> str:
    return f"{feature}#"


def frequencies(df: DataFrame, column: str, threshold: float = 5) -> DataFrame:
    """value, n, share, keep: how often each value occurs; ``threshold`` below 0 keeps shares of at least its size, from 1 on so many most frequent values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")  # one row on the right side
    if threshold < 0:
        return out.withColumn("keep", F.col("share") >= -threshold)
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(int(threshold)).select(F.col("value").alias("_top"), F.lit(True).alias("_keep"))
    return out.join(F.broadcast(top), out["value"].eqNullSafe(top["_top"]), "left").withColumn("keep", F.coalesce("_keep", F.lit(False))).drop("_top", "_keep")


def others(df: DataFrame, column: str, threshold: float, new: str | float) -> DataFrame:
    """``df`` with the values of ``column`` that ``frequencies`` does not keep replaced by ``new``."""
    keep = frequencies(df, column, threshold).where("keep").select(F.col("value").alias("_kept"), F.lit(True).alias("_is"))
    marked = df.join(keep, df[column].eqNullSafe(keep["_kept"]), "left")
    return marked.withColumn(column, F.when(F.col("_is"), F.col(column)).otherwise(F.lit(new).cast(df.schema[column].dataType))).drop("_kept", "_is")


def others_in_all(df: DataFrame, most: int, new: str = "~") -> DataFrame:
    """Every string column reduced to its ``most - 1`` most frequent values and ``new``."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return reduce(lambda out, c: others(out, c, most - 1, new), strings, df)


def known_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, level: the different upper-case values of string columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.upper(F.col(c)).alias("level")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").distinct()


def without_noise(value: Column, eps: float = 2.0**-52) -> Column:
    """Numbers that rounding left next to 0, less than two machine steps away, as 0."""
    return F.when(F.abs(value) < 2 * eps, F.lit(0.0)).otherwise(value)


def capped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Numbers beyond the bounds as the bounds; null stays null."""
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    return F.when(value > high, F.lit(float(high))).otherwise(value) if high is not None else value


def ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the place of the value of ``column`` among its different values, from 1, whatever their number; rows without a value go."""
    return ranked(df.where(F.col(column).isNotNull()), column, name)


def sanity(df: DataFrame, numerator: str, denominator: str, weight: str, columns: list[str]) -> DataFrame:
    """One row: rows, zero and negative denominators, negative numerators and weights, and nulls in any of ``columns``, in a single pass."""
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(denominator) == 0).alias("zero_denominators"),
        F.count_if(F.col(denominator) < 0).alias("negative_denominators"), F.count_if(F.col(numerator) < 0).alias("negative_numerators"),
        F.count_if(F.col(weight) < 0).alias("negative_weights"), F.count_if(nulls).alias("rows_with_nulls"))


def train_flag(key: Column, validation: float, seed: int) -> Column:
    """True for a share ``1 - validation`` of keys; the key and the seed alone decide, whatever the partitions."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0) >= validation


def exact_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with is_train true for exactly round(share * n) rows: those first in the order of a hash of the key. Rows of one key go together."""
    return df.withColumn("is_train", sampled(df, share, seed, key))


def split_points(df: DataFrame, columns: list[str], points: int, weight: str | None = None) -> dict[str, list[float]]:
    """For each column the upper edges of its bins: weighted quantiles at (i + 0.5) / points, each a value of the column; the last is the greatest value."""
    shares = [(i + 0.5) / points for i in range(points)]
    rows = df if weight else df.withColumn("_one", F.lit(1.0))
    out = {}
    for c, (*found, top) in ((c, q or [0.0]) for c, q in all_weighted_quantiles(rows, columns, weight or "_one", shares).items()):
        edges = sorted(set(found))
        out[c] = [*edges[:-1], top]
    return out


def prepare(
    df: DataFrame,
    numerator: str,
    denominator: str | None = None,
    weight: str | None = None,
    key: str | None = None,
    train: str | None = None,
    features: list[str] | None = None,
    as_categorical: tuple[str, ...] = (),
    validation: float = 0.3,
    points: int = 250,
    weighted_bins: bool = True,
    ignore_zero_denominator: bool = False,
    seed: int = 90210,
) -> Prepared:
    """A table with its roles, codes and levels. Raises ValueError for columns that are not there, nulls, other train flags than 0 and 1, and denominators or numerators that no model can use.

    Without a denominator or weight each row counts 1; without a train flag a hash of the key decides; without a key a row's hash stands in for it.
    """
    named = [c for c in (numerator, denominator, weight, key, train) if c]
    if not numerator:
        raise ValueError("a numerator column is needed")
    if missing := [c for c in [*named, *(features or []), *as_categorical] if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    if not 0 < validation < 1:
        raise ValueError("validation must be in (0, 1)")
    features = [c for c in features or df.columns if c not in named]
    if not features:
        raise ValueError("no feature is left")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    categorical = [c for c in features if kinds[c] == "string" or c in as_categorical]
    numeric = [c for c in features if c not in categorical]
    if bad := [c for c in numeric if not any(kinds[c].startswith(k) for k in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"))]:
        raise ValueError(f"neither numbers nor strings: {', '.join(bad)}")
    key_of = F.col(key).cast("string") if key else F.hex(F.xxhash64(*[F.col(c) for c in df.columns]))
    rows = df.select(
        key_of.alias("key"), F.col(numerator).cast("double").alias("numerator"),
        (F.col(denominator).cast("double") if denominator else F.lit(1.0)).alias("denominator"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        (F.col(train).cast("int") if train else train_flag(key_of, validation, seed).cast("int")).alias("flag"),
        *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    checks = sanity(rows, "numerator", "denominator", "weight", rows.columns).crossJoin(rows.agg(F.count_if(~F.col("flag").isin(0, 1)).alias("odd_flags"), *[F.count_if(F.isnan(c)).alias(f"nan_{i}") for i, c in enumerate(numeric)])).first()
    if not checks["n_rows"]:
        raise ValueError("the table is empty")
    if checks["rows_with_nulls"] or any(checks[f"nan_{i}"] for i in range(len(numeric))):
        raise ValueError("nulls or NaN in a role or a feature")
    if checks["odd_flags"]:
        raise ValueError("the train flag must be 0 or 1")
    if checks["zero_denominators"] and not ignore_zero_denominator:
        raise ValueError("a denominator is 0")
    return encode(rows.withColumn("is_train", F.col("flag") == 1).drop("flag"), numeric, categorical, points, weighted_bins)


def encode(rows: DataFrame, numeric: list[str], categorical: list[str], points: int = 250, weighted_bins: bool = True) -> Prepared:
    """Bins and codes for rows that have their roles already. Bins come from training and validation rows together."""
    spark = rows.sparkSession
    levels: list[tuple[str, int, float | None, str | None]] = []
    codes: dict[str, Column] = {}
    found = split_points(rows, numeric, points, "weight" if weighted_bins else None) if numeric else {}
    for c, edges in found.items():
        levels += [(c, i, float(e), None) for i, e in enumerate(edges)]
        codes[code(c)] = F.least(first_at_least(F.col(c), edges), F.lit(len(edges))) - 1
    if categorical:
        wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in categorical])).alias("p")
        different = rows.select(wanted).select("p.*").distinct()
        many = different.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_LEVELS).select("feature").collect()
        if many:
            raise ValueError(f"more than {MOST_LEVELS} levels: {', '.join(r[0] for r in many)}")
        found = sorted(map(tuple, different.collect()))  # at most MOST_LEVELS a feature
        for c in categorical:
            values = [v for f, v in found if f == c]
            levels += [(c, i, None, v) for i, v in enumerate(values)]
            if len(values) <= 64:
                codes[code(c)] = reduce(lambda e, iv: e.when(F.col(c) == iv[1], iv[0]), list(enumerate(values))[1:], F.when(F.col(c) == values[0], 0))
            else:
                codes[code(c)] = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), F.col(c))
    kinds = pa.schema([("feature", pa.string()), ("code", pa.int32()), ("number", pa.float64()), ("text", pa.string())])
    table = spark.createDataFrame(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*levels, strict=True), kinds, strict=True)], schema=kinds))
    return Prepared(rows.withColumns({k: v.cast("int") for k, v in codes.items()}), table, numeric, categorical)
