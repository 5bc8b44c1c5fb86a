"""Sketches a batch: quantiles and distinct counts that merge without a second look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LOG2_REGISTERS = 200, 12
RANK_ERROR = 0.0133  # of a quantile sketch with K = 200, at 99 % confidence; normalised, for one quantile
COUNT_ERROR = 3 * 1.04 / 2 ** (LOG2_REGISTERS / 2)  # three standard errors of a distinct count


def batches(rows: DataFrame, batch: str, value: str, member: Column | str, k: int = K, registers: int = LOG2_REGISTERS) -> DataFrame:
    """A row a batch to keep: batch, n, quantiles (a sketch of ``value``, nulls left out) and members (a sketch of the distinct ``member``).

    A sketch takes a few kilobytes however many rows its batch has; both are made by partial aggregation.
    """
    members = F.hll_sketch_agg(F.col(member) if isinstance(member, str) else member, registers)
    return rows.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), k).alias("quantiles"), members.alias("members"))


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Batches' sketches as one row (or one for each value of ``by``): n, quantiles, members."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.hll_union_agg("members").alias("members"))


def quantiles(sketch: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """share, value: estimates whose true rank is within RANK_ERROR of the share."""
    wanted = F.array(*map(F.lit, shares))
    found = F.arrays_zip(wanted.alias("share"), F.kll_sketch_get_quantile_bigint("quantiles", wanted).alias("value"))
    return sketch.select(*by, F.explode(found).alias("x")).select(*by, "x.share", "x.value")


def ranks(sketch: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The share of rows at or below a value."""
    return sketch.select(*by, F.kll_sketch_get_rank_bigint("quantiles", value).alias("share"))


def distinct(sketch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return sketch.select(*by, F.hll_sketch_estimate("members").alias("n_distinct"))
