"""Training metrics: bits per character, histories, best checkpoints, losses."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS
from .decoding import let


def bits_per_char(loss: Column) -> Column:
    return loss / F.lit(math.log(2.0))


def step_line(step: Column, loss: Column, width: int = 5) -> Column:
    """Step with leading zeros and loss with six decimals, as logs show them."""
    return F.format_string(f"Step %0{width}d: %.6f", step, loss)


def logged_once(df: DataFrame, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    """One row for each key: rows that were logged twice repeat."""
    return df.groupBy(*keys).agg(*[F.max(m).alias(m) for m in METRICS])


def validated(df: DataFrame) -> DataFrame:
    """Rows with both validation values."""
    return df.na.drop(subset=["avg_val_loss", "avg_val_bpc"])


def every(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Rows of steps that are multiples of n."""
    return df.where(F.col(step) % n == 0)


def history_summary(df: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """by, metric, steps, first, last, least, most, mean of each metric in step order; steps without a value are left out."""
    long = df.unpivot([*by, "step"], list(METRICS), "metric", "v").where("v is not null")
    return long.groupBy(*by, "metric").agg(
        F.count("*").alias("steps"), F.min_by("v", "step").alias("first"), F.max_by("v", "step").alias("last"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean")
    )


def best_checkpoints(df: DataFrame, saved_every: int, by: Sequence[str] = ("run",)) -> DataFrame:
    """by, best_step, best_loss, best_saved_step, best_saved_loss, final_step, final_loss by validation loss.

    Ties go to the earlier step; the saved ones are null if no validated step was saved.
    """
    at = F.struct(F.col("avg_val_loss").alias("loss"), "step")
    saved = F.min(F.when(F.col("step") % saved_every == 0, at))
    last = F.max(F.struct("step", F.col("avg_val_loss").alias("loss")))
    g = df.where("avg_val_loss is not null").groupBy(*by).agg(F.min(at).alias("b"), saved.alias("s"), last.alias("f"))
    return g.select(*by, *[F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("b", "best"), ("s", "best_saved"), ("f", "final")) for c in ("step", "loss")])


def cross_entropy(logits: Column, target: Column) -> Column:
    """log-sum-exp of the logits less the target's; null for a null list or a target outside it."""
    def entropy(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top - F.get(x, target))

    return let(F.transform(logits, lambda v: v.cast("double")), entropy)


def mean_of_means(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """avg_loss: mean of the batches' mean losses."""
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("avg_loss"))
