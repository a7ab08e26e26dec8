"""Equality joins of many rows to one row per key, where one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed

#: Rows of one key that a single task takes without being split.
ROWS_A_SALT = 20_000
#: A table of hot keys is broadcast only if it has been counted and is no larger than this.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, salts) of every key with more than ROWS_A_SALT rows. counts has one row per key.

    The table is written once and measured: within the two limits it is marked to be
    broadcast, beyond them it is joined by a shuffle, whose skewed partitions Spark splits
    at run time. Every key over ROWS_A_SALT gets its salts, however many there are.
    """
    hot = checkpointed(counts.where(F.col(n) > ROWS_A_SALT).select(F.col(key), F.ceil(F.col(n) / F.lit(ROWS_A_SALT)).cast("int").alias("_salts")))
    return F.broadcast(hot) if is_small(hot) else hot


def is_small(written: DataFrame) -> bool:
    """Whether a table that has been written may be broadcast: its rows and bytes are counted."""
    rows, size = written.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*written.columns)))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def join_to_measured(many: DataFrame, one: DataFrame, key: str, hot: Callable[[], DataFrame], spread: Column, how: str = "left") -> DataFrame:
    """As :func:`join_to_unique`, where ``one`` has been written: broadcast if it is small, else with the hot keys."""
    if is_small(one):
        return many.join(F.broadcast(one), key, how)
    return join_to_unique(many, one, key, hot(), spread, how)


def join_to_unique(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "left") -> DataFrame:
    """``many`` joined to ``one`` (unique by key), the rows of hot keys spread over salts.

    hot comes from :func:`hot_keys`. spread is an integer expression over ``many`` that tells
    its rows apart. The row of a hot key is copied once per salt; rows of other keys take
    salt 0, those of null keys, which join nothing, a salt of their own each time.
    """
    left = many.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")).cast("int")).when(F.col(key).isNull(), F.pmod(spread, F.lit(1 << 20)).cast("int")).otherwise(F.lit(0))
    ).drop("_salts")
    right = (
        one.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        .drop("_salts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
