"""What the operators of this package share: bounded samples, let-binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch  # noqa: F401 - the operators' tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once.

    A lambda variable can't be inlined by CollapseProject, so an expensive
    value that a higher-order function refers to for every element isn't
    computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, group: str, key: Column, n: int, seed: int) -> DataFrame:
    """About ``n`` rows of each value of ``group``, all of them where there are fewer.

    The share of each group follows from one count over all rows; rows are
    taken by a hash of ``key``, so the same rows are taken however the table is
    split. At most ``n + 6 * sqrt(n)`` rows a group are expected.
    """
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, size in sizes.items():
        if value is not None:
            share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, n / size))).otherwise(share)
    return df.filter(unit_hash(seed, key) < share)


HOT_ROWS = 1000
SENT_ROWS = 100_000
"""Rows of hot keys that are sent to all tasks at most; beyond that they are joined salted."""
SALTS = 64


def join_hot(big: DataFrame, small: DataFrame, key: str | list[str], scratch: Scratch, how: str = "inner") -> DataFrame:
    """``big`` with ``small``, which has one row a key, and in ``n`` how many rows of ``big`` have it; ``n`` is left out.

    Keys with over HOT_ROWS rows are joined apart, so that none fills a task:
    they are written first, and so counted, and sent to where big's rows are
    while they are SENT_ROWS at most. Beyond that each is copied SALTS times
    and big's rows are dealt by key and salt.
    """
    key = [key] if isinstance(key, str) else key
    hot, _ = scratch.write(small.filter(F.col("n") > HOT_ROWS).drop("n"), "hot-keys")
    cold = small.filter(F.col("n") <= HOT_ROWS).drop("n")
    if hot.count() <= SENT_ROWS:
        hot = F.broadcast(hot)
        return big.join(hot, key).unionByName(big.join(hot.select(*key), key, "left_anti").join(cold, key, how))
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = hot.withColumns({"__salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "__hot": F.lit(True)})
    both = salted.join(copies, [*key, "__salt"], "left")
    return both.filter("__hot").drop("__salt", "__hot").unionByName(both.filter("__hot is null").select(*big.columns).join(cold, key, how))
