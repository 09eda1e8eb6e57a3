"""Staged tables, joins that survive hot keys, and Arrow helpers shared by the operators."""

from __future__ import annotations

import functools
import gc
import operator
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pdengine.staging import materialise

__all__ = ["ascii_lower", "attach", "numbered", "running", "slices", "spread", "staged"]

#: A key is hot when it holds more than this share of the rows; fewer than 1/share keys can be.
HOT_SHARE = 1e-3
#: Seconds of work after which the driver is asked to let go of finished shuffles.
LONG = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Shuffle files stay on disk until the driver's JVM notices that nothing
    refers to their shuffle any more, which it does when it collects garbage.
    After a long step it is asked to, else the shuffles of all steps add up.
    """
    began = time.monotonic()
    out = materialise(df)
    if time.monotonic() - began > LONG:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone.

    ``lower`` is faster and does the same where all characters are ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a narrow table over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _ranged(rows: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """Rows range-sorted and written, with ``_part`` and ``_at``, their place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    out = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", at))
    return out.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per part of a range sort, ``_b_<name>``: the sums over all parts before it; one row per part passes the driver."""
    types = {n: rows.select(c.alias("c")).schema["c"].dataType.simpleString() for n, c in sums.items()}
    found = sorted(rows.groupBy("_part").agg(*[F.sum(c).cast(types[n]).alias(n) for n, c in sums.items()]).collect(), key=lambda r: r["_part"])
    total = dict.fromkeys(sums, 0)
    before = []
    for r in found:
        before.append((r["_part"], *[float(v) if types[n] == "double" else v for n, v in total.items()]))
        total = {n: total[n] + (r[n] or 0) for n in sums}
    return rows.sparkSession.createDataFrame(before, "_part long, " + ", ".join(f"_b_{n} {t}" for n, t in types.items()))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``_place``, their position from 0 in the order of the columns, by a range sort."""
    out = _ranged(rows, order)
    first = _before(out, {"n": F.lit(1).cast("long")})
    return out.join(F.broadcast(first), "_part").withColumn("_place", F.col("_b_n") + F.col("_at")).drop("_part", "_at", "_b_n")


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Rows with, per name, the sum of its column over all rows before in the order, by a range sort."""
    out = _ranged(rows, tuple(order))
    above = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = out.withColumns({f"_i_{n}": F.sum(c).over(above) for n, c in sums.items()})
    joined = inside.join(F.broadcast(_before(out, sums)), "_part")
    return joined.withColumns({n: F.col(f"_b_{n}") + F.coalesce(f"_i_{n}", F.lit(0)) for n in sums}).drop(
        "_part", "_at", *[f"_{k}_{n}" for n in sums for k in "bi"]
    )


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], size: str, out: list[str]) -> DataFrame:
    """Left join of ``lookup`` (one row per key) that no hot key can overload.

    ``lookup`` counts in ``size`` the rows that hold its key. Hot keys, fewer
    than 1/HOT_SHARE whatever the data, are broadcast; their rows then take part
    in the shuffled join under a salt that finds nothing, so they spread.
    """
    total = lookup.agg(F.sum(size).alias("t")).select("t").scalar()
    is_hot = F.col(size) > F.lit(HOT_SHARE) * total
    named = lookup.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(size), *out)
    hot = named.where(is_hot).select(
        *[F.col(f"_k{i}").alias(f"_h{i}") for i in range(len(keys))],
        F.struct(*out).alias("_hot"),
    )
    cold = named.where(~is_hot).select(
        *[f"_k{i}" for i in range(len(keys))], F.lit(0).alias("_z"), F.struct(*out).alias("_cold")
    )
    same = lambda p: functools.reduce(operator.and_, [F.col(k) == F.col(f"{p}{i}") for i, k in enumerate(keys)])
    lost = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])
    found = rows.join(F.broadcast(hot), same("_h"), "left").withColumn(
        "_s",
        F.when(F.col("_hot").isNotNull() | lost, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).otherwise(0).cast("int"),
    )
    joined = found.join(cold, same("_k") & (F.col("_s") == F.col("_z")), "left")
    kept = [c for c in rows.columns if c not in out]
    return joined.select(*kept, *[F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in out])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold ``most`` bytes, or are one text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
