"""Order-dependent aggregates that stay parallel inside one hot key.

A session is the natural key, but one session may hold a large share of all
rows. Anything that walks a session in order (running sums, ordered string
concatenation, previous-row lookups) is therefore done in fixed-size blocks
of the order column: the heavy work is partitioned by ``(key, block)``, and
only one small row per block is combined per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# rows per block; one block is sorted inside one task
BLOCK = 1 << 16


def block_of(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / F.lit(size))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str,
                out: str, exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """``sum(value) over (partition by keys order by order rows ... )``,
    inclusive or exclusive of the current row. ``order`` must be unique per
    key. Block totals are summed per key, then added back by a join."""
    keys = list(keys)
    blk, loc, tot, off = "_rs_blk", "_rs_loc", "_rs_tot", "_rs_off"
    d = df.withColumn(blk, block_of(order, block))
    frame_end = -1 if exclusive else Window.currentRow
    w = (Window.partitionBy(*keys, blk).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, frame_end))
    d = d.withColumn(loc, F.coalesce(F.sum(value).over(w), F.lit(0)))
    totals = d.groupBy(*keys, blk).agg(F.sum(value).alias(tot))
    wb = (Window.partitionBy(*keys).orderBy(blk)
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, blk, F.coalesce(F.sum(tot).over(wb), F.lit(0)).alias(off))
    return (d.join(offsets, [*keys, blk])
            .withColumn(out, F.col(off) + F.col(loc))
            .drop(blk, loc, off))


def join_sorted(pairs: Column, sep: str) -> Column:
    """Strings ``v`` in the order of ``k``; a null string counts as empty, it does
    not lose its place."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.coalesce(x["v"], F.lit(""))), sep)


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, value: Column | str,
                   sep: str, out: str, block: int = BLOCK) -> DataFrame:
    """Per key, ``value`` strings joined by ``sep`` in ``order``.

    Two levels: strings are first joined inside ``(key, block)`` groups, then
    the per-block pieces are joined per key, so no task sorts more than one
    block of rows (the final string per key is the result itself)."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    blk = "_oc_blk"
    part = (df.withColumn(blk, block_of(order, block))
            .groupBy(*keys, blk)
            .agg(join_sorted(F.collect_list(F.struct(F.col(order).alias("k"), v.alias("v"))), sep).alias("_piece")))
    return part.groupBy(*keys).agg(
        join_sorted(F.collect_list(F.struct(F.col(blk).alias("k"), F.col("_piece").alias("v"))), sep).alias(out))
