"""Mixing sources to target weights by entropy balancing.

DataFrame functions alone. Every document gets a rate r, the number of times
the mix takes it, such that the tokens of each source meet its target:
minimise sum(r ln r - r) subject to sum(r * size) = target for each source and
r <= ``most``. Among all such rates these stay nearest to one for every
document; of a source that is to shrink, the mix gives up long documents
first and so keeps as many documents as it can. The dual is convex, with one
multiplier a source, and its solution tilts the rates exponentially:
r = min(most, exp(multiplier * size / mean size)).

* Targets: the sources share the tokens by weight; a source stops at ``most``
  times its own tokens and the excess is shared again by weight among the
  others, until none is above. Whole-number arithmetic decides who is full.
* Newton: documents of one source and size have one rate, so the iterations
  read a table of (source, size, number of documents), not the documents. One
  iteration is a join of that table with the multipliers and an aggregate by
  source; all sources move at once, each inside a bracket that halves where a
  step would leave it. Terms are summed as decimals, so that the order of the
  rows does not matter and reruns agree to the last bit.
* Copies: the rates are rounded along the sizes of a source by running sums,
  which keeps the error of any source under its longest document; where that
  is over ``tolerance`` of the target, copies of the longest document that still
  fits are added or taken away until nothing fits, none beyond one copy from its
  rate on average of its size. The copies of one (source, size) are dealt to blocks of documents by hash, then inside of each block.
  A hot source, size or row is spread over blocks and counted before a shuffle.

Defined results: a null size counts as 0; a document of size 0 takes 0; rows
that are alike in all columns (which must be comparable) are counted as one
group and each returned; a null source is a source; a source without weight
gets target 0; a table without tokens has targets of 0; an empty table gives no
rows; columns of the input that are named like the new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running_sum
from .common import Workspace, saved

MOST = 3
#: Error of a source's tokens, as a share of its target, that whole copies may leave where they can be changed.
TOLERANCE = 0.001
#: Documents of one source and size are dealt to so many blocks.
BLOCKS = 4096
KEY = ["_none", "_source"]
MADE = ("source_size", "target", "rate", "copies", "taken")
EXACT = "decimal(38,0)"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("_none", F.col(source).isNull()).withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))


def cyclic_weights(docs: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """(source, weight): weights 1 .. ``cycle`` in turn over the sources in
    order of code points, null last. The order is made by ranges, so that no
    task sees all sources."""
    with Workspace(docs.sparkSession, "weights") as ws:
        each = ws.saved(_keyed(docs.select(source).distinct(), source), "sources")
        placed = ws.saved(each.repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id()), "ranges")
        sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
        rank = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY)) - 1 + F.col("_ahead")
        return saved(placed.join(sizes, "_part").select(source, (1 + rank % cycle).cast("long").alias("weight")), "weights")


def source_targets(ws: Workspace, sources: DataFrame, most: int) -> DataFrame:
    """``sources(_none, _source, total, weight, ...)`` with ``full`` and ``target``."""
    state = ws.saved(sources.withColumn("full", F.col("weight") == 0), "shares")
    exact = lambda c: F.col(c).cast(EXACT)
    words = state.agg(F.sum(exact("total"))).first()[0]
    while True:
        free = state.where("not full").agg(F.sum(exact("weight"))).first()[0]
        spent = state.where("full and weight > 0").agg(F.sum(exact("total"))).first()[0]
        left = (words or 0) - most * (spent or 0)
        above = (F.col("weight").cast(EXACT) * F.lit(left).cast(EXACT) > exact("total") * F.lit(most * (free or 0)).cast(EXACT))
        more = ws.saved(state.withColumn("full", F.col("full") | (F.lit(bool(free)) & above)), "shares")
        if more.where("full").count() == state.where("full").count():
            break
        state = more
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(free or 1))
    target = F.when(F.col("weight") == 0, 0.0).when(F.col("full"), most * F.col("total").cast("double")).otherwise(share)
    return ws.saved(state.withColumn("target", target), "targets")


def _multipliers(ws: Workspace, sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with ``multiplier``; null where the rates are all 0 or all ``most``."""
    total = F.col("total").cast("double")
    least = F.col("least") * F.col("docs") / total  # shortest document of a size, in mean sizes
    shrinks = F.col("target") < total
    state = targets.where("not full and target > 0").select(
        *KEY, "total", "docs", "target", F.lit(0.0).alias("multiplier"),
        (F.when(shrinks, F.ln(F.col("target") / total) / least).otherwise(0.0) - 1).alias("low"),
        (F.when(shrinks, 0.0).otherwise(F.ln(F.lit(float(most))) / least) + 1).alias("high"))
    state, ended = ws.saved(state, "multipliers"), []
    at = F.col("_size") * F.col("docs") / F.col("total").cast("double")
    rate = F.least(F.lit(float(most)), F.exp(F.col("multiplier") * at))
    tokens = F.col("n") * F.col("_size") * rate
    decimal = lambda x: F.sum(x.cast("decimal(28,6)")).cast("double")
    while not state.isEmpty():
        told = sizes.join(state, KEY).groupBy(*state.columns).agg(
            decimal(tokens).alias("f"), decimal(F.when(rate < most, tokens * at).otherwise(0.0)).alias("slope"))
        low, high = F.when(F.expr("f < target"), F.col("multiplier")).otherwise(F.col("low")), F.when(F.expr("f < target"), F.col("high")).otherwise(F.col("multiplier"))
        step = F.when(F.expr("f > 0 and slope > 0"), F.expr("multiplier - (ln(f) - ln(target)) * f / slope"))
        told = told.withColumn("low", low).withColumn("high", high).withColumn("step", step)
        near = F.expr("abs(f - target) <= 1e-8 * target + 1e-6 or high - low <= 1e-13 * greatest(1, abs(multiplier))")
        step = F.when(F.expr("step > low and step < high"), F.col("step")).otherwise(F.expr("(low + high) / 2"))
        told = ws.saved(told.withColumn("near", near).withColumn("multiplier", F.when(F.col("near"), F.col("multiplier")).otherwise(step)), "newton")
        ended.append(told.where("near").select(*KEY, "multiplier"))
        state = told.where("not near").select(*state.columns)
    if not ended:
        return targets.withColumn("multiplier", F.lit(None).cast("double"))
    return targets.join(reduce(DataFrame.union, ended), KEY, "left")


def _corrections(ws: Workspace, plan: DataFrame, most: int, tolerance: float) -> list[DataFrame]:
    """Changes (key, _size, change) that bring the tokens of a source nearer to its target."""
    off = plan.groupBy(*KEY).agg((F.round(F.first("target")).cast(EXACT) - F.sum(F.col("k").cast(EXACT) * F.col("_size"))).alias("off"),
                                 F.first("target").alias("target"))
    left = ws.saved(off.where(F.abs("off") > tolerance * F.col("target")).select(*KEY, "off", F.lit(2**62).alias("under")), "off")
    steps = []
    while not left.isEmpty():
        up, down = F.least(F.col("n") * most, F.floor(F.col("n") * (F.col("rate") + 1))), F.greatest(F.lit(0), F.ceil(F.col("n") * (F.col("rate") - 1)))
        room = F.when(F.col("off") > 0, up - F.col("k")).otherwise(F.col("k") - down)
        fits = plan.join(left, KEY).withColumn("room", room).where("_size > 0 and _size < under and _size <= abs(off) and room > 0")
        best = fits.groupBy(*KEY, "off").agg(F.max(F.struct("_size", "room")).alias("b"))
        change = (F.least(F.expr("abs(off) div b._size"), F.col("b.room")) * F.signum("off")).cast("long")
        step = ws.saved(best.select(*KEY, "off", F.col("b._size").alias("_size"), change.alias("change")), "step")
        steps.append(step.select(*KEY, "_size", "change"))
        left = ws.saved(step.select(*KEY, (F.col("off") - F.col("change") * F.col("_size")).cast(EXACT).alias("off"),
                                    F.col("_size").cast("long").alias("under")).where("off <> 0"), "off")
    return steps


def entropy_mix(docs: DataFrame, weights: DataFrame, size: str = "size", source: str = "source",
                most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (both of the source, in
    tokens), ``rate``, ``copies`` (how often the mix takes the row, 0 ..
    ``most``) and ``taken`` (its tokens, copies counted). ``weights(source,
    weight)``: whole numbers. Select the columns that are needed before: all
    of them are shuffled."""
    shown = [c for c in docs.columns if c not in MADE]
    with Workspace(docs.sparkSession, "mix") as ws:
        units = docs.select(*shown).groupBy(*shown).agg(F.count("*").alias("_m"))
        tokens = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
        units = _keyed(units.withColumn("_size", tokens), source).withColumn("_block", F.pmod(F.xxhash64(*shown), F.lit(BLOCKS)).cast("int"))
        units = ws.saved(units, "units")
        sizes = ws.saved(units.groupBy(*KEY, "_size").agg(F.sum("_m").alias("n")), "sizes")
        sources = sizes.groupBy(*KEY).agg(F.sum(F.col("n").cast(EXACT) * F.col("_size")).cast("long").alias("total"), F.sum("n").alias("docs"),
                                          F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("least"))
        weighed = _keyed(weights.select(F.col(source), F.col("weight").cast("long")), source).drop(source)
        sources = sources.join(weighed, KEY, "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
        solved = ws.saved(_multipliers(ws, sizes, source_targets(ws, sources, most), most), "solved")

        at = F.col("_size") * F.col("docs") / F.col("total").cast("double")
        rate = (F.when(F.col("target") <= 0, 0.0).when(F.col("full"), float(most))
                .otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * at))))
        rated = sizes.join(solved, KEY).withColumn("rate", rate)
        rated = ws.saved(rated.withColumn("part", (F.col("n") * F.col("rate")).cast("decimal(28,9)")), "rates")
        # copies of all documents of a size: the running sum of n * rate, rounded
        ran = running_sum(rated, KEY, "_size", "part", "_to")
        copies = F.floor(F.col("_to") + F.lit(0.5).cast("decimal(2,1)")) - F.floor(F.col("_to") - F.col("part") + F.lit(0.5).cast("decimal(2,1)"))
        plan = ws.saved(ran.select(*KEY, "_size", "n", "total", "target", "rate", copies.cast("long").alias("k")), "plan")
        steps = _corrections(ws, plan, most, tolerance)
        if steps:
            change = reduce(DataFrame.union, steps).groupBy(*KEY, "_size").agg(F.sum("change").alias("change"))
            plan = plan.join(change, [*KEY, "_size"], "left").withColumn("k", F.col("k") + F.coalesce("change", F.lit(0))).drop("change")

        # deal the copies beyond the same for all: to blocks, then inside of a block
        group = [*KEY, "_size"]
        blocks = units.groupBy(*group, "_block").agg(F.sum("_m").alias("_in")).join(
            plan.withColumn("_each", F.expr("k div n")).withColumn("_extra", F.expr("k % n")), group)
        upto = F.sum("_in").over(Window.partitionBy(*group).orderBy("_block")).cast(EXACT)
        dealt = blocks.withColumn("_upto", upto).withColumn("_more", F.expr(
            f"cast(_extra as {EXACT}) * _upto div n - cast(_extra as {EXACT}) * (_upto - _in) div n"))
        dealt = dealt.select(*group, "_block", F.col("total").alias("source_size"), "target", "rate", "_each", "_more")
        place = Window.partitionBy(*group, "_block").orderBy(F.xxhash64(F.lit("place"), *shown), *shown).rowsBetween(Window.unboundedPreceding, -1)
        placed = (units.join(dealt, [*group, "_block"]).withColumn("_ahead", F.coalesce(F.sum("_m").over(place), F.lit(0)))
                  .withColumn("_up", F.expr("least(greatest(_more - _ahead, 0), _m)")))
        # one row for each of the alike rows, in two steps lest an array grow with their number
        rows = placed.withColumn("_hi", F.explode(F.expr("sequence(0L, (_m - 1) div 65536)")))
        rows = rows.withColumn("_nth", F.explode(F.expr("sequence(_hi * 65536, least(_m, (_hi + 1) * 65536) - 1)")))
        copies = (F.col("_each") + F.when(F.col("_nth") < F.col("_up"), 1).otherwise(0)).cast("long")
        return saved(rows.select(*shown, "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("_size")).alias("taken")), "mix")
