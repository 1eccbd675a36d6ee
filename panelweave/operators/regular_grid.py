"""Irregular readings onto a regular grid of cells: everything here is read off a cumulative counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _known(source: list[str]) -> Column:
    ok = F.lit(True)
    for s in source:
        ok &= F.col(f"`{s}`").isNotNull()
    return ok


def counter_grid(readings: DataFrame, source: list[str], time: str, counter: str, cells: int, width: int, start: float | None = None, reach: float | None = None) -> DataFrame:
    """Increments of a cumulative counter per cell: (source..., slot_no, increment, covered, last_time), all cells of each source.

    Consecutive readings are differenced; a reading below the one before it means that the counter was reset, and it counts
    from zero. An increment belongs to the time since the reading before, or at most to the last `reach` of it, and is spread
    over the cells in proportion to the overlap. Time that no increment belongs to is uncovered: before the first reading
    (unless the counter is known to be zero at `start`), after the last, and in a gap what lies further back than `reach`.
    covered is the covered share of the cell; a cell with none has covered 0 and a null increment. last_time is the time of the
    last reading, or start, at or before the cell's beginning.

    Repeated readings shrink on the map side to one per source and time, so a source brings its distinct times to a task.

    Defined cases: rows with a null source, time or counter, or NaN, are ignored; of several at the same time the greatest
    counts; a reading at or before start only says where the counter stood; time outside the grid is cut off; an empty
    table gives an empty grid.
    """
    t, c = F.col(f"`{time}`").cast("double"), F.col(f"`{counter}`").cast("double")
    ok = _known(source) & t.isNotNull() & ~F.isnan(t) & c.isNotNull() & ~F.isnan(c)
    return _cells(readings.where(ok).groupBy(*source, t.alias("_t")).agg(F.max(c).alias("_c")), source, cells, width, start, reach)


def _cells(one: DataFrame, source: list[str], cells: int, width: int, start: float | None, reach: float | None) -> DataFrame:
    """counter_grid of readings (source..., _t, _c) that have one row per source and time."""
    w = W.partitionBy(*source).orderBy("_t")
    first = F.lit(None if start is None else float(start)).cast("double")
    d = one.select(*source, F.coalesce(F.lag("_t").over(w), first).alias("_a"), "_t", F.coalesce(F.lag("_c").over(w), F.when(first.isNotNull(), 0.0)).alias("_p"), "_c", F.lead("_t").over(w).alias("_n"))
    gain = F.when(F.col("_c") < F.col("_p"), F.col("_c")).otherwise(F.col("_c") - F.col("_p"))
    step = lambda a, z, x: F.struct(a.alias("a"), z.alias("z"), x.alias("x"))
    own = step(F.col("_a"), F.col("_t"), gain)
    rest = F.when(F.col("_n").isNull(), step(F.col("_t"), F.lit(float(cells * width)), F.lit(None).cast("double")))
    d = d.select(*source, F.explode(F.array_compact(F.array(own, rest))).alias("_g")).select(*source, "_g.*")
    lo = F.greatest(F.floor(F.coalesce("a", F.lit(0.0)) / width), F.lit(0)).cast("int")
    hi = F.least(F.ceil(F.col("z") / width) - 1, F.lit(cells - 1)).cast("int")
    d = d.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_s", F.explode(F.sequence("_lo", "_hi")))
    begin = F.col("a") if reach is None else F.greatest(F.col("a"), F.col("z") - F.lit(float(reach)))
    begin = F.when(F.col("x").isNotNull(), begin)
    over = F.greatest(F.least(F.col("z"), (F.col("_s") + 1) * F.lit(float(width))) - F.greatest(begin, F.col("_s") * F.lit(float(width))), F.lit(0.0))
    over = F.when(begin.isNotNull(), over).otherwise(0.0)
    d = d.select(*source, "_s", over.alias("_o"), F.when(over > 0, F.col("x") * over / (F.col("z") - begin)).alias("_x"), F.when(F.col("a") <= F.col("_s") * width, F.col("a")).alias("_l"))
    out = d.groupBy(*source, "_s").agg(F.sum("_x").alias("increment"), (F.sum("_o") / width).alias("covered"), F.max("_l").alias("last_time"))
    return out.select(*source, F.col("_s").alias("slot_no"), "increment", "covered", "last_time")


def _ordinals(readings: DataFrame, source: list[str], time: str, *more: Column) -> DataFrame:
    """Distinct reading times of each source with their number: the counter _c, read at _t, when the unit of time that a reading stands for is over."""
    end = (F.col(f"`{time}`") + 1).cast("double").alias("_t")
    one = readings.groupBy(*source, end).agg(*more) if more else readings.select(*source, end).distinct()
    return one.withColumn("_c", F.row_number().over(W.partitionBy(*source).orderBy("_t")).cast("double"))


def reading_gaps(readings: DataFrame, source: list[str], time: str, cells: int, width: int, also_occupied: Column | None = None) -> DataFrame:
    """The cells that no reading reaches: (source..., slot_no, from_minute), from_minute being the last reading before, or -1.

    The number of readings so far is a counter that rises by one in each unit of time with a reading. On its grid the cells
    with nothing covered are those without a reading, and the last reading before is the counter's.

    also_occupied: a predicate on rows that fill the last cell without being readings (a closing auction).
    Defined cases: rows with a null source or time are no readings; a source without a reading has no cells.
    """
    is_reading = F.coalesce(F.col(f"`{time}`").between(0, cells * width - 1), F.lit(False))
    known = readings.where(_known(source))
    grid = _cells(_ordinals(known.where(is_reading), source, time), source, cells, width, start=0, reach=1)
    empty = grid.where("covered = 0")
    if also_occupied is not None:
        filled = known.where(F.coalesce(also_occupied, F.lit(False)) & ~is_reading).select(*source).distinct().withColumn("slot_no", F.lit(cells - 1))
        empty = empty.join(filled, [*source, "slot_no"], "left_anti")
    return empty.select(*source, "slot_no", (F.col("last_time") - 1).cast("int").alias("from_minute"))


def gauge_grid(readings: DataFrame, source: list[str], time: str, cells: int, width: int, first: str, last: str, order: str, closing: tuple[str, int] | None = None) -> DataFrame:
    """The full row of cells per source: (source..., slot_no, price, state, from_minute).

    The number of readings so far is laid onto the grid as a counter; its sum up to a cell is the number of the reading that
    holds there. price is the `last` of that reading: of one in the cell ('observed') or before it ('filled', nothing of the
    cell covered); before the first reading there is only `first` of that reading, marked 'leading'. `order` decides between
    repeated readings of one time: the greatest counts (nulls lowest), then the greatest price.
    closing: (column, time): that column's value at that time replaces the last cell's price ('auction').

    Defined cases: readings without a positive `last` are none; a source without a reading has no cells.
    """
    ok = lambda c: F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) & (F.col(f"`{c}`") > 0)
    t = F.col(f"`{time}`")
    usable = F.coalesce(t.between(0, cells * width - 1) & ok(last), F.lit(False))
    known = readings.where(_known(source))
    latest = lambda c: F.struct(F.col(f"`{order}`").alias("o"), F.col(f"`{c}`").alias("p"))
    opens = F.struct(F.col(f"`{order}`").alias("o"), F.when(ok(first), F.col(f"`{first}`")).alias("p"))
    one = _ordinals(known.where(usable), source, time, F.max(latest(last)).getField("p").alias("_p"), F.max(opens).getField("p").alias("_f"))
    # at most one price per unit of time
    row = one.groupBy(*source).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_p"))), lambda x: x["_p"]).alias("_ps"), F.min_by("_f", "_c").alias("_f"))
    grid = _cells(one, source, cells, width, start=0, reach=1).join(row, source)
    held = F.round(F.sum(F.coalesce("increment", F.lit(0.0))).over(W.partitionBy(*source).orderBy("slot_no").rowsBetween(W.unboundedPreceding, 0))).cast("int")
    grid = grid.withColumn("_h", held)
    closed = F.lit(False)
    if closing is not None:
        auction = known.where(F.coalesce((t == closing[1]) & ok(closing[0]), F.lit(False))).groupBy(*source).agg(F.max(latest(closing[0])).getField("p").alias("_auction"))
        grid = grid.join(auction, source, "left")
        closed = (F.col("slot_no") == cells - 1) & F.col("_auction").isNotNull()
    price = F.when(F.col("_h") > 0, F.try_element_at("_ps", F.col("_h"))).otherwise(F.col("_f"))
    state = F.when(F.col("covered") > 0, "observed").when(F.col("_h") > 0, "filled").otherwise("leading")
    if closing is not None:
        price, state = F.when(closed, F.col("_auction")).otherwise(price), F.when(closed, "auction").otherwise(state)
    return grid.select(*source, "slot_no", price.alias("price"), state.alias("state"), (F.col("last_time") - 1).cast("int").alias("from_minute"))
