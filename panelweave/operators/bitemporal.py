"""What was known at a point of two-dimensional time: versions as disjoint rectangles, found through a grid.

A version of a fact is valid from one time (valid axis) and recorded at another (recorded axis). At a point (v, r) the
current version is the one of highest rank among those with valid_from <= v and recorded_from <= r. Each version is thus
current in its quadrant less the quadrants of higher-ranked ones, a staircase, which is cut into disjoint rectangles.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper edge of rectangles without one, as a day number (year 9999).
OPEN = 2_932_896
#: Side of a grid cell in days (four years).
CELL_DAYS = 1461


class Front:
    """The lower-left corner points of a union of quadrants: v rising, r falling."""

    def __init__(self) -> None:
        self.v: list[int] = []
        self.r: list[int] = []

    def uncovered(self, v: int, r: int) -> list[tuple[int, int, int, int]]:
        """The quadrant of (v, r) less the union, as rectangles (v0, v1, r0, r1), upper edges excluded."""
        i = bisect_left(self.v, v + 1)
        top = self.r[i - 1] if i else OPEN
        out, left = [], v
        while r < top:
            right = self.v[i] if i < len(self.v) else OPEN
            out.append((left, right, r, top))
            if right == OPEN:
                break
            left, top = right, self.r[i]
            i += 1
        return out

    def add(self, v: int, r: int) -> None:
        i = bisect_left(self.v, v)
        if (i and self.r[i - 1] <= r) or (i < len(self.v) and self.v[i] == v and self.r[i] <= r):
            return
        j = i
        while j < len(self.v) and self.r[j] >= r:
            j += 1
        self.v[i:j], self.r[i:j] = [v], [r]


def _rectangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by entity, block and falling rank; carried corner points come first in each block."""
    at, front = None, Front()
    for pdf in batches:
        picks, rects = [], []
        e, b, v, r, c = (pdf[n].to_numpy() for n in ("_e", "_b", "_v", "_r", "_c"))
        for k in range(len(pdf)):
            if at != (e[k], b[k]):
                at, front = (e[k], b[k]), Front()
            if not c[k]:
                found = front.uncovered(v[k], r[k])
                rects += found
                picks += [k] * len(found)
            front.add(v[k], r[k])
        edges = np.array(rects, dtype="int32").reshape(-1, 4)
        out = pdf.iloc[picks].drop(columns=["_b", "_c", "_rank"]).reset_index(drop=True)
        for n, name in enumerate(("_v0", "_v1", "_r0", "_r1")):
            out[name] = edges[:, n]
        yield out


def version_rectangles(versions: DataFrame, entity: str, valid_from: str, recorded_from: str, rank: list, payload: list[str], block_days: int = 8 * 365) -> DataFrame:
    """Disjoint rectangles (_e, payload..., _v, _r, _v0, _v1, _r0, _r1; day numbers, upper edges excluded).

    rank: sort expressions, highest-ranked version first; the first of them must be on the column rank_day, or on
    valid_from. An entity's versions are cut into blocks of that day, and each block only needs the corner points of the
    blocks above it, of which there are few: so no task holds all versions of an entity.
    """
    base = versions.select(
        F.col(f"`{entity}`").alias("_e"),
        F.unix_date(F.col(f"`{valid_from}`").cast("date")).alias("_v"),
        F.unix_date(F.col(f"`{recorded_from}`").cast("date")).alias("_r"),
        *[F.col(f"`{p}`") for p in payload],
        *[x.alias(f"_o{i}") for i, (x, _) in enumerate(rank)],
    ).where("_e is not null and _v is not null and _r is not null and _o0 is not null")
    order = [F.col(f"_o{i}").desc_nulls_last() if falling else F.col(f"_o{i}").asc_nulls_last() for i, (_, falling) in enumerate(rank)]
    base = base.withColumn("_b", F.floor(F.unix_date(F.col("_o0").cast("date")) / F.lit(block_days)).cast("int"))
    corners = base.groupBy("_e", "_b", "_v").agg(F.min("_r").alias("_r"))
    w = W.partitionBy("_e", "_b").orderBy("_v")
    corners = corners.withColumn("_m", F.min("_r").over(w.rowsBetween(W.unboundedPreceding, -1))).where("_m is null or _r < _m").drop("_m")
    names = [f"_o{i}" for i in range(len(rank))]
    empty = [F.lit(None).cast(dict(base.dtypes)[n]).alias(n) for n in [*payload, *names]]
    # an entity's blocks are few: its calendar's; corners go to those of them that lie below their own
    blocks = F.collect_set("_b").over(W.partitionBy("_e"))
    carried = corners.withColumn("_bs", blocks).select("_e", F.explode(F.filter("_bs", lambda b: b < F.col("_b"))).alias("_b"), "_v", "_r", F.lit(True).alias("_c"), *empty)
    rows = base.select("_e", "_b", "_v", "_r", F.lit(False).alias("_c"), *payload, *names).unionByName(carried)
    # the order below is total up to identical rows, of which the second has no rectangle
    rows = rows.repartition("_e", "_b").sortWithinPartitions("_e", "_b", F.col("_c").desc(), *order, "_v", "_r")
    rows = rows.select("_e", "_b", "_v", "_r", "_c", F.lit(0).alias("_rank"), *payload)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in ["_e", "_v", "_r", *payload]) + ", _v0 int, _v1 int, _r0 int, _r1 int"
    return rows.mapInPandas(_rectangles, schema)


def locate(rects: DataFrame, events: DataFrame, entity: str, valid_at: str, recorded_at: str, payload: list[str], cell_days: int = CELL_DAYS) -> DataFrame:
    """Each event row with the payload of the rectangle it lies in; events in none are dropped.

    Rectangles are filed under the grid cells they meet, of those in which there are events (their list is bounded by the
    calendar: a hundred years have 25 x 25 cells). Events look only into their own cell, by an equality join on entity
    and cell; rectangles are disjoint, so an event finds one at most.
    """
    ev = events.withColumns({"_pv": F.unix_date(F.col(f"`{valid_at}`").cast("date")), "_pr": F.unix_date(F.col(f"`{recorded_at}`").cast("date"))})
    ev = ev.where(F.col("_pv").isNotNull() & F.col("_pr").isNotNull()).withColumns({"_cv": F.floor(F.col("_pv") / cell_days).cast("int"), "_cr": F.floor(F.col("_pr") / cell_days).cast("int")})
    cells = sorted((r[0], r[1]) for r in ev.select("_cv", "_cr").distinct().collect())
    meets = lambda x: (F.col("_v0") < (x["v"] + 1) * cell_days) & (F.col("_v1") > x["v"] * cell_days) & (F.col("_r0") < (x["r"] + 1) * cell_days) & (F.col("_r1") > x["r"] * cell_days)
    grid = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r in cells]) if cells else F.array().cast("array<struct<v:int,r:int>>")
    filed = rects.withColumn("_cell", F.explode(F.filter(grid, meets))).select("_e", F.col("_cell.v").alias("_cv"), F.col("_cell.r").alias("_cr"), "_v0", "_v1", "_r0", "_r1", *[F.col(f"`{p}`").alias(f"_q_{p}") for p in payload])
    ev = ev.withColumn("_e", F.col(f"`{entity}`"))
    hit = ev.join(filed, ["_e", "_cv", "_cr"]).where("_v0 <= _pv and _pv < _v1 and _r0 <= _pr and _pr < _r1")
    return hit.select(*[F.col(f"`{c}`") for c in events.columns], *[F.col(f"_q_{p}").alias(p) for p in payload])


def known_at(events: DataFrame, versions: DataFrame, entity: str, event_time: str, valid_from: str, recorded_from: str, rank: list, payload: list[str]) -> DataFrame:
    """Each event with the version that was current and already recorded at its time.

    Defined cases: rows with a null entity or time match nothing; of identical versions one counts; an event before every
    version is dropped; no limit on age. Event columns keep their names; payload names must not be among them. The valid
    time of a version recorded before it is valid is its recorded time, so that it counts from then on.
    """
    v = versions.withColumn("_vf", F.least(F.col(f"`{valid_from}`").cast("date"), F.col(f"`{recorded_from}`").cast("date")))
    rects = version_rectangles(v, entity, "_vf", recorded_from, rank, payload)
    return locate(rects, events, entity, event_time, event_time, payload)
