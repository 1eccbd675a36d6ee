"""Pairs of records nearest in time, when exact times never coincide."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Width of a time range in tolerances: margins add 2 in this many rows.
RANGE_TOLERANCES = 64
#: Bytes of source files for each bucket of entities.
BUCKET_BYTES = 32 * 1024 * 1024


def nearest_position(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each left number the position of the nearest in the sorted right numbers, the lower of two equally near."""
    after = np.searchsorted(right, left)
    before = np.clip(after - 1, 0, len(right) - 1)
    after = np.clip(after, 0, len(right) - 1)
    return np.where(np.abs(left - right[before]) <= np.abs(right[after] - left), before, after)


def _matcher(tolerance: int):  # noqa: ANN202
    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = left.slice(0, 0).select(["_e", "_t"]).append_column("_m", pa.array([], pa.int64()))
        if not left.num_rows or not right.num_rows:
            return empty
        n = left.num_rows
        codes = pd.factorize(pd.concat([left["_e"].to_pandas(), right["_e"].to_pandas()], ignore_index=True))[0].astype("int64")
        lt, rt = left["_t"].to_numpy(), right["_t"].to_numpy()
        # times within the group's range, entities laid end to end and further apart than the tolerance
        low = min(lt.min(), rt.min())
        width = int(max(lt.max(), rt.max())) - int(low) + 2 * tolerance + 2
        if width * (int(codes.max()) + 1) < 2**62:
            lk, rk = codes[:n] * width + (lt - low), np.sort(codes[n:] * width + (rt - low))
            near = rk[nearest_position(lk, rk)] - lk
        else:  # too many for one axis: entity by entity
            near = np.full(n, tolerance + 1, dtype="int64")
            rows, order = np.argsort(codes[:n], kind="stable"), np.lexsort((rt, codes[n:]))
            lc, rc = codes[:n][rows], codes[n:][order]
            for code in np.intersect1d(lc, rc):
                own = rows[np.searchsorted(lc, code) : np.searchsorted(lc, code, "right")]
                other = rt[order[np.searchsorted(rc, code) : np.searchsorted(rc, code, "right")]]
                near[own] = other[nearest_position(lt[own], other)] - lt[own]
        ok = np.abs(near) <= tolerance
        hit = left.select(["_e", "_t"]).filter(pa.array(ok))
        return hit.append_column("_m", pa.array((lt + near)[ok]))

    return match


def _micros(df: DataFrame, c: str) -> Column:
    """A date's or timestamp's microseconds; dates are whole days in any session zone."""
    col = F.col(f"`{c}`")
    return F.unix_date(col).cast("long") * DAY if dict(df.dtypes)[c] == "date" else F.unix_micros(col.cast("timestamp"))


def _back(df: DataFrame, c: str, micros: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.date_from_unix_date(F.floor(F.col(micros) / DAY).cast("int")) if kind == "date" else F.timestamp_micros(micros).cast(kind)


def source_bytes(df: DataFrame) -> int:
    """Size of the files that df reads, by the statistics of its plan; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(min(int(str(leaves.apply(i).stats().sizeInBytes())), 2**60) for i in range(leaves.size()))


def nearest_times(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance: dt.timedelta, range_tolerances: int = RANGE_TOLERANCES, buckets: int | None = None) -> DataFrame:
    """(entity, left_time, right_time): for each distinct (entity, time) of left the nearest time of the same entity in right.

    Times are dates or timestamps, compared by the microsecond. Both tables are reduced, map-side, to distinct (entity,
    time), then co-grouped by a bucket of entities and a time range of range_tolerances x tolerance, which bounds what a hot entity
    brings to a task; right rows near a border also go to the range beyond it, by the tolerance. In a group a binary search
    over all its entities at once compares each left time with its two neighbours. The buckets grow with the files read.

    Defined cases: null entities or times match nothing; at most `tolerance` apart, on either side; the same time counts; of two
    equally near the earlier; left rows without a match are dropped; other columns, whatever their names, are left out.
    """
    reach = int(tolerance / dt.timedelta(microseconds=1))
    width = max(reach, 1) * range_tolerances
    if buckets is None:
        buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), (source_bytes(left) + source_bytes(right)) // BUCKET_BYTES)
    one = lambda df, c: df.select(F.col(f"`{entity}`").alias("_e"), _micros(df, c).alias("_t")).where("_e is not null and _t is not null").distinct()
    bucket = F.pmod(F.xxhash64("_e"), F.lit(buckets)).alias("_g")
    rng = lambda x: F.floor(x / F.lit(width)).cast("long")
    lt = one(left, left_time).select("_e", "_t", bucket, rng(F.col("_t")).alias("_r"))
    rt = one(right, right_time).select("_e", "_t", bucket, F.explode(F.sequence(rng(F.col("_t") - reach), rng(F.col("_t") + reach))).alias("_r"))
    kind = dict(lt.dtypes)["_e"]
    hit = lt.groupBy("_g", "_r").cogroup(rt.groupBy("_g", "_r")).applyInArrow(_matcher(reach), f"_e {kind}, _t long, _m long")
    return hit.select(F.col("_e").alias(entity), _back(left, left_time, "_t").alias(left_time), _back(right, right_time, "_m").alias(right_time))


def nearest_in_series(left: DataFrame, series: DataFrame, left_day: str, right_day: str, tolerance: dt.timedelta) -> DataFrame:
    """All rows of left that have a day of the (single) series near enough, with that day; both columns are dates.

    Distinct days are matched and joined back; the joined side has one row per calendar day at most, so it may be
    broadcast whatever the size of left.
    """
    one = nearest_times(left.select(F.lit(0).alias("_s"), left_day), series.select(F.lit(0).alias("_s"), right_day), "_s", left_day, right_day, tolerance, buckets=1)
    return left.join(F.broadcast(one.drop("_s")), left_day)
