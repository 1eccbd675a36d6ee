"""Percentiles of very large columns from mergeable centroid digests, certified by a counting pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.nearest import source_bytes
from panelweave.session import stored

#: Clusters per digest at most; at the median a cluster holds pi / (2 * SIZE) of the values, towards the ends ever less.
SIZE = 500
#: Share of ranks by which a percentile may be off, besides half a rank.
RANK_ERROR = 0.01
FLUSH_ROWS = 1_000_000
#: Bytes of source files that make about one digest a group.
PIECE_BYTES = 128 * 1024 * 1024
#: Groups whose estimates are broadcast to where the values are read; of more groups, the values are shuffled to them.
BROADCAST_GROUPS = 100_000
#: Values of one group that a task counts in the second way; a larger group is spread over more tasks.
SALT_ROWS = 4_000_000


def compress(codes: np.ndarray, means: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids (code, mean, weight), sorted, of sorted values clustered under a quantile-dependent size.

    A value's cluster is the whole part of size * (arcsin(2q - 1) / pi + 1/2), q being the middle of its weight among its
    group's. All groups are clustered at once. Centroids go in as values do, so merging is the same operation.
    """
    order = np.lexsort((means, codes))
    c, m, w = codes[order], means[order], weights[order]
    first = np.r_[True, c[1:] != c[:-1]]
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    cum = np.cumsum(w)
    base = np.r_[0.0, cum[start[1:] - 1]] if len(start) else np.array([])
    total = np.add.reduceat(w, start)
    q = (cum - w / 2 - base[group]) / total[group]
    k = np.floor(size * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5))
    edge = np.flatnonzero(first | np.r_[True, k[1:] != k[:-1]])
    weight = np.add.reduceat(w, edge)
    mean = np.add.reduceat(m * (w / np.repeat(weight, np.diff(np.r_[edge, len(w)]))), edge)
    return c[edge], mean, weight


def _packed(keys: pd.DataFrame, codes: np.ndarray, means: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    out = keys.iloc[codes[start]].reset_index(drop=True)
    out["_means"], out["_weights"] = np.split(means, start[1:]), np.split(weights, start[1:])
    return out


def _grouped(pdf: pd.DataFrame, by: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    codes = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    first = np.unique(codes, return_index=True)[1]
    return pdf[by].iloc[first], codes


def partial_digests(df: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One digest (by..., _means, _weights) per group and scanned piece; no shuffle. Null, NaN and infinite values are left out."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*by, v.alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    kinds = dict(rows.dtypes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pdf = pa.Table.from_batches(held).to_pandas()
                held.clear()
                keys, codes = _grouped(pdf, by)
                made = compress(codes, pdf["_v"].to_numpy(), np.ones(len(pdf)), size)
                yield from _to_arrow(_packed(keys, *made), by, kinds)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= FLUSH_ROWS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(digest, _schema(by, kinds))


def _schema(by: list[str], kinds: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", _means array<double>, _weights array<double>"


def _to_arrow(pdf: pd.DataFrame, by: list[str], kinds: dict[str, str]) -> Iterator[pa.RecordBatch]:
    of = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [pa.field(c, of[kinds[c]]) for c in by] + [pa.field(c, pa.list_(pa.float64())) for c in ("_means", "_weights")]
    yield from pa.Table.from_pandas(pdf, pa.schema(fields), preserve_index=False).to_batches(max_chunksize=2000)


def _merged(df: DataFrame, by: list[str], spread: list, size: int) -> DataFrame:
    kinds = dict(df.dtypes)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, codes = _grouped(pdf, by)
        n = pdf["_means"].map(len).to_numpy()
        made = compress(np.repeat(codes, n), np.concatenate(pdf["_means"].to_numpy()), np.concatenate(pdf["_weights"].to_numpy()), size)
        return _packed(keys, *made)

    return df.withColumns({f"_s{i}": c for i, c in enumerate(spread)}).groupBy(*[f"_s{i}" for i in range(len(spread))]).applyInPandas(lambda pdf: merge(pdf.drop(columns=[c for c in pdf if c.startswith("_s")])), _schema(by, kinds))


def merge_digests(digests: DataFrame, by: list[str], size: int = SIZE, fan: int | None = None) -> DataFrame:
    """One digest per group, from any number of digests of separate pieces, days or files.

    In two steps, so that a group of which there are very many digests is not merged by one task: first `fan` ways by
    where the digests come from, then those results. Without `fan` it is the root of the number of pieces that the source files
    make, so that both steps grow alike: a million pieces are merged a thousand at a time.
    """
    fan = max(16, int((source_bytes(digests) / PIECE_BYTES) ** 0.5)) if fan is None else fan
    buckets = max(1, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    own = F.pmod(F.xxhash64(*by), F.lit(buckets))
    some = _merged(digests.select(*by, "_means", "_weights"), by, [own, F.pmod(F.spark_partition_id(), F.lit(fan))], size)
    return _merged(some, by, [own], size)


def estimates(digests: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """(by..., n_values, estimates): the values at the given shares, interpolated between centroids."""
    kinds = dict(digests.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ns, es = [], []
            for m, w in zip(pdf["_means"], pdf["_weights"]):
                middle = np.cumsum(w) - np.asarray(w) / 2
                ns.append(int(round(np.sum(w))))
                es.append(np.interp(np.array(probs) * np.sum(w), middle, m))
            yield pdf[by].assign(n_values=ns, estimates=es)

    return digests.mapInPandas(read, f"{head}, n_values bigint, estimates array<double>")


def certified_percentiles(df: DataFrame, coarse: list[str], fine: list[str], value: str, probs: list[float], size: int = SIZE) -> DataFrame:
    """Percentiles of value per (coarse, fine) group and, merged from those digests, per coarse group, with their certificate.

    Digests travel, values don't: the second pass broadcasts the estimates, if there are not too many groups, counts in the
    tasks that read the values, and shuffles counts. The digests are stored, so nothing is digested twice.

    Columns: coarse..., fine... (null for the coarse groups), is_coarse, q, n_values, estimate, rank_error, error_bound,
    certified. A second pass over all values counts those below and not above each estimate; rank_error is how far q * n
    lies outside these two counts, as a share of n, and certified says that it is within RANK_ERROR + 0.5 / n.

    Defined cases: null keys form groups of their own; null, NaN and infinite values are left out; groups without values
    have no row; ties count as one stretch of ranks.
    """
    by = [*coarse, *fine]
    digests = stored(merge_digests(partial_digests(df, by, value, size), by, size))
    low = estimates(digests, by, probs)
    high = estimates(merge_digests(digests.select(*coarse, "_means", "_weights"), coarse, size), coarse, probs)
    same = lambda a, b, on: a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    both = same(low.alias("a"), high.select(*coarse, F.col("estimates").alias("_high"), F.col("n_values").alias("_hn")).alias("b"), coarse).select(*[F.col(f"a.{c}") for c in by], F.col("estimates").alias("_low"), F.col("n_values").alias("_ln"), "_high", "_hn")
    both = stored(both)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*by, v.alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    groups, most = both.agg(F.count(F.lit(1)), F.max("_ln")).first()
    if groups <= BROADCAST_GROUPS:
        near = same(rows.alias("a"), F.broadcast(both).alias("b"), by)
    else:
        # both sides salted by the input partition, which stays the same when a task is repeated
        salts = -(-most // SALT_ROWS)
        salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
        copies = both.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        near = same(salted.alias("a"), copies.alias("b"), [*by, "_salt"])
    at = range(len(probs))
    count = lambda e, op, i: F.sum((F.col("_v") < F.col(e)[i] if op == "l" else F.col("_v") <= F.col(e)[i]).cast("long")).alias(f"{e}{op}{i}")
    counted = near.groupBy(*[F.col(f"b.{c}").alias(c) for c in by]).agg(*[count(e, op, i) for e in ("_low", "_high") for op in "le" for i in at], *[F.first(c).alias(c) for c in ("_low", "_ln", "_high", "_hn")])
    line = lambda e, n: F.explode(F.array(*[F.struct(F.lit(probs[i]).alias("q"), F.col(e)[i].alias("estimate"), F.col(f"{e}l{i}").alias("l"), F.col(f"{e}e{i}").alias("e"), F.col(n).alias("n")) for i in at])).alias("x")
    fine_rows = counted.select(*by, F.lit(False).alias("is_coarse"), line("_low", "_ln"))
    top = counted.groupBy(*coarse).agg(*[F.sum(f"_high{op}{i}").alias(f"_high{op}{i}") for op in "le" for i in at], F.first("_high").alias("_high"), F.first("_hn").alias("_hn"))
    top_rows = top.select(*coarse, *[F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in fine], F.lit(True).alias("is_coarse"), line("_high", "_hn"))
    out = fine_rows.unionByName(top_rows)
    rank = F.col("x.q") * F.col("x.n")
    err = F.greatest(F.lit(0.0), F.col("x.l") - rank, rank - F.col("x.e")) / F.col("x.n")
    bound = F.lit(RANK_ERROR) + 0.5 / F.col("x.n")
    return out.select(*by, "is_coarse", "x.q", F.col("x.n").alias("n_values"), "x.estimate", err.alias("rank_error"), bound.alias("error_bound"), (err <= bound).alias("certified"))
