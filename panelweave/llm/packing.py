"""Texts into sequences of a fixed number of tokens, by multiway differencing."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Windows filled together; a task holds the sizes of as many items at once.
BATCH_WINDOWS = 256
#: Items without any tokens, of which a window takes any number, are let go after so many items.
HELD = 500_000
#: Items are bundled, as they come, up to this share of a window, so that a batch has a bounded number of parts to place however short they are.
BUNDLE = 1 / 16

_encoders: dict = {}


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, read once per worker; in a task the file that was shipped under that name."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path if TaskContext.get() is None else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items into k parts of near-equal sums, as lists of positions.

    Every item starts as a partial partition: itself and k - 1 empty parts. The two with the greatest imbalance are merged,
    the largest part of one with the smallest of the other, until one is left. Empty parts are not stored.
    """
    heap = [(-s, i, [s], [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sa, pa_ = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        over = len(sa) + len(sb) - k
        if over <= 0:
            parts = [*zip(sa, pa_), *zip(sb, pb)]
        else:
            at = len(sa) - over  # the smallest `over` parts of a meet the smallest of b, the largest of b first to the last of a
            joined = [(sa[at + j] + sb[len(sb) - 1 - j], (pa_[at + j], pb[len(sb) - 1 - j])) for j in range(over)]
            parts = [*zip(sa[:at], pa_[:at]), *joined, *zip(sb[: len(sb) - over], pb[: len(sb) - over])]
        parts.sort(key=lambda x: -x[0])
        sums, items = [x[0] for x in parts], [x[1] for x in parts]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (low - sums[0], tie, sums, items))
        tie += 1

    def flat(x: tuple) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if isinstance(y, int):
                out.append(y)
            else:
                stack.extend(y)
        return sorted(out)

    return [flat(x) for x in heap[0][3]] if heap else []


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, none above capacity, into as few windows as differencing finds; the count rises while one is overfull."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(s * 2 > capacity for s in sizes))
    while True:
        parts = differencing(sizes, k)
        over = [x for x in (sum(sizes[i] for i in p) - capacity for p in parts) if x > 0]
        if not over:
            return parts
        k += max(1, sum(over) // capacity)


def bundles(sizes: list[int], most: int) -> list[list[int]]:
    """Neighbouring items together while they stay within `most`; positions."""
    out: list[list[int]] = []
    room = -1
    for i, s in enumerate(sizes):
        if s <= room:
            out[-1].append(i)
            room -= s
        else:
            out.append([i])
            room = most - s
    return out


def pack_texts(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """(doc_id, piece_no, token_start, n_tokens, window_id, window_offset): each text, or piece of one, and its place.

    A text longer than capacity is cut into full windows and a rest; no other is cut. Items are packed as they are read,
    in batches of about batch_windows windows, without a shuffle: what one task holds is bounded, and a batch leaves at most
    the windows that differencing had to add. Short items are bundled first (see BUNDLE) and placed as one. The tokenizer's file
    is read on the driver and shipped to the executors. window_id = (input partition, batch, window), stable when a task is repeated.

    Defined cases: a null or empty text has no tokens and takes a place of length 0; repeated rows are packed as often as
    they occur; every row comes out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        total = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, number
            whole = [x for x in held if x[3] == capacity]
            rest = [x for x in held if x[3] < capacity]
            units = bundles([x[3] for x in rest], int(capacity * BUNDLE))
            filled = fill_windows([sum(rest[i][3] for i in u) for u in units], capacity)
            windows = [[x] for x in whole] + [[rest[i] for u in p for i in units[u]] for p in filled]
            rows = []
            for n, items in enumerate(windows):
                offset = 0
                for d, piece, start, size in items:
                    rows.append((d, piece, start, size, (part << 42) | (number << 20) | n, offset))
                    offset += size
            held.clear()
            total, number = 0, number + 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "piece_no", "token_start", "n_tokens", "window_id", "window_offset"])

        for b in batches:
            kind = b.schema.field(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(enc.encode_ordinary(t)) if t else 0
                for piece in range(max(1, -(-n // capacity))):
                    size = min(capacity, n - piece * capacity)
                    held.append((d, piece, piece * capacity, size))
                    total += size
                if total >= batch_windows * capacity or len(held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    docs.sparkSession.sparkContext.addFile(tokenizer)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(pack, f"doc_id {dict(src.dtypes)['doc_id']}, piece_no long, token_start long, n_tokens long, window_id long, window_offset long")


def token_sequences(docs: DataFrame, placed: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(window_id, pieces, tokens): the sequences themselves, pieces (doc_id, piece_no, window_offset, n_tokens) in order of their places.

    docs (doc_id, text) with unique ids, placed as pack_texts gives it. A window has at most its capacity of tokens; the pieces of a
    text are found by an equality join on its id.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            made = [enc.encode_ordinary(t)[a : a + n] if t else [] for t, a, n in zip(*(b.column(i).to_pylist() for i in (5, 6, 3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "piece_no", "window_id", "n_tokens", "window_offset", "tokens"])

    both = placed.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "piece_no", "window_id", "n_tokens", "window_offset", "text", "token_start")
    kind = dict(both.dtypes)["doc_id"]
    pieces = both.mapInArrow(cut, f"doc_id {kind}, piece_no long, window_id long, n_tokens long, window_offset long, tokens array<int>")
    at = F.struct("window_offset", "doc_id", "piece_no", "n_tokens", "tokens")
    rows = pieces.groupBy("window_id").agg(F.array_sort(F.collect_list(at)).alias("p"))
    return rows.select("window_id", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece_no"].alias("piece_no"), x["window_offset"].alias("window_offset"), x["n_tokens"].alias("n_tokens"))).alias("pieces"), F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"))


def sequence_texts(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, fits): the texts read back from their sequences, by place and length only; fits says that no sequence of theirs is above capacity."""
    rows = token_sequences(docs, placed, tokenizer).select("tokens", F.explode("pieces").alias("x"))
    own = rows.select("x.doc_id", F.struct("x.piece_no", F.slice("tokens", (F.col("x.window_offset") + 1).cast("int"), F.col("x.n_tokens").cast("int")).alias("t")).alias("y"), (F.size("tokens") <= capacity).alias("ok"))
    whole = own.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("y")), lambda y: y["t"])).alias("t"), F.bool_and("ok").alias("fits"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(t) for t in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["doc_id", "text", "fits"])

    return whole.mapInArrow(read, f"doc_id {dict(whole.dtypes)['doc_id']}, text string, fits boolean")
