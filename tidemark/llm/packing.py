"""Packing by minimum bin slack (operator 9).

A document is cut at multiples of the window; full windows are sequences already. What remains of each document is shorter than a
window, so the whole corpus has at most `window - 1` different remaining lengths, however large it is. The plan works on their
counts: for each window the longest remaining length is set, and a bitset subset-sum over the other lengths (bit s: sum s can be
reached) finds the sum closest to the capacity; backtracking through the bitsets gives how many pieces of each length it takes. The
multiset is used as often as the counts allow before the next one is sought, so the plan's size depends on the window alone. Pieces
are then numbered within their length (in salted parts with prefix sums, so a length that a third of all pieces share is split) and
meet their window by an equi-join on the length.

Rows: a null text is an empty one; every document has its end id, so an empty one is a piece of length 1. Equal documents and equal
ids keep all their pieces. An empty table gives no pieces. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import salt, written
from tidemark.llm.tokens import slices

WINDOW = 1024
SALTS = 64
SLOTS = "length int, rank_from long, rank_to long, need int, first_sequence long, first_offset int"


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (how many of each, within the counts) whose sum is closest to the capacity from below."""
    steps, reach, full = [], 1, (1 << capacity + 1) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left = min(counts[length], capacity // length)
        part = 1
        while left and not reach >> capacity:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            left -= take
            part *= 2
    at, chosen = reach.bit_length() - 1, {}
    for length, take, was in reversed(steps):
        if not was >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of SLOTS: of the pieces of a length, ranks [from, to) go to windows, `need` in each, from a sequence and an offset on."""
    left = {k: v for k, v in counts.items() if v > 0}
    used, slots, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = best_filling({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            slots.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return slots


def cut(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, and the ids (u32 bytes) where they are asked for."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in slices(batches):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                data, n = ids.tobytes(), len(ids)
                for at in range(0, n, window):
                    piece = data[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, piece)[: 5 + keep_ids])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")[: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to every piece (length in 1..window). The pieces are read twice: give a written table."""
    spark = pieces.sparkSession
    part = salt(F.concat_ws(":", "doc_id", "start", "ids_crc32"), SALTS)
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window).withColumn("part", part)
    sizes = rest.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # window - 1 rows at most
    slots = spark.createDataFrame(plan(counts, window), SLOTS)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = rest.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("own") + F.col("base"))
    placed = ranked.join(slots, "length").filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    placed = placed.withColumn("sequence_id", (F.col("first_sequence") + F.floor(nth / F.col("need"))) * 2).withColumn("offset", (F.col("first_offset") + F.pmod(nth, F.col("need")) * F.col("length")).cast("long"))
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset").unionByName(alone)


def pack_documents(docs: DataFrame, encoder: Callable, window: int = WINDOW) -> DataFrame:
    """Even sequence ids hold packed remainders, odd ones a full window of one document."""
    packed = pack(written(cut(docs, encoder, window), "pieces"), window)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
