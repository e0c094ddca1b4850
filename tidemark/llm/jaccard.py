"""N-gram Jaccard join by set relations (operator 10): classes, links and components of documents with similar shingle sets.

1. Equal sets are one class (128-bit digest of the sorted shingle digests); from here on a class counts once.
2. Answers of similar sets are derived, not computed again: minima of the set under a few mixings bring highly similar sets to a
   common leader, drawn afresh for each mixing. A set is compared with its most alike leader, then with leaders of other components only. One that links to a leader shares the
   leader's component, so none of its links inside that component has to be found; what is left to find are links that leave it.
3. Those are found exactly. Tokens are ordered by how many documents hold them (a sketch of fixed size, filled from all documents;
   any order is right, a good one is fast), and two sets that link share a token among the first `n - ceil(t n) + 1` of each. The
   index list of a token holds one block per component: smallest and largest size, earliest position. Blocks of one component are
   never paired, and a pair of blocks is skipped when the sizes cannot link or the positions leave too few tokens behind the
   shared one. Blocks with several sets are opened for the pairs that remain, and sizes, positions and parity bits of the whole
   sets are tested per pair of sets.
4. Candidates are verified on whole sets; components come from label propagation with pointer jumping over the links.

No pair is made inside a component once it is known, no list is held by one task (lists are joined on the token, and Spark can
split that join), and no cap stands on any list.

Rows: a text that is null or has no word has no set, links with nothing and is its own component; a text with fewer than `k` words
has its whole sequence as its one shingle. Repeated rows are one class; rows with equal ids and different texts are separate
documents. A null id has a set and links, and its component is named by the smallest id that is not null (null if there is none).
Extra columns are left out.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import TIDY, settings, written
from tidemark.llm.tokens import slices

CELL_BITS, PARTS = 20, 64
CELLS = (1 << CELL_BITS) // PARTS
#: Mixings, each of which draws a leader; a set is compared with a leader that shares this part of the threshold of its minima.
MINIMA, ALIKE = 8, 0.65
#: Members that a component sends to meet a set in one round, and the part of links that makes another round worth while.
SEATS, YIELD = 8, 0.02
#: Rows and bytes of an Arrow batch, and rows that the Parquet reader unpacks at once: texts and whole sets are large rows.
BATCH_ROWS, BATCH_BYTES, READER_ROWS = 2_000, 1 << 20, 512
#: Most bits of a filter (as a power of two), and its bits for each row: it spares most rows without a candidate a second look.
FILTER_BITS, BITS_A_ROW = 26, 64
BITS = tuple(f"b{i}" for i in range(8))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, *((np.arange(1, MINIMA + 1, dtype=object) * 0xD6E8FEB86659FD93 % (1 << 64)) | 1)], np.uint64)
#: Words whose digests a worker keeps.
WORD_ENTRIES, LONGEST_WORD = 100_000, 64


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


_WORDS: dict[bytes, int] = {}


def _word_digests(words: list[bytes]) -> np.ndarray:
    """64-bit digests of words, from a cryptographic hash, so that no words are known to collide. Each is hashed once per worker, but for
    those beyond the bound of the cache, which are forgotten again."""
    fresh = set(words).difference(_WORDS)
    _WORDS.update((w, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")) for w in fresh)
    out = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    full = len(_WORDS) > WORD_ENTRIES
    for w in fresh:
        if full or len(w) > LONGEST_WORD:
            del _WORDS[w]
    return out


def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes the result of a task on. Then its words are forgotten and free memory goes back: a worker lives on through later steps."""
    try:
        yield from batches
    finally:
        _WORDS.clear()
        pa.default_memory_pool().release_unused()


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text: sorted distinct 64-bit digests of its k-word shingles."""
    cut = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    words = _word_digests(list(itertools.chain.from_iterable(cut)))
    bounds = np.cumsum([0, *map(len, cut)])
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(bounds, bounds[1:]):
            w, size = words[a:b], min(k, b - a)
            if not size:
                out.append(words[:0])
                continue
            h = np.full(len(w) - size + 1, size, np.uint64)
            for i in range(size):
                h = _mix(h * _ODD[0] + w[i : len(w) - size + 1 + i], _ODD[1])
            h.sort()
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed_overlap(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """First tokens of which a linking set shares one: the intersection is at least ceil(num n / den)."""
    return n - -(-num * n // den) + 1


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, n, digest, minima. And per task the parts of its token sketch (part, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, task = np.zeros(1 << CELL_BITS, np.uint32), TaskContext.get().partitionId()
        names = ["doc_id", "n", "digest", "minima", "task", "part", "cells"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        for b in slices(batches, 1_000_000):
            sets = shingles(b.column("text").to_pylist(), k)
            if sum(map(len, sets)):
                cells, times = np.unique(np.concatenate(sets) >> np.uint64(64 - CELL_BITS), return_counts=True)
                sketch[cells.astype(np.int64)] += times.astype(np.uint32)
            with np.errstate(over="ignore"):
                minima = [[int(_mix(s, _ODD[3 + m]).min().astype(np.int64)) for m in range(MINIMA)] if len(s) else [] for s in sets]
            none = [None] * b.num_rows
            columns = [b.column("doc_id"), [len(s) for s in sets], [digest(s) if len(s) else None for s in sets], minima, none, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)
        if sketch.any():
            none = [None] * PARTS
            columns = [none, none, none, none, [task] * PARTS, list(range(PARTS)), [sketch[i * CELLS : (i + 1) * CELLS].tobytes() for i in range(PARTS)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.mapInArrow(lambda batches: _forgetting(run(batches)), "doc_id long, n int, digest binary, minima array<long>, task int, part int, cells binary")


def token_weights(profile: DataFrame) -> np.ndarray:
    """A byte per sketch cell that grows with its count: 1 MB whatever the corpus, so it may pass the driver and go to all tasks."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(CELLS, np.uint64)
        for x in rows["cells"]:
            cells += np.frombuffer(x, "<u4" if len(x) == 4 * CELLS else "<u8")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "task": [rows["task"].iloc[0] % 16], "cells": [cells.tobytes()]})

    schema = "part int, task int, cells binary"
    rows = profile.filter(F.col("part").isNotNull()).select("part", "task", "cells")
    rows = rows.groupBy("part", F.pmod("task", F.lit(16))).applyInPandas(total, schema).groupBy("part").applyInPandas(total, schema)
    out = np.zeros((PARTS, CELLS))
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(r["cells"], "<u8")
    return np.minimum(255, np.log2(out.ravel() + 1) * 6).astype(np.uint8)


def prefixes(docs: DataFrame, k: int, num: int, den: int, weights: np.ndarray) -> DataFrame:
    """Per document with a set: digest, n, the first tokens in the global order, and 512 parity bits of the whole set.

    A bit is the parity of the set's tokens with one remainder; two sets differ in at least as many tokens as in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            ids, sizes, firsts, parity = [], [], [], []
            for s in shingles(b.column("text").to_pylist(), k):
                if len(s):
                    p = prefix_length(len(s), num, den)
                    w = weights[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    ids.append(digest(s))
                    sizes.append(len(s))
                    firsts.append(s[np.argsort(w, kind="stable")[:p]].astype(np.int64))
                    parity.append(np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view("<i8"))
            ends = np.cumsum([0, *map(len, firsts)])
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
            bits = np.array(parity, np.int64).reshape(-1, 8).T
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), tokens, *map(pa.array, bits)], ["digest", "n", "tokens", *BITS])

    return docs.select("text").mapInArrow(lambda batches: _forgetting(run(batches)), "digest binary, n int, tokens array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _slots(ids: pa.Array, power: int) -> np.ndarray:
    """Places of numbers in a filter of 2**power bits."""
    import pyarrow.compute as pc

    with np.errstate(over="ignore"):
        x = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return (_mix(x * _ODD[0], _ODD[1]) >> np.uint64(64 - power)).astype(np.int64)


def _holds(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    places = _slots(ids, (8 * len(bits)).bit_length() - 1)
    return (bits[places >> 3] >> (7 - (places & 7)) & 1).astype(bool)


def membership(wanted: DataFrame, key: str, rows: int | None = None) -> np.ndarray:
    """A bit array with the places of the numbers in `key`: as large as the number of rows asks for, 8 MB at most or where it is not
    known. More numbers only make it less selective. The driver, every executor and every worker hold a copy while it is used."""
    power = FILTER_BITS if rows is None else min(FILTER_BITS, max(16, (BITS_A_ROW * rows).bit_length()))
    size = (1 << power) // 8 // PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, some = np.zeros(1 << power - 3, np.uint8), False
        for b in batches:
            places = _slots(b.column(key), power)
            np.bitwise_or.at(packed, places >> 3, np.right_shift(128, places & 7).astype(np.uint8))
            some = some or b.num_rows > 0
        if some:
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "cells": pa.array([packed[i * size : (i + 1) * size].tobytes() for i in range(PARTS)], pa.binary())})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(size, np.uint8)
        for x in rows["cells"]:
            cells |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "cells": [cells.tobytes()]})

    schema = "part int, cells binary"
    marked = wanted.select(key).coalesce(16).mapInArrow(mark, schema).groupBy("part").applyInPandas(either, schema)
    out = np.zeros((PARTS, size), np.uint8)
    for r in marked.collect():
        out[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The columns of `wanted` (rep, digest, ...) with the whole `shingles` of each class, computed again from one of its documents.

    Only documents that pass the filter are looked at again; texts are not shuffled. A repeated row gives its set once per task, and
    a link found twice is one link.
    """
    bits = membership(wanted, "rep", wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for b in slices([whole.filter(pa.array(_holds(bits, whole.column("doc_id"))))], 1_000_000):
                rows = [(digest(s), s.tobytes()) for s in shingles(b.column("text").to_pylist(), k) if len(s)]
                rows = [r for r in rows if r[0] not in seen and not seen.add(r[0])]
                yield pa.RecordBatch.from_pydict({"digest": pa.array([r[0] for r in rows], pa.binary()), "shingles": pa.array([r[1] for r in rows], pa.binary())})

    return docs.mapInArrow(lambda batches: _forgetting(run(batches)), "digest binary, shingles binary").join(wanted.drop("rep"), "digest").drop("digest")


def verified(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among rows (x, y, left, right), by their whole sets; a is the row's x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, keep = b.column("x").to_numpy(), b.column("y").to_numpy(), np.zeros(b.num_rows, bool)
            last, left = None, None
            for i, (x, l, r) in enumerate(zip(a.tolist(), b.column("left"), b.column("right"))):
                if x != last:
                    last, left = x, np.frombuffer(l.as_buffer(), np.uint64)
                right = np.frombuffer(r.as_buffer(), np.uint64)
                at = np.searchsorted(left, right)
                common = int((left[np.minimum(at, len(left) - 1)] == right).sum())
                keep[i] = den * common >= num * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[keep]), "b": pa.array(c[keep])})

    return pairs.select("x", "y", "left", "right").mapInArrow(lambda batches: _forgetting(run(batches)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in a link: the smallest id it reaches. Each round takes the least label of the neighbours and then jumps to that label's own label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        least = written(least, "labels")
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = least.join(jump, "component").select("id", F.least("component", "far").alias("component"), "old")
        labels = written(new, "labels")
        if not labels.filter(F.col("component") != F.col("old")).head(1):
            return labels.drop("old")
        labels = labels.drop("old")


def led_components(derived: DataFrame) -> DataFrame:
    """(id, component) of every id in a link (a leader, b member).

    A member has a leader per mixing at most. Its first one stands for it; the others, and a leader that is itself a member, are
    linked to that first one, so labels run over the distinct links among leaders only and each member is joined once.
    """
    stars = derived.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"), F.collect_set("a").alias("leaders"))
    stars = written(stars, "led-stars")
    heads = stars.select(F.explode("leaders").alias("id")).distinct()
    core = stars.select("first", F.explode("leaders").alias("other")).unionByName(stars.join(heads, "id", "left_semi").select("first", F.col("id").alias("other")))
    core = core.filter(F.col("first") != F.col("other")).select(F.col("first").alias("a"), F.col("other").alias("b")).distinct()
    named = components(core).withColumnRenamed("id", "first")
    rows = stars.select("id", "first").unionByName(heads.select("id", F.col("id").alias("first")))
    return rows.join(named, "first", "left").groupBy("id").agg(F.min(F.coalesce("component", "first")).alias("component"))


def alike(rows: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, ...) whose sizes can link and that share enough minima to be likely to, with the number of `shared` ones."""
    x, y = (rows.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("minima").alias(f"{s}_minima")) for s in "xy")
    shared = F.size(F.filter(F.zip_with("x_minima", "y_minima", lambda a, b: a == b), lambda same: same))
    sizes = (F.col("y_n") * den >= F.col("x_n") * num) & (F.col("x_n") * den >= F.col("y_n") * num)
    near = pairs.join(x, "x").join(y, "y").withColumn("shared", shared)
    return near.filter(sizes & (F.col("shared") >= int(MINIMA * ALIKE * num / den))).select(*pairs.columns, "shared")


def leader_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(x leader, y, best): for each mixing, the classes with one minimum meet a leader that is drawn for this mixing; best marks the
    leader that shares most minima with y. Pairs whose sizes cannot link, or that share too few minima to be likely to (fewer are
    asked of the best), are left to the exact search."""
    drawn = rows.select("id", F.posexplode("minima").alias("m", "least"))
    leaders = drawn.groupBy("m", "least").agg(F.min_by("id", F.xxhash64("id", "m")).alias("x"), F.count("*").alias("held")).filter("held > 1").drop("held")
    met = drawn.join(leaders, ["m", "least"]).filter(F.col("x") != F.col("id")).select("x", F.col("id").alias("y")).distinct()
    of = alike(rows, met, num, den).groupBy("y").agg(F.sort_array(F.collect_list(F.struct("shared", "x")), asc=False).alias("of"))  # MINIMA at most
    of = of.select("y", F.posexplode("of").alias("at", "of")).filter((F.col("at") == 0) | (F.col("of.shared") >= int(MINIMA * num / den)))
    return of.select("of.x", "y", (F.col("at") == 0).alias("best"))


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after links (a, b) between components have made one of both."""
    one, other = (named.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    across = links.join(one, "a").join(other, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b").distinct()
    names = components(across).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    return named.join(names, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))


def drawn_together(known: DataFrame, pairs: DataFrame, minima: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """`known` (id, component) after rounds in which a set meets members of the components of its leaders, and of the component that
    most sets with the same leader are in (two sets may link where neither links to the leader).

    A component sends up to SEATS members, drawn anew in each round, and a set that is not in it is compared with the one that shares
    most minima with it. A link makes one component of both, so that the exact search need not find the many others between them. No
    pair is compared twice. Rounds go on while they pay: as long as YIELD of their comparisons are links.
    """
    tested = pairs.filter("best").select("x", "y")
    for turn in itertools.count():
        one, other = (known.select(F.col("id").alias(s), F.col("component").alias(f"of_{s}")) for s in "xy")
        placed = pairs.select("x", "y").join(one, "x").join(other, "y")
        most = placed.groupBy("x", "of_y").count().filter("count > 1").groupBy("x").agg(F.max_by("of_y", F.struct("count", "of_y")).alias("most"))
        towards = placed.join(most, "x", "left").select("y", "of_y", F.explode(F.array("of_x", "most")).alias("component"))
        apart = towards.filter("component <> of_y").select("y", "component").distinct()
        seat = F.pmod(F.xxhash64("id", F.lit(2 * turn)), F.lit(SEATS)).alias("seat")
        seats = known.groupBy("component", seat).agg(F.min_by("id", F.xxhash64("id", F.lit(2 * turn + 1))).alias("x"))
        fresh = apart.join(seats.drop("seat"), "component").join(tested, ["x", "y"], "left_anti")
        best = alike(minima, fresh, num, den).groupBy("y", "component").agg(F.max_by("x", F.struct("shared", F.xxhash64("x", "y"))).alias("x"))
        chosen = written(best.select("x", "y"), "jaccard-chosen")
        n = chosen.count()
        if not n:
            return known
        left, right = (within(sets.withColumnRenamed("id", key), key, membership(chosen, key, n)).withColumnRenamed("shingles", side) for key, side in (("x", "left"), ("y", "right")))
        links = written(verified(right.join(chosen, "y").join(left, "x"), num, den), "jaccard-derived")
        found = links.count()
        if found:
            known = written(merged(known, links), "jaccard-known")
        if found < YIELD * n:
            return known
        tested = tested.unionByName(chosen)


def within(rows: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Rows whose key may be in the filter."""
    return rows.mapInArrow(lambda batches: (b.filter(pa.array(_holds(bits, b.column(key)))) for b in batches), rows.schema)


def live_tokens(entries: DataFrame) -> DataFrame:
    """Rows (id, component, several, n, bits, at, token) of the tokens that sets of two components hold, and few others.

    Tokens are first reduced to their least and largest component on the map side; the filter built from those that differ then
    spares the others the way through a shuffle.
    """
    held = entries.select("component", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    alive = written(held.filter("low < high").select("token"), "jaccard-alive")
    bits = membership(alive, "token", alive.count())
    carried = ["id", "component", "several", "n", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            flat, ends = tokens.flatten(), tokens.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), ends)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
            mine = np.flatnonzero(_holds(bits, flat))
            take = pa.array(row[mine])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in carried), pa.array(at[mine].astype(np.int32)), flat.take(pa.array(mine))], [*carried, "at", "token"])

    schema = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in carried) + ", at int, token long"
    return entries.mapInArrow(run, schema)


def candidates(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of classes in different components that share a token of both prefixes and whose sizes, positions and parity bits
    allow a link."""
    own = ["id", "n", *BITS]
    single = tokens.filter("not several").select("token", "component", *own, F.col("n").alias("low"), F.col("n").alias("high"), "at")
    shared = tokens.filter("several").groupBy("token", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("at"))
    blocks = single.unionByName(shared, allowMissingColumns=True)

    def fits(l: dict, r: dict):
        """Sizes, positions and, where both sides are single sets, parity bits."""
        sizes = (r["high"] * den >= l["low"] * num) & (l["high"] * den >= r["low"] * num)
        behind = F.least(l["high"] - l["at"], r["high"] - r["at"]) * (num + den) >= (l["low"] + r["low"]) * num
        differ = sum((F.bit_count(l[b].bitwiseXOR(r[b])) for b in BITS), F.lit(0)) * (num + den) <= (l["n"] + r["n"]) * (den - num)
        return sizes & behind & F.coalesce(differ, F.lit(True))

    columns = ["component", *own, "low", "high", "at"]
    of = lambda s: {c: F.col(f"{s}_{c}") for c in columns}
    l, r = (blocks.select("token", *(F.col(c).alias(f"{s}_{c}") for c in columns)) for s in "lr")
    pairs = l.join(r, "token").filter((F.col("l_component") < F.col("r_component")) & fits(of("l"), of("r")))
    members = tokens.filter("several")
    for s in "lr":  # blocks with several sets are opened
        opened = members.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("component", *own, "at")), F.col("n").alias(f"{s}_low"), F.col("n").alias(f"{s}_high"))
        closed = pairs.filter(f"{s}_id is null").drop(*(f"{s}_{c}" for c in columns if c != "component"))
        closed = closed.join(opened, ["token", f"{s}_component"]).filter(fits(of("l"), of("r")))
        pairs = pairs.filter(f"{s}_id is not null").unionByName(closed)
    return pairs.select(F.least("l_id", "r_id").alias("x"), F.greatest("l_id", "r_id").alias("y")).distinct()


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Small batches while texts and whole sets travel: a row of `verified` holds two sets, on both sides of the Python worker. Shuffle
    files go with each step."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READER_ROWS}
    return settings(spark, {name: str(n) for name, n in sizes.items()} | TIDY)


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links with den * intersection >= num * union)."""
    with small_batches(docs.sparkSession):
        return _join(docs, k, num, den)


def _join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = written(profiles(docs, k), "jaccard-profiles")
    owned = profile.filter("part is null")
    classes = written(owned.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")

    minima = owned.filter("digest is not null").select("digest", "minima").dropDuplicates(["digest"]).join(classes.select("digest", "id", "n"), "digest")
    minima = written(minima.select("id", "n", "minima"), "jaccard-minima")
    pairs = written(leader_pairs(minima, num, den), "jaccard-pairs")
    best = pairs.filter("best").select(F.col("y").alias("id"), F.col("x").alias("leader"))
    leads = pairs.select(F.col("x").alias("id")).distinct().withColumn("leads", F.lit(True))
    wanted = classes.select("rep", "digest", "id").join(best, "id", "left").join(leads, "id", "left").filter("leads or leader is not null")
    sets = written(sets_of(docs, written(wanted, "jaccard-wanted"), k), "jaccard-sets")
    members = sets.select(F.col("leader").alias("x"), F.col("id").alias("y"), F.col("shingles").alias("right"))
    leaders = sets.filter("leads").select(F.col("id").alias("x"), F.col("shingles").alias("left"))
    derived = written(verified(members.join(leaders, "x"), num, den), "jaccard-derived")
    known = led_components(derived)
    met = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    known = written(met.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "jaccard-known")
    known = drawn_together(known, pairs, minima, sets.select("id", "shingles"), num, den)

    sizes = known.groupBy("component").agg((F.count("*") > 1).alias("several"))
    weights = token_weights(profile)
    entries = prefixes(docs, k, num, den, weights).dropDuplicates(["digest"]).join(classes.select("digest", "id").join(known.join(sizes, "component"), "id", "left"), "digest")
    entries = entries.select("id", "n", "tokens", *BITS, F.coalesce("component", "id").alias("component"), F.coalesce("several", F.lit(False)).alias("several"))
    entries = written(entries, "jaccard-entries")
    live = written(live_tokens(entries), "jaccard-live")
    left = written(candidates(live, num, den), "jaccard-candidates")
    missing = left.select(F.col("x").alias("id")).union(left.select("y")).distinct()
    have = sets.select("id", "shingles").join(missing, "id", "left_semi")
    lacking = classes.select("rep", "digest", "id").join(missing, "id", "left_semi").join(sets.select("id"), "id", "left_anti")
    more = sets_of(docs, written(lacking, "jaccard-wanted"), k).select("id", "shingles")
    whole = written(have.unionByName(more), "jaccard-sets")
    rows = left.join(whole.select(F.col("id").alias("y"), F.col("shingles").alias("right")), "y").join(whole.select(F.col("id").alias("x"), F.col("shingles").alias("left")), "x")
    searched = written(verified(rows, num, den), "jaccard-searched")

    named = entries.select("id", "component")  # every class
    if searched.head(1):
        named = merged(named, searched)
    named = classes.select("id", "digest", "rep").join(named, "id")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "component").select("digest", "component_id")
    out = owned.join(named, "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
