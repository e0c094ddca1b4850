"""MinHash near-dedup with min-max hashing (operator 11): components of documents whose shingle sets are similar enough.

1. Each permutation of the 64-bit shingle digests gives two values, its least and its greatest one; both agree between two sets with
   probability J, so a signature of 128 values takes 64 hash evaluations a shingle, and its estimate is unbiased with a variance below
   that of 128 separate minima. A band holds both values of two permutations. A link of J >= 0.8 meets in none of the 32 bands with a
   probability of (1 - 0.8**4)**32 = 5e-8 (for a union of five shingles, the smallest that can link, 6e-7: there the two values of a permutation exclude each other most).
2. Equal sets are one class. Classes that agree in a band share a bucket. Pairs in a bucket are tried if their sizes can link and their
   signatures agree in at least half of the values that a link is expected to agree in less seven deviations; every link is confirmed
   on the full sets.
3. No bucket emits its pairs while it is large: in rounds, the largest component of a bucket sends one member, drawn anew in each
   round, to the members of all other components of the bucket; links merge components, and buckets of one component leave. Rounds go
   on while they find links. Pairs of different components that are left over are then tried one by one, all of them that an exact
   bound does not exclude (512 parity bits of the full sets: two sets differ in at least as many shingles as in bits), so no link
   between classes that share a bucket is lost.

Rows: a text that is null or has no word has no set and links with nothing; a text with fewer than `k` words has its whole sequence as
its one shingle. Repeated rows are one class; rows with equal ids and different texts are documents of their own. A null id links, its
component is named by the smallest id that is not null (null if there is none), and `kept` compares null-safely. An empty table gives
no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import _forgetting, _holds, membership, merged, small_batches, verified, within
from tidemark.llm.shared import written
from tidemark.llm.tokens import slices

PERMUTATIONS, BANDS = 64, 32
PER_BAND = PERMUTATIONS // BANDS
VALUES = 2 * PERMUTATIONS
_BY = np.random.default_rng(20).integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A round that links fewer than this part of the pairs it tried is the last one.
YIELD = 0.02


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text: sorted distinct 64-bit digests of its k-word shingles; words are hashed by a keyed hash (SipHash) of their bytes."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    every = list(itertools.chain.from_iterable(words))
    digests = pd.util.hash_array(np.array(every, dtype=object), categorize=False) if every else np.zeros(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for w in words:
            h, at = digests[at : at + len(w)], at + len(w)
            size = min(k, len(h))
            if size:
                s = np.full(len(h) - size + 1, size, np.uint64)
                for i in range(size):
                    s = _mix(s * _ODD + h[i : len(h) - size + 1 + i])
                s.sort()
                h = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(h)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set that is not empty: least and greatest value under each permutation, one after the other."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint64)
    with np.errstate(over="ignore"):
        for i, by in enumerate(_BY):
            x = flat * by
            out[:, 2 * i] = np.minimum.reduceat(x, starts)
            out[:, 2 * i + 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A row per set: a 64-bit key for each band."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    with np.errstate(over="ignore"):
        for i in range(2 * PER_BAND):
            keys = _mix(keys * _ODD + _mix(signature[:, i :: 2 * PER_BAND]))
    return keys.view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the number of shingles with one remainder."""
    return np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view("<i8")


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, n, digest of its set, keys of its bands, 16 bits of each value of its signature, and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000_000):
            sets = shingles(b.column("text").to_pylist(), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, short, digests, bits = ([None] * len(sets) for _ in range(4))
            if some:
                signature = signatures([sets[i] for i in some])
                for i, row, values in zip(some, band_keys(signature), (_mix(signature) >> np.uint64(48)).astype("<u2")):
                    keys[i], short[i], bits[i], digests[i] = row, values.tobytes(), parity(sets[i]), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "keys", "short", "bits"])

    return docs.mapInArrow(lambda batches: _forgetting(run(batches)), "doc_id long, n long, digest binary, keys array<long>, short binary, bits array<long>")


def least_agreement(num: int, den: int) -> int:
    """Values in which a link's signatures agree but for about one case in 10**11: seven deviations below the expected number."""
    j = num / den
    return max(1, int(VALUES * j - 7 * (VALUES * j * (1 - j)) ** 0.5))


def alike(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) whose sizes can link and whose signatures agree enough, with the number of values that agree."""
    least = least_agreement(num, den)
    x, y = (classes.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("short").alias(f"{s}_short")) for s in "xy")
    sizes = (F.col("y_n") * den >= F.col("x_n") * num) & (F.col("x_n") * den >= F.col("y_n") * num)
    rows = pairs.join(y, "y").join(x, "x").filter(sizes).select("x", "y", "x_short", "y_short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, r = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("x_short", "y_short"))
            agree = (l == r).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep), pa.array(agree, pa.int64()).filter(keep)], ["x", "y", "agree"])

    return rows.mapInArrow(run, "x long, y long, agree long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """(id, shingles) of the classes `wanted` (id, rep, digest), computed again from a document of each; texts are not shuffled.

    The filter, for `rows` classes at most, is looked up in the worker that computes the sets: a second one behind it would hold the texts again.
    """
    bits = membership(wanted, "rep", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for b in slices([whole.filter(pa.array(_holds(bits, whole.column("doc_id"))))], 1_000_000):
                own = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()) for s in shingles(b.column("text").to_pylist(), k) if len(s)]
                own = [r for r in own if r[0] not in seen and not seen.add(r[0])]
                yield pa.RecordBatch.from_pydict({"digest": pa.array([r[0] for r in own], pa.binary()), "shingles": pa.array([r[1] for r in own], pa.binary())})

    found = docs.mapInArrow(lambda batches: _forgetting(run(batches)), "digest binary, shingles binary")
    return found.join(wanted.select("id", "digest"), "digest").drop("digest").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs (x, y), by the full sets."""
    left, right = (sets.select(F.col("id").alias(s), F.col("shingles").alias(c)) for s, c in (("x", "left"), ("y", "right")))
    return verified(pairs.select("x", "y").join(right, "y").join(left, "x"), num, den)


def apart(buckets: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (key, id, component) of the buckets that hold several components."""
    placed = buckets.join(known, "id")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return placed.join(several.select("key"), "key", "left_semi")


def sent(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (x, y): the largest component of a bucket sends the member drawn in this round to the members of its other components."""
    drawn = placed.groupBy("key", "component").agg(F.count("*").alias("held"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("x"))
    heads = drawn.groupBy("key").agg(F.max_by(F.struct("x", "component"), F.struct("held", F.xxhash64("x", F.lit(turn)))).alias("head"))
    met = placed.join(heads, "key").filter(F.col("component") != F.col("head.component"))
    return met.select(F.least("head.x", "id").alias("x"), F.greatest("head.x", "id").alias("y")).distinct()


def across(placed: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (x, y) of different components in a bucket whose sizes and parity bits do not exclude a link."""
    rows = placed.join(classes.select("id", "n", *(F.col("bits")[i].alias(f"b{i}") for i in range(8))), "id")
    one, other = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key")) for s in "xy")
    sizes = (F.col("n_y") * den >= F.col("n_x") * num) & (F.col("n_x") * den >= F.col("n_y") * num)
    differ = sum((F.bit_count(F.col(f"b{i}_x").bitwiseXOR(F.col(f"b{i}_y"))) for i in range(8)), F.lit(0))
    near = sizes & (differ * (num + den) <= (F.col("n_x") + F.col("n_y")) * (den - num))
    pairs = one.join(other, (one["key"] == other["key"]) & (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & near)
    return pairs.select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()


def dedup(docs: DataFrame, k: int = 2, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links with den * intersection >= num * union), kept."""
    with small_batches(docs.sparkSession):
        return _dedup(docs, k, num, den)


def _dedup(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    owned = written(profiles(docs, k), "minmax-profiles")
    classes = owned.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("short").alias("short"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "minmax-classes")

    entries = classes.select("id", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    met = written(met, "minmax-met")
    buckets = written(within(entries, "key", membership(met, "key", met.count())).join(met, "key"), "minmax-buckets")
    of_pairs = written(classes.select("id", "n", "short", "bits", "rep", "digest").join(buckets.select("id").distinct(), "id"), "minmax-of-pairs")
    known = written(of_pairs.select("id", F.col("id").alias("component")), "minmax-known")
    sets, tried = None, None

    def linked(pairs: DataFrame, best: bool) -> tuple[int, int]:
        """Tries pairs that have not been tried, the most alike one of each y only where `best`; number of pairs and of links."""
        nonlocal known, tried, sets
        fresh = pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti")
        near = alike(fresh, of_pairs, num, den)
        if best:
            near = near.groupBy("y").agg(F.max_by("x", F.struct("agree", F.xxhash64("x"))).alias("x"))
        near = written(near.select("x", "y"), "minmax-tried")
        n = near.count()
        if not n:
            return 0, 0
        ids = near.select(F.col("x").alias("id")).union(near.select("y")).distinct()
        lacking = of_pairs.join(ids, "id", "left_semi") if sets is None else of_pairs.join(ids, "id", "left_semi").join(sets.select("id"), "id", "left_anti")
        more = written(sets_of(docs, written(lacking.select("id", "rep", "digest"), "minmax-lacking"), k, 2 * n), "minmax-sets")
        sets = more if sets is None else sets.unionByName(more)
        links = written(confirmed(near, sets, num, den), "minmax-links")
        found = links.count()
        if found:
            known = written(merged(known, links), "minmax-known")
        tried = near if tried is None else tried.unionByName(near)
        return n, found

    for turn in itertools.count():
        n, found = linked(sent(apart(buckets, known), turn), best=turn == 0)
        if found <= YIELD * n:
            break
    linked(across(apart(buckets, known), of_pairs, num, den), best=False)

    named = classes.select("id", "digest", "rep").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "component").select("digest", "component_id")
    out = owned.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
