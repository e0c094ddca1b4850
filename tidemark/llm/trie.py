"""Conversation prefix trie (operator 12): one row per distinct beginning of conversations, from minimal-perfect-hash node tables.

1. `chained` numbers the turns of every conversation and gives each its prefix digest: h(d) = h(d-1) * B + t(d) modulo 2**61 - 1, for
   two bases B and two halves of the turn's MD5. Rows are dealt by ranges of (conversation, turn), so a conversation of any length is
   cut over tasks; a task works from zero, and what the tasks before hold of its first conversation (a count and a digest) is put in
   front afterwards. The driver sees two rows per task.
2. Rows of one (depth, digest) are a node; they are counted map-side.
3. Nodes are dealt to shards by ranges of (smallest member, depth), which are even however hot a subtree or a first turn is. A shard
   enumerates its digests and gives them the slots of a minimal perfect hash (`Slots`); as every digest is stored at its slot, a digest
   that is not in the shard is told apart. Counts are scattered into flat arrays and accumulated through the array of parent slots, the
   deepest nodes first.
4. A node whose parent lies in another shard hands its sums over to that parent, its portal. Portals form a small forest of their own
   (at most one edge per shard and portal), whose sums come from pointer doubling in a number of rounds that is the logarithm of its
   height; then every shard adds them at its portals and accumulates once more.
5. The ids of the conversations that end at a node are sorted by ranges, joined to pieces of text where they lie, and hashed piece by
   piece.

Rows: turns without a conversation id belong to no conversation. Null roles and texts are empty; a null turn comes first; turns with
equal numbers are ordered by their MD5, and repeated rows are turns of their own. A conversation may have no turns after the
rebuilding: it is a member of the root only. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

PRIME = (1 << 61) - 1
BASES = (0x0D1B54A32D192ED0 % PRIME, 0x1A2E8F13C4D96B57 % PRIME)
#: Bytes of joined ids that travel as one row.
PIECE = 1 << 20
KEY, UP = ["depth", "p1", "p2"], ["up_depth", "q1", "q2"]


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), more])


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, turn, t (MD5 of role and text) and n_bytes of the text, of all turns that have a conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))


def carries(edges: list[tuple]) -> dict[int, tuple]:
    """Of (part, first run, last run) in order, a run being (conversation, turns, p1, p2): what earlier parts hold of a part's first
    conversation, as (conversation, turns, (p1, p2))."""
    out, held = {}, (None, 0, (0, 0))
    for part, (conv, n, *p), last in edges:
        if conv == held[0]:
            out[part] = held
            p = [(x * pow(base, n, PRIME) + y) % PRIME for x, base, y in zip(held[2], BASES, p)]
            n += held[1]
        held = (conv, n, tuple(p)) if last[0] == conv else (last[0], last[1], tuple(last[2:]))
    return out


def chained(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (conv_id, t, the columns of `order`, ...) with depth (from 1) and the digests of the prefix that ends with the turn (p1,
    p2) and of the one before (q1, q2)."""
    dealt = rows.repartitionByRange(_parts(rows), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    own, new = rows.columns, ["depth", "p1", "p2", "q1", "q2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, at, p = TaskContext.get().partitionId(), None, 0, (0, 0)
        (one, other) = BASES
        for b in batches:
            found = []
            for c, t in zip(b.column("conv_id").to_pylist(), b.column("t").to_pylist()):
                if c != conv:
                    conv, at, p = c, 0, (0, 0)
                q, at = p, at + 1
                p = ((p[0] * one + int.from_bytes(t[:8], "big")) % PRIME, (p[1] * other + int.from_bytes(t[8:], "big")) % PRIME)
                found.append((at, *p, *q))
            columns = zip(*found) if found else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in columns), pa.array([part] * b.num_rows, pa.int32())], [*own, *new, "part"])

    local = written(dealt.mapInArrow(run, _schema(rows, "depth long, p1 long, p2 long, q1 long, q2 long, part int")), "trie-chained")
    runs = local.groupBy("part", "conv_id").agg(F.max("depth").alias("n"), F.max_by("p1", "depth").alias("p1"), F.max_by("p2", "depth").alias("p2"))
    a_run = F.struct("conv_id", "n", "p1", "p2")
    edges = runs.groupBy("part").agg(F.min_by(a_run, "conv_id").alias("first"), F.max_by(a_run, "conv_id").alias("last")).orderBy("part").collect()  # a row per task
    before = carries([(r["part"], tuple(r["first"]), tuple(r["last"])) for r in edges])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = {c: b.column(c).to_numpy().copy() for c in new}
            convs, parts = b.column("conv_id").to_numpy(), b.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                conv, n, p = before.get(part, (None, 0, None))
                for i in np.flatnonzero((parts == part) & (convs == conv)).tolist() if n else ():
                    at = int(values["depth"][i])
                    for x, y, base, held in zip(("p1", "p2"), ("q1", "q2"), BASES, p):
                        values[x][i] = (int(values[x][i]) + held * pow(base, at, PRIME)) % PRIME
                        values[y][i] = (int(values[y][i]) + held * pow(base, at - 1, PRIME)) % PRIME
                    values["depth"][i] = at + n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(values[c]) for c in new)], [*own, *new])

    return local.mapInArrow(put, _schema(rows, "depth long, p1 long, p2 long, q1 long, q2 long"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (of `digested`) after every conversation c has taken the first h turns of conversation c - c % group in place of its own
    first h; h is crc32 of c's decimal digits modulo `most`. And the ids of all conversations."""
    numbered = chained(turns, ["turn", "t"]).select("conv_id", "t", "n_bytes", F.col("depth").alias("o"))
    ids = numbered.filter("o = 1").select("conv_id")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.when(F.col("conv_id") > 0, 0).otherwise(1 - group)
    last = F.when(F.col("conv_id") < 0, 0).otherwise(group - 1)
    heads = numbered.filter((F.col("o") < most) & (F.col("conv_id") % group == 0)).withColumn("conv_id", F.explode(F.transform(F.sequence(first, last), lambda i: F.col("conv_id") + i)))
    heads = heads.filter(F.col("o") <= h).join(ids, "conv_id", "left_semi").withColumn("side", F.lit(0))
    return heads.unionByName(numbered.filter(F.col("o") > h).withColumn("side", F.lit(1))), ids


def _level(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
        for k in keys[1:]:
            x = (x ^ (x >> np.uint64(29)) ^ k.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        return x


class Slots:
    """Minimal perfect hash of distinct digests (columns of `keys`): on each level a digest that meets no other takes its place, the
    others go on to the next; a slot is the rank of the place taken. Digests are stored at their slots, so others are found out."""

    def __init__(self, keys: np.ndarray):
        self.taken, self.before, left, base = [], [], np.arange(keys.shape[1]), 0
        while len(left):
            size = len(left) + len(left) // 2 + 1
            place = (_level(keys[:, left], len(self.taken)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            self.taken.append(alone)
            self.before.append(base + np.cumsum(alone) - alone)
            base += int(alone.sum())
            left = left[~alone[place]]
        self.keys = np.zeros_like(keys)
        self.keys[:, self._place(keys)] = keys

    def _place(self, keys: np.ndarray) -> np.ndarray:
        slot = np.zeros(keys.shape[1], np.int64)
        left = np.arange(keys.shape[1])
        for i, (taken, before) in enumerate(zip(self.taken, self.before)):
            place = (_level(keys[:, left], i) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[place]
            slot[left[hit]] = before[place[hit]]
            left = left[~hit]
        return slot

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for one that is not here."""
        if not self.keys.shape[1]:
            return np.full(keys.shape[1], -1, np.int64)
        slot = self._place(keys)
        return np.where((self.keys[:, slot] == keys).all(axis=0), slot, -1)


class Shard:
    """Flat arrays over the slots of a shard's nodes."""

    def __init__(self, nodes: pd.DataFrame):
        of = lambda names: np.stack([nodes[c].to_numpy(np.int64) for c in names])
        self.slots = Slots(of(KEY))
        at, n = self.slots.of(of(KEY)), len(nodes)
        self.parent, self.up = np.full(n, -1, np.int64), np.zeros((3, n), np.int64)
        self.up[:, at] = of(UP)
        self.parent[at] = self.slots.of(of(UP))
        self.conv, self.n_convs, n_ends, n_bytes = (self._scatter(at, nodes[c].to_numpy(np.int64)) for c in ("conv_id", "n_convs", "n_ends", "n_bytes"))
        self.children, self.leaves, self.saved = np.zeros(n, np.int64), (n_ends == self.n_convs).astype(np.int64), (self.n_convs - 1) * n_bytes
        depth = self.slots.keys[0]
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        np.add.at(self.children, self.parent[self.parent >= 0], 1)

    @staticmethod
    def _scatter(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        np.add.at(out, at, x)
        return out

    def accumulate(self) -> None:
        """Sums of subtrees, the deepest nodes first."""
        for level in reversed(self.levels):
            inner = level[self.parent[level] >= 0]
            for x in (self.leaves, self.saved):
                np.add.at(x, self.parent[inner], x[inner])

    def tops(self) -> np.ndarray:
        """The highest ancestor in the shard, the highest nodes first."""
        top = np.arange(len(self.parent))
        for level in self.levels:
            inner = level[self.parent[level] >= 0]
            top[inner] = top[self.parent[inner]]
        return top

    def leaving(self) -> np.ndarray:
        """Nodes whose parent is elsewhere."""
        return np.flatnonzero((self.parent < 0) & (self.slots.keys[0] > 0))


def _of_kind(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
    return rows[rows["kind"] == kind]


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    shard = Shard(rows)
    shard.accumulate()
    at = shard.leaving()
    out = pd.DataFrame({**dict(zip(UP, shard.up[:, at])), "children": 1, "leaves": shard.leaves[at], "saved": shard.saved[at]})
    out = out.groupby(UP, as_index=False).sum()
    out.insert(0, "part", int(rows["part"].iloc[0]))
    return out


def _next_portals(rows: pd.DataFrame) -> pd.DataFrame:
    shard, portals = Shard(_of_kind(rows, 0)), _of_kind(rows, 1)
    top = shard.tops()[shard.slots.of(np.stack([portals[c].to_numpy(np.int64) for c in KEY]))]
    return pd.DataFrame({"portal": portals["conv_id"].to_numpy(np.int64), **dict(zip(UP, shard.up[:, top]))})


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    shard, portals, above = Shard(_of_kind(rows, 0)), _of_kind(rows, 1), _of_kind(rows, 2)
    at = shard.slots.of(np.stack([portals[c].to_numpy(np.int64) for c in KEY]))
    for x, c in ((shard.children, "n_convs"), (shard.leaves, "n_ends"), (shard.saved, "n_bytes")):
        np.add.at(x, at, portals[c].to_numpy(np.int64))
    shard.accumulate()
    parents = np.where(shard.parent >= 0, shard.conv[shard.parent], 0)
    if len(above):
        names = Slots(np.stack([above[c].to_numpy(np.int64) for c in KEY]))
        convs = Shard._scatter(names.of(np.stack([above[c].to_numpy(np.int64) for c in KEY])), above["conv_id"].to_numpy(np.int64))
        out = shard.leaving()
        parents[out] = convs[names.of(shard.up[:, out])]
    keys = dict(zip(KEY, shard.slots.keys))
    return pd.DataFrame({**keys, "conv_id": shard.conv, "parent_conv_id": pd.Series(parents).astype("Int64").where(keys["depth"] > 0), "n_convs": shard.n_convs, "n_children": shard.children, "n_leaves": shard.leaves, "saved_tokens": shard.saved})


def portal_sums(portals: DataFrame, pointers: DataFrame) -> DataFrame:
    """(portal, leaves, saved): what arrives at each portal (leaves, saved), and at all portals that point to it, by pointer doubling."""
    state = written(portals.select("portal", "leaves", "saved").join(pointers, "portal", "left"), "trie-portals")
    while state.filter("next is not null").head(1):
        add = state.filter("next is not null").groupBy(F.col("next").alias("portal")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = state.select(F.col("portal").alias("next"), F.col("next").alias("far"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        new = state.join(add, "portal", "left").join(far, "next", "left")
        state = written(new.select("portal", (F.col("leaves") + zero("more_leaves")).alias("leaves"), (F.col("saved") + zero("more_saved")).alias("saved"), F.col("far").alias("next")), "trie-portals")
    return state.drop("next")


def ends_digests(ends: DataFrame) -> DataFrame:
    """Per node (KEY) at which conversations end: SHA-256 of their ids in ascending order, joined by commas."""
    n = _parts(ends)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, out = None, None, [], 0, []

        def flush():
            if ids:
                out.append((*key, first, ",".join(ids)))

        for b in batches:
            for *k, c in zip(*(b.column(x).to_pylist() for x in (*KEY, "conv_id"))):
                if k != key or size > PIECE:
                    flush()
                    key, first, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield from _piece_batch(out)
            out = []
        flush()
        yield from _piece_batch(out)

    def _piece_batch(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], [*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(b.column(x).to_pylist() for x in (*KEY, "ids"))):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if key is not None:
            out.append((*key, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], [*KEY, "ends_sha256"])

    cut = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, "depth long, p1 long, p2 long, first long, ids string")
    return cut.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, order: list[str], members: DataFrame | None = None) -> DataFrame:
    """Nodes of the turns (conv_id, t, n_bytes, the columns of `order`); `members` (conv_id) names conversations that may have none."""
    rows = chained(turns, order)
    zero = F.lit(0).cast("long")
    ends = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("p1", "depth").alias("p1"), F.max_by("p2", "depth").alias("p2"))
    if members is not None:
        bare = members.join(ends.select("conv_id"), "conv_id", "left_anti").select("conv_id", *(zero.alias(c) for c in KEY))
        ends = ends.unionByName(bare)
    ends = written(ends, "trie-ends")
    parts = rows.select("conv_id", *KEY, "q1", "q2", "n_bytes", F.lit(1).cast("long").alias("n_convs"), zero.alias("n_ends"))
    parts = parts.unionByName(ends.select("conv_id", *(zero.alias(c) for c in [*KEY, "q1", "q2", "n_bytes"]), F.lit(1).cast("long").alias("n_convs"), zero.alias("n_ends")))
    parts = parts.unionByName(ends.select("conv_id", *KEY, *(zero.alias(c) for c in ["q1", "q2", "n_bytes", "n_convs"]), F.lit(1).cast("long").alias("n_ends")))
    nodes = parts.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_ends")), *(F.max(c).alias(c) for c in ("n_bytes", "q1", "q2")))
    nodes = nodes.withColumn("up_depth", F.col("depth") - 1).repartitionByRange(_parts(parts), "conv_id", "depth").withColumn("part", F.spark_partition_id())
    nodes = written(nodes.withColumn("kind", F.lit(0)), "trie-nodes")

    exits = written(nodes.groupBy("part").applyInPandas(_exits, "part int, up_depth long, q1 long, q2 long, children long, leaves long, saved long"), "trie-exits")
    named = dict(zip(UP, KEY))
    arriving = exits.groupBy(*UP).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))).withColumnsRenamed(named)
    portals = arriving.join(nodes.select(*KEY, "conv_id", "part"), KEY).withColumn("portal", F.monotonically_increasing_id())
    portals = written(portals, "trie-portals")

    def message(rows: DataFrame, kind: int, conv_id: str, **values) -> DataFrame:
        """Rows for the shards in the form of nodes."""
        given = {"conv_id": F.col(conv_id), "kind": F.lit(kind), **{c: F.col(x) for c, x in values.items()}}
        return rows.select(*(given.get(c, F.col(c) if c in (*KEY, "part") else F.lit(0).cast(nodes.schema[c].dataType)).alias(c) for c in nodes.columns))

    asked = nodes.unionByName(message(portals, 1, "portal"))
    pointers = asked.groupBy("part").applyInPandas(_next_portals, "portal long, up_depth long, q1 long, q2 long").withColumnsRenamed(named)
    pointers = pointers.join(portals.select(*KEY, F.col("portal").alias("next")), KEY).select("portal", "next")
    sums = portal_sums(portals, pointers)
    total = portals.drop("leaves", "saved").join(sums, "portal")
    above = exits.select(F.col("part").alias("to"), *UP).withColumnsRenamed(named).join(portals.select(*KEY, "conv_id"), KEY).withColumnRenamed("to", "part")
    told = nodes.unionByName(message(total, 1, "portal", n_convs="children", n_ends="leaves", n_bytes="saved")).unionByName(message(above, 2, "conv_id"))
    schema = "depth long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    answers = told.groupBy("part").applyInPandas(_answers, schema)
    found = answers.join(ends_digests(ends), KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, ids = rebuilt(digested(conversations))
    return trie(turns, ["side", "o"], ids)


def oracle() -> str:
    """The same nodes in SQL: prefix digests by recursion over depth, crc32 bit by bit."""
    crc = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))"
    return f"""
    WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, md5(strlen(role) || ':' || role || text) AS m, strlen(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS o FROM t),
    c AS (SELECT conv_id, xor({crc}, 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    u AS (SELECT c.conv_id, 0 AS side, o.o, o.m, o.b FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.o <= c.h
          UNION ALL SELECT c.conv_id, 1, o.o, o.m, o.b FROM c JOIN o ON o.conv_id = c.conv_id AND o.o > c.h),
    r AS (SELECT conv_id, m, b, row_number() OVER (PARTITION BY conv_id ORDER BY side, o) AS d FROM u),
    p AS (SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS k, '' AS up, CAST(0 AS BIGINT) AS b FROM c
          UNION ALL SELECT p.conv_id, r.d, md5(p.k || r.m), p.k, r.b FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
    l AS (SELECT conv_id, max(d) AS n FROM p GROUP BY 1),
    n AS (SELECT d, k, any_value(up) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, count(*) FILTER (n = d) AS n_ends,
                 sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (n = d), '')) AS ends FROM p JOIN l USING (conv_id) GROUP BY d, k),
    s AS (SELECT d, k, d AS at, k AS top, up AS above FROM n
          UNION ALL SELECT s.d, s.k, n.d, n.k, n.up FROM s JOIN n ON n.d = s.at - 1 AND n.k = s.above),
    g AS (SELECT s.at AS d, s.top AS k, sum(CASE WHEN x.n_ends = x.n_convs THEN 1 ELSE 0 END) AS leaves, sum((x.n_convs - 1) * x.b) AS saved FROM s JOIN n x ON x.d = s.d AND x.k = s.k GROUP BY 1, 2),
    h AS (SELECT d - 1 AS d, up AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2)
    SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(h.children, 0) AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
    FROM n JOIN g ON g.d = n.d AND g.k = n.k LEFT JOIN h ON h.d = n.d AND h.k = n.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.up AND n.d > 0"""
