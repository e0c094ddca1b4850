"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue (operator 4).

The queue has one bucket of positions per merge rank. Two bitmap levels say which buckets hold something: the next bucket is
found by find-first-set on the upper word and then on the lower one, so a step costs the same in a pre-token of ten bytes and in
one of a million, and all pre-tokens of a slice share the steps. Positions are linked in a list; an entry whose pair has changed
since it was queued is stale and skipped.

Rows: a null text is an empty one and gives no ids. Repeated rows stay. Ids that are not in the vocabulary make decoding fail with
a message. Extra columns pass through; one named like an output column is replaced.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokens import ChunkEncoder, slices

#: Fixed value: the white space that the pattern's \s means (Unicode White_Space).
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BITS = 8
MASK = (1 << BITS) - 1
#: Stands for a byte without rank; bytes of pre-tokens in one queue (or one pre-token).
UNKNOWN, RUN_BYTES = -2, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _runs(pieces: list[bytes]) -> Iterator[list[bytes]]:
    ends, at = np.cumsum([0, *map(len, pieces)]), 0
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_BYTES, "right")) - 1)
        yield pieces[at:to]
        at = to


class RankQueue:
    """Merge ranks with the positions that wait for them; the lowest rank first, its leftmost position first.

    One queue serves many pre-tokens at once: they stand one behind the other, no pair goes over a border, and as the lowest rank of all
    is the lowest of every pre-token that holds it, each is merged as if it stood alone. So a step of the bitmaps serves a whole bucket.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pairs = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64)
        self.singles = np.array([ranks.get(bytes((a,)), UNKNOWN) for a in range(256)], np.int64)
        self.low = [0] * ((max(ranks.values(), default=0) >> BITS) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit bytes."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        rest = [p for p, i in zip(pieces, whole) if i < 0 and p]
        merged = itertools.chain.from_iterable(map(self._merged, _runs(rest)))
        known = np.array(whole, np.int64).astype("<u4").tobytes()
        return [known[4 * at : 4 * at + 4] if i >= 0 else next(merged) if p else b"" for at, (p, i) in enumerate(zip(pieces, whole))]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        low, get, text = self.low, self.ranks.get, b"".join(pieces)
        n, codes = len(text), np.frombuffer(text, np.uint8).astype(np.int64)
        starts = np.cumsum([0, *map(len, pieces)])
        first, link = self.pairs[codes << 8 | np.append(codes[1:], 0)], np.arange(-1, n)
        first[starts[1:] - 1] = -1
        link[starts] = -1  # a pre-token's start, and the end of all, has nothing before it
        pair, before, after, token = first.tolist(), link.tolist(), list(range(1, n + 1)), self.singles[codes].tolist()
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        held, at = np.unique(first[order], return_index=True)
        buckets: dict[int, list[int]] = {r: x.tolist() for r, x in zip(held.tolist(), np.split(order, at[1:]))} if len(held) else {}
        top = 0
        for rank in buckets:
            low[rank >> BITS] |= 1 << (rank & MASK)
            top |= 1 << (rank >> BITS)
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            rank = high << BITS | (word & -word).bit_length() - 1
            low[high] = word = word & word - 1
            if not word:
                top &= top - 1
            bucket, lower = buckets.pop(rank), False
            bucket.sort()
            for done, i in enumerate(bucket, 1):
                if pair[i] != rank:
                    continue
                j = after[i]
                k = after[i] = after[j]
                token[i], token[j], pair[j] = rank, -1, -1
                p = before[i]
                if before[k] >= 0:
                    before[k] = i
                    new = pair[i] = get(text[i : after[k]], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> BITS] |= 1 << (new & MASK)
                            top |= 1 << (new >> BITS)
                        lower = new < rank
                else:
                    pair[i] = -1
                if p >= 0:
                    new = pair[p] = get(text[p:k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            buckets[new] = [p]
                            low[new >> BITS] |= 1 << (new & MASK)
                            top |= 1 << (new >> BITS)
                        lower = lower or new < rank
                if lower and done < len(bucket):  # a lower rank comes first; the others wait
                    buckets[rank] = bucket[done:]
                    low[rank >> BITS] |= 1 << (rank & MASK)
                    top |= 1 << (rank >> BITS)
                    break
        ids = np.array(token, np.int64)
        if (ids == UNKNOWN).any():
            raise KeyError(text[token.index(UNKNOWN)])
        ends = 4 * np.concatenate([[0], np.cumsum(ids >= 0)])[starts]
        raw = ids[ids >= 0].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


class Codec:
    """One per worker: ranks, compiled pattern, and the ids of the pre-tokens seen (bounded)."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))
        self.merge_all = RankQueue(self.ranks).merge_all
        self.seen: dict[str, bytes] = {}
        self.chunks = ChunkEncoder(self.encode_strings, spaced=True, entries=700_000, encode_units=self.encode_units)
        names: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for b, i in self.ranks.items():
            names[i] = b
        self.bytes_of = pa.array(names, pa.large_binary())

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of strings that are one pre-token each."""
        return self.merge_all([u.encode() for u in units])

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        seen, cut = self.seen, [self.pieces.findall(s) for s in strings]
        fresh = list(set(itertools.chain.from_iterable(cut)).difference(seen))
        ids = dict(zip(fresh, self.merge_all([p.encode("utf-8", "replace") for p in fresh])))
        out = [b"".join([ids[p] if p in ids else seen[p] for p in parts]) for parts in cut]
        if len(seen) < 500_000:
            seen.update((p, x) for p, x in ids.items() if len(p) <= 32)
        return out


    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        got = self.bytes_of.take(lists.flatten())
        at = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, 8 * got.offset)[at] if len(got) else at
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), got.buffers()[2] or pa.py_buffer(b"")])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _passing(df: DataFrame, *out: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in out]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids` (array of int) to every row. No shuffle; memory is bounded by one slice of texts and the caches."""
    keep = [f.name for f in _passing(docs, ids)]
    schema = T.StructType([*_passing(docs, ids), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        chunks = codec(ranks_path, pattern).chunks
        for b in slices(batches, column=text):
            got = chunks.batch([t or "" for t in b.column(text).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), "<u4").view("<i4"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), values)], [*keep, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded` (binary) to every row with an array of ids; null ids give empty bytes."""
    keep = [f.name for f in _passing(tokens, decoded)]
    schema = T.StructType([*_passing(tokens, decoded), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        text_of = codec(ranks_path, pattern).decode
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), text_of(part.column(ids))], [*keep, decoded])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, the digest of the ids and the digest of the decoded bytes."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).select("doc_id", "ids"), ranks_path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
