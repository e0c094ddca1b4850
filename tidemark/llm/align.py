"""Cross-tokenizer alignment (operator 13): token groups and id-pair counts of two vocabularies over the same bytes.

1. Documents are shuffled by their full text, with equal texts counted map-side; each distinct text is tokenised and aligned once.
2. The tokens of both vocabularies cover the same bytes. Where a token of either ends, a group ends, and the two tokens that end there
   are linked. Two linked tokens end together, so the bytes of the shorter one are a suffix of the longer one's: the pairs that can
   ever be linked follow from the vocabularies alone. They are numbered once (`Pairs`), and counts are flat arrays over that number.
   This is also the size bound of what passes the driver and goes to all tasks, whatever the corpus.
3. Counts weigh a text's links by its multiplicity. Measures are taken per distinct text and joined to the documents by the text's
   SHA-256.

Texts are cut before single blanks (no blank before, no white space behind): no token of either vocabulary reaches over such a cut
(checked when the second vocabulary is loaded). A chunk is aligned once per worker process and looked up afterwards.

Rows: a text that is null or empty, or whose tokens do not spell a blank and the text, has no tokens: zeros and an empty digest. Every
row of the table gives one row, repeated ids included; a null id stays null. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.tokens import LONGEST_CACHED, slices

#: Blanks that the plain split would not cut as the rule above says: at either end, in runs, or before other white space.
UNSAFE = re.compile(r"\A | (?:\s|\Z)")
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: How the second vocabulary writes a blank, and a byte.
BLANK, BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
CACHE_ENTRIES = 500_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pairs:
    """Numbers of the id pairs (a, b) whose bytes are suffixes of one another."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        keys: set[int] = set()
        for first, second, key in ((a, b, lambda x, y: x << 32 | y), (b, a, lambda x, y: y << 32 | x)):
            ids: dict[bytes, list[int]] = {}
            for i, raw in enumerate(second):
                if raw:
                    ids.setdefault(raw, []).append(i)
            for i, raw in enumerate(first):
                keys.update(key(i, j) for at in range(len(raw)) for j in ids.get(raw[at:], ()))
        self.keys = np.array(sorted(keys), np.int64)
        self.b = (self.keys & 0xFFFFFFFF).astype(np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b.astype(np.int64))

    def __len__(self) -> int:
        return len(self.keys)


class Aligner:
    """Two tokenizers: `path_a` for the tokenizers library (byte-level), `path_b` for sentencepiece (adds the leading blank itself)."""

    def __init__(self, path_a: str, path_b: str, entries: int = CACHE_ENTRIES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_char = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(of_char[c] for c in n) if all(c in of_char for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        #: A piece with a blank behind another character would reach over a cut: then texts are aligned whole.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.pairs = Pairs(self.bytes_a, self.bytes_b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.entries = entries
        self.cache: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of a blank and the text, each without the blank it begins with."""
        if not self.cuts:
            return [text]
        if not UNSAFE.search(text):
            return text.split(" ")
        parts = CUT.split(" " + text)
        parts[0] = parts[0][1:]
        return parts

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """Per chunk: groups as text, numbers of its links (u32), ids of a plus ids of b times 2**32; None where the bytes differ.

        Chunks without white space at their ends go through both libraries as one text, which is divided again by byte offsets."""
        joined = [c for c in chunks if self.cuts and c and not c[0].isspace() and c[-1] != " "]
        out = dict(zip(joined, self.aligned(joined)))
        for c in chunks:
            if out.get(c) is None:
                out[c] = self.aligned([c])[0]
        return [out[c] for c in chunks]

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """As `align`, for chunks that may be joined; None for all where the bytes of the joined text differ."""
        if not chunks:
            return []
        raws = [(" " + c).encode("utf-8", "replace") for c in chunks]
        text, raw = " ".join(chunks), b"".join(raws)
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return [None] * len(chunks)
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b, ends = at[last_a], ends_a[last_a]
        links = self.pairs.number(ids_a[last_a], ids_b[last_b]).astype("<u4").tobytes()
        stop_a, stop_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        said_a, said_b = list(map(str, a)), list(map(str, b))
        groups = [f"{','.join(said_a[i:j])}|{','.join(said_b[k:l])}" for i, j, k, l in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b)]
        cuts = np.searchsorted(ends, np.cumsum([len(r) for r in raws]), "right").tolist()
        of = lambda stops, g: stops[g - 1] if g else 0
        return [(";".join(groups[g:h]), links[4 * g : 4 * h], of(stop_a, h) - of(stop_a, g) + (of(stop_b, h) - of(stop_b, g) << 32)) for g, h in zip([0, *cuts], cuts)]

    def measure(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, groups' digest, numbers of the links."""
        cut = [[] if BLANK in t or not t else self.chunks(t) for t in texts]
        cache = self.cache
        new = list({c for parts in cut for c in parts if c not in cache})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            cache.update(zip(some, self.align(some)))
        out = []
        for parts in cut:
            found = [cache[c] for c in parts]
            if not found or None in found:
                out.append((0, 0, "", b""))
                continue
            groups, links, sizes = zip(*found)
            total = sum(sizes)
            out.append((total & 0xFFFFFFFF, total >> 32, hashlib.sha256(";".join(groups).encode()).hexdigest(), b"".join(links)))
        over = len(cache) > self.entries
        for c in new:
            if over or len(c) > LONGEST_CACHED:
                del cache[c]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def distinct_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per distinct text that is not empty: digest, copies, n_a, n_b, groups_sha256, links."""
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    rows = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for b in slices(batches):
            n_a, n_b, sha, links = zip(*tool.measure(b.column("text").to_pylist())) if b.num_rows else ((), (), (), ())
            columns = [b.column("digest"), b.column("copies"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(sha, pa.string()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "copies", "n_a", "n_b", "groups_sha256", "links"])

    return rows.mapInArrow(run, "digest binary, copies long, n_a long, n_b long, groups_sha256 string, links binary")


def _flat(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Link numbers of a batch in one array, and how many each row has."""
    rows = links.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) // 4 for r in rows], np.int64)


def pair_counts(texts: DataFrame, size: int) -> DataFrame:
    """(pair, n): links of each pair in all documents. A task adds into one flat array and hands over what is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            links, per_row = _flat(b.column("links"))
            copies = np.repeat(b.column("copies").to_numpy(), per_row)
            order = np.argsort(links, kind="stable")
            if len(order):
                held, first = np.unique(links[order], return_index=True)
                total[held] += np.add.reduceat(copies[order], first)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})

    return texts.select("copies", "links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. And the id pairs: a, b, n."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = aligner(path_a, path_b).pairs
    texts = written(distinct_texts(docs, path_a, path_b), "align-texts")
    sums = written(pair_counts(texts, len(pairs)), "align-pairs")
    found = sums.toArrow()  # len(pairs) rows at most
    counts = np.zeros(len(pairs), np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(int(pairs.b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, pairs.b, counts)
    best = counts == highest[pairs.b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links, per_row = _flat(b.column("links"))
            ends = np.cumsum(per_row)
            within = lambda x: (s := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[ends] - s[ends - per_row]
            columns = [*(b.column(c) for c in ("digest", "n_a", "n_b", "groups_sha256")), *(pa.array(x, pa.int64()) for x in (per_row, per_row, within(best[links]), within(counts[links])))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n_a", "n_b", "groups_sha256", "n_groups", "n_links", "n_best", "count_sum"])

    measures = texts.mapInArrow(run, "digest binary, n_a long, n_b long, groups_sha256 string, n_groups long, n_links long, n_best long, count_sum long")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    joined = docs.filter("text <> ''").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).join(measures, "digest").select("doc_id", *names, "groups_sha256")
    bare = docs.filter("text is null or text = ''").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names), F.lit("").alias("groups_sha256"))
    key = spark.createDataFrame(pa.table({"pair": np.arange(len(pairs), dtype=np.int32), "a": pairs.keys >> 32, "b": pairs.b}))
    return joined.unionByName(bare), sums.join(key, "pair").select("a", "b", "n")
