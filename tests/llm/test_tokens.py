"""BPE codec, record files and packing against the libraries and brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, records
from tidemark.llm.shared import workspace
from tidemark.llm.tokens import library_encoder

random.seed(7)
ODD = ["", " ", "  a", "a\n ", "a\n \nb", "a  b   c ", "\x1c a\x1d\x1e b", "don't I'll 'tis 123 45a", "ab" * 3000, "!!??" * 50, "é ́b", "a \x85 b", "a  b", "<|endoftext|> x<|endoftext|>", "\x00 a \x00"]
ODD += ["".join(random.choice(" \n\ta'1.é\x1c\x00 ") for _ in range(random.randint(1, 14))) for _ in range(400)]
ODD += ["İ: a İ. İstanbul:", "a <|startoftext|> b", "<|ENDOFTEXT|> <|endoftext|>", " <|endoftext|>", "Word.\nNext%%\nÉté, ÀÖ! ß ÿ.", "ab.\n cd", "ab\n\ncd", "x's y'll.", "µm ªº ×÷ K ſ."]
ODD += [" ".join("".join(random.choice("aBéÀİßſ\u0307\u0301.,:%'1\n<|>") for _ in range(random.randint(1, 7))) for _ in range(12)) for _ in range(600)]


def docs(spark, extra=True):
    rows = [(i, t, "en", "x", 0, "clash") for i, t in enumerate(ODD)] + [(3, "a\n ", "en", "x", 0, "clash"), (3, "a\n ", "en", "x", 0, "clash"), (None, "none", None, None, None, None), (9_999, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, ids string")


def test_bpe_equals_library():
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t, ids in zip(ODD, codec.chunks.batch(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), repr(t)


def one_by_one(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[x] for x in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_one_rank_queue_serves_all_pre_tokens():
    """Ranks in any order, so that a merge can bring up a lower rank while others of its bucket still wait."""
    for turn in range(60):
        ways = random.Random(turn)
        tokens = [b"a", b"b", b"c", *{bytes(ways.choice(b"abc") for _ in range(ways.randint(2, 6))) for _ in range(90)}]
        ways.shuffle(tokens)
        ranks = {t: 3 * i for i, t in enumerate(tokens)}
        pieces = [bytes(ways.choice(b"abc") for _ in range(ways.choice([0, 1, 2, 5, 9, 30]))) for _ in range(80)]
        want = [[ranks[p]] if p in ranks else one_by_one(ranks, p) for p in pieces]
        got = bpe.RankQueue(ranks).merge_all(pieces)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    with pytest.raises(KeyError):
        bpe.RankQueue(ranks).merge_all([b"abz"])


def test_bpe_decodes_slices_of_lists():
    import pyarrow as pa

    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lists = pa.array([[1, 2], None, [], [50, 300, 7], [9]], pa.list_(pa.int32()))
    names = {i: b for b, i in codec.ranks.items()}
    want = [b"".join(names[i] for i in x or []) for x in lists.to_pylist()]
    for at in range(6):
        assert codec.decode(lists.slice(at)).to_pylist() == want[at:]
        assert codec.decode(lists.slice(0, at)).to_pylist() == want[:at]


def test_bpe_digests(spark):
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    frame = docs(spark)
    want = []
    for r in frame.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    got = [tuple(r) for r in bpe.digests(frame, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(frame.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_equal_whole_texts(file, spaced):
    model = Tokenizer.from_file(P.path(file))
    for t, ids in zip(ODD, library_encoder(P.path(file), spaced).batch(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_round_trip(spark):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    frame, start, want = docs(spark), 0, []
    got = [tuple(r) for r in records.round_trip(frame, P.path("word_bpe_49k.json")).orderBy("start").collect()]
    texts = {}
    for r in frame.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        for t in texts[key]:
            ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4")
            want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert got == want
    assert records.round_trip(frame.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_records_seek_and_damage(spark):
    folder = workspace(spark, "records-test")
    manifest = records.write_records(docs(spark), records.with_end(P.path("word_bpe_49k.json"), 1, False), folder)
    row = manifest.orderBy("part").first()
    rows = records.read_records(spark, manifest, folder).orderBy("start").collect()
    assert records.read_record(folder, row["path"], 1).tobytes() == rows[1]["ids"]
    data = bytearray(records.frame(np.arange(5)))
    assert records.read_frame(io.BytesIO(bytes(data))).tolist() == [0, 1, 2, 3, 4]
    assert records.read_frame(io.BytesIO(records.frame(np.array([70_000])))).tolist() == [70_000]
    data[15] ^= 1
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(bytes(data)))


def test_fillings_are_closest():
    for _ in range(200):
        counts = {random.randint(1, 40): random.randint(1, 4) for _ in range(random.randint(0, 6))}
        capacity = random.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.best_filling(counts, capacity)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_packing_holds_every_id_once(spark):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    frame = docs(spark)
    rows = packing.pack_documents(frame, records.with_end(P.path("byte_bpe_50k.json"), 0, True), 64).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 64
    want = []
    for r in frame.collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes()), len(ids)) for i in range(0, len(ids), 64)]
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    assert sum(at.values()) / (64 * len(at)) > 0.95
    assert packing.pack_documents(frame.limit(0), records.with_end(P.path("byte_bpe_50k.json"), 0, True)).count() == 0
