"""Min-max dedup, the prefix trie and token alignment against brute force on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import align, minmax, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def text_of(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefé") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus():
    base = text_of(120, 1).split()
    rows = [(i, text_of(40 + i, i)) for i in range(30)]
    for i in range(30, 80):  # near copies, some of them links of links only
        w = list(base)
        for j in range(i % 9):
            w[(7 * i + 13 * j) % 120] = f"edit{i}{j}"
        rows.append((i, " ".join(w)))
    chain = [f"w{i}" for i in range(100)]
    rows += [(80 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(10)]
    rows += [(95, None), (96, ""), (97, " \t\n"), (98, "One"), (99, "one"), (100, "one two"), (101, "ONE\ttwo"), (102, "x " * 30_000), (103, "x x"), (104, "İ é İ"), (105, "i̇ é i̇")]
    return rows + [(50, " ".join(base)), rows[0], rows[0], (None, rows[3][1]), (None, "alone by itself")]


def brute_sets(rows, k):
    out = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


@pytest.mark.parametrize("k,num", [(2, 80), (5, 80), (3, 90)])
def test_minmax_components(spark, k, num):
    rows = corpus()
    sets = brute_sets(rows, k)
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                of = [of[i] if x == of[j] else x for x in of]
    want = collections.Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        want[d, len(sets[i]), component, d == component] += 1
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, digest string")
    got = collections.Counter(tuple(r) for r in minmax.dedup(docs, k, num, 100).collect())
    assert got == want
    assert minmax.dedup(docs.limit(0)).count() == 0


def test_minmax_large_group_tries_few_pairs(spark, monkeypatch):
    base = text_of(200, 3).split()
    rows = []
    for i in range(400):
        w = list(base)
        for j in range(4):
            w[random.Random(5 * i + j).randrange(200)] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    tried = []
    plain = minmax.confirmed
    monkeypatch.setattr(minmax, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or plain(pairs, *a))
    got = minmax.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sum(tried) < 4 * len(rows)


def test_signature_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    one, other = minmax.signatures([minmax._mix(a + np.uint64(1)), minmax._mix(b + np.uint64(1))])
    assert abs((one == other).mean() - 800 / 1200) < 0.15
    assert minmax.least_agreement(80, 100) == 70


def conversations():
    r = random.Random(4)
    rows = []
    for c in [*range(0, 60), 100, 103, 1007, -3, -5]:
        if c in (10, 25):
            continue
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, "", "long " * 50, f"own {c}"])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]  # copies
    rows += [(300, t, "user", f"deep {t}") for t in range(700)]
    rows += [(1, None, "user", "null turn"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (3, 0, "a", "tie"), (None, 0, "user", "nobody"), (None, 1, "user", "nobody")]
    return rows


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    for c in own:
        own[c] = [x[3:] for x in sorted(own[c])]
    ids = {}

    def number(up, turn):
        return ids.setdefault((up, turn), len(ids) + 1)

    members, ends, up_of, turn_of, depth_of = collections.defaultdict(list), collections.defaultdict(list), {0: None}, {0: ("", "")}, {0: 0}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        at = 0
        members[0].append(c)
        for turn in own.get(base, [])[:h] + own[c][h:]:
            new = number(at, turn)
            up_of[new], turn_of[new], depth_of[new] = at, turn, depth_of[at] + 1
            at = new
            members[at].append(c)
        ends[at].append(c)
    kids = collections.Counter(up_of.values())
    leaves, saved = collections.Counter(), collections.Counter()
    for n in sorted(members, key=lambda n: -depth_of[n]):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * len(turn_of[n][1].encode())
        if n:
            leaves[up_of[n]] += leaves[n]
            saved[up_of[n]] += saved[n]
    return sorted((members[n][0], depth_of[n], None if not n else members[up_of[n]][0], len(members[n]), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def test_trie_equals_brute_force_and_sql(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted(map(tuple, trie.rebuilt_trie(table).collect()), key=lambda r: r[:2])
    assert got == brute_trie(rows)
    assert trie.rebuilt_trie(table.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(trie.oracle()).fetchall(), key=lambda r: r[:2]) == got


def test_slots_are_minimal_and_tell_strangers_apart():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 61, (3, 5000)), axis=1)
    slots = trie.Slots(keys)
    assert sorted(slots.of(keys)) == list(range(keys.shape[1]))
    assert (slots.of(r.integers(0, 1 << 61, (3, 5000))) == -1).all()
    assert (trie.Slots(keys[:, :0]).of(keys) == -1).all()


ODD = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "a", "the", " word", "é", "İ", "ﬁ", "①", "中", "😀", "\u0301", "'s", "!", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "0", "123", "();\r", "\u200b", "x" * 70, "слово"]


def plain(tool, text):
    """Ids of the whole text by both libraries, and the groups."""
    if not text:
        return [], [], []
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tool.bytes_a[i] for i in a) != raw or b"".join(tool.bytes_b[i] for i in b) != raw:
        return [], [], []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((tool.bytes_a, a), (tool.bytes_b, b))]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        k, l = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append((a[i:k], b[j:l]))
        i, j = k, l
    return a, b, groups


def test_alignment_equals_whole_texts(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    texts += [None, "", " ", "  ", "a▁b", "word " * 20_000] + texts[:40] * 3
    tool = align.aligner(*PATHS)
    rows = [(None if i == 7 else i % 1400, t) for i, t in enumerate(texts)]
    whole = [plain(tool, t) for t in texts]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, _, groups in whole for g in groups)
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = collections.Counter()
    for (d, _), (a, b, groups) in zip(rows, whole):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[d, len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""] += 1
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n_a int, digest string")
    found, pairs = align.align(docs, *PATHS)
    assert collections.Counter(map(tuple, found.collect())) == want
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(counts)
    assert align.align(docs.limit(0), *PATHS)[0].count() == 0


def test_cache_bounds_do_not_change_results():
    tool, small = align.aligner(*PATHS), align.Aligner(*PATHS, entries=3)
    texts = [text_of(50, i) for i in range(8)]
    assert [small.measure([t])[0] for t in texts] == tool.measure(texts) and len(small.cache) <= 60
