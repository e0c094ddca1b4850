"""Rules, classifier, lines, urls, chat, nearest neighbours and the Jaccard join against brute force on small fixtures."""

import itertools
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import ann, chat, cotrain, jaccard, lines, packing, rules, urls

random.seed(3)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus():
    base = words(80, 1).split()
    rows = [(i, words(60 + i, i) + ".\nshared footer", "en", "s", 10, "own") for i in range(40)]
    for i in range(40, 60):
        w = list(base)
        for j in range(i % 4):
            w[(7 * i + 13 * j) % 80] = f"edit{i}{j}"
        rows.append((i, " ".join(w), "fr", None, None, "own"))
    rows += [(60, None, None, None, None, None), (61, "", "en", "s", 0, "own"), (62, "one two", "en", "s", 7, "own"), (63, "ONE two", "en", "t", 7, "own"), (64, "x " * 30_000, "en", "t", 1, "own")]
    return rows + [(50, " ".join(base), "fr", None, None, "own"), rows[0], rows[0], (None, words(70, 99), "de", "t", 5, "own"), (70, "AAA!! " * 70, "en", "s", 420, "own")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def brute_counts(text):
    w = WORD.findall(text or "")
    ls = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(ls) if WORD.search(x) and x in ls[:i])
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {t for t in tri if tri.count(t) > 1} if len(tri) < 500 else set(tri)
    hit = {j for i, t in enumerate(tri) if t in many for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_rule_counts(docs):
    got = rules.judge(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        n = brute_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    assert rules.judge(docs.limit(0)).count() == 0


def test_rules_reject_outliers(spark):
    rows = [(i, words(120, i), "en", "s", 1, "") for i in range(200)] + [(900 + i, " ".join(f"{w}$$$&&&" for w in words(120, i).split()), "en", "s", 1, "") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert all(got[i] for i in range(200)) and not any(got[900 + i] for i in range(20))


def test_every_statistic_can_reject(spark):
    assert rules.CUT == pytest.approx(16.812, abs=1e-3) and rules.CONSISTENCY == pytest.approx(1.3616, abs=1e-3)
    lines_of = lambda i: [words(8, 1000 * i + j) for j in range(16)]
    again = lambda i: lines_of(i)[:12] + [" ".join(lines_of(i)[k] for k in (0, 1, 2, 3))]
    marked = lambda i: [x.replace(" ", ", ") for x in lines_of(i)]
    rows = [(i, "\n".join(lines_of(i)), "en", "s", 1, "") for i in range(200)]
    rows += [(300 + i, "\n".join(again(i)), "en", "s", 1, "") for i in range(4)] + [(400 + i, "\n".join(marked(i)), "en", "s", 1, "") for i in range(4)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert sum(not got[i]["kept"] for i in range(200)) <= 4
    for i in (*range(300, 304), *range(400, 404)):
        assert not got[i]["base_failed"] and not got[i]["kept"], got[i]


def test_concentration_takes_the_nearest_bins():
    import pandas as pd

    x = np.random.default_rng(0).normal(size=(100, rules.D))
    x[75:] += 50
    rows = [{"_group": "g", "bin": b, "n": 25, **{f"s{i}": x[25 * b : 25 * b + 25, i].sum() for i in range(rules.D)}, **{f"c{i}_{j}": (x[25 * b : 25 * b + 25, i] * x[25 * b : 25 * b + 25, j]).sum() for i in range(rules.D) for j in range(i, rules.D)}} for b in (3, 1, 0, 2)]
    out = rules.concentrate(pd.DataFrame(rows)).iloc[0]
    cov = np.cov(x[:75].T, bias=True) + np.diag(np.square(rules.FLOORS))
    assert np.allclose(out["centre"], x[:75].mean(0)) and np.allclose(np.array(out["inverse"]).reshape(rules.D, rules.D), np.linalg.inv(cov))


def test_classifier(spark):
    good = [(i, words(80, i), "en", f"s{i % 3}", 400, "own") for i in range(120)]
    bad = [(i, words(80, i).upper().replace(" ", "!! "), "en", f"s{i % 3}", 400, "own") for i in range(120, 200)]
    frame = spark.createDataFrame(good + bad + [(None, None, None, None, None, None), good[0]], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 200, 2)] + [(999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(frame, labels).collect()
    assert len(got) == 202 and {c for c in got[0].asDict()} == {"doc_id", "text", "lang", "source", "n_chars", "text_score", "meta_score", "score", "kept"}
    held_out = [r["kept"] == (r["doc_id"] < 120) for r in got if r["doc_id"] is not None and r["doc_id"] % 2]
    assert np.mean(held_out) > 0.97
    assert cotrain.classify(frame.limit(0), labels).count() == 0
    assert {r["score"] for r in cotrain.classify(frame, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in cotrain.classify(frame, labels.limit(0)).collect()} == {1.0}


def test_all_unlabelled_documents_take_part(spark):
    """Source `rare` has no labels and the largest digests of its ids, so no bounded pool of 6,000 holds it."""
    order = [r["id"] for r in spark.range(6_600).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    texts = [words(60, i) for i in range(40)]
    bad = lambda i, n: n >= 6_300 or i % 2 == 0
    rows = [(i, texts[i % 40].upper().replace(" ", "!! ") if bad(i, n) else texts[i % 40], "en", "rare" if n >= 6_300 else "b" if bad(i, n) else "a", 400, "") for n, i in enumerate(order)]
    labels = spark.createDataFrame([(i, int(not bad(i, n))) for n, i in enumerate(order[:200])], "doc_id long, quality int")
    got = cotrain.classify(spark.createDataFrame(rows, SCHEMA), labels, ["doc_id", "source"]).groupBy("source").agg({"meta_score": "max"}).collect()
    score = dict(map(tuple, got))
    assert score["b"] < 0.1 and score["a"] > 0.9 and score["rare"] < 0.1, score


def test_lines(docs):
    got = lines.drop_boilerplate(docs.withColumnRenamed("kept", "n_lines")).collect()
    rows = corpus()
    assert len(got) == len(rows)
    count, pages = {}, {}
    for r in rows:
        pages[r[3]] = pages.get(r[3], 0) + 1
        for x in {x for x in (r[1] or "").split("\n") if x.strip(" ")} if r[1] is not None else ():
            count[r[3], x] = count.get((r[3], x), 0) + 1
    drop = {k for k, n in count.items() if n >= lines.MIN_PAGES and n > pages[k[0]] * lines.RATIO}
    assert ("s", "shared footer") in drop
    want = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x) not in drop)) for r in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    cases = [("http://A.example.ORG/en/1?x", "a.example.org", "/en/1", "example.org/en/1", "block"), ("x://b.org", "b.org", "", None, "allow"), (None, "", "", None, "allow"), ("no url", "", "", None, "allow"), ("h://notorg/x#y", "notorg", "/x", None, "allow"), ("h://e.com/de/9#a/b", "e.com", "/de/9", "com/de/", "block"), ("h://example.org/es/2", "example.org", "/es/2", "example.org/es/", "block"), ("h://É.org/es/2", "É.org", "/es/2", "org/", "allow")]
    pages = spark.createDataFrame([(i, c[0], "") for i, c in enumerate(cases)] + [(0, cases[0][0], "")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(5, None)], "doc_id long, quality int")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:]
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_url_templates_reject_impure_branches(spark):
    rows = [(i, f"http://h.net/good/{i}") for i in range(40)] + [(100 + i, f"http://h.net/bad/{100 + i}") for i in range(40)] + [(300 + i, f"http://w.net/{'ab'[i % 2]}x{chr(97 + i)}q/p") for i in range(26)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all(got[i]["verdict"] == "allow" and got[i]["template"] == "/good/{n}" for i in range(40))
    assert all(got[100 + i]["verdict"] == "block" for i in range(40))
    assert {got[300 + i]["template"] for i in range(26)} <= {"/*/p", "/*/*"}


def test_chat(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    pairs = spark.createDataFrame([(1, t(("user", "q"), ("assistant", "a")), t(("user", "q"), ("assistant", "b"), (None, None))), (2, t(("user", "q")), t(("user", "q"))), (3, [], t(("user", "q")))], "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["id"]: r for r in chat.format_preferences(pairs, "id").collect()}
    assert got[1]["prompt"] == "<|user|>\nq<|end|>\n" and got[1]["n_prefix"] == 1
    assert got[1]["chosen"] == "<|assistant|>\na<|end|>\n" and got[1]["chosen_mask"] == "14:0,9:1" and got[1]["rejected_mask"] == "14:0,9:1,5:0,8:0"
    assert (got[2]["n_prefix"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "") and got[3]["prompt"] == ""
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "z"), (None, 0, "user", "lost"), (3, 1, "assistant", None), (3, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in chat.format_preferences(chat.conversation_pairs(turns), "conv_id").collect()} == {1, 2, 3}
    assert chat.conversation_pairs(turns.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:380] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (1004, []), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, frame.filter("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
    assert set(got) == set(range(0, 600, 20)) and hits / 300 >= 0.9
    few = frame.filter("vec_id < 5")
    assert ann.search(few, few, 10).groupBy("query_id").count().filter("count != 4").count() == 0
    assert ann.search(frame.limit(0), frame, 10).count() == 0


def brute_components(rows, k, num, den):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            old, new = comp[b], comp[a]
            comp = [new if c == old else c for c in comp]
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, math.inf), math.inf if r[0] is None else r[0])
    return sorted(((r[0], len(s), (None if least[c] == math.inf else least[c]) if s else r[0]) for r, s, c in zip(rows, sets, comp)), key=str)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(docs, k, num, den):
    got = sorted((tuple(r) for r in jaccard.join(docs, k, num, den).collect()), key=str)
    assert got == brute_components(corpus(), k, num, den)
    assert jaccard.join(docs.limit(0), k, num, den).count() == 0


def test_word_digests_do_not_depend_on_the_cache(monkeypatch):
    text = words(400, 5) + " " + "é" * 5000
    whole = jaccard.shingles([text, None, "", text.upper()], 3)
    monkeypatch.setattr(jaccard, "WORD_ENTRIES", 1)
    for a, b in zip(whole, jaccard.shingles([text, None, "", text.upper()], 3)):
        assert np.array_equal(a, b)


def test_jaccard_keeps_texts_apart_that_defeat_polynomial_hashes(spark):
    """Words of 1,024 letters after the Thue-Morse sequence and its complement have equal polynomial hashes modulo 2**64 for every base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    frame = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.join(frame).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30)] + [(70, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == docs.columns, name
        rows = spark.createDataFrame(after.collect(), SCHEMA)
    left = {r["doc_id"] for r in rows.collect()}
    assert set(range(1, 40)) <= left and not {60, 61, 62, 63, 64, 70} & left
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == left
    assert packing.WINDOW >= max(p["offset"] + p["length"] for p in pieces)


def test_one_of_many_copies_keeps_its_text(spark, docs, tmp_path):
    """Documents 40, 44, .. 56 and the second 50 are six equal pages of a source with 22. Another text of 50 stays by itself, and its id with it."""
    base = words(80, 1)
    copies = {r[0] for r in corpus() if r[1] == base}
    assert len(copies) == 6
    rows = corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()
    assert sum(r["text"] == base for r in rows) == 6
    assert not any("shared footer" in (r["text"] or "") for r in rows)
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert {r["doc_id"] for r in left if r["text"] == base} == {40, 50}
    assert {r["doc_id"] for r in left if not (r["text"] or "").strip()} <= {60, 61}


def test_workers_forget_words_at_the_end_of_a_task():
    """Also where the task is ended early; a worker that lives on holds none of them in later steps."""
    for whole in (True, False):
        jaccard.shingles(["some words of a text"], 2)
        assert jaccard._WORDS
        rows = jaccard._forgetting(iter([1, 2, 3]))
        assert (list(rows) == [1, 2, 3]) if whole else next(rows) == 1
        rows.close()
        assert not jaccard._WORDS


def test_the_filter_of_live_tokens_is_as_large_as_they_ask_for(spark, monkeypatch):
    asked, own = [], jaccard.membership
    monkeypatch.setattr(jaccard, "membership", lambda wanted, key, rows=None: asked.append(rows) or own(wanted, key, rows))
    rows = [(1, 1, False, 3, [5, 6, 7]), (2, 2, False, 3, [7, 8, 9]), (3, 2, True, 1, [8])]
    frame = spark.createDataFrame([(*r[:4], *[0] * 8, r[4]) for r in rows], "id long, component long, several boolean, n int, " + ", ".join(f"{b} long" for b in jaccard.BITS) + ", tokens array<long>")
    live = {(r["id"], r["token"]) for r in jaccard.live_tokens(frame).collect()}
    assert {(1, 7), (2, 7)} <= live and asked == [1]
