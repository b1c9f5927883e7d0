import random

import numpy as np
from pyspark.sql import functions as F

from outcomelens.llm import leakage
from outcomelens.llm.words import bare_words

VOCABULARY = [f"word{k}" for k in range(400)]


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + ("." if k % 12 == 11 else "") for k in range(n))


def noise(seed, n=120):
    rng = random.Random(f"n{seed}")
    return " ".join(f"other{rng.randrange(500)}" for _ in range(n))


def changed(text, seed, every=9):
    rng = random.Random(seed)
    return " ".join("slip" if k % every == rng.randrange(every) == 0 else w for k, w in enumerate(text.split()))


def frames(spark):
    p = {i: passage(i) for i in range(5)}
    reordered = ". ".join(reversed(p[2].split(". ")))
    half = " ".join(p[3].split()[:30])
    docs = {
        1: noise(1) + " " + p[0] + " " + noise(2), 2: noise(3) + " " + changed(p[1], 1).upper() + "!!", 3: reordered, 4: noise(4) + half, 5: noise(5), 6: " ".join(p[4].split()[:9]) + noise(6),
        7: "", 8: None, 9: "<p>" + p[0].replace(" ", " <b>").replace(".", "&amp;") + "</p>", 10: p[0].replace(" ", "\\n"), 11: noise(7, 20_000) + " " + p[1], 12: (p[0] + " " + p[1]) * 3,
    }
    expected = {(1, 0), (2, 1), (3, 2), (4, 3), (9, 0), (10, 0), (11, 1), (12, 0), (12, 1)}
    rows = list(docs.items()) + [(1, docs[1])]
    extra = lambda df: df.withColumn("gram", F.lit(1)).withColumn("share", F.lit(2)).withColumn("lang", F.lit("en"))
    items = [(i, t) for i, t in p.items()] + [(8, None), (9, "")]
    return extra(spark.createDataFrame(rows, "doc_id bigint, text string")), extra(spark.createDataFrame(items, "item_id bigint, passage string")), expected


def test_leaks(spark):
    docs, items, expected = frames(spark)
    found = leakage.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted(expected)


def test_without_the_broadcast_filter(spark, monkeypatch):
    docs, items, expected = frames(spark)
    monkeypatch.setattr(leakage, "FILTER_BOUND", 0)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == expected


def test_no_items_or_documents(spark):
    docs, items, _ = frames(spark)
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def brute_score(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            same = leakage.MATCH if x == y and x >= 0 else leakage.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + leakage.GAP, h[i][j - 1] + leakage.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_is_optimal():
    rng = random.Random(0)
    for _ in range(200):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(1, 15))])
        columns = leakage.align(a, b)
        score, i, j = 0, None, None
        for x, y, same in columns:
            assert not same or a[x] == b[y]
        score = sum(leakage.MATCH if same else 0 for _, _, same in columns)
        # every column that does not match costs the same, as a mismatch or as a gap
        score += sum(leakage.GAP for _, _, same in columns if not same)
        assert score == brute_score(a, b), (a, b, i, j)


def test_words():
    assert bare_words("<b>Caf&eacute;</b>\\n\\u0041 x­yz 1,5") == ["café", "a", "xyz", "1", "5"]
    assert bare_words(None) == bare_words("") == []


def test_passages_shared_by_many_items(spark, monkeypatch):
    copies, template = passage(20), passage(21, 40)
    near = [" ".join(copies.split()[:57] + [f"end{k}"] * 3) for k in range(4)]
    items = [(k, copies) for k in range(5)] + [(10 + k, t) for k, t in enumerate(near)] + [(20 + k, template + " " + passage(30 + k, 20)) for k in range(6)]
    docs = [(1, noise(20) + " " + copies), (2, noise(21) + " " + template + " " + noise(22)), (3, noise(23) + " " + passage(30, 20))]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    expected = {(1, k) for k in (*range(5), *range(10, 14))} | {(2, 20 + k) for k in range(6)} | {(3, 20)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == expected
    monkeypatch.setattr(leakage, "FILTER_BOUND", 0)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == expected


def unseeded_share(passage, text):
    """leaked_share with the whole text aligned."""
    codes = {}
    p = np.array([codes.setdefault(w, len(codes)) for w in passage])
    t = np.array([codes.get(w, -1) for w in text])
    total, least = 0, min(leakage.LEAST_WORDS, len(passage))
    while True:
        columns = leakage.align(p, t)
        matches = [(i, j) for i, j, same in columns if same]
        if len(matches) < least:
            return total / len(passage)
        kept = [pair for stretch in leakage.stretches(columns, least) for pair in stretch]
        total += len(kept)
        for i, j in kept or matches:
            t[j] = -1
            p[i] = -2 if kept else p[i]


def edited(rng, words):
    """A stretch of the words with every k-th one changed, left out or preceded by another."""
    n = rng.randrange(len(words) // 2 if len(words) > 8 else len(words), len(words) + 1)
    at, every = rng.randrange(len(words) - n + 1), rng.randrange(2, 12)
    out = []
    for k, w in enumerate(words[at : at + n]):
        kind = rng.choice(("slip", "", f"more {w}", f"more {w}")) if k % every == every - 1 else w
        out += kind.split()
    return out


def test_short_and_edited_stretches_as_without_seeds(spark):
    rng = random.Random(7)
    passages = {k: passage(100 + k, rng.choice((1, 2, 3, 5, 6, 7, 8, 12, 24, 38))).replace(".", "").split() for k in range(60)}
    texts = {k: noise(200 + k, 15).split() + edited(rng, passages[k % 60]) + noise(300 + k, 15).split() for k in range(180)}
    twelve = passage(400, 38).replace(".", "").split()
    passages[60], texts[180] = twelve, ["slip" if k in (4, 9) else w for k, w in enumerate(twelve[:12])]
    passages[61], texts[181] = twelve[::-1], ["slip" if k % 4 == 3 else w for k, w in enumerate(twelve[::-1])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in passages.items()], "item_id bigint, passage string")
    expected = {(d, i) for d, t in texts.items() for i, p in passages.items() if unseeded_share(p, t) >= leakage.SHARE}
    assert {(180, 60), (181, 61)} <= expected and {len(passages[i]) for _, i in expected} >= {1, 2, 3, 5, 6, 7, 8}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == expected


def test_alignment_in_blocks_of_rows(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))])
        b = np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(1, 80))])
        whole = leakage.align(a, b)
        monkeypatch.setattr(leakage, "CELLS", 0)
        assert leakage.align(a, b) == whole
        monkeypatch.undo()


def test_column_scores_bound_the_words_of_all_stretches():
    rng = random.Random(10)
    texts = [np.array([rng.randrange(-1, 9) for _ in range(rng.randrange(0, 90))], int) for _ in range(40)]
    passage = np.array([rng.randrange(9) for _ in range(30)])
    for text, scores in zip(texts, leakage.column_scores(passage, texts)):
        assert scores.max(initial=0) == brute_score(passage, text)
        assert leakage.most_words(scores, 8) >= unseeded_share(list(passage), list(text)) * len(passage) - 1e-9 or len(text) == 0


def test_a_long_text_is_searched_whole(spark):
    p = passage(50)
    text = " ".join([noise(51, 3000), p, noise(52, 3000), p[: len(p) // 2], noise(53, 3000)] + [" ".join(p.split()[:3])] * 2000)
    found = leakage.leaks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(1, p)], "item_id bigint, passage string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]


def test_recall_on_regular_edits(spark):
    """Every word at a multiple of 4, 5 or 6 changed: identity 0.75 and more. Every third is below IDENTITY by definition."""
    found = {}
    items = spark.createDataFrame([(k, passage(500 + k)) for k in range(40)], "item_id bigint, passage string")
    for every in (3, 4, 5, 6):
        docs = [(k, noise(600 + k, 60) + " " + " ".join("slip" if j % every == every - 1 else w for j, w in enumerate(passage(500 + k).split())) + " " + noise(700 + k, 60)) for k in range(40)]
        rows = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
        assert all(r.doc_id == r.item_id for r in rows)
        found[every] = len(rows)
    assert found[3] < 40 and found[4] == found[5] == found[6] == 40


def test_passages_shared_by_fifty_items(spark):
    shared = passage(800)
    items = spark.createDataFrame([(k, shared + (f" end{k}" if k % 2 else "")) for k in range(50)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, noise(801) + " " + shared), (2, noise(802))], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(1, k) for k in range(50)}


def test_scripts_without_spaces(spark):
    text = "模型在训练时会看到大量的文本其中一部分可能来自评测集所以必须仔细检查"
    assert bare_words("ab漢字cd 東") == ["ab", "漢", "字", "cd", "東"]
    docs = spark.createDataFrame([(1, "前言很短。" + text + "。后面还有别的话"), (2, "完全不同的句子没有任何关系")], "doc_id bigint, text string")
    assert [r.doc_id for r in leakage.leaks(docs, spark.createDataFrame([(7, text)], "item_id bigint, passage string")).collect()] == [1]
