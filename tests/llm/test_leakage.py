import random

import numpy as np

from linkloom.llm import leakage as L

WORDS = "kiln weir ledger harbour lantern mason candle bolt granary fathom hinge tile nail rope barrel clerk map seal winter salt strait mule foundry almanac gate brick tower bell page coin".split()


def passage(rng, n=70):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(10, 999)) if rng.random() < 0.3 else "") for _ in range(n))


def cases():
    rng = random.Random(8)
    items = [(k, passage(rng)) for k in range(12)]
    docs, want = [], set()
    filler = lambda n: " ".join(rng.choice("people river news market street garden office letter minister budget".split()) for _ in range(n))
    for d in range(60):
        k = d % 12
        words = items[k][1].split()
        kind = d // 12
        if kind == 0:
            part = words
        elif kind == 1:
            part = [w.upper() + "," for w in words[20:55]]
        elif kind == 2:
            part = [("other" if i % 11 == 5 else w) for i, w in enumerate(words[5:60])]
        elif kind == 3:
            part = words[:18] + "so they said and nobody knew why".split() + words[18:40]
        else:
            part = words[10:22]
        if kind < 4:
            want.add((d, k))
        docs.append((d, filler(rng.randint(0, 200)) + " " + " ".join(part) + " " + filler(rng.randint(0, 200))))
    docs += [(100, None), (101, ""), (102, filler(3000)), (103, passage(rng, 400))]
    return docs, items, want


def test_leaks_against_cases(spark):
    docs, items, want = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as item_id", "'q' as passage")
    i = spark.createDataFrame(items, "item_id long, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()} == want


def test_candidate_search_recall(spark):
    """Retrieval finds all pairs that the check alone finds over all pairs."""
    docs, items, _ = cases()
    import pandas as pd

    prepared = L._prepared(pd.DataFrame(items, columns=["item_id", "passage"]))
    settings = L.Settings()
    brute = {(d, p.item_id) for d, t in docs for p in prepared if L.covered_share(p, L.words_of(t), settings) >= settings.min_share}
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert L.common_subsequence(a, b) == t[-1][-1]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    i = spark.createDataFrame([(1, None), (2, "x")], "item_id long, passage string")
    assert L.leaks(d, i).count() == 0
    assert L.leaks(d.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, passage string")).count() == 0


def test_index_against_all_windows():
    """The clusters find nearly all passages that a comparison with every window finds."""
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    topics = unit(rng.standard_normal((60, 48)))
    windows = unit(topics[rng.integers(0, 60, 900)] + 0.12 * rng.standard_normal((900, 48))).astype(np.float32)
    owner = np.arange(900) // 5
    centres, members = L._clusters(windows, 1)
    assert sorted(np.concatenate(members)) == list(range(900))
    space = L.Space([], {}, windows, windows, windows, windows, owner, centres, members, L.Settings(), 1)
    blocks = unit(windows[rng.integers(0, 900, 200)] + 0.1 * rng.standard_normal((200, 48)))
    brute = {(int(i), int(owner[j])) for i, j in zip(*np.nonzero(blocks @ windows.T >= L.Settings().min_cosine))}
    found = space.near(blocks)
    assert found <= brute and len(found) >= 0.95 * len(brute)
