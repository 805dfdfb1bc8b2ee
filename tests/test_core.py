"""Core operators on inline rows with results derived by hand or by a plain model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.functions import vectors as V
from linkloom.operators import anchors, candidates, coref, evaluate, features, intervals, kb, ner, ranking, titles, tokens
from linkloom.operators.numbering import numbered
from linkloom.plans import core_queries, pipeline
from linkloom.session import cut_lineage
from linkloom.sources import documents, dumps, sinks


def value(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()
    return row["x"]


def test_anchor_probabilities(spark):
    rows = [("en", "apple", "apple_inc")] * 3 + [("en", "apple", "apple_fruit")] + [("en", "big apple", "new_york_city")] * 2
    df = spark.createDataFrame(rows, "lang string, surface string, title string")
    plain = {(r["surface"], r["title"]): r for r in anchors.pair_statistics(df).collect()}
    assert plain["apple", "apple_inc"]["p_title_given_surface"] == 0.75
    own = {(r["surface"], r["title"]): r for r in anchors.surface_title_statistics(df).collect()}
    assert own["apple", "apple_inc"]["p_surface_given_title"] == 0.75
    assert own["apple inc", "apple_inc"]["p_title_given_surface"] == 1.0
    assert len(own) == 6


def test_candidates_limit_before_filter_and_overrides(spark):
    stats = spark.createDataFrame([("en", "x", f"t{i}_people" if i < 9 else f"t{i}", 1, 1.0 / (i + 1), 0.5) for i in range(12)] + [("en", "new york", "new_york", 1, 0.9, 0.1), ("en", "new york", "new_york_city", 1, 0.1, 0.1)], "lang string, surface string, title string, cnt long, p_title_given_surface double, p_surface_given_title double")
    wanted = spark.createDataFrame([("en", "x"), ("en", "new york"), ("en", "none"), ("es", "x")], "lang string, surface string")
    top = candidates.by_surface(wanted, stats)
    assert top.where("surface = 'x'").count() == 10
    kept = candidates.apply_overrides(candidates.drop_unwanted(top))
    assert [r["title"] for r in kept.where("surface = 'x'").collect()] == ["t9"]
    assert [r["title"] for r in kept.where("surface = 'new york'").collect()] == ["new_york_city"]
    both = candidates.with_english_fallback(wanted, stats)
    assert {r["cand_lang"] for r in both.where("lang = 'es'").collect()} == {"en"}


def test_ngram_candidate_priority(spark):
    stats = spark.createDataFrame([("es", "a", "own", 1, 1.0, 1.0), ("en", "b c", "english", 1, 1.0, 1.0)], "lang string, surface string, title string, cnt long, p_title_given_surface double, p_surface_given_title double")
    words = spark.createDataFrame([("es", "d", "by_word", 1, 1.0, 1.0), ("en", "e", "english_word", 1, 1.0, 1.0)], "lang string, word string, title string, cnt long, p_title_given_word double, p_word_given_title double")
    grams = spark.createDataFrame([("es", "a", 1, True), ("es", "d", 1, True), ("es", "d", 1, False), ("es", "b c", 2, False), ("es", "e", 1, True), ("en", "b c", 2, True)], "lang string, surface string, n int, capitalised boolean")
    found = {(r["lang"], r["surface"], r["n"], r["capitalised"]): (r["title"], r["priority"]) for r in candidates.ngram_candidates(grams, stats, words).collect()}
    assert found == {
        ("es", "a", 1, True): ("own", 1), ("es", "d", 1, True): ("by_word", 2), ("es", "b c", 2, False): ("english", 3), ("es", "e", 1, True): ("english_word", 4), ("en", "b c", 2, True): ("english", 1),
    }


def test_character_grams_against_plain_count(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))).strip() or "a"
    names = sorted({text().replace(" ", "_") for _ in range(150)})
    # one title has the surface's rare grams, twelve others its common one only
    names += [f"wxyz{i}" for i in range(12)] + ["qrstuvwxyz"]
    rows = [(lang, t) for t in names for lang in ("en", "es")] + [("en", None), (None, "abc")]
    asked = sorted({text() for _ in range(60)} | {"qrstuvwxyz", "stuvwxyz"})
    surfaces = [(lang, s) for s in asked for lang in ("en", "es", "zh")] + [("en", ""), ("en", None), (None, "abc"), ("en", "abc")]
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)} if len(t) >= 4 else {t}
    want = set()
    for lang, s in {(a, b) for a, b in surfaces if a in ("en", "es") and b}:
        counts = [(-len(grams(s) & grams(t.replace("_", " ").strip().lower())), t) for t in {t for a, t in rows if a == lang and t}]
        want |= {(lang, s, t, -n, i + 1) for i, (n, t) in enumerate(sorted(c for c in counts if c[0])[:10])}
    stats = spark.createDataFrame(rows, "lang string, title string")
    wanted = spark.createDataFrame(surfaces, "lang string, surface string")
    columns = ("lang", "surface", "title", "shared", "rank")
    found = lambda: [tuple(r) for r in candidates.by_character_grams(wanted, stats).select(*columns).collect()]
    assert sorted(found()) == sorted(want)
    # in several blocks and parts the same
    monkeypatch.setattr(candidates, "BLOCK_TITLES", 20)
    monkeypatch.setattr(candidates, "PART_SURFACES", 15)
    assert sorted(found()) == sorted(want)
    assert candidates.by_character_grams(wanted.where("false"), stats).count() == 0


def test_title_functions(spark):
    assert value(spark, X.title_case(F.col("a")), a="new__york_cITY") == "New_York_CITY"
    assert value(spark, X.kb_title(F.col("a")), a="New york") == "New_york"
    assert value(spark, X.cut_parenthesis(F.col("a")), a="rio (city)") == "rio"
    assert value(spark, X.cut_parenthesis(F.col("a")), a="(x) y") == "(x) y"
    assert value(spark, X.gazetteer_case(F.col("a")), a="jean-luc de x") == "Jean-Luc De X"
    assert value(spark, X.hashtag(F.col("a")), a="new-york_city_(x)") == "newyorkcity"
    assert value(spark, X.simplified(F.col("a")), a="漢國") == "汉国"
    assert value(spark, X.edit_distance(F.col("a"), F.col("b")), a="café", b="cafe_(x)") == 1
    assert value(spark, X.jaccard(X.surface_tokens(F.col("a")), X.surface_tokens(F.col("b"))), a="john smith", b="smith") == 0.5
    assert value(spark, X.clean_surface(F.col("a"), F.col("b"))[1], a="ab <i>x", b=7) == 2
    assert value(spark, X.clean_surface(F.col("a"), F.col("b"))[0], a="<i>", b=3) == "<i>"


def test_vectors(spark):
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[3.0, 4.0]) == pytest.approx(1)
    with pytest.raises(Exception, match="different size"):
        value(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0])
    rows = spark.createDataFrame([("k", [1.0, 2.0], 1.0), ("k", [3.0, 6.0], 3.0), ("k", None, 9.0), ("z", [1.0, 1.0], 0.0)], "key string, vec array<double>, w double")
    means = {r["key"]: r["mean"] for r in ranking.mean_vector(rows, ["key"], "w").collect()}
    assert means == {"k": [2.5, 5.0], "z": [0.0, 0.0]}
    assert len(ranking.features_of(False)) == 20 and len(ranking.features_of(True)) == 11 and len(ranking.features_of(False, True)) == 8
    assert len(V.feature_products(ranking.BASE_FEATURES)) == 190


def test_mid_chain(spark):
    rows = spark.createDataFrame([("es", "rio"), ("es", "x"), ("es", "NIL"), ("es", None), ("zh", "北京"), ("es", "rio_de_janeiro")], "lang string, title string")
    known = spark.createDataFrame([("Rio", "en", "m.1"), ("Y", "en", "m.2"), ("北京", "zh-cn", "m.3"), ("Rio_De_Janeiro", "es", "m.4")], "title string, lang string, mid string")
    mapping = spark.createDataFrame([("es", "x", "y")], "lang string, title string, en_title string")
    found = {r["title"]: (r["mid"], r["mid_try"]) for r in kb.mid_chain(rows, known, mapping).collect()}
    assert found == {"rio": ("m.1", 2), "x": ("m.2", 3), "NIL": (None, None), None: (None, None), "北京": ("m.3", 1), "rio_de_janeiro": ("m.4", 1)}


def test_tokens_and_context(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "en", "Ab c. It's\nd"), (2, "en", ""), (3, None, None)], "doc_id long, lang string, text string")
    toks = tokens.tokens(docs)
    rows = toks.orderBy("tok_id").collect()
    assert [(r["token"], r["start"], r["end"], r["sent_id"]) for r in rows] == [("Ab", 0, 2, 0), ("c", 3, 4, 0), (".", 4, 5, 0), ("It", 6, 8, 1), ("'", 8, 9, 1), ("s", 9, 10, 1), ("d", 11, 12, 2)]
    spans = spark.createDataFrame([(7, 1, 3, 4), (8, 1, None, 4), (9, 1, 99, 120)], "mention_id long, doc_id long, start int, end int")
    assert [tuple(r) for r in tokens.token_spans(spans, toks).collect()] == [(7, 1, 1, 1)]
    assert sorted(r["word"] for r in tokens.context_words(spans, toks, 1).collect()) == [".", "ab"]
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c.\nИ中") for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None]
    many = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    places = [(k, rng.randrange(21), rng.choice([None, *range(-1, 60)]), rng.choice([None, *range(0, 60)])) for k in range(300)]
    asked = spark.createDataFrame(places, "mention_id long, doc_id long, start int, end int")
    plain = sorted(tuple(r) for r in tokens.context_words(asked, tokens.tokens(many), 3).collect())
    assert plain and sorted(tuple(r) for r in tokens.text_contexts(asked, many, 3, block=7).collect()) == plain
    stops = spark.createDataFrame([("en", "ab"), ("en", "it"), ("es", "c"), (None, "d")], "lang string, word string")
    flagged = lambda: sorted((r["surface"], r["n"], r["is_stop"]) for r in tokens.ngrams_upto(toks, 2, stops).collect())
    few = flagged()
    assert ("Ab", 1, True) in few and ("It", 1, True) in few and ("c", 1, False) in few and ("Ab c", 2, False) in few
    monkeypatch.setattr(tokens, "MAX_STOPS", 1)  # as with a list too large to be sent
    assert flagged() == few
    two = {r["surface"] for r in tokens.ngrams(toks, 2).collect()}
    assert "Ab c" in two and "c ." in two and ". It" not in two


def test_bio_round_trip(spark):
    labels = [(1, 0, i, t) for i, t in enumerate("B-PER I-PER O B-ORG I-ORG".split())] + [(1, 1, 5, "O"), (1, 1, 6, "B-LOC")]
    df = spark.createDataFrame(labels, "doc_id long, sent_id long, tok_id int, label string").withColumns({"start": F.col("tok_id") * 2, "end": F.col("tok_id") * 2 + 1})
    assert sorted(r["mention_type"] for r in intervals.bio_decode(df).collect()) == ["LOC", "ORG", "PER"]
    assert [r["mention_type"] for r in intervals.bio_decode(df, emit_trailing=False).collect()] == ["PER"]


def test_overlap_antijoin_keeps_nulls(spark):
    spans = spark.createDataFrame([(1, 1, 11, 13), (2, 1, 21, 23), (3, 1, None, None), (4, 2, 11, 13)], "mention_id long, doc_id long, start int, end int")
    bad = spark.createDataFrame([(1, 2, 21)], "doc_id long, start int, end int")
    assert sorted(r["mention_id"] for r in intervals.drop_overlapping(spans, bad).collect()) == [2, 3, 4]


def test_nested_against_plain_pass(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(40):
        for k in range(rng.randint(0, 14)):
            start = rng.randint(0, 60)
            rows.append((doc * 100 + k, doc, start, start + rng.randint(1, 12)))
    df = spark.createDataFrame(rows, "mention_id long, doc_id long, start int, end int")
    got = {r["mention_id"] for r in intervals.resolve_nested(df).collect()}
    want = set()
    for doc in range(40):
        own = sorted((r for r in rows if r[1] == doc), key=lambda r: (r[2], r[3], r[0]))
        want |= {own[i][0] for i in intervals.kept_spans([(r[2], r[3], r[3] - r[2]) for r in own])}
    assert got == want


def test_person_containment(spark):
    rows = [(1, 1, 0, "Barack Hussein Obama", "PER", "m1", "t1", 0.7), (2, 1, 9, "Barack", "PER", "NIL", None, 0.1), (3, 1, 20, "Obama", "PER", "m9", "t9", 0.2), (4, 1, 30, "Obama", "ORG", "m8", "t8", 0.3), (5, 2, 0, "Obama", "PER", "m7", "t7", 0.4)]
    df = spark.createDataFrame(rows, "mention_id long, doc_id long, start int, surface string, mention_type string, mid string, wiki_title string, confidence double")
    got = {r["mention_id"]: (r["mid"], r["confidence"]) for r in coref.person_containment(df).collect()}
    assert got == {1: ("m1", 0.7), 2: ("m1", 0.7), 3: ("m1", 0.7), 4: ("m8", 0.3), 5: ("m7", 0.4)}


def test_containment_against_plain_search(spark):
    rng = random.Random(6)
    rows = [(i, i % 9, i, "".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))).strip() or "a", "PER", f"m{i}", f"t{i}", 0.5) for i in range(260)]
    df = spark.createDataFrame(rows, "mention_id long, doc_id long, start int, surface string, mention_type string, mid string, wiki_title string, confidence double")
    want = {}
    for i, doc, _, s, _, mid, _, _ in rows:
        outer = [r for r in rows if r[1] == doc and len(r[3]) > len(s) and s in r[3]]
        want[i] = min(outer, key=lambda r: (-len(r[3]), r[2]))[5] if outer else mid
    assert {r["mention_id"]: r["mid"] for r in coref.person_containment(df).collect()} == want


def test_extreme_cosines_in_blocks(spark):
    rng = random.Random(2)
    rows = [(g, i, [rng.gauss(0, 1) for _ in range(4)]) for g in (1, 2) for i in range(23)] + [(3, 1, [1.0, 0.0, 0.0, 0.0]), (4, 1, None)]
    df = spark.createDataFrame(rows, "doc long, id long, vec array<double>")
    got = {(r["doc"], r["id"]): (r["cos_max"], r["cos_min"]) for r in ranking.extreme_cosines_within(df, "doc", block=5).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for g, i, v in rows:
        others = [cos(v, w) for h, j, w in rows if h == g and j != i and v and w]
        assert got[g, i] == pytest.approx((max(others, default=0.0), min(others, default=0.0)))


def test_training_selection(spark):
    men = spark.createDataFrame([(i, i // 4, "en", f"s{i}", f"gold {i}", "m.1" if i % 2 else "m.2") for i in range(40)], "mention_id long, doc_id long, lang string, surface string, gold_wiki_title string, mid string")
    cands = spark.createDataFrame([("en", f"s{i}", f"gold_{i}", 1 if i % 8 else 2) for i in range(40)], "lang string, surface string, title string, rank int")
    types = spark.createDataFrame([("m.1", ["people.person"]), ("m.2", ["x.y"])], "mid string, types array<string>")
    found = ranking.select_training(men, cands, types, ratio=2.0).collect()
    assert found == []  # documents with a main type lose the others, among them all hard ones
    found = ranking.select_training(men.withColumn("mid", F.lit("m.1")), cands, types, ratio=2.0).collect()
    assert sum(r["kind"] == "hard" for r in found) == 5 and sum(r["kind"] == "easy" for r in found) == 10


def _jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def _greedy(surfaces):
    """Clusters of (id, surface) in order: each takes in later ones that overlap by more than a half."""
    leader = {}
    for i, (x, s) in enumerate(surfaces):
        if x in leader:
            continue
        leader[x] = x
        for y, t in surfaces[i + 1 :]:
            if y not in leader and _jaccard(s, t) > 0.5:
                leader[y] = x
    return leader


def test_surface_clusters_equal_the_greedy_pass(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(60):
        own = []
        for k in range(rng.randint(1, 9)):
            own.append((doc * 100 + k, " ".join(rng.sample("a b c d e".split(), rng.randint(1, 4)))))
        rows += [(i, doc, s, "PER", "NIL") for i, s in own]
        order = sorted(own, key=lambda r: (-len(r[1]), r[0]))
        # equal token sets stand at their first member's place
        seen: dict = {}
        for i, s in order:
            seen.setdefault(frozenset(s.split()), []).append((i, s))
        firsts = sorted((min(m)[0], len(m[0][1]), m) for m in seen.values())
        led = _greedy([(m[0], m[2][0][1]) for m in sorted(firsts, key=lambda f: (-f[1], f[0]))])
        for first, _, members in firsts:
            for i, _ in members:
                want[i] = led[first]
    df = spark.createDataFrame(rows, "mention_id long, doc_id long, surface string, mention_type string, mid string")
    got = {r["mention_id"]: r["cluster_id"] for r in coref.cluster_surfaces(df, ["doc_id"]).collect()}
    assert got == {i: f"NIL{w:05d}" for i, w in want.items()}


def test_greedy_order_isnt_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    assert {r["node"]: r["leader"] for r in coref.lead_and_follow(nodes, edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    none = spark.createDataFrame([], "a long, b long")
    assert {r["node"]: r["leader"] for r in coref.lead_and_follow(nodes, none).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "d", 0, 2, "PER", "m1"), (2, "d", 5, 8, "ORG", "NIL1"), (3, "d", 9, 12, "PER", "m3"), (4, "d", 20, 22, "PER", "m4")], "id long, doc string, start int, end int, type string, mid string")
    pred = spark.createDataFrame([(1, "d.xml", 0, 2, "PER", "m1", ["m1"]), (2, "d.xml", 5, 8, "PER", "NIL", []), (3, "d.xml", 30, 31, "PER", "m", [])], "id long, doc string, start int, end int, type string, mid string, cand_mids array<string>")
    scores = {r["level"]: r for r in evaluate.precision_recall(evaluate.match_gold(pred, gold), gold.agg(F.count("*").alias("n_gold"))).collect()}
    assert (scores["span"]["precision"], scores["span"]["recall"]) == (pytest.approx(2 / 3), 0.5)
    assert (scores["type"]["precision"], scores["type"]["recall"]) == (pytest.approx(1 / 3), 0.25)
    assert scores["link"]["correct"] == 1


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["v"] + 1 == r["number"] for r in numbered(df, ["v"]).collect())


def test_dump_rows(spark):
    line = "INSERT INTO `page` VALUES (10,0,'A_b,_c','',0,0,1,0.5),(11,0,'It\\'s_(x)','',0,1,0,0.1),(12,1,'Talk','',0,0,0,0.1);"
    df = spark.createDataFrame([(line,), ("-- comment",)], "value string")
    assert [tuple(r) for r in dumps.dump_pages(df).collect()] == [(10, "a_b,_c", 0)]
    assert [tuple(r) for r in dumps.dump_pages(df, True).collect()] == [(11, "it's_(x)", 1)]
    links = spark.createDataFrame([("INSERT INTO `langlinks` VALUES (10,'en','New York'),(10,'fr','N');",)], "value string")
    assert [tuple(r) for r in dumps.dump_langlinks(links, "en").collect()] == [(10, "en", "new_york")]


def test_quotes_authors_and_offsets(spark):
    df = spark.createDataFrame([("d", "ab<quote x>cd</quote>ef <AUTHOR> Jo Doe </AUTHOR>"), ("e", None)], "doc_name string, xml string")
    assert [tuple(r) for r in documents.quoted_intervals(df).collect()] == [("d", 2, 21)]
    a = documents.authors(df).first()
    assert (a["start"], a["end"], a["surface"]) == (33, 39, "Jo Doe")
    aligned = documents.align_offsets(df.withColumn("text", documents.plain_text(F.col("xml"))))
    rows = {(r["plain_start"], r["plain_end"]): (r["xml_start"], r["xml_end"]) for r in aligned.collect()}
    assert rows[0, 2] == (0, 2) and rows[3, 5] == (11, 13)


def test_ere_round_trip(spark):
    df = spark.createDataFrame([(1, 5, 3, 7, "A & B", "PER", "m.1", "NAM"), (2, 5, 9, 10, "A", "PER", "m.1", "NAM")], "mention_id long, doc_id long, start int, end int, surface string, mention_type string, mid string, noun_type string")
    xml = sinks.ere_documents(df, legacy_length=False)
    entities = xml.select(F.col("doc_id").cast("string").alias("doc_name"), F.explode(F.regexp_extract_all("xml", F.lit("(?s)<entity .*?</entity>"), F.lit(0))).alias("entity"))
    got = sorted((r["start"], r["end"], r["surface"], r["mention_type"]) for r in documents.ere_mentions(entities).collect())
    assert got == [(3, 7, "A & B", "PER"), (9, 10, "A", "PER")]


def test_gold_reader_rejects_unknown_language(spark):
    ok = spark.createDataFrame([("s\tid\tx\tENG_NW_1:0-2\tm.1\tPER\tNAM",)], "value string")
    assert documents.gold_mentions(ok).first()["end"] == 3
    with pytest.raises(Exception, match="unknown language"):
        documents.gold_mentions(spark.createDataFrame([("s\tid\tx\tDEU_NW_1:0-2\tm.1\tPER\tNAM",)], "value string")).collect()


def test_gold_reader_reads_every_line(spark, tmp_path):
    lines = [
        "gold\tE1\tx\tENG_NW_1:0-2\tm.1\tPER\tNAM", 'gold\tE2\t"a ""b""\tc"\tSPA_DF_2:3-5\tNIL00001\tORG\tNAM\r', 'gold\tE3\tsay "x"\tCMN_DF_3:3-5\tm.2\tORG\tNOM',
        'gold\tE4\t"open\tENG_WB_4:123456789-123456790\tm.3\tGPE\tNAM\tmore', "gold\tE5\tx\tDEU_NW_1:0-2\tm.1\tPER\tNAM", "gold\tE6\tx\tENG_NW_1:0-2147483647\tm.1\tPER\tNAM",
        "gold\tE7\tx\tENG_NW_1:a-2\tm.1\tPER\tNAM", "gold\tE8\tx", "", None,
    ]
    d = write_tables(spark, tmp_path, raw_lines=(list(enumerate(lines)), "line_id long, line string"))
    got = sorted(tuple(r) for r in core_queries.queries()["gold_reader"](spark, d).collect())
    assert got == [
        ("E1", "x", "ENG_NW_1", 0, 3, "m.1", "PER", "NAM", "en"), ("E2", 'a "b"\tc', "SPA_DF_2", 3, 6, "NIL00001", "ORG", "NAM", "es"),
        ("E3", 'say "x"', "CMN_DF_3", 3, 6, "m.2", "ORG", "NOM", "zh"), ("E4", '"open', "ENG_WB_4", 123456789, 123456791, "m.3", "GPE", "NAM", "en"),
    ]
    rejected = documents.gold_lines(spark.read.parquet(f"{d}/raw_lines.parquet"))[1]
    assert {tuple(r) for r in rejected.collect()} == {(4, "language"), (5, "bounds"), (6, "bounds"), (7, "columns"), (8, "columns"), (9, "columns")}


def test_html_keeps_text(spark):
    docs = spark.createDataFrame([(1, "ab cd ef"), (2, "x")], "doc_id long, text string")
    men = spark.createDataFrame([(1, 3, 5, "t"), (1, 4, 6, "u")], "doc_id long, start int, end int, wiki_title string")
    got = {r["doc_id"]: r["html"] for r in sinks.linked_html(docs, men).collect()}
    assert got == {1: 'ab <a href="#t">cd</a> ef', 2: "x"}


def test_ngram_cascade(spark):
    docs = spark.createDataFrame([(1, "en", "New York is big")], "doc_id long, lang string, text string")
    types = spark.createDataFrame([("en", "new york", ["location"]), ("en", "york", ["person"])], "lang string, surface string, coarse array<string>")
    got = {(r["start"], r["end"]): r["features"] for r in ner.wikify_ngrams(tokens.tokens(docs), types).collect()}
    assert got[0, 8] == ["TOPFBTYPETOKEN-location"] and got[0, 3] == ["B-TOPFBTYPETOKEN-location"] and got[4, 8] == ["I-TOPFBTYPETOKEN-location"]
    spans = pipeline.tag_mentions(tokens.tokens(docs), types).collect()
    assert [(r["start"], r["end"], r["mention_type"]) for r in spans] == [(0, 8, "LOC")]


def test_lists_are_cut_to_known_grams(spark):
    """Runs of tokens that known n-grams cover, with their numbers and offsets; the cascade's result is that of whole lists."""
    text = "He saw New York's mayor, then the Ann Σοφός of it.\nYork is new York"
    docs = spark.createDataFrame([(1, "en", text), (2, "zh", "他 在 中 华 住"), (3, None, "York"), (4, "en", "nothing here"), (5, "en", None)], "doc_id long, lang string, text string")
    surfaces = spark.createDataFrame([("new york",), ("mayor ,",), ("中华",), ("ann σοφός of it",), (None,)], "surface string")
    known = tokens.KnownGrams(surfaces, spark.createDataFrame([("york",), ("here",)], "word string"))
    rows = tokens.token_lists(docs, known=known).collect()
    got = {(r["doc_id"], r["sent_id"], r["toks"][0]["tok_id"]): [t["token"] for t in r["toks"]] for r in rows}
    # "here" is known as a capitalised word only, "York ' s" isn't known
    assert got == {
        (1, 0, 2): ["New", "York"], (1, 0, 6): ["mayor", ","], (1, 0, 10): ["Ann", "Σοφός", "of", "it"], (1, 2, 15): ["York"], (1, 2, 17): ["new", "York"],
        (2, 0, 2): ["中", "华"], (3, 0, 0): ["York"],
    }
    assert all(text[t["start"] : t["end"]] == t["token"] for r in rows if r["doc_id"] == 1 for t in r["toks"])
    types = spark.createDataFrame([("en", "new york", ["location"]), ("en", "york", ["person"]), ("zh", "中华", ["location"]), ("en", "ann σοφός of it", ["person"])], "lang string, surface string, coarse array<string>")
    spans = lambda lists: {tuple(map(str, r)) for r in ner.wikify_ngrams(lists, types).where("size(features) > 0").collect()}
    assert spans(tokens.token_lists(docs, known=known)) == spans(tokens.token_lists(docs))


def test_texts_without_known_grams_leave_no_lists(spark):
    """What the cascade shuffles comes from the n-grams that the index knows, not from all of the texts."""
    index = small_index(spark)
    docs = spark.createDataFrame([(1, "en", "a b c d. " * 50 + "Ann Lee came."), (2, "en", "a b c d. " * 50)], "doc_id long, lang string, text string")
    lists = ner.known_lists(docs, index.statistics, index.words).collect()
    assert [(r["doc_id"], [t["token"] for t in r["toks"]]) for r in lists] == [(1, ["Ann", "Lee"])]


def test_lists_are_cut_to_typed_grams(spark):
    """From rows of tokens or lists only the runs of typed n-grams stay; spans are those of whole lists."""
    docs = spark.createDataFrame([(1, "en", "We saw New York. York is big, big as Rome"), (2, "es", "nada"), (None, "en", "Rome")], "doc_id long, lang string, text string")
    types = spark.createDataFrame([("en", "new york", ["location"]), ("en", "york", ["person"]), ("en", "rome", ["location"])], "lang string, surface string, coarse array<string>")
    for toks in (tokens.tokens(docs), tokens.token_lists(docs)):
        runs = {(r["doc_id"], r["sent_id"], tuple(t["token"] for t in r["toks"])) for r in ner.typed_lists(toks, types).collect()}
        assert runs == {(1, 0, ("New", "York")), (1, 1, ("York",)), (1, 1, ("Rome",)), (None, 0, ("Rome",))}
        spans = {(r["start"], r["end"], r["mention_type"]) for r in pipeline.tag_mentions(toks, types).where("doc_id = 1").collect()}
        assert spans == {(7, 15, "LOC"), (17, 21, "PER"), (37, 41, "LOC")}


def test_scratch_of_dropped_lineages_is_freed(spark, monkeypatch):
    """The driver's garbage is collected once enough was materialised, so that dead shuffles leave the disk."""
    from linkloom import session

    asked = []
    monkeypatch.setattr(session, "COLLECT_S", 0.0)
    monkeypatch.setattr(session.gc, "collect", lambda: asked.append(1))
    assert session.cut_lineage(spark.range(3)).count() == 3 and asked


def test_cascade_makes_known_grams_only(spark):
    """The stages of the cascade get the n-grams of the index, however long the texts are."""
    index = small_index(spark)
    docs = spark.createDataFrame([(1, "en", "a b c d. " * 50 + "Ann Lee came.")], "doc_id long, lang string, text string")
    lists = ner.known_lists(docs, index.statistics, index.words)
    grams = ner.surface_forms(lists, 4)
    assert {(r["surface"], r["n"]) for r in grams.collect()} == {("ann", 1), ("lee", 1), ("ann lee", 2)}
    types = ner.gram_types(grams, index.statistics, index.words, index.kb_titles, index.title_map, index.kb_types)
    found = ner.wikify_ngrams(lists, types).where("n = 2").collect()
    assert [(r["start"], r["end"], r["features"]) for r in found] == [(450, 457, ["TOPFBTYPETOKEN-person"])]


def write_tables(spark, folder, **tables):
    """A data directory with tables of (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_queries_find_long_phrases_and_make_four_grams(spark, tmp_path):
    en, zh = "We saw the United States of America in one two three four five six seven.", "他 在 中 华 人 民 共 和 国 住。"
    titles = [("m.1", "en", "united_states_of_america"), ("m.2", "en", "One two three four five six seven"), ("m.3", "zh", "中华人民共和国"), ("m.4", "es", "in"), ("m.5", "en", "saw"), ("m.6", "en", None)]
    d = write_tables(
        spark, tmp_path, documents=([(1, "en", en), (2, "zh", zh), (3, "es", None)], "doc_id long, lang string, text string"),
        kb_titles=(titles, "mid string, lang string, title string"),
    )
    hits = {(r["doc_id"], r["n"], (en if r["doc_id"] == 1 else zh)[r["start"] : r["end"]]) for r in core_queries.queries()["phrase_hits"](spark, d).collect()}
    assert hits == {(1, 1, "saw"), (1, 4, "United States of America"), (1, 7, "one two three four five six seven"), (2, 7, "中 华 人 民 共 和 国")}
    made = {(r["doc_id"], r["n"]): r["n_grams"] for r in core_queries.queries()["ngrams"](spark, d).collect()}
    assert made == {(1, n): 17 - n for n in range(1, 5)} | {(2, n): 12 - n for n in range(1, 5)}


def test_context_feature_uses_words_of_all_lengths(spark, tmp_path):
    # keys of the words: aaaaaaa 0, ccc 2, fffffff 3 (no vector), kkkkkkk 2
    mention = "mention_id long, doc_id long, lang string, surface string, start_offset int, end_offset int, loaded_at timestamp"
    d = write_tables(
        spark, tmp_path, documents=([(1, "en", "aaaaaaa ccc X fffffff"), (2, "en", "kkkkkkk Y")], "doc_id long, lang string, text string"),
        mentions=([(1, 1, "en", "X", 12, 13, None), (5, 2, "en", "Y", 8, 9, None)], mention),
        embeddings=([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (5, [9.0, 9.0])], "vec_id long, embedding array<float>"),
    )
    got = {r["mention_id"]: r["W_CON30"] for r in core_queries.queries()["context_feature"](spark, d).collect()}
    assert got == {1: 1.0, 5: 0.0}


def test_ranked_document_uses_earlier_choices(spark):
    rows = [(1, 10, 0, 1, "a", [1.0], [1.0, 0.0]), (1, 11, 5, 1, "b", [0.5], [0.0, 1.0]), (1, 11, 5, 2, "c", [0.5], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, mention_id long, start int, rank int, title string, features array<double>, vec array<double>")
    got = {r["mention_id"]: r["title"] for r in ranking.rank_documents(df, [1.0, 1.0, 0.0, 0.0]).collect()}
    assert got == {10: "a", 11: "c"}


def test_tagger_learns(spark):
    docs = spark.createDataFrame([(i, "en", f"Mr Smith{i} met people") for i in range(30)], "doc_id long, lang string, text string")
    toks = ner.token_features(tokens.tokens(docs)).withColumn("label", F.when(F.col("tok_id") == 1, "B-PER").otherwise("O"))
    model = ner.train_tagger(toks)
    scores = {r["mention_type"]: (r["n_gold"], r["n_found"], r["f1"]) for r in ner.tagger_scores(model, toks).collect()}
    assert scores == {"PER": (30, 30, 1.0), "all": (30, 30, 1.0)}
    found = model.transform(toks.withColumn("kind", F.lit("O")))
    assert found.where("(tok_id = 1) != (found = 'PER')").count() == 0


def test_search_cache(spark):
    cache = spark.createDataFrame([("en", "prefix", "rio", '["rio", ["Rio de Janeiro", "Rio"]]')], "lang string, mode string, query string, payload string")
    got = documents.search_titles(spark.createDataFrame([("en", "rio"), ("en", "x")], "lang string, query string"), cache)
    assert {r["query"]: r["titles"] for r in got.collect()} == {"rio": ["Rio_de_Janeiro", "Rio"], "x": []}
    cats = spark.createDataFrame([("rio", '{"query": {"pages": {"1": {"categories": [{"title": "Category:Cities"}]}}}}')], "title string, payload string")
    assert documents.search_categories(cats).first()["category"] == "Category:Cities"


def test_empty_tables(spark):
    m = spark.createDataFrame([], "mention_id long, doc_id long, lang string, surface string, mention_type string, start int, end int, mid string, wiki_title string, confidence double")
    stats = anchors.surface_title_statistics(anchors.mention_anchors(m))
    assert stats.count() == 0
    assert coref.cluster_surfaces(m, ["doc_id"]).count() == 0
    assert intervals.resolve_nested(m).count() == 0
    assert coref.coreference_view(m).count() == 0


def test_linker_keeps_permitted_titles_only(spark):
    linked = spark.createDataFrame([("en", "Washington", "washington_(state)")] * 3 + [("en", "Washington", "washington,_d.c."), ("en", "Ohio", "ohio")], "lang string, surface string, wiki_title string")
    kb_titles = spark.createDataFrame([("m.1", "en", "ohio")], "mid string, lang string, title string")
    kb_types = spark.createDataFrame([], "mid string, types array<string>")
    pages = spark.createDataFrame([], "page_id long, lang string, ns int, title string, is_redirect int")
    redirects = spark.createDataFrame([], "page_id long, lang string, target_title string, seen_at timestamp")
    index = pipeline.build_index(linked, kb_titles, kb_types, pages, redirects)
    m = spark.createDataFrame([(1, 1, "en", "Washington", "LOC", 0, 10), (2, 1, "en", "Ohio", "LOC", 12, 16)], "mention_id long, doc_id long, lang string, surface string, mention_type string, start int, end int")
    assert {r["mention_id"]: r["wiki_title"] for r in pipeline.annotate(m, index).collect()} == {1: "washington,_d.c.", 2: "ohio"}


def test_stream(spark, tmp_path):
    from linkloom.streaming.scoring import link_stream

    men = spark.createDataFrame([(1, 1, "en", "Rio", "GPE", 0, 3, "m.1", "rio", 0.5)], "mention_id long, doc_id long, lang string, surface string, mention_type string, start int, end int, mid string, wiki_title string, confidence double")
    men.write.parquet(str(tmp_path / "in"))
    kbt = spark.createDataFrame([("rio", "en", "m.1")], "title string, lang string, mid string")
    types = spark.createDataFrame([("m.1", ["location.location"])], "mid string, types array<string>")
    pages = spark.createDataFrame([], "page_id long, ns int, title string, is_redirect int, lang string")
    red = spark.createDataFrame([], "page_id long, target_title string, lang string, seen_at timestamp")
    index = pipeline.build_index(men, kbt, types, pages, red)
    seen = []
    stream = spark.readStream.schema(men.schema).parquet(str(tmp_path / "in"))
    q = link_stream(stream, index, lambda rows, n: seen.extend(r["mid"] for r in rows.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["m.1"]


def test_config():
    from linkloom.config import parse_config

    c = parse_config("# models\ntarget_kb = enwiki\ndefault_ranking_model = d.model\nes_ranking_model = es.model\nuse_search = true\n")
    assert (c.target_kb, c.use_search, c.ranking_model("es"), c.ranking_model("zh"), c.ranking_model("xx")) == ("enwiki", True, "es.model", "d.model", "d.model")
    for bad in ("target_kb = other", "nonsense = 1", "target_kb"):
        with pytest.raises(ValueError):
            parse_config(bad)


def test_feature_maps_and_weights(spark, tmp_path):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0})], "x map<string,double>, y map<string,double>")
    assert df.select(ner.merged_features(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 1.0, "b": 3.0}
    ranking.save_weights(spark, ["f", "g"], [0.5, -1.0], str(tmp_path / "w"))
    assert ranking.load_weights(spark, str(tmp_path / "w")) == (["f", "g"], [0.5, -1.0])
    assert ranking.read_model(["solver x", "w", "0.5", "-1"]) == [0.5, -1.0]


def test_optional_surface_features(spark):
    df = spark.createDataFrame([("new york", "new_york_city", 1), ("n y", "new_york", 2)], "surface string, title string, rank int")
    got = [(r["SAME_INITIALS"], r["PREFIX"], r["SAME_LENGTH"], r["ISTOP"]) for r in ranking.surface_features(df).orderBy("rank").collect()]
    assert got == [(0.0, 1.0, 0.0, 1.0), (1.0, 0.0, 1.0, 0.0)]


def test_other_readers(spark):
    ann = spark.createDataFrame([("d", "tok\t0\t3\nx\t4\t5\n#title_a\t0\t5\n#b\t1\t5\n# \t0\t3")], "doc_name string, text string")
    assert [tuple(r) for r in documents.annotated_article(ann).collect()] == [("d", "title_a", 0, 5)]
    con = spark.createDataFrame([("d", 0, "B-PER\t0\t2\tx\tx\tJo"), ("d", 1, ""), ("d", 2, "O\t3\t4\tx\tx\ta")], "doc_name string, seq int, value string")
    assert sorted((r["sent_id"], r["token"]) for r in documents.conll_tokens(con).collect()) == [(0, "Jo"), (1, "a")]
    brown = spark.createDataFrame([("0110\tdog\t5",)], "value string")
    assert dumps.brown_clusters(brown, (2, 4)).first()["prefixes"] == ["01", "0110"]
    triples = spark.createDataFrame([("m.1\ten\tRio",), ("m.1\tx_id\tRio",), ("m.1\ten",)], "value string")
    assert [tuple(r) for r in dumps.kb_triples(triples).collect()] == [("m.1", "en", "Rio")]
    links = spark.createDataFrame([(1, "en", "a"), (1, "es", "b"), (1, "en", "c")], "page_id long, lang string, title string")
    assert titles.titles_of_pages(links).first()["titles"] == {"en": "c", "es": "b"}


def test_article_dump(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id>{r}<revision><text>{x}</text></revision></page>"
    pages = [page.format(t="A b", n=0, i=1, r="", x="see [[New York|the City]] and [[File:x.png]] [[Rio]]"), page.format(t="R", n=0, i=2, r='<redirect title="A b"/>', x=""), page.format(t="T", n=1, i=3, r="", x="")]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "".join(pages) + "</mediawiki>")
    got = {(r["surface"], r["title"]) for r in dumps.wiki_anchors(dumps.article_pages(spark, str(tmp_path / "d.xml"))).collect()}
    assert got == {("the city", "new_york"), ("rio", "rio")}


def test_title_translator(spark):
    mapping = spark.createDataFrame([("es", "rio", "river")], "lang string, title string, en_title string")
    every = spark.createDataFrame([("river", "ru", "reka"), ("river", "zh", "he-liu_(x)"), ("river", "es", "rio"), ("river", "xx", "no")], "src_title string, lang string, tgt_title string")
    targets = spark.createDataFrame([("es", "rios", "rio")], "lang string, title string, target string")
    queries = spark.createDataFrame([("es", "rio"), ("es", "rios"), ("es", "nada")], "lang string, title string")
    got = {r["title"]: r["hashtags"] for r in titles.translate_title(queries, mapping, targets, every).collect()}
    assert got == {"rio": ["river", "rio", "heliu", "reka"], "rios": ["river", "rio", "heliu", "reka"], "nada": None}


def test_document_stem(spark):
    assert value(spark, X.document_stem(F.col("a")), a="ENG_NW_001.v2.cmp.txt") == "ENG_NW_001.v2"


def test_copied_features(spark):
    a = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, tok_id int")
    b = spark.createDataFrame([(1, 0, ["x"]), (1, 1, ["y"])], "doc_id long, tok_id int, features array<string>")
    assert [r["copied"] for r in ner.copy_features(a, b).orderBy("tok_id").collect()] == [["x"], ["y"]]
    with pytest.raises(Exception, match="token counts differ"):
        ner.copy_features(a, b.where("tok_id = 0")).collect()


def plain_cos(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def test_static_features(spark):
    """Two mentions of one document, in Spanish: each base feature against its definition."""
    docs = spark.createDataFrame([(1, "es", "aa rio bb lima cc")], "doc_id long, lang string, text string")
    men = spark.createDataFrame([(1, 1, "es", 3, 6, "rio"), (2, 1, "es", 10, 14, "lima"), (3, 2, "es", None, None, "rio")], "mention_id long, doc_id long, lang string, start int, end int, surface string")
    cand = spark.createDataFrame([(1, 1, "río", "es", 0.7, 0.2), (1, 2, "rio_(film)", "en", 0.3, 0.1), (2, 1, "lima", "es", 1.0, 1.0), (3, 1, "río", "es", 0.7, 0.2)], "mention_id long, rank int, title string, cand_lang string, p_title_given_surface double, p_surface_given_title double")
    mapping = spark.createDataFrame([("es", "río", "river")], "lang string, title string, en_title string")
    vec = {"aa": [1.0, 0.0], "bb": [0.0, 1.0], "rio": [1.0, 1.0], "lima": [1.0, -1.0], "title_río": [2.0, 1.0], "title_lima": [0.0, 3.0]}
    vectors = spark.createDataFrame([("es", k, v) for k, v in vec.items()] + [("en", "title_river", [1.0, 2.0]), ("en", "title_rio_(film)", [1.0, 0.0])], "lang string, key string, vec array<double>")
    rows = features.static_features(men, cand, docs, tokens.document_frequency(docs), mapping, vectors).collect()
    got = {(r["mention_id"], r["title"]): r for r in rows}
    assert len(got) == len(rows) == 4
    r = got[1, "río"]
    assert (r["TITLEPROB"], r["SURFACEPROB"]) == (0.7, 0.2)
    assert r["NE_TITLE_COS"] == pytest.approx(plain_cos(vec["lima"], [1, 2])) and r["NE_TITLE_COS_L"] == pytest.approx(plain_cos(vec["lima"], vec["title_río"]))
    assert r["NE_MINMAX_MAX"] == r["NE_MINMAX_MIN"] == pytest.approx(r["NE_TITLE_COS"]) and r["NE_MINMAX_L_MAX"] == pytest.approx(r["NE_TITLE_COS_L"])
    # all words stand in one line each, so weights are equal; lima and cc count too, cc has no vector
    context = np.mean([vec["aa"], vec["bb"], vec["lima"]], axis=0)
    assert r["W_CON30"] == pytest.approx(plain_cos(context, [1, 2])) and r["W_CON200_L"] == pytest.approx(plain_cos(context, vec["title_río"]))
    # an English candidate without a foreign title has no foreign features
    assert got[1, "rio_(film)"]["NE_TITLE_COS_L"] == 0.0 and got[1, "rio_(film)"]["W_CON30"] == pytest.approx(plain_cos(context, [1, 0]))
    # a mention alone in its document, without offsets
    assert got[3, "río"]["NE_TITLE_COS"] == 0.0 and got[3, "río"]["W_CON30"] == 0.0
    names = ranking.features_of(False)
    best = features.rank_with_features(spark.createDataFrame(rows), names, [1.0] + [0.0] * 19)
    assert {r["mention_id"]: r["title"] for r in best.collect()} == {1: "río", 2: "lima", 3: "río"}


def test_cascade_goes_through_lists_without_joins(spark, monkeypatch):
    rng = random.Random(11)
    words = ["ann", "Ann", "lee", "new", "York", "12", "of", "the", "o'x", "'", "."]
    line = lambda: " ".join(rng.choices(words, k=12))
    docs = [(i, ("en", "es", "zh", None)[i % 4], line() + "\n" + line()) for i in range(40)] + [(None, "en", line()), (None, "en", line())]
    schema = "doc_id long, lang string, text string"
    lists = tokens.token_lists(spark.createDataFrame(docs, schema))
    stops = spark.createDataFrame([("en", "of"), ("en", "the"), ("es", "the"), (None, "ann")], "lang string, word string")
    forms = {(r["lang"], r["surface"], r["n"], r["capitalised"]) for r in ner.surface_forms(lists, 4, stops).collect()}
    known = tokens.KnownGrams(spark.createDataFrame([(f[1],) for f in forms], "surface string"))
    assert {tuple(r) for r in ner.surface_forms(lists, 4, stops, known).collect()} == forms
    kinds = [["person"], ["location", "book"], ["book"], [], ["organization", "person"]]
    rows = [(*f, rng.choice(kinds)) for f in sorted(forms) if rng.random() < 0.3]
    types = spark.createDataFrame(rows, "lang string, surface string, n int, capitalised boolean, coarse array<string>")
    plain = spark.createDataFrame([(a, b, k) for (a, b), k in {(r[0], r[1]): r[4] for r in rows}.items()], "lang string, surface string, coarse array<string>")
    told = lambda found: sorted(map(str, found.collect()))
    want = [told(ner._joined_cascade(lists, t, stops, 4)) for t in (types, plain)]
    # texts under one id meet each other, so they still go by joins
    both = tokens.token_lists(spark.createDataFrame([*docs, (1, "es", docs[1][2][4:] + " lee")], schema))
    want_both = told(ner._joined_cascade(both, types, stops, 4))
    assert told(ner.wikify_ngrams(both, types, stops)) == want_both and "I-TOPFBTYPETOKEN-person" in str(want)

    def none(*_):
        raise AssertionError("n-grams were joined")

    monkeypatch.setattr(ner, "propagate_types", none)
    assert [told(ner.wikify_ngrams(lists, t, stops)) for t in (types, plain)] == want


def test_texts_are_ranked_without_vectors_in_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["ann", "lee", "york", "new", "río", "lima", "big", "old"]
    vec = lambda: rng.standard_normal(5).tolist()
    vectors = [("es", w, vec()) for w in vocabulary[:6]] + [("es", f"title_t{i}", vec()) for i in range(5)] + [("ru", "big", vec()), ("ru", "title_u1", vec()), ("es", "old", [0.0] * 5)]
    vectors = spark.createDataFrame(vectors, "lang string, key string, vec array<double>")
    mapping = spark.createDataFrame([("es", "t0", "t1"), ("es", "t2", "t3"), ("ru", "u1", "t4")], "lang string, title string, en_title string")
    docs, men = [(1, "en", None)], []
    for d in range(2, 9):
        lang = ("en", "es", "ru")[d % 3]
        words = [str(w) for w in rng.choice([*vocabulary, "x", "."], 40)]
        text = " ".join(words)
        docs.append((d, lang, text))
        for _ in range(int(rng.integers(1, 9))):
            a = int(rng.integers(0, len(text) - 5))
            men.append((len(men), d, lang, "LOC", a, a + 4, " ".join(rng.choice(vocabulary, 2))))
    docs.append((3, "es", "york new big york Ann."))  # an id that two texts have
    men += [(900, 2, "en", "PER", None, None, "Ann"), (901, 2, None, "PER", 3, 5, "ann"), (902, 77, "es", "PER", 0, 3, "Ann lee"), (903, 77, "es", "PER", 4, 3, "none"), (904, 1, "en", "PER", 0, 3, None)]
    docs = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    men = spark.createDataFrame(men, "mention_id long, doc_id long, lang string, mention_type string, start int, end int, surface string").withColumn("key", F.lower("surface"))
    cand = []
    for r in men.select("lang", "key").where("lang is not null and key != 'none'").distinct().collect():
        for k, t in enumerate(rng.choice(["t0", "t1", "t2", "t3", "t4", "u1", "t9"], int(rng.integers(1, 5)), replace=False)):
            cand.append((r["lang"], r["key"], "en" if t in ("t1", "t3") else r["lang"], str(t), k + 1, float(rng.random()), float(rng.random())))
    cand = spark.createDataFrame(cand, "lang string, surface string, cand_lang string, title string, rank int, p_title_given_surface double, p_surface_given_title double")
    names = ranking.features_of(False)
    weights = rng.standard_normal(len(names) + 60).tolist()
    df = tokens.document_frequency(docs)
    rows = men.join(cand.withColumnRenamed("surface", "key"), ["lang", "key"]).select("mention_id", "rank", "title", "cand_lang", "p_title_given_surface", "p_surface_given_title")
    static = features.static_features(men, rows, docs, df, mapping, features.aliased(vectors))
    want = {r["mention_id"]: r for r in features.rank_with_features(static, names, weights).collect()}
    cut = []
    monkeypatch.setattr(features, "cut_lineage", lambda rows: cut.append(dict(rows.dtypes)) or cut_lineage(rows))
    monkeypatch.setattr(features.TextRanker, "CONTEXTS", 3)
    monkeypatch.setattr(features.TextRanker, "MENTIONS", 10)
    got = features.rank_texts(men, cand, docs, df, mapping, vectors, names, weights).collect()
    assert len(got) == men.count() and {r["mention_id"] for r in got if r["wiki_title"] is not None} == set(want)
    for r in got:
        if r["mention_id"] in want:
            w = want[r["mention_id"]]
            assert r["wiki_title"] == w["title"] and r["confidence"] == pytest.approx(w["confidence"], abs=1e-9)
    assert len({r["title"] for r in want.values()}) > 3
    # neither here nor in the linker a written row carries a vector
    monkeypatch.setattr(pipeline, "cut_lineage", features.cut_lineage)
    linked = pipeline.annotate_ranked(men.drop("key"), docs, small_index(spark), vectors, names, tuple(weights)).collect()
    assert len(linked) == len(got)
    assert cut and not [c for c in cut if {"array<double>", "array<float>"} & set(c.values())]


def test_sequential_ranking_against_plain_model(spark):
    rng = np.random.default_rng(5)
    rows = []
    for doc in range(3):
        for m in range(6):
            for k in range(rng.integers(1, 4)):
                v = None if rng.random() < 0.15 else rng.standard_normal(4).tolist()
                rows.append((doc, doc * 10 + m, int(rng.integers(0, 50)) if k == 0 else rows[-1][2], k + 1, f"t{doc}{m}{k}", rng.random(2).tolist(), v))
    w = [0.4, 0.2, 0.9, 0.7, -0.3]
    df = spark.createDataFrame(rows, "doc_id long, mention_id long, start int, rank int, title string, features array<double>, vec array<double>")
    got = {r["mention_id"]: (r["title"], r["score"], r["confidence"]) for r in ranking.rank_documents(df, w).collect()}
    want = {}
    for doc in range(3):
        chosen = []
        mentions = sorted({(r[2], r[1]) for r in rows if r[0] == doc})
        for _, m in mentions:
            scored = []
            for r in sorted((r for r in rows if r[1] == m), key=lambda r: r[3]):
                near = [plain_cos(r[6], c) for c in chosen] if r[6] else []
                x = [*r[5], plain_cos(np.mean(chosen, axis=0), r[6]) if near else 0.0, max(near, default=0.0), min(near, default=0.0)]
                scored.append((float(np.dot(x, w)), -r[3], r[4], r[6]))
            scored.sort(key=lambda s: (-s[0], -s[1]))
            want[m] = (scored[0][2], scored[0][0], 1.0 if len(scored) == 1 else 1 / (1 + np.exp(scored[1][0] - scored[0][0])))
            if scored[0][3] is not None:
                chosen.append(scored[0][3])
    assert {m: v[0] for m, v in got.items()} == {m: v[0] for m, v in want.items()}
    assert all(got[m][1:] == pytest.approx(want[m][1:]) for m in want)


def small_index(spark):
    linked = spark.createDataFrame([("en", "New York", "new_york_city")] * 3 + [("en", "Ann Lee", "ann_lee"), ("es", "Río", "río")], "lang string, surface string, wiki_title string")
    kb_titles = spark.createDataFrame([("m.1", "en", "New_York_City"), ("m.2", "en", "Ann_Lee"), ("m.3", "es", "Río"), ("m.3", "en", "River")], "mid string, lang string, title string")
    kb_types = spark.createDataFrame([("m.1", ["location.location"]), ("m.2", ["people.person"]), ("m.3", ["location.location"])], "mid string, types array<string>")
    pages = spark.createDataFrame([], "page_id long, lang string, ns int, title string, is_redirect int")
    redirects = spark.createDataFrame([], "page_id long, lang string, target_title string, seen_at timestamp")
    return pipeline.build_index(linked, kb_titles, kb_types, pages, redirects)


def test_text_to_links(spark, tmp_path):
    small_index(spark).save(str(tmp_path / "index"))
    index = pipeline.Index.load(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "en", "Ann Lee saw New York. It was 2020."), (2, "es", "Vimos Río."), (3, "en", None), (4, None, "New York"), (5, "en", "")], "doc_id long, lang string, text string")
    from linkloom.config import Config

    rows = pipeline.annotate_text(docs, index, Config()).collect()
    got = {(r["doc_id"], r["start"], r["end"]): (r["surface"], r["mention_type"], r["en_title"], r["mid"]) for r in rows}
    assert got == {
        (1, 0, 7): ("Ann Lee", "PER", "ann_lee", "m.2"), (1, 12, 20): ("New York", "LOC", "new_york_city", "m.1"), (2, 6, 9): ("Río", "LOC", "river", "m.3"),
    }
    assert pipeline.annotate_text(docs.where("false"), index, Config()).count() == 0


def test_linker_settings(spark):
    from linkloom.config import Config

    index = small_index(spark)
    men = "mention_id long, doc_id long, lang string, surface string, mention_type string, start int, end int"
    m = spark.createDataFrame([(1, 1, "en", "York", "LOC", 0, 4), (2, 1, "en", "Nowhere", "LOC", 5, 12), (3, 1, "es", "Ann Lee", "PER", 13, 20)], men)
    search = spark.createDataFrame([("en", "nowhere", ["New_York_City"])], "lang string, query string, titles array<string>")
    plain = {r["mention_id"]: r["wiki_title"] for r in pipeline.annotate(m, index).collect()}
    # a word of a surface finds the title, another language's mention the English one
    assert plain == {1: "new_york_city", 2: "NIL", 3: "ann_lee"}
    found = {r["mention_id"]: (r["wiki_title"], r["mid"]) for r in pipeline.annotate(m, index, config=Config(use_search=True), search=search).collect()}
    assert found[2] == ("New_York_City", "m.1")
    with pytest.raises(ValueError):
        pipeline.annotate(m, index, target_kb="other")


def test_article_texts(spark):
    text = "See [[New York|the City]], [[Rio]] and [[File:x.png|a file]]."
    articles = spark.createDataFrame([(1, "A b", text), (2, "A/c", "x"), (3, "E", None), (4, "F", "")], "page_id long, title string, text string")
    made = dumps.plain_articles(articles)
    rows = {r["page_id"]: r for r in made.collect()}
    assert set(rows) == {1, 4} and rows[1]["plain"] == "See the City, Rio and ."
    assert [tuple(a) for a in rows[1]["anchors"]] == [(4, 12, "new_york"), (14, 17, "rio")]
    files = sinks.annotation_texts(made).select(F.col("title").alias("doc_name"), "text")
    assert {tuple(r) for r in documents.annotated_article(files).collect()} == {("A b", "new_york", 4, 12), ("A b", "rio", 14, 17)}
    assert [r["line"] for r in sinks.anchor_lines(spark.createDataFrame([("a", "b")], "surface string, title string")).collect()] == ["a\tb"]


def test_conll_without_quotations(spark):
    toks = tokens.tokens(spark.createDataFrame([(1, "en", "a b c")], "doc_id long, lang string, text string")).withColumn("label", F.lit("O"))
    quoted = spark.createDataFrame([(1, 2, 3)], "doc_id long, start int, end int")
    assert [r["line"].split("\t")[5] for r in sinks.conll_lines(toks, quoted=quoted).orderBy("tok_id").collect()] == ["a", "c"]


def test_readers_of_folders_and_slices(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.x.xml").write_text("<p>漢 國</p>\n<AUTHOR> Jo </AUTHOR>")
    (tmp_path / "d" / "a.txt").write_text("")  # an empty file is no document
    (tmp_path / "d" / "c.txt").write_text("x")
    raw = documents.read_texts(spark, str(tmp_path / "d"))
    assert [r["doc_name"] for r in raw.collect()] == ["b", "c"]
    docs = documents.corpus(raw, "zh")
    assert {r["doc_name"]: r["text"].strip() for r in docs.collect()} == {"b": "汉 国 Jo", "c": "x"}
    authors = documents.authors(docs)
    assert [(r["surface"], r["mid"]) for r in authors.collect()] == [("Jo", "NIL")]
    mentions = spark.createDataFrame([("b", 1, 2, "x", "PER", "m.1", 0.5)], "doc_name string, start int, end int, surface string, mention_type string, mid string, confidence double")
    both = evaluate.attach_authors(mentions, authors, docs.where("doc_name = 'b'"))
    assert sorted(r["surface"] for r in both.collect()) == ["Jo", "x"]
    assert evaluate.attach_authors(mentions, authors, docs.where("doc_name = 'c'")).count() == 1
    gold = spark.createDataFrame([("en", "NAM"), ("en", "NOM"), ("es", "NAM")], "lang string, noun_type string")
    assert documents.gold_slice(gold, "en").count() == 1 and documents.gold_slice(gold, "en", None).count() == 2
    chars = X.script_table(spark, "Simplified-Traditional")
    assert "汉" in chars[0]


def test_last_link_wins(spark):
    lines = spark.createDataFrame([(2, "INSERT INTO `langlinks` VALUES (1,'en','B c'),(1,'en','It\\'s'),(2,'es','x');"), (1, "INSERT INTO `langlinks` VALUES (2,'es','y'),(1,'en','z');")], "seq int, value string")
    assert {tuple(r) for r in dumps.dump_langlinks(lines).collect()} == {(1, "en", "it's"), (2, "es", "x")}
    assert {tuple(r) for r in dumps.dump_langlinks(lines, "es").collect()} == {(2, "es", "x")}
    pages = spark.createDataFrame([(1, "es", "A b"), (2, "es", "A b"), (3, "ru", "A b")], "page_id long, lang string, title string")
    links = spark.createDataFrame([(1, "es", "P", 5), (2, "es", "Q", 7), (3, "ru", "R", 1), (9, "es", "S", 9)], "page_id long, lang string, title string, seq int")
    assert {tuple(r) for r in documents.language_link_dict(pages, links).select("lang", "title", "en_title").collect()} == {("es", "a_b", "q"), ("ru", "a_b", "r")}
    every = documents.all_languages(pages.select("page_id", "title"), links)
    assert {tuple(r) for r in every.select("title", "lang", "tgt_title").collect()} == {("a_b", "es", "q"), ("a_b", "ru", "r")}


def test_optional_tagger_and_ranker_features(spark):
    labelled = spark.createDataFrame([(1, 0, 0, "B-PER"), (1, 0, 1, "O"), (1, 1, 2, "O")], "doc_id long, sent_id long, tok_id int, label string")
    assert {r["tok_id"]: r["features"] for r in ner.previous_label_features(labelled).collect()} == {0: [], 1: ["prev-B-PER", "prev-PER"], 2: []}
    src = ranking.source_features(spark.createDataFrame([("surface", 0.5), (None, None)], "src string, score double"), ["surface", "word"])
    assert [(r["SRC:surface"], r["SRC:word"], r["PRESCORE"]) for r in src.collect()] == [(1.0, 0.0, 0.5), (0.0, 0.0, 0.0)]
    cats = spark.createDataFrame([("rio", "Cities of Brazil")], "title string, category string")
    stops = spark.createDataFrame([("of",)], "word string")
    rows = spark.createDataFrame([(1, "rio"), (2, "x")], "mention_id long, title string")
    assert [(r["mention_id"], r["features"]) for r in ner.category_features(rows, cats, stops).collect()] == [(1, ["TOPWIKICATTOKEN-brazil", "TOPWIKICATTOKEN-cities"])]


def test_gold_is_matched_by_beginning_of_name(spark):
    cols = "id long, doc string, start int, end int, type string, mid string"
    pred = spark.createDataFrame([(1, "d1.txt", 0, 3, "PER", "m.1", ["m.1"]), (2, "d2", 0, 3, "PER", "m.9", ["m.9", "m.2"]), (3, None, 0, 3, "PER", "m.1", None)], cols + ", cand_mids array<string>")
    gold = spark.createDataFrame([(7, "d1", 0, 3, "PER", "m.1"), (8, "d2", 0, 3, "PER", "m.2"), (9, "other", 0, 3, "PER", "m.1")], cols)
    got = {r["id"]: (r["span_ok"], r["link_ok"], r["in_candidates"]) for r in evaluate.match_gold(pred, gold).collect()}
    assert got == {1: (True, True, False), 2: (True, False, True), 3: (False, False, False)}


def test_rules_are_the_tables(spark):
    """Other rules, other results: nothing but the joined table decides."""
    from linkloom.operators import rejects

    rules = (rejects.FieldRule(0, "kind", r"\Aa\z"), rejects.FieldRule(1, "range", r"\A[0-9:-]+\z", ordered=True))
    lines = spark.createDataFrame([(1, "a\t:3-5"), (2, "a\t:5-3"), (3, "b\t:1-1"), (4, "a")], "line_id long, line string")
    bad = rejects.violations(rejects.parse_lines(lines), rules)
    assert {(r["line_id"], r["reason"], *r["fields"]) for r in bad.collect()} == {(2, "value", "range"), (3, "value", "kind"), (4, "columns")}


def test_jobs(spark, tmp_path):
    from linkloom.plans import jobs

    d = write_tables(
        spark, tmp_path / "in", mentions=([("en", "New York", "new_york_city"), ("es", "Río", "río")], "lang string, surface string, wiki_title string"),
        kb_titles=([("m.1", "en", "New_York_City")], "mid string, lang string, title string"), kb_types=([("m.1", ["location.location"])], "mid string, types array<string>"),
        wiki_pages=([], "page_id long, lang string, ns int, title string, is_redirect int"), wiki_redirects=([], "page_id long, lang string, target_title string, seen_at timestamp"),
        documents=([(1, "en", "He saw New York")], "doc_id long, lang string, text string"),
    )
    jobs.build_index(spark, d, str(tmp_path / "index"))
    jobs.annotate_documents(spark, f"{d}/documents.parquet", str(tmp_path / "index"), str(tmp_path / "out"), n_stops=0)
    assert [(r["start"], r["mid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, "m.1")]
    english = pipeline.Index.load(spark, str(tmp_path / "index"), ("zh",))
    assert {r["lang"] for r in english.statistics.collect()} == {"en"}
    with pytest.raises(Exception, match="already exists"):
        jobs.build_index(spark, d, str(tmp_path / "index"))


def test_bounded_sample_and_feature_ids(spark):
    from linkloom.operators.numbering import bounded_sample

    rows = spark.range(20_000)
    assert bounded_sample(rows, ["id"], 20_000).count() == 20_000
    n = bounded_sample(rows, ["id"], 4_000).count()
    assert 3_400 < n <= 4_000
    ids = ranking.feature_ids(["a", "b", "a"])
    assert ids == {"a": 1, "b": 2} and ranking.feature_ids(["c"], ids, is_open=False) == ids and ranking.feature_ids(["c"], ids)["c"] == 3
