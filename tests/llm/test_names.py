"""Name variants: parsing, alignment and linking of small cases."""

import itertools
import random

from linkloom.llm import names

MENTION = "mention_id long, doc_id long, surface string, gold_wiki_title string, lang string, mid string, loaded_at timestamp"


def linked_pairs(spark, rows):
    df = spark.createDataFrame([(i, d, s, t, g, "NIL", None) for i, (d, s, t, g) in enumerate(rows)], MENTION)
    docs = spark.createDataFrame([(1, "en"), (2, "en")], "doc_id long, lang string")
    linked = names.link_entities(names.latest_nil_mentions(df, docs))
    return {tuple(r) for r in names.same_entity_pairs(linked).collect()}


def people():
    given = ["Katherine", "William", "Robert", "Samuel", "Deborah"]
    last = ["Tarberhezal", "Krukuntonber", "Gonlartelpo", "Stibrerbrustal", "Malsunkruvi", "Drobendrebur", "Hellelfulpir", "Nalvintoben"]
    return [f"{g} {s}" for g, s in itertools.product(given, last)]


def test_one_edit_against_definition():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))}
        near |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"}
        near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert names.one_edit(a, b) == (b in near), (a, b)


def test_parsing():
    assert names.parse_name("Dr. Katherine R. Tarber", False) == (["katherine", "tarber"], ["r."], None)
    assert names.parse_name("katherine_tarber_(judge)", True) == (["katherine", "tarber"], [], "judge")
    assert names.parse_name("BCMQ", False) == ([], ["@bcmq"], None)
    assert names.parse_name("水文大学（宁提门杜）", False)[0] == ["宁提门杜水文大学"]
    assert names.parse_name("宁提门杜水文大", False)[0] == ["宁提门杜水文大学"]
    assert names.parse_name(None, True) == ([], [], None)


def test_alignment():
    assert names.align(("committee", "mines", "quarries"), ("cttee.", "mines", "quarries"))
    assert not names.align(("committee", "mines"), ("cttee.", "health"))
    assert names.align(("bill",), ("william",)) and names.align(("w.",), ("bill",)) and not names.align(("k.",), ("william",))


def test_alignment_of_long_names():
    # the first of two that fit isn't always the right one
    filler = ("berlin", "cairo", "delhi", "essen", "florence")
    assert names.align(("as.", "assoc.", *filler), ("association", "astronomy", *filler)) == 2 + 3 * len(filler)
    assert not names.align(("as.", "assoc.", *filler), ("astronomy", "assembly", *filler))
    rng = random.Random(5)
    words = ["association", "astronomy", "as.", "assoc.", "a.", "bill", "william", "w.", "bilk", "will", "astronom"]
    for _ in range(400):
        a, b = (tuple(rng.choice(words) for _ in range(rng.randint(1, n))) for n in (4, 7))
        short, long = sorted((a, b), key=len)
        every = ([names._fits(x, y) for x, y in zip(short, p)] for p in itertools.permutations(long, len(short)))
        assert names.align(a, b) == max((sum(f) for f in every if all(f)), default=0), (a, b)


def test_classes_of_a_block_are_found_by_their_tokens():
    rng = random.Random(8)
    long = "x" * 40 + "yz" * 20
    words = ["association", "assocation", "astronomy", "as.", "assoc.", "a.", "bill", "william", "w.", "b.", "bilk", "will", "wlil", "ana", "anna", "t.", "ted", "theodore", "ab", long, long[:-1], long[1:], long[:40] + long[41:], long[:64], long[:65], long[:63]]
    for _ in range(300):
        classes = names._Classes()
        for _ in range(12):
            classes.add(tuple(sorted(rng.choice(words) for _ in range(rng.randint(1, 4)))))
        name = tuple(sorted(rng.choice(words) for _ in range(rng.randint(1, 3))))
        fitting = lambda every: [c for c in every if len(c) >= len(name) and names.align(name, c)]  # noqa: E731, B023
        assert fitting(classes.near(name)) == fitting(classes.all), name


def test_a_frequent_surname_is_a_better_key_than_a_word_typed_once(spark):
    rng = random.Random(3)
    others = ["".join(rng.choice("bcdfgklmnprtvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(160)]
    rows = [(1, f"{w} Smith", None, "en") for w in others[:60] for _ in range(2)] + [(1, f"John {w}", None, "en") for w in others[60:] for _ in range(2)]
    n = len(rows)
    rows += [(1, "John Smith", None, "en"), (1, "Jhon Smith", None, "en"), (2, "Jhno Smith", "john_smith", "en")]
    got = {p for p in linked_pairs(spark, rows) if p[1] >= n}
    assert got == {(n, n + 1), (n, n + 2), (n + 1, n + 2)}


def test_variants_of_one_person_and_others_apart(spark):
    rows = [(1, p, None, "en") for p in people()]
    n = len(rows)
    rows += [(1, "Tarberhezal, Katherine", None, "en"), (1, "K. Tarberhezal", None, "en"), (1, "Kate Tarberhezal", None, "en"), (1, "Katherine Tarberehzal", None, "en"), (1, "Katherine B. Tarberhezal", None, "en"), (1, "Tarberhezal", None, "en")]
    got = linked_pairs(spark, rows)
    own = people().index("Katherine Tarberhezal")
    want = {(own, n + k) for k in range(5)} | {(n + a, n + b) for a, b in itertools.combinations(range(5), 2)}
    assert got == want  # the bare surname fits five people and is linked to none


def test_namesakes_are_told_by_qualifier_and_languages_apart(spark):
    rows = [(1, p, None, "en") for p in people() if "Gonlartelpo" not in p]
    n = len(rows)
    rows += [(1, "William Gonlartelpo", "william_gonlartelpo_(pilot)", "en"), (1, "W. Gonlartelpo", "william_gonlartelpo_(pilot)", "en"), (2, "Bill Gonlartelpo", "william gonlartelpo (painter)", "en"), (2, "Gonlartelpo", "William_Gonlartelpo_(painter)", "en"), (2, "Will Gonlartelpo", None, "es")]
    assert linked_pairs(spark, rows) == {(n, n + 1), (n + 2, n + 3)}


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None, None, None, "NIL", None), (None, 1, "Ab Cd", None, "en", "NIL", None), (2, None, "...", None, "en", "NIL", None), (3, 1, "x" * 50_000, None, "en", "NIL", None), (3, 1, "x" * 50_000, None, "en", "NIL", None)], MENTION)
    docs = spark.createDataFrame([], "doc_id long, lang string")
    assert names.same_entity_pairs(names.link_entities(names.latest_nil_mentions(df, docs))).count() == 0
    assert names.link_entities(names.latest_nil_mentions(df.where("false"), docs)).count() == 0


def test_words_at_the_border_of_the_two_indexes_meet(spark):
    """One letter more or less at the length from which words are indexed by their ends."""
    word = "abcdefgh" * (names.LONG // 8)
    other = word[:10] + "x" + word[10:]
    rows = spark.createDataFrame([("en", w) for w in (word, word, other)], "lang string, word string")
    assert {r["word"]: r["spelling"] for r in names.spellings(rows).collect()} == {word: word, other: word}
