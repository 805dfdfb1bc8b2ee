import unicodedata
from types import SimpleNamespace

import pytest

from linkloom.llm import confusables as C


def test_same_look():
    same = [("Sеruldrіrmil", "Seruldrirmil"), ("ｄｅｐａｒｔ　ｏｆ", "depart of"), ("café", "café"), ("a​b­c", "abc"), ("a b", "a b"), ("⾦⻔⼟", "金门土"), ("Ρort", "Port"), ("（画家）", "(画家)")]
    for a, b in same:
        assert C.skeleton_text(a) == C.skeleton_text(b), (a, b)


def test_visible_differences_stay():
    for a, b in [("abc", "Abc"), ("cafe", "café"), ("a_b", "a b"), ("漢", "汉"), ("x²", "x2"), ("burn", "bum"), ("ll", "Il")]:
        assert C.skeleton_text(a) != C.skeleton_text(b)


def test_skeleton_is_stable():
    for point in [*range(0x250), *range(0x370, 0x530), *range(0x2000, 0x2100), *range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0xFF00, 0xFFF0)]:
        once = C.skeleton_text(chr(point))
        assert C.skeleton_text(once) == once and unicodedata.normalize("NFD", once) == once


def test_pairs(spark):
    rows = [(1, 1, "a b", "t"), (2, 1, "a b", "t"), (3, 1, "a b", None), (4, 2, "a b", "t"), (5, 1, None, "ｔ"), (2, 1, "a b", "t"), (None, 1, "a b", None), (6, None, "a b", None)]
    df = spark.createDataFrame(rows, "mention_id long, doc_id long, surface string, gold_wiki_title string").selectExpr("*", "1 as id", "2 as grp", "'x' as field_name")
    got = {tuple(r) for r in C.same_look_pairs(df, ("surface", "gold_wiki_title"), "mention_id", "doc_id").collect()}
    assert got == {("surface", 1, 2), ("surface", 2, 3), ("gold_wiki_title", 1, 5), ("gold_wiki_title", 2, 5)}
    assert C.same_look_pairs(df.where("false"), ("surface",), "mention_id", "doc_id").count() == 0
    groups = {r["form"]: (r["originals"], r["n_rows"]) for r in C.look_groups(df, "surface").collect()}
    assert groups == {"a b": (["a b", "a b"], 7)}


def test_table_of_look_alikes(spark):
    """Letters of other scripts go to the ASCII letter of their own kind; ASCII stays, and so do letters that look like digits."""
    more = C.look_alikes(spark)
    assert len(more) > 500
    assert not any(c.isascii() for c in more)
    looks = lambda a, b: C.skeleton_text(a, C._Prototypes(more)) == C.skeleton_text(b, C._Prototypes(more))
    assert looks("Ꭺnn", "Ann") and looks("ᴄat", "cat") and looks("ⅼong", "long")
    assert not looks("З", "3") and not looks("l", "I") and not looks("ñ", "n") and not looks("漢", "汉")


def test_missing_table_is_an_error(spark):
    """Without ICU's data, or with a call of it that fails, there is no shorter table."""
    with pytest.raises(RuntimeError, match="ICU"):
        C.look_alikes(SimpleNamespace(_jvm=None))
    absent = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=spark._jvm.no.such.package))))
    with pytest.raises(RuntimeError, match="ICU"):
        C.look_alikes(SimpleNamespace(_jvm=absent))
