import random

import pytest

from linkloom.llm.components import group_ids, redirect_links


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


CASES = {
    "empty": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "repeats": [(2, 1), (1, 2), (2, 1)],
    "chain": [(i, i + 1) for i in range(60)],
    "shuffled chain": [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)],
    "star": [(500, i) for i in range(200)],
    "random": [(random.Random(i).randint(0, 150), random.Random(i + 999).randint(0, 150)) for i in range(120)],
}


@pytest.mark.parametrize("name", CASES)
def test_groups(spark, name):
    df = spark.createDataFrame(CASES[name], "a long, b long").selectExpr("a as x", "b as y", "'z' as v", "1 as root")
    assert {r["vertex"]: r["group_id"] for r in group_ids(df, "x", "y").collect()} == plain(CASES[name])


def test_redirect_links(spark):
    pages = spark.createDataFrame([(1, 0, "A b", "en"), (2, 0, "a_B", "en"), (3, 0, "C", "en"), (4, 1, "C", "en"), (5, 0, "c", "es"), (3, 0, "C", "en"), (None, 0, "C", "en")], "page_id long, ns int, title string, lang string")
    red = spark.createDataFrame([(3, "A_B", "en"), (3, "a b", "en"), (4, "C", "en"), (3, "C", "en"), (3, "c", "es"), (3, None, "en"), (5, "A_B", None)], "page_id long, target_title string, lang string")
    assert {tuple(r) for r in redirect_links(pages, red).collect()} == {(3, 1), (3, 2)}
