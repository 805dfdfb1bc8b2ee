import random
from collections import Counter, defaultdict

import pytest

from linkloom.llm import packing


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_each_item_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 2, 3, 10, 64, 256])
    h = Counter(rng.randint(1, rng.choice([cap, max(1, cap // 4)])) for _ in range(rng.randint(0, 300)))
    intervals, n = packing.plan_containers(dict(h), cap)
    fill, seen = Counter(), defaultdict(set)
    for size, first, last, container, each in intervals:
        for k in range(first, last):
            assert k not in seen[size]
            seen[size].add(k)
            fill[container + (k - first) // each] += size
    assert {s: len(v) for s, v in seen.items()} == {s: c for s, c in h.items() if c}
    assert all(v <= cap for v in fill.values()) and set(fill) == set(range(n))
    total = sum(s * c for s, c in h.items())
    large = sum(c for s, c in h.items() if s > cap / 2)
    assert n <= 1 + max(1.25 * total / cap, large + total / cap)


@pytest.mark.parametrize("seed", range(30))
def test_large_items_are_paired_wherever_two_fit(seed):
    assert packing.plan_containers({2000: 1, 1500: 1, 1400: 1}, 4096)[1] == 2
    rng = random.Random(seed)
    cap = rng.choice([30, 1000, 4096])
    distinct = rng.sample(range(cap // 3 + 1, cap // 2 + 1), min(rng.randint(1, 40), cap // 2 - cap // 3))
    assert packing.plan_containers(dict.fromkeys(distinct, 1), cap)[1] == (len(distinct) + 1) // 2
    h = Counter(rng.randint(cap // 3 + 1, cap) for _ in range(rng.randint(1, 80)))
    # the fewest containers of at most two items: the smallest goes with the largest if it fits
    items, fewest, i = sorted(h.elements()), 0, 0
    while items[i:]:
        i += len(items) - i > 1 and items[i] + items[-1] <= cap
        items.pop()
        fewest += 1
    assert packing.plan_containers(dict(h), cap)[1] == fewest


def test_pack_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 3, 40, 50, 90, 130, 270])) for i in range(400)] + [(7, 40), (7, 40), (None, 50), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(df, 100).collect()
    fill = Counter()
    parts = defaultdict(list)
    for r in out:
        fill[r["container"]] += r["token_end"] - r["token_start"]
        parts[r["doc_id"]].append((r["token_start"], r["token_end"]))
    assert max(fill.values()) <= 100
    assert sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert sorted(parts[next(i for i, n in rows if n == 270)]) == [(0, 100), (100, 200), (200, 270)]
    # items above a half need a container each; of the others at most two fit one, whatever the order
    pieces = [b - a for p in parts.values() for a, b in p]
    alone = sum(n > 50 for n in pieces)
    paired = sum(40 <= n <= 50 for n in pieces)
    assert len(fill) <= alone + (paired + 1) // 2 + 1
    assert all(len(parts[i]) == 1 for i, n in rows[:400] if 0 < (n or 0) <= 100 and i != 7)
    assert packing.pack(df.where("false"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_tokens_of_texts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "你好" * 5000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.count_tokens(docs).collect()}
    assert got[1] >= 2 and got[2] == 0 and 3 not in got and got[4] >= 5000 and got[5] > 1
    sizes = spark.createDataFrame([(1, 100), (2, None)], "pack_id int, capacity_tokens int")
    packed = packing.pack_all(docs, sizes)
    assert {r["doc_id"] for r in packed.collect()} == {1, 4, 5}


def test_one_item_of_each_size_pairs_up():
    """Flat histograms: half as many containers as large items, as in the best packing."""
    for sizes, capacity, best in (((50, 40), 100, 1), ((40, 39, 38, 37), 100, 2), (range(700, 1024), 2048, 162)):
        intervals, n = packing.plan_containers({s: 1 for s in sizes}, capacity)
        assert n == best and len({i[0] for i in intervals}) == len(sizes)
