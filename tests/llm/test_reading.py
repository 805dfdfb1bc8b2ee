import random

import numpy as np
import pytest

from linkloom.llm import reading as R

SIMPLE = ["The cat is here.", "I like the dog.", "We see the red box.", "It is a nice day."]
PLAIN = ["Last summer the town opened a modern library near the river.", "Visitors admired the quiet bridge before the market closed."]
NEWS = ["Officials argued that the regional ministry would reject the preliminary budget within eleven months.", "Critics of the federal commission warned that the agreement might undermine the independent inquiry."]
HARD = ["By foregrounding intertextuality, the dialectic destabilises an ontological phenomenology whose legitimation remains prescriptive.", "Such heterogeneity presupposes the incommensurable historiography that it problematises."]
LEVELS = [SIMPLE, PLAIN, NEWS, HARD]


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        level = i % 4
        text = [rng.choice(LEVELS[level] if rng.random() < 0.85 else LEVELS[rng.randrange(4)]) for _ in range(rng.randint(6, 14))]
        rows.append((i, " ".join(text), level + 1))
    return rows


def test_languages():
    assert R.language_of("The cat is in the house and it is warm.") == "en"
    assert R.language_of("El gato está en la casa y no es de ella.") == "es"
    assert R.language_of("今天小猫很红，月亮也很白。") == "zh"
    assert R.language_of("Утром Новый завод сообщает об этом.") is None
    assert R.language_of("เมื่อวานนี้ผู้คนเห็นว่าตลาดเก่าเปิด") is None
    assert R.language_of("Xyz qwv") is None


def test_isotonic_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y = rng.normal(size=rng.integers(1, 9))
        got = R.isotonic(y, np.ones(len(y)))
        n = len(y)
        want = [max(min(y[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(got, want)


def test_held_out_levels(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows] + [(900, None, 500), (901, "The cat.", 8), (902, "Утром завод. " * 40, 480)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, v, r) for i, _, v in rows[:120] for r in ("a", "b")] + [(5, None, "c"), (7777, 2, "a")], "doc_id long, reading_level int, rater string")
    got = {r["doc_id"]: r["reading_level"] for r in R.reading_levels(docs, labels, min_chars=100).collect()}
    held = [(i, v) for i, t, v in rows[120:] if len(t) >= 100]
    assert not {900, 901, 902} & set(got)
    assert sum(got[i] == v for i, v in held) >= 0.9 * len(held)


def test_needs_two_levels():
    with pytest.raises(ValueError):
        R.fit(["The cat is here."] * 5, np.ones(5))
