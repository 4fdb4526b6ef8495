"""The factorisation machine: pairs formed one by one, held-out accuracy, odd rows."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedwake.llm import factors, factors_queries

PARTS = ["ta", "lo", "mi", "ren", "su", "vek", "or", "an", "ist", "ed"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary invented texts (1) and ones with signs, capitals or repeats (0)."""
    draw = random.Random(8)

    def text(good, kind):
        words = ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(40, 160))]
        if not good and kind == 0:
            words = [w + draw.choice(["###", "***"]) for w in words]
        elif not good and kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif not good:
            words = words[:6] * (len(words) // 6)
        return " ".join(words)

    rows = [(k, text(k % 4 > 0, k % 3), k % 4 > 0) for k in range(600)]
    docs = [(k, t, "en", f"s{k % 3}", len(t), "x") for k, t, _ in rows]
    docs += [(9000, None, "en", None, None, "x"), (9001, "", "en", "s1", 0, "x"), (None, "x y", "en", "s1", 3, "x"), (9002, "word " * 300_000, None, None, 1_500_000, "x")]
    docs += [(9003, *docs[1][1:]), (9003, *docs[1][1:])]
    labels = [(k, int(y)) for k, _, y in rows] + [(None, 1), (5, None), (77777, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(6),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_documents_it_has_not_seen(labelled):
    docs, labels = labelled
    model = factors_queries.fitted(docs, labels)
    found = factors.score(docs, model).withColumn("held", factors.held_out(F.col("doc_id"))).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [(r.score >= 0.5) == (r.doc_id % 4 > 0) for r in found if r.held and r.doc_id < 9000]
    assert len(held) > 100 and np.mean(held) > 0.95
    assert len({r.score for r in found if r.doc_id in (1, 9003)}) == 1
    assert factors.score(docs.limit(0), model).collect() == []


def test_scores_are_sums_over_all_pairs(labelled):
    docs, labels = labelled
    model = factors_queries.fitted(docs, labels)
    texts = [r.text for r in docs.where("doc_id < 12 OR doc_id IN (9000, 9001)").select("text").collect()]
    numbers = [np.array([math.nan if t is None else float(len(t)) for t in texts])]
    got = model.scores(texts, numbers)
    for k, text in enumerate(texts):
        _, place, value = factors.inputs([text], [numbers[0][k : k + 1]], model.layout)
        value = factors.standardised(place, value, model)
        assert len(set(place)) == len(place)
        total = model.bias + sum(model.weights[p] * x for p, x in zip(place, value, strict=True))
        total += sum(model.factors[a] @ model.factors[b] * x * y for (a, x), (b, y) in combinations(list(zip(place, value, strict=True)), 2))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_statistics_of_a_text():
    text = "Ab cd, Ab### é1\n\nAb cd, x\nAb cd, x"
    _, place, value = factors.inputs([text], [], factors.Layout(4))
    got = dict(zip(factors.STATS, value[place >= 4], strict=True))
    words = text.split()
    solid = sum(len(w.encode()) for w in words)
    want = {
        "log_words": math.log(10), "word_length": solid / 10, "upper": 4 / solid, "digit": 1 / solid, "point": 3 / solid, "sign": 3 / solid, "wide": 2 / solid,
        "sign_words": 0.1, "point_words": 0.3, "distinct_words": 5 / 10, "top_word": 0.3, "distinct_pairs": 6 / 9, "distinct_triples": 7 / 8,
        "words_a_line": math.log(10 / 3), "distinct_lines": 2 / 3,
    }
    assert got == pytest.approx(want)


def test_few_labels(labelled):
    docs, labels = labelled
    assert factors.fit(docs, labels.limit(0)).scores(["any", None]).tolist() == [0.0, 0.0]
    assert factors.fit(docs, labels.where("quality = 1")).scores(["any"]).tolist() == [1.0]
    assert factors.fit(docs, labels.limit(0)).scores([]).tolist() == []


def test_the_sample_bounds_what_comes_to_the_driver(spark, labelled):
    docs, labels = labelled
    few, known = docs.where("doc_id < 40"), labels.where("doc_id < 40")
    once = factors.fit(few, known, sample=6)
    many = factors.fit(few.crossJoin(spark.range(30)).drop("id"), known, sample=6)
    assert np.allclose(many.weights, once.weights) and np.allclose(many.factors, once.factors) and many.prior == once.prior
    picked = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(6) for c in (0, 1)]
    again = factors.fit(few, picked[0].union(picked[1]), sample=1000)
    assert np.allclose(again.centre, once.centre)
