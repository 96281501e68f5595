"""Quality rules against plain Python, and the model's accuracy on held-out rows."""

import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import linear, quality
from weftline.llm.tokens import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = st.lists(st.text(alphabet=st.sampled_from("ab ab\n\t\r\x0b\x0c#<é \U0001d11e"), max_size=60), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_counts_equal_plain_python(texts):
    found = quality.counts(texts, Words(texts))
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_and_hashes_depend_on_the_word_alone(texts):
    words = Words(texts)
    seen = {}
    each = [WORD.findall(t) for t in texts]
    assert [words.first[i + 1] - words.first[i] for i in range(len(texts))] == [len(w) for w in each]
    for w, h in zip((w for ws in each for w in ws), words.hashes().tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def corpus(spark, prose, n=240):
    rows, labels = [], []
    for i in range(n):
        text, good = prose(40 + i % 60, i), i % 3 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split(" ")) if i % 2 else text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_model_on_rows_it_has_not_seen(spark, prose):
    docs, labels = corpus(spark, prose)
    model = quality.train(docs, labels.filter("doc_id < 150"))
    got = {r["doc_id"]: r for r in quality.judge(docs, model).collect()}
    wrong = [i for i in range(150, 240) if got[i]["kept"] != (i % 3 != 0)]
    assert len(wrong) <= 1
    brier = sum((got[i]["probability"] - (i % 3 != 0)) ** 2 for i in range(150, 240)) / 90
    assert brier < 0.05
    assert [r["doc_id"] for r in quality.keep(docs, model).orderBy("doc_id").collect()] == [i for i in range(240) if got[i]["kept"]]


def test_edges(spark, prose):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    long = prose(60_000, 1)
    docs = spark.createDataFrame(
        [(1, None, 1, "x"), (2, "", 0, None), (3, " \n\t", 1, "x"), (4, long, 1, "y"), (4, long, 1, "y"), (None, prose(30, 2), None, "z"), (5, "one two three four five six seven eight nine ten", 0, "z")],
        "doc_id long, text string, kept int, probability string",
    )
    model = quality.train(docs, labels)
    assert model is None  # one class alone teaches nothing
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in quality.judge(docs, model).collect())
    assert got == [("1", 0, True, False), ("2", 0, True, False), ("3", 0, True, False), ("4", 60_000, False, True), ("4", 60_000, False, True), ("5", 10, False, True), ("None", 30, False, True)]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.judge(docs.filter("false"), model).count() == 0
    assert quality.train(docs, labels.filter("false")) is None


@pytest.mark.parametrize("repeats", [False, True])
def test_scores_do_not_depend_on_the_batch(prose, repeats):
    import numpy as np

    texts = [prose(20 + i, i) for i in range(12)] + ["", "a", "ab cd"]
    w = np.random.default_rng(0).normal(size=4 * linear.BUCKETS)
    whole = linear.means(linear.buckets(Words(texts), repeats), w)
    single = [float(linear.means(linear.buckets(Words([t]), repeats), w)[0]) for t in texts]
    assert np.allclose(whole, single, atol=1e-9)
    sparse = [float((w[a] * v).sum()) for a, v in linear.vectors(texts, repeats)]
    assert np.allclose(whole, sparse, atol=1e-5)


def test_platt_recovers_a_logistic_curve():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, 20_000)
    y = (rng.random(20_000) < linear.sigmoid(0.7 * x - 2)).astype(float)
    slope, offset = linear.platt(x, y)
    assert abs(slope - 0.7) < 0.05 and abs(offset + 2) < 0.15
