"""Spaced seeds: every pattern of substitutions is hit; documents against all alignments in plain Python."""

import itertools
import random
import re
import string

import numpy as np
import pytest

from weftline.llm import decontaminate as d

CLEAN = str.maketrans({**{i: i + 32 for i in range(65, 91)}, **dict.fromkeys(map(ord, string.punctuation))})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CLEAN))


def plain(text, items):
    x, out = tokens(text), []
    for i, item in items:
        y = tokens(item)
        if i is None or len(y) < d.SPAN:
            continue
        n = min(len(y), d.WINDOW)
        limit = d.MAX_SUBSTITUTIONS if len(y) >= d.WINDOW else 0
        for a in range(len(x) - n + 1):
            if any(sum(p != q for p, q in zip(x[a : a + n], y[b : b + n], strict=True)) <= limit for b in range(len(y) - n + 1)):
                out.append(i)
                break
    return sorted(set(out))


def test_every_pattern_of_substitutions_leaves_a_seed():
    for wrong in itertools.combinations(range(d.WINDOW), d.MAX_SUBSTITUTIONS):
        assert any(not {o + p for p in mask} & set(wrong) for mask in d.MASKS for o in range(d.WINDOW - d.SPAN + 1))
    assert all(mask[0] == 0 and mask[-1] < d.SPAN for mask in d.MASKS)


def corpus(prose, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng.randint(4, 50), 900 + i)) for i in range(30)] + [(77, None), (78, ""), (79, "a b c"), (3, prose(30, 5000)), (None, prose(40, 901))]
    texts = [prose(rng.randint(5, 150), i) for i in range(40)]
    for k in range(60):
        item = (rng.choice(items)[1] or "").split(" ")
        lo = rng.randint(0, max(0, len(item) - 14))
        part = item[lo : lo + rng.randint(10, 40)]
        for _ in range(rng.randint(0, 4)):
            if part:
                part[rng.randrange(len(part))] = "changed"
        text = " ".join(part)
        text = text.upper() if k % 3 == 0 else text.replace(" ", " -- ") if k % 3 == 1 else text
        texts.append(prose(rng.randint(1, 60), 7000 + k) + " " + text + " " + prose(rng.randint(1, 60), 8000 + k))
    return list(enumerate([*texts, None, "", " \n "])), items


#: The seeds themselves, and tables of many and of hardly any bits.
SIZES = [(1 << 20, 1 << 27), (10, 1 << 20), (0, 64)]


@pytest.mark.parametrize(("seed", "exact", "bits"), [(1, *SIZES[0]), (2, *SIZES[1]), (1, *SIZES[2])])
def test_equals_all_alignments(spark, prose, seed, exact, bits):
    rows, items = corpus(prose, seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_ids string, matched int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in d.contamination(docs, bench, exact, bits).collect()}
    dirty = set()
    for i, text in rows:
        want = plain(text, items)
        assert got[i]["item_ids"] == want and got[i]["contaminated"] == bool(want)
        dirty |= {i} if want else set()
    assert 20 < len(dirty) < 80
    kept = d.clean(docs, bench, exact, bits)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in rows if i not in dirty]


@pytest.mark.parametrize(("exact", "bits"), SIZES)
def test_edges(spark, prose, exact, bits):
    """Rows that repeat an id, or have none, keep the result of their own text at any size of the benchmark."""
    long = prose(50_000, 1)
    leak = " ".join(long.split()[49_000:49_020])
    rows = [(1, long), (1, "clean words"), (1, long), (2, None), (2, None), (None, prose(30, 2)), (None, leak), (None, leak), (3, "")]
    docs = spark.createDataFrame([(*r, b"x", "y") for r in rows], "doc_id long, text string, digest binary, Digest_ string")
    bench = spark.createDataFrame([(5, leak), (5, leak), (6, leak.upper())], "item_id int, text string")
    got = sorted((str(r["doc_id"]), r["contaminated"], r["item_ids"], r["matched"]) for r in d.contamination(docs, bench, exact, bits).collect())
    bad, good = (True, [5, 6], 13), (False, [], 0)
    assert got == sorted([("1", *bad), ("1", *good), ("1", *bad), ("2", *good), ("2", *good), ("None", *good), ("None", *bad), ("None", *bad), ("3", *good)])
    kept = d.clean(docs, bench, exact, bits)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["text"] not in (long, leak))
    none = bench.filter("false")
    assert d.contamination(docs, none, exact, bits).filter("contaminated").count() == 0 and d.clean(docs, none, exact, bits).count() == len(rows)
    assert d.contamination(docs.filter("false"), bench, exact, bits).count() == 0 and d.clean(docs.filter("false"), bench, exact, bits).count() == 0


def test_a_phrase_that_all_items_and_documents_have(spark, prose):
    phrase = prose(9, 1)
    items = [(i, f"{prose(15, 100 + i)} {phrase} {prose(15, 200 + i)}") for i in range(60)]
    rows = [(i, f"{prose(20, 300 + i)} {phrase} {prose(20, 400 + i)}") for i in range(60)] + [(99, f"{prose(20, 9)} {items[7][1]}")]
    got = {r["doc_id"]: r["item_ids"] for r in d.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: plain(t, items) for i, t in rows} and got[99] == [7]


def test_seeds_do_not_depend_on_their_place():
    h = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.array_equal(d._seeds(h, 0)[7:], d._seeds(h[7:], 0)) and not np.isin(d._seeds(h, 0), d._seeds(h, 1)).any()
