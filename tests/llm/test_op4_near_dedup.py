"""Near duplicates against all pairs compared in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain(rows, width, percent):
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text, width))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def corpus(prose, seed):
    """Copies, copies with edits, chains of edits, a passage that many share, and documents on their own."""
    rng = random.Random(seed)
    texts = [prose(rng.randint(30, 200), 1000 * seed + i) for i in range(25)]
    passage = prose(40, 77)
    for base in texts[:8]:
        texts += [base, base.upper()]
        words = base.split(" ")
        for _ in range(4):
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(["edit", "other", "words"])
            texts.append(" ".join(words))
    texts += [passage + " " + prose(rng.randint(5, 60), 5000 + i) for i in range(40)]
    texts += ["", None, " \n", "one", "One", "one two", "one two", "one two three", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_equals_all_pairs(spark, prose, seed, width, percent):
    rows = corpus(prose, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in nd.near_duplicates(docs, width, percent).collect()}
    want = plain(rows, width, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    for i, text in rows:
        assert got[i]["n_shingles"] == len(shingles(text, width)) and got[i]["kept"] == (want[i] == i)


def test_long_lists(spark, prose, monkeypatch):
    """Lists over the short length are finished in blocks, and components by rounds."""
    monkeypatch.setattr(nd, "SMALL_EDGES", 0)
    monkeypatch.setattr(nd, "SHORT_LIST", 3)
    rows = corpus(prose, 4)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain(rows, 3, 85)


def test_too_many_candidates_for_the_bit_table(spark, prose, monkeypatch):
    monkeypatch.setattr(nd, "FILTER_BITS", 64)
    rows = corpus(prose, 5)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain(rows, 3, 85)


def test_edges(spark, prose):
    text = prose(40_000, 3)
    schema = "doc_id long, text string, n_shingles string, kept int, component_id string, key int"
    extra = ("x", 1, "y", 2)
    rows = [(5, text), (5, text), (9, text + " end"), (None, text), (None, None), (2, None), (2, ""), (7, "solo words here")]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, 5, False), (None, None, True), (2, 2, True), (2, 2, True), (7, 7, True)], key=str)
    assert nd.near_duplicates(docs.filter("false"), 3, 85).count() == 0
    assert nd.near_duplicates(docs.filter("doc_id = 7"), 3, 85).count() == 1


@pytest.mark.parametrize("small", [0, None])
def test_components_of_a_long_chain(spark, small):
    ids = list(range(0, 400, 3))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(1001, 1002), (5, 5)], "a long, b long")
    got = {r["doc_id"]: r["component_id"] for r in nd.components(edges, small).collect()}
    assert got == {**dict.fromkeys(ids, 0), 1001: 1001, 1002: 1001}


def test_sets_do_not_depend_on_the_batch(prose):
    texts = [prose(n, n) for n in (1, 2, 3, 50, 300)] + ["", "a b"]
    whole = list(nd.shingle_sets(texts, 3))
    for text, s in zip(texts, whole, strict=True):
        assert np.array_equal(next(nd.shingle_sets([text], 3)), s) and len(s) == len(shingles(text, 3))


def edited_copies(n, seed):
    """One text with 3 or 4 of its 150 words replaced by new ones in most copies, with fewer in some, which are their only links."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for j in rng.sample(range(150), 0 if i == n // 2 else 1 if i % 100 == 50 else 2 if i % 20 == 10 else rng.randint(3, 4)):
            words[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return rows


def all_pairs(rows, width, percent):
    """As plain(), by a product of matrices."""
    sets = [shingles(text, width) for _, text in rows]
    place = {s: k for k, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        m[k, [place[x] for x in s]] = 1
    shared, n = (m @ m.T).astype(int), m.sum(axis=1).astype(int)
    linked = 100 * shared >= percent * (n[:, None] + n - shared)
    label, last = np.array([i for i, _ in rows]), None
    while last is None or (label != last).any():
        last, label = label, np.array([label[x].min() for x in linked])
    return dict(zip([i for i, _ in rows], label.tolist(), strict=True))


@pytest.mark.parametrize("block", [1024, 300])
def test_large_group_of_edited_copies(spark, monkeypatch, block):
    """Links to members other than the ends of long lists are found, in one block and in many."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", block, raising=False)
    rows = edited_copies(2000, 1)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()}
    want = all_pairs(rows, 3, 85)
    assert sum(got[i] != want[i] for i in want) == 0


@pytest.mark.parametrize("columns", [4096, 7])
def test_shared_counts(monkeypatch, columns):
    monkeypatch.setattr(nd, "COLUMNS", columns)
    rng = np.random.default_rng(1)
    often, seldom = rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    left, right = ([np.unique(np.concatenate([rng.choice(often, 25), rng.choice(seldom, 30)])) for _ in range(n)] for n in (90, 70))
    assert nd._shared(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_very_short_sets(spark):
    """Of 4 and 5 shingles with 4 in common, wherever the fifth is in the order of hashes."""
    rows = [(2 * k + j, " ".join(f"w{k}_{i}" for i in range(8 + j))) for k in range(60) for j in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize(("percent", "k"), [(85, 48), (80, 48), (50, 48), (100, 48), (90, 12)])
def test_common_values(percent, k):
    """Similar sets, as random as they can be, have as many retained values in common as is asked for, and one of the rarest."""
    rng, need = random.Random(percent), nd.common_values(percent, k)
    assert len(need) == k + 2 and all(1 <= x <= max(1, min(n, k)) for n, x in enumerate(need[1:], 1))
    for n in [*range(1, k + 20), 100, 400]:
        for _ in range(20):
            other = rng.randint(-(-n * percent // 100), n)  # a subset, at the threshold or above
            a = sorted(rng.sample(range(10**9), n))
            b = sorted(rng.sample(a, other))
            if rng.random() < 0.5:  # what was left out, in part replaced, as long as the similarity holds
                more = rng.randint(0, max(0, other * 100 // percent - n))
                b = sorted([*b, *rng.sample(range(10**9, 2 * 10**9), more)])
            shared = len(set(a[:k]) & set(b[:k]))
            assert 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
            assert shared >= max(need[min(n, k + 1)], need[min(len(b), k + 1)])


def test_estimate_from_ranks(spark, prose):
    """Sets around the size of the sketch, at 5 words and 80 %, against all pairs."""
    rng, rows = random.Random(8), []
    for g in range(12):
        words = prose(rng.randint(40, 70), 100 + g).split()
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(edited[rng.randint(0, 3) : len(edited) - rng.randint(0, 3)])))
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, 5, 80)


def test_passage_that_a_third_of_all_share(spark, prose):
    """Values of a passage are in no list unless it is most of the document; one id with two texts is one node."""
    passage = prose(30, 1)
    rows = [(i, f"{passage} {prose(60, 100 + i)}") for i in range(150)] + [(200, passage), (201, passage + " end"), (200, prose(80, 7)), (202, prose(80, 7) + " end"), (203, prose(80, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, 3, 85).collect()}
    assert got == plain(rows, 3, 85)
    slim = nd.sketch(docs, 3).selectExpr("doc_id", "hash(signature) as tag", "n_shingles", "sketch")
    assert nd.inverted_lists(slim, 85, nd.SKETCH)[1].agg({"n": "max"}).first()[0] <= 2


def test_keep_one(spark, prose):
    """Ids that are missing or repeated: each row is a document; columns of any name stay."""
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    names = ["doc_id", "text", "kept", "number", "row", "component_id", "a.b"]
    schema = ", ".join(f"`{x}` {'long' if x == 'doc_id' else 'string'}" for x in names)
    rows = [(7, a), (3, a + " end"), (None, a), (9, b), (9, b), (9, c), (None, prose(60, 4)), (None, prose(60, 4)), (1, None), (None, ""), (2, "")]
    docs = spark.createDataFrame([(*r, *names[2:]) for r in rows], schema)
    out = nd.keep_one(docs, 3, 85)
    assert out.columns == names
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(*r, *names[2:]) for r in [(3, a + " end"), (9, b), (9, c), (None, prose(60, 4)), (1, None), (None, ""), (2, "")]], key=str)
    unique = docs.filter("doc_id in (7, 3, 1)")
    assert sorted(r["doc_id"] for r in nd.keep_one(unique, 3, 85).collect()) == [1, 3] and nd.keep_one(unique, 3, 85).columns == names
    assert nd.keep_one(docs.filter("false")).count() == 0
