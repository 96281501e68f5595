"""Lattice scores against a sum over all segmentations, base scores against plain counting."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import lattice_lm as lm

LOWER = {i: i + 32 for i in range(65, 91)}
find = re.compile(r"[^\x20\x09-\x0D]+").findall


def tiny(pieces):
    keys = np.array([lm._key(p) for p in pieces], np.uint64)
    order = np.argsort(keys)
    w = np.concatenate([np.arange(1.0, len(pieces) + 1)[order], np.full(256, 0.01), [1.0]])
    lattice = lm.Lattice(keys[order], np.log(w / w.sum()), 5)
    return lattice, {p: float(np.exp(lattice.log_p[list(order).index(i)])) for i, p in enumerate(pieces)}


PIECES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba", "bab", "▁abab", "é"]


def segmentations(text, p, byte):
    """Pairs of probability and pieces of every segmentation."""
    if not text:
        return [(1.0, [])]
    out = []
    for n in range(1, len(text) + 1):
        piece = text[:n]
        if piece in p:
            step = p[piece]
        elif n == 1:
            step = byte ** len(piece.encode())
        else:
            continue
        out += [(step * q, [piece, *rest]) for q, rest in segmentations(text[n:], p, byte)]
    return out


WORDS = ["a", "ab", "abab", "babab", "bé", "x", "ax\U0001d11eb", "bbbbbbb", "ababababa"]


def test_forward_is_the_sum_over_all_segmentations():
    lattice, p = tiny(PIECES)
    byte = float(np.exp(lattice.log_p[len(lattice.keys)]))
    got = lattice.score(WORDS)
    for word, log_p in zip(WORDS, got, strict=True):
        assert math.isclose(log_p, math.log(sum(q for q, _ in segmentations("▁" + word, p, byte))), rel_tol=1e-9)


def test_expectation_is_the_posterior_mean():
    lattice, p = tiny(PIECES)
    byte = float(np.exp(lattice.log_p[len(lattice.keys)]))
    counts = np.arange(1.0, len(WORDS) + 1)
    want = Counter()
    for word, n in zip(WORDS, counts, strict=True):
        every = segmentations("▁" + word, p, byte)
        total = sum(q for q, _ in every)
        for q, pieces in every:
            for piece in pieces:
                want[piece] += n * q / total
    got = lattice.expect(WORDS, counts)
    place = {int(k): i for i, k in enumerate(lattice.keys)}
    for piece in PIECES:
        assert math.isclose(got[place[int(lm._key(piece))]], want[piece], rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(got[len(lattice.keys) : len(lattice.keys) + 256].sum(), want["x"] + 4 * want["\U0001d11e"], rel_tol=1e-9)


def test_long_words_stay_finite():
    lattice, _ = tiny(PIECES)
    assert np.isfinite(lattice.score(["ab" * 5000, "\U0001d11e" * 3000])).all()


needs = pytest.mark.skipif(not Path(lm.VOCABULARY).exists(), reason="the vocabulary is not here")


def plain(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    end = object()
    tokens = [[*find((t or "").translate(LOWER)), end] for _, t in rows]
    c = Counter(x for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for x in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[x] > 0 for x in ws), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)) for (i, _), ws in zip(rows, tokens, strict=True)]


@needs
@pytest.mark.parametrize("block_docs", [3, 60_000])
def test_base_scores_equal_plain_counting(spark, prose, monkeypatch, block_docs):
    monkeypatch.setattr(lm, "BLOCK_DOCS", block_docs)
    rows = [(i, prose(5 + i % 50, i % 30)) for i in range(60)] + [(100, None), (101, ""), (102, "A a B"), (102, "A a B"), (None, "null id"), (103, "x " * 70_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, block string").repartition(2)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score(docs).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(plain(rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0
    same = [g[5:] for g in got if g[0] == 102]
    assert same[0] == same[1]


def all_scores(rows, lattice, log):
    """score and lattice_score of each row: words one by one, the lattice as a sum over all segmentations."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    p = {piece: math.exp(lattice.log_p[k]) for piece, k in log.items()}
    byte = [math.exp(x) for x in lattice.log_p[len(lattice.keys) : len(lattice.keys) + 256]]

    def lattice_of(word):
        alpha = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - lattice.longest), j):
                step = p.get(word[i:j])
                if step is None and j - i == 1:
                    step = math.prod(byte[b] for b in word[i].encode())
                alpha[j] += alpha[i] * (step or 0.0)
        return alpha[-1]

    tokens = [find((t or "").translate(LOWER)) for _, t in rows]
    c = Counter(x for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for x in ws)
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    end = math.exp(lattice.log_p[-1])
    out = []
    for ws in tokens:
        q = [lattice_of("▁" + w) for w in ws] + [end]
        counts = [c[w] for w in ws] + [ends]
        out.append((sum(math.log10((k + v * x) / (n + v)) for k, x in zip(counts, q, strict=True)), sum(map(math.log10, q))))
    return out


@needs
@pytest.mark.parametrize("small", [True, False])
def test_scores_equal_plain_arithmetic(spark, prose, monkeypatch, small):
    """Whole scores, with the re-estimated lattice, from blocks of three documents and short rows, and from large ones."""
    if small:
        for name, value in (("BLOCK_DOCS", 3), ("ROW_PLACES", 2), ("SENT_PLACES", 5), ("WORD_ROWS", 7)):
            monkeypatch.setattr(lm, name, value)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lm.VOCABULARY)
    rows = [(i, prose(4 + i % 30, i % 17)) for i in range(40)] + [(100, "Été 𝄞𝄞 unseen"), (101, None), (None, "a a a b")]
    seen = []
    monkeypatch.setattr(lm, "_score", lambda lattice, f=lm._score: seen.append(lattice) or f(lattice))
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    place = {int(k): i for i, k in enumerate(seen[0].keys)}
    log = {piece: place[key] for piece in map(model.id_to_piece, range(model.get_piece_size())) if (key := int(lm._key(piece))) in place}
    for (i, text), (score, lattice) in zip(rows, all_scores(rows, seen[0], log), strict=True):
        r = got[i, len(find(text or "")) + 1]
        assert r["score"] == pytest.approx(score, rel=1e-6) and r["lattice_score"] == pytest.approx(lattice, rel=1e-6)


def test_gathered_words(monkeypatch):
    """Rows of one word in any number of batches give its sum and all its keys, in rows of a bounded length."""
    monkeypatch.setattr(lm, "WORD_ROWS", 4)
    monkeypatch.setattr(lm, "ROW_PLACES", 3)
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = sorted(rng.choice(["a", "b", "bb", "c", "é"], rng.integers(1, 40)).tolist())
        table = pa.table({"word": words, "key": np.arange(len(words)), "count": rng.integers(0, 5, len(words))})
        got = pa.Table.from_batches(list(lm._gather(iter(table.to_batches(max_chunksize=int(rng.integers(1, 6))))))).to_pylist()
        assert [r["word"] for r in got if r["head"]] == sorted(set(words)) and max(len(r["keys"]) for r in got) <= 3
        for w in set(words):
            mine = [r for r in got if r["word"] == w]
            rows = [r for r in table.to_pylist() if r["word"] == w]
            assert {r["c"] for r in mine} == {sum(r["count"] for r in rows)} and [k for r in mine for k in r["keys"]] == [r["key"] for r in rows]


@needs
def test_a_likely_text_scores_higher_than_a_shuffled_one(spark, prose):
    rows = [(i, prose(80, i)) for i in range(40)]
    odd = [(1000 + i, "".join(reversed(t))) for i, t in rows]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows + [(i, t) for i, t in odd if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()}
    held = [i for i in got if got[i]["held_out"]]
    per = lambda i: got[i]["score"] / got[i]["n_tokens"]
    assert max(per(i) for i in held if i >= 1000) < min(per(i) for i in held if i < 1000)


@needs
def test_probabilities_sum_to_one():
    p = np.exp(lm.Lattice.load().log_p)
    assert math.isclose(p.sum(), 1) and (p > 0).all()


@needs
def test_empty_and_all_held_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])
    assert row["base_score"] == pytest.approx(0.0)
