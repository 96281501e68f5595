"""Language-model scores from a subword lattice.

An existing subword vocabulary spans, for every word, the lattice of all its
segmentations. No unigram vocabulary is at hand: the pieces are those of a BPE
model, whose scores are the ranks of its merges. Ranks turned into Zipf weights
start a unigram model, and expectation over the distinct words of the training
documents, each counted once, gives the probabilities. A word's probability is
the sum over all segmentations, found by a forward recursion in log space; a
text's is the product over its words and one end. Pieces never reach across a gap
between words, so this equals the recursion over the whole text, and each
distinct word of the corpus is computed once. That is lattice_score.

For score a word seen in training is one more arc across its lattice, from end to
end, with its count (Witten-Bell weights share the mass between this arc and the
pieces).

Documents are read once, in blocks: a block lists its distinct words with their
counts in training documents, and holds which document has which of its words
how often. Words are gathered with their places in the blocks, get their counts
and scores, and these return to the blocks in arrays; texts are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks, materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes of a block, and documents in it at most.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 60_000
#: Distinct words that a task works on at once, at least if there are more.
WORD_ROWS = 20_000
#: Bits of a word's key that hold its place in the block, and that hold the block's number in its task.
PLACE_BITS, NUMBER_BITS = 24, 13
#: Places of a word in one row at most, and places that a task sends back to the blocks at once.
ROW_PLACES, SENT_PLACES = 1 << 16, 1 << 21
SMOOTH = 0.1
#: Rounds of expectation; README has held-out figures of more and fewer.
ROUNDS = 2
_LOWER = {i: i + 32 for i in range(65, 91)}
_CELLS = 1 << 18
_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _char_hash(cp: np.ndarray) -> np.ndarray:
    x = (cp.astype(_U) + _U(0x632BE59BD9B4E019)) * _Q
    return x ^ (x >> _U(32))


@dataclass
class Lattice:
    """Pieces by hash, their log probabilities (natural), and how many code points the longest has; bytes have ids after the pieces, the end the last."""

    keys: np.ndarray
    log_p: np.ndarray
    longest: int

    @staticmethod
    def load(path: str = VOCABULARY) -> Lattice:
        """The pieces of a SentencePiece model, with Zipf weights by the rank of their scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        keys = np.array([_key(model.id_to_piece(i)) for i in ids], _U)
        rank = np.argsort(np.argsort([-model.get_score(i) for i in ids], kind="stable"))
        order = np.argsort(keys)
        weights = np.concatenate([1 / (rank[order] + 10.0), np.full(256, 1e-6), [1e-3]])
        return Lattice(keys[order], np.log(weights / weights.sum()), max((len(model.id_to_piece(i)) for i in ids), default=0))

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> _U(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        at = np.flatnonzero(self.table[(h >> _U(44)).astype(np.int64)].ravel())
        some = h.ravel()[at]
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        good = self.keys[place] == some
        out.ravel()[at[good]] = place[good]
        return out

    def _edges(self, cp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length: ids and log probabilities of the pieces at every place; cp has a word a row."""
        n = cp.shape[1]
        chars = _char_hash(cp)
        h, ids, logs = np.zeros_like(chars), [], []
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * _P + chars[:, size - 1 :]
            found = self.find(h ^ (h >> _U(29)))
            log = np.where(found >= 0, self.log_p[found], -np.inf)
            if size == 1:
                for r, c in zip(*np.nonzero(found < 0), strict=True):  # no piece for the character: its bytes
                    log[r, c] = sum(self.log_p[len(self.keys) + b] for b in chr(cp[r, c]).encode("utf-8", "surrogatepass"))
            ids.append(found)
            logs.append(log)
        return ids, logs

    def _forward(self, logs: list[np.ndarray]) -> np.ndarray:
        rows, n = logs[0].shape
        alpha = np.full((rows, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            alpha[:, j] = np.logaddexp.reduce([alpha[:, j - s] + logs[s - 1][:, j - s] for s in range(1, min(j, len(logs)) + 1)], axis=0)
        return alpha

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length at a time: their places in the list and their code points, with a word mark in front."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            step = max(1, _CELLS // (n + 1))
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                cp = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                yield part, np.concatenate([np.full((len(part), 1), 0x2581, np.uint32), cp], axis=1)

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, over all segmentations."""
        out = np.zeros(len(words))
        for at, cp in self.groups(words):
            out[at] = self._forward(self._edges(cp)[1])[:, -1]
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece and byte over all segmentations of the words."""
        total = np.zeros(len(self.log_p))
        for at, cp in self.groups(words):
            ids, logs = self._edges(cp)
            alpha = self._forward(logs)
            rows, n = logs[0].shape
            beta = np.full((rows, n + 1), -np.inf)
            beta[:, n] = 0
            for i in range(n - 1, -1, -1):
                beta[:, i] = np.logaddexp.reduce([beta[:, i + s] + logs[s - 1][:, i] for s in range(1, min(n - i, len(logs)) + 1)], axis=0)
            for s, (found, log) in enumerate(zip(ids, logs, strict=True), 1):
                weight = np.exp(alpha[:, : n - s + 1] + log + beta[:, s:] - alpha[:, -1:]) * counts[at][:, None]
                some = found >= 0
                total += np.bincount(found[some], weight[some], len(total))
                if s == 1:
                    for r, c in zip(*np.nonzero(~some), strict=True):
                        for b in chr(cp[r, c]).encode("utf-8", "surrogatepass"):
                            total[len(self.keys) + b] += weight[r, c]
        return total


def _key(piece: str) -> np.uint64:
    h = 0
    for c in _char_hash(np.array([ord(x) for x in piece], np.uint32)).tolist():
        h = (h * int(_P) + c) & 0xFFFFFFFFFFFFFFFF
    return _U(h ^ (h >> 29))


_SCHEMA = pa.schema([("word", pa.string()), ("key", pa.int64()), ("count", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *[(x, pa.binary()) for x in ("lengths", "posts", "post_docs", "times")]])
_BLOCKS = "word string, key long, count long, block long, docs array<long>, held array<boolean>, lengths binary, posts binary, post_docs binary, times binary"


def _packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


class _Block:
    """Documents of a block while they are read."""

    def __init__(self):
        self.vocabulary: defaultdict[str, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.docs, self.held, self.size = [], [], [], 0

    def add(self, words: list[str], doc: int | None, held: bool, size: int) -> bool:
        """True if the block is full."""
        self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc)
        self.held.append(held)
        self.size += size
        return self.size >= BLOCK_BYTES or len(self.docs) >= BLOCK_DOCS

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each distinct word, then one for the documents: posts of words to documents, word by word."""
        n = np.array([len(x) for x in self.ids], np.int64)
        key = np.concatenate(self.ids).astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
        key, times = np.unique(key, return_counts=True)
        word, doc = key // len(n), key % len(n)
        size = len(self.vocabulary)
        counts = np.bincount(word, times * ~np.array(self.held)[doc], size).astype(np.int64)
        words = list(self.vocabulary)
        for k in range(0, size, 20_000):
            part = words[k : k + 20_000]
            m = len(part)
            front = [pa.array(part, pa.string()), pa.array((block << PLACE_BITS) + np.arange(k, k + m)), pa.array(counts[k : k + m])]
            yield pa.RecordBatch.from_arrays(front + [pa.nulls(m, f.type) for f in list(_SCHEMA)[3:]], schema=_SCHEMA)
        row = [None, None, None, block, self.docs, self.held, n.tobytes(), np.bincount(word, minlength=size).astype(np.int32).tobytes(), doc.astype(np.uint16).tobytes(), _packed(times)]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, text, held_out)."""
    find = re.compile(WORD).findall
    base, number, block = TaskContext.get().partitionId() << NUMBER_BITS, 0, _Block()
    for part, texts in chunks(batches):
        for text, doc, held in zip(texts, part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
            if block.add(find(text.translate(_LOWER)), doc, held, len(text)):
                yield from block.rows(base + number)
                number, block = number + 1, _Block()
    if block.docs:
        yield from block.rows(base + number)


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they are long enough for vectorised work."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by word, one row a word with its count and its keys; more for very many keys, of which the first is the head."""
    held: list[pa.RecordBatch] = []  # rows of the last word so far, which may go on

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, keys = part.column(0), part.column(1)
        first = np.concatenate([[0], np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)) + 1])
        counts = np.add.reduceat(part.column(2).to_numpy(), first)
        n = np.diff(np.append(first, part.num_rows))
        pieces = -(-n // ROW_PLACES)
        of = np.repeat(np.arange(len(first)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        offsets = np.append(first[of] + piece * ROW_PLACES, part.num_rows).astype(np.int32)
        columns = [words.take(pa.array(first[of])), pa.array(counts[of]), pa.array(piece == 0), pa.ListArray.from_arrays(pa.array(offsets), keys)]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "head", "keys"])

    for batch in _together(batches, WORD_ROWS):
        words = batch.column(0)
        last = words[len(words) - 1]
        # where the batch's last word begins
        other = np.flatnonzero(pc.not_equal(words, last).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from rows(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        elif held and held[0].column(0)[0].as_py() != last.as_py():
            yield from rows(pa.concat_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from rows(pa.concat_batches(held))


def _expect(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.log_p))
        for batch in _together(batches, WORD_ROWS):
            total += lattice.expect(batch.column(0).to_pylist(), np.ones(batch.num_rows))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

    return run


def _score(lattice: Lattice):
    """Counts and scores of words, sent to the blocks in arrays by place."""

    def sent(words: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, c, log_p = (np.concatenate(x) for x in zip(*words, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, c, log_p = keys[order], c[order], log_p[order]
        block = keys >> PLACE_BITS
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        place, parts = (keys & ((1 << PLACE_BITS) - 1)).astype(np.uint32), []
        for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
            parts.append((int(block[a]), place[a:b].tobytes(), _packed(c[a:b]), log_p[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in parts], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "places", "c", "log_p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _together(batches, WORD_ROWS):
            log_p = (lattice.score(batch.column(0).to_pylist()) / np.log(10)).astype(np.float32)
            keys = batch.column(2)
            times = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
            held.append((keys.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), times), np.repeat(log_p, times)))
            n += len(held[-1][0])
            if n >= SENT_PLACES:
                yield from sent(held)
                held, n = [], 0
        if n:
            yield from sent(held)

    return run


def _documents(n: int, distinct: int, ends: int, log_end: float):
    """Scores of a block's documents from the block's own row and its words' counts and scores.

    A word seen in training is one more arc across the lattice, with its count;
    the segmentations share the weight of the distinct words (Witten and Bell).
    """

    def whole(c: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        if not distinct:
            return log_p
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(c), np.log(distinct) + log_p * np.log(10)) - np.log(n + distinct)) / np.log(10)

    base = lambda c: np.log10((c + SMOOTH) / (n + SMOOTH * (distinct + 1)))

    def run(words: pa.Table, block: pa.Table) -> pa.Table:
        row = {name: block.column(name)[0] for name in ("docs", "held", "lengths", "posts", "post_docs", "times")}
        lengths, posts, doc = (np.frombuffer(row[k].as_buffer(), t) for k, t in (("lengths", np.int64), ("posts", np.int32), ("post_docs", np.uint16)))
        times = _unpacked(row["times"].as_buffer(), len(doc)).astype(float)
        c, log_p = np.zeros(len(posts), np.int64), np.zeros(len(posts))
        for places, counts, logs in zip(*[words.column(x) for x in ("places", "c", "log_p")], strict=True):
            place = np.frombuffer(places.as_buffer(), np.uint32)
            c[place], log_p[place] = _unpacked(counts.as_buffer(), len(place)), np.frombuffer(logs.as_buffer(), np.float32)
        word = np.repeat(np.arange(len(posts)), posts)
        total = lambda x: np.bincount(doc, x[word] * times, len(lengths))
        return pa.table({
            "doc_id": pa.array(row["docs"].as_py(), pa.int64()),
            "held_out": pa.array(row["held"].as_py(), pa.bool_()),
            "n_tokens": lengths + 1,
            "n_known": total((c > 0).astype(float)).astype(np.int64) + int(ends > 0),
            "train_tokens": np.full(len(lengths), n, np.int64),
            "base_score": total(base(c)) + base(ends),
            "score": total(whole(c, log_p)) + float(whole(np.array(ends), np.array(log_end))),
            "lattice_score": total(log_p) + log_end,
        })

    return run


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for every row of docs (doc_id, text).

    Scores are log10 probabilities: base_score of a smoothed word unigram model,
    lattice_score of the subword lattice alone, score of the lattice with an arc
    for each word of the training. They learn from documents whose crc32(doc_id
    as text) mod 10 is not 0 (a null doc_id counts among these). Words are
    lower-cased in A-Z, and an end follows the last. Null and empty texts are an
    end alone. Repeated rows each count and get a row each. Other columns are
    ignored. An empty table gives no rows. rounds: how often expectation is
    repeated. A word's score is kept in single precision.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    blocks = materialise(docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(_collect, _BLOCKS), "lm-blocks")
    whole = blocks.filter("block is not null").select(F.col("block").alias("of"), "docs", "held", "lengths", "posts", "post_docs", "times")
    # a word has no more rows than there are blocks
    words = blocks.filter("block is null").select("word", "key", "count").repartition("word").sortWithinPartitions("word")
    words = materialise(words.mapInArrow(_gather, "word string, c long, head boolean, keys array<long>"), "lm-words")
    n, distinct = words.filter("head").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = whole.agg(F.coalesce(F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + (~x).cast("long"))), F.lit(0))).first()[0]
    n, distinct = n + ends, distinct + int(ends > 0)

    lattice = Lattice.load(vocabulary)
    for _ in range(rounds):
        expected = words.filter("head and c > 0").select("word").mapInArrow(_expect(lattice), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.full(len(lattice.log_p), SMOOTH)
        for piece, k in expected:
            total[piece] += k
        total[-1] += ends
        lattice = Lattice(lattice.keys, np.log(total / total.sum()), lattice.longest)
    scored = words.select("word", "c", "keys").mapInArrow(_score(lattice), "block long, places binary, c binary, log_p binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return scored.groupBy("block").cogroup(whole.groupBy("of")).applyInArrow(_documents(n, distinct, ends, float(lattice.log_p[-1] / np.log(10))), out)
