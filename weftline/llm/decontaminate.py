"""Benchmark decontamination with spaced-seed hashing.

Two fixed masks of six token positions each pick the tokens that are hashed;
the positions between them are ignored. Any 13 aligned tokens with at most two
substitutions hold an unbroken seed of one of the masks, whichever the two
positions are (a test walks through all of them).

Seeds of the test items are a table. Documents are read in place: a copy of the
seeds, or beyond a bound of their number a bit table of fixed size, tells which
places of a text may have one, and only regions around these places go on, once
for each distinct text. Their seeds are joined with the items' seeds; along the
diagonal of each hit the tokens of region and item are then compared one by one,
and a text is contaminated if 13 aligned tokens agree in 11 or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, discard, materialise
from .tokens import Words, mix

#: Token positions that each mask hashes.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW, MAX_SUBSTITUTIONS = 13, 2
#: Items of fewer tokens than WINDOW count if they occur whole and unchanged; of fewer than SPAN tokens they hold no seed and never do.
#: Distinct seeds that go to the tasks as they are, 8 bytes each; more go as a table of so many bits.
EXACT_SEEDS, TABLE_BITS = 1 << 20, 1 << 27

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PUNCTUATION = np.zeros(128, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_FRONT_BITS = 20


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, lower-cased in A-Z and without ASCII punctuation, and each text's offset."""
    words = Words(texts, lower=True, drop=_PUNCTUATION)
    return words.hashes(), words.first


def _seeds(h: np.ndarray, mask: int) -> np.ndarray:
    n = max(0, len(h) - SPAN + 1)
    total = np.full(n, np.uint64(mask + 1))
    for k, multiplier in zip(MASKS[mask], _MULTIPLIERS, strict=True):
        total = total + h[k : k + n] * multiplier
    return mix(total)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class Known:
    """Which seeds the items may have: the seeds themselves, or a table of bits."""

    def __init__(self, seeds: np.ndarray | None, bits: np.ndarray | None = None):
        self.seeds, self.bits = seeds, bits
        self.front = np.zeros(1 << _FRONT_BITS, bool)
        if seeds is not None:
            self.front[(seeds >> np.uint64(64 - _FRONT_BITS)).astype(np.int64)] = True

    def places(self, h: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h with a known seed of a mask, and these seeds."""
        s = _seeds(h, mask)
        if self.seeds is None:
            slot = s & np.uint64(len(self.bits) * 8 - 1)
            at = np.flatnonzero(self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
        else:
            at = np.flatnonzero(self.front[(s >> np.uint64(64 - _FRONT_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.seeds, s[at]), len(self.seeds) - 1)
            at = at[self.seeds[place] == s[at]] if len(self.seeds) else at[:0]
        return at, s[at]


def _known(seeds: DataFrame, exact: int, bits: int) -> Known:
    """From a table of distinct seeds (seed)."""
    if seeds.limit(exact + 1).count() <= exact:
        return Known(np.sort(seeds.toArrow().column("seed").to_numpy().view(np.uint64)))
    slots = seeds.select(F.col("seed").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    found = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return Known(None, table.view(np.uint8))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's id, the digest of its tokens, these, and its seeds with their places."""
    for part, texts in chunks(batches):
        h, first = _tokens(texts)
        rows = []
        for i in range(len(texts)):
            tokens = h[first[i] : first[i + 1]]
            found = [_seeds(tokens, m) for m in range(len(MASKS))]
            rows.append((_digest(tokens), tokens.tobytes(), np.concatenate(found).view(np.int64), np.concatenate([np.arange(len(x)) for x in found])))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["item_id", "item", "tokens", "seeds", "places"])


_REGION = pa.struct([("start", pa.int32()), ("region", pa.binary()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_REGIONS = "array<struct<start:int,region:binary,seeds:array<long>,places:array<int>>>"


def _survey(known: Known, texts: list[str]) -> Iterator[tuple[bytes | None, list[dict] | None]]:
    """Digest of each text's tokens and its regions with known seeds; None twice if there are none."""
    h, first = _tokens(texts)
    at, seeds = (np.concatenate(x) for x in zip(*(known.places(h, m) for m in range(len(MASKS))), strict=True))
    owner = np.searchsorted(first, at, "right") - 1
    inside = at + SPAN <= first[owner + 1] if len(at) else np.zeros(0, bool)
    order = np.argsort(at[inside], kind="stable")
    at, seeds, owner = at[inside][order], seeds[inside][order], owner[inside][order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield None, None
            continue
        tokens, p, s = h[first[i] : first[i + 1]], at[a:b] - first[i], seeds[a:b]
        # a window of 13 tokens that holds the seed reaches no further than this
        lo, hi = np.maximum(p - (WINDOW - SPAN), 0), np.minimum(p + WINDOW, len(tokens))
        cut = np.concatenate([[0], np.flatnonzero(lo[1:] > hi[:-1]) + 1, [len(p)]])
        regions = [{"start": int(lo[x]), "region": tokens[lo[x] : hi[y - 1]].tobytes(), "seeds": s[x:y].view(np.int64), "places": p[x:y].astype(np.int32)} for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield _digest(tokens), regions


def _find(known: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            digests, regions = zip(*_survey(known, texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(regions, pa.list_(_REGION))], names=["doc_id", "digest", "regions"])

    return run


def _rows(known: Known, column: int, names: list[str]):
    """Whole rows: those without known seeds, or if two names are given those with them, and their digest and regions as two more columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, column):
            digests, regions = zip(*_survey(known, texts), strict=True)
            digests = pa.array(digests, pa.binary())
            if names:
                part = pa.RecordBatch.from_arrays([*part.columns, digests, pa.array(regions, pa.list_(_REGION))], names=[*part.schema.names, *names])
            yield part.filter(digests.is_valid() if names else digests.is_null())

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Agreeing tokens in the best window of an item (or what of it meets the region) laid along a region; 0 if none is close enough."""
    for batch in batches:
        out = []
        for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
            same = np.frombuffer(x.as_buffer(), np.uint64) == np.frombuffer(y.as_buffer(), np.uint64)
            if n < WINDOW:
                out.append(n if len(same) == n and same.all() else 0)
                continue
            sums = np.concatenate([[0], np.cumsum(same)])
            best = int((sums[WINDOW:] - sums[:-WINDOW]).max(initial=0))
            out.append(best if best >= WINDOW - MAX_SUBSTITUTIONS else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["digest", "item", "matched"])


def _index(benchmark: DataFrame, exact: int, bits: int) -> tuple[DataFrame, Known]:
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialise(items.mapInArrow(_items, "item_id long, item binary, tokens binary, seeds array<long>, places array<int>"), "leak-items")
    seeds = materialise(items.select(F.explode("seeds").alias("seed")).distinct(), "leak-seeds")
    known = _known(seeds, exact, bits)
    discard(seeds)
    return items, known


def _verdicts(found: DataFrame, items: DataFrame) -> DataFrame:
    """digest, item_ids, matched of the contaminated texts; found: digest and regions. A written table."""
    regions = found.filter("digest is not null").select("digest", F.inline("regions"))
    regions = regions.groupBy("digest", "start").agg(*[F.first(c).alias(c) for c in ("region", "seeds", "places")])
    regions = materialise(regions, "leak-regions")
    zipped = lambda: F.explode(F.arrays_zip("seeds", "places")).alias("s")
    distinct = materialise(items.groupBy("item").agg(*[F.first(c).alias(c) for c in ("tokens", "seeds", "places")]), "leak-distinct")
    ours = regions.select("digest", "start", zipped()).select("digest", "start", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    theirs = distinct.select("item", zipped()).select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    diagonals = materialise(ours.join(theirs, "seed").select("digest", "start", "item", (F.col("at") - F.col("place")).alias("shift")).distinct(), "leak-diagonals")
    # of region and item, the tokens that meet
    both = diagonals.join(regions.select("digest", "start", "region"), ["digest", "start"]).join(distinct.select("item", "tokens"), "item")
    both = both.withColumn("n", F.expr("length(tokens) div 8")).withColumn("lo", F.greatest(F.lit(0), F.col("start") - F.col("shift")))
    both = both.withColumn("size", F.least("n", F.expr("start + length(region) div 8 - shift")) - F.col("lo"))
    piece = lambda of, first: F.substring(of, (8 * first + 1).cast("int"), (8 * F.col("size")).cast("int"))
    both = both.select("digest", "item", piece("region", F.col("lo") + F.col("shift") - F.col("start")).alias("x"), piece("tokens", F.col("lo")).alias("y"), "n")
    matched = both.mapInArrow(_compare, "digest binary, item binary, matched long").filter("matched > 0").groupBy("digest", "item").agg(F.max("matched").alias("matched"))
    matched = materialise(matched, "leak-matched")
    out = matched.join(items.select("item", "item_id").distinct(), "item").groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched"))
    out = materialise(out, "leak-verdicts")
    discard(regions, distinct, diagonals, matched)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, exact: int = EXACT_SEEDS, bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), matched (agreeing tokens of the best window) for every row of docs (doc_id, text).

    benchmark has item_id and text. Null, empty and very short items match
    nothing, nor do null and empty documents; repeated items are reported once
    by item_id, a null item_id is left out. Documents are told apart by their
    text: rows that repeat a doc_id, null among them, get a row each with the
    result of their own text. With an empty benchmark no document is
    contaminated, an empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    items, known = _index(benchmark, exact, bits)
    found = materialise(docs.select("doc_id", "text").mapInArrow(_find(known), f"doc_id {kind}, digest binary, regions {_REGIONS}"), "leak-rows")
    verdicts = _verdicts(found, items)
    discard(items)
    touched = found.filter("digest is not null").select("doc_id", "digest").join(verdicts, "digest", "left").select("doc_id", "item_ids", "matched")
    clean = found.filter("digest is null").select("doc_id", F.lit(None).cast("array<long>").alias("item_ids"), F.lit(None).cast("long").alias("matched"))
    none = F.array().cast("array<long>")
    return touched.union(clean).select("doc_id", F.col("matched").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("matched", F.lit(0).cast("long")).alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, exact: int = EXACT_SEEDS, bits: int = TABLE_BITS) -> DataFrame:
    """The rows of docs which are not contaminated, with all their columns, whatever their names.

    Nulls, repeated rows and empty tables are as in contamination(). Rows without
    a known seed are passed on where they lie; only the others are written and
    shuffled to their verdicts.
    """
    items, known = _index(benchmark, exact, bits)
    column, names = docs.columns.index("text"), []
    for name in ("digest", "regions"):
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        names.append(name)
    more = docs.sparkSession.range(0).select(F.lit(None).cast("binary").alias(names[0]), F.lit(None).cast(_REGIONS).alias(names[1])).schema
    rows = materialise(docs.mapInArrow(_rows(known, column, names), StructType([*docs.schema.fields, *more.fields])), "leak-rows")
    verdicts = _verdicts(rows.select(F.col(names[0]).alias("digest"), F.col(names[1]).alias("regions")), items)
    discard(items)
    touched = rows.join(verdicts.select(F.col("digest").alias(names[0])), names[0], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.mapInArrow(_rows(known, column, []), docs.schema).union(touched)
