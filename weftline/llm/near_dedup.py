"""MinHash near-dedup with bottom-k sketches.

One hash function orders a document's distinct word shingles; the k smallest
hashes are its sketch. Documents with equal shingle sets are one class, found by
a signature; only class representatives go on.

Inverted lists hold the documents of each retained value. Two documents that are
similar enough have a known number of retained values in common: for sets within
the sketch it follows from the sizes, for larger ones it is the binomial bound
that fails with a probability below MISSED. So a document is entered only for
its rarest values, as many as it can have beside the common ones (a prefix
filter: one common value is among the rarest of both). Values that occur once
count for nothing, and those of a passage that a large part of the corpus shares
are left out unless the passage is most of the document.

In a list each member meets the smallest and the largest; a document is first
compared with the one it meets most often. Pairs pass a bound on set sizes and
the similarity estimated from the union's sketch, and are then confirmed on the
full shingle sets. Connected components of confirmed links follow. Lists that
then hold several components are finished exactly: short ones by all pairs of
different components, long ones by comparing full sets in blocks, first with
some hundred documents of the area (components that share such lists), then what
is still outside the area's largest component with all of the area. So all
documents that share a list are of one component or have been compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise
from .tokens import Words, mix, windows

SKETCH = 48
#: Lists up to this length are finished by pairs of members from different components, longer ones in blocks.
SHORT_LIST = 64
#: Edges up to this number are made into components by one task, 16 bytes each.
SMALL_EDGES = 100_000
#: Documents and shingle hashes that one side of a block of the last round has at most, on average.
BLOCK_DOCS, BLOCK_HASHES = 1024, 1 << 21
#: Columns of a block that are multiplied at once, and the share of pairs below which a column is added pair by pair.
COLUMNS, SPARSE = 4096, 1 / 64
#: Probability that sketches of two documents at the threshold have fewer values in common than is asked for.
MISSED = 1e-9
#: Bits of the table of wanted document ids at most: 16 MB.
FILTER_BITS = 1 << 27


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    h = words.hashes()
    runs, at = windows(h, words.doc, width)
    first = np.searchsorted(at, words.first)
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            yield np.zeros(0, np.uint64)
        elif b - a < width:
            total = int(b - a)
            for x in h[a:b].tolist():
                total = (total * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([total], np.uint64))
        else:
            yield np.unique(runs[first[i] : first[i + 1]])


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sizes, marks, kept = [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                kept.append(s[:k].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))],
                names=["doc_id", "n_shingles", "signature", "sketch"],
            )

    return run


def sketch(docs: DataFrame, width: int = 3, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, signature (null without shingles), sketch of every document."""
    return docs.select("doc_id", "text").mapInArrow(_sketches(width, k), "doc_id long, n_shingles long, signature binary, sketch array<long>")


def _wanted(ids: DataFrame) -> np.ndarray | None:
    """A bit table of the ids' hashes, with 256 bits or more for each id, or 8 or more in the largest; None if that is too small."""
    n = ids.count()
    if 8 * n > FILTER_BITS:
        return None
    bits = min(FILTER_BITS, 1 << max(6, (512 * n).bit_length() - 1))
    words = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 64))")).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return table.view(np.uint8)


def _sets(width: int, wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                slot = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for part, texts in chunks([batch]):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), sets], names=["doc_id", "shingles"])

    return run


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (sorted hashes) of the documents in ids (doc_id), and perhaps of a few others.

    Texts stay where they are: a bit table of the wanted ids goes to the tasks.
    Only if the ids are too many for the table are texts shuffled to the ids.
    """
    ids = ids.distinct()
    wanted = _wanted(ids)
    slot = F.lit(0).cast("long") if wanted is None else F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(wanted)))
    rows = docs.select("doc_id", "text", slot.alias("slot")).filter("doc_id is not null")
    if wanted is None:
        rows = rows.join(ids, "doc_id", "left_semi")
    return rows.mapInArrow(_sets(width, wanted), "doc_id long, shingles binary")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_values(percent: int, k: int) -> list[int]:
    """How many retained values a document has in common with a similar one, by its number of shingles (the last entry is for more than k).

    A set within the sketch shares percent of itself, less what a partner, larger
    by no more than the threshold allows, may not retain. Otherwise the k values
    of the union's sketch are a sample of the union, of which each is common with
    a probability of the similarity.
    """
    t = percent / 100
    low, below = 0, (1 - t) ** k
    while below < MISSED and low < k:
        low += 1
        below += math.comb(k, low) * t**low * (1 - t) ** (k - low)
    out = [0]
    for n in range(1, k + 1):
        most = n * 100 // percent  # the largest partner
        least = -(-n * percent // 100)
        out.append(max(1, least - max(0, most - k), min(least, low) if most > k else 0))
    return [*out, max(1, low)]


def _common(size: str, percent: int, k: int):
    table = F.array(*[F.lit(x) for x in common_values(percent, k)])
    return F.element_at(table, (F.least(F.col(size), F.lit(k + 1)) + 1).cast("int"))


def inverted_lists(reps: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, doc_id) of every list with two documents or more, (key, lo, hi, n) of each list, and the documents entered.

    reps: doc_id, tag (tells rows of one doc_id apart), n_shingles, sketch. Of a
    document entered, `held` has those of its retained values that occur again,
    with their ranks in its sketch, by rank.
    """
    entries = reps.select(F.posexplode("sketch").alias("rank", "key"), "doc_id", "tag", "n_shingles")
    # aggregates are written before they are joined: a join right above an aggregate can't split a hot key
    often = materialise(entries.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "near-values")
    # sets: rows that repeat a document with its text are one
    held = entries.join(often, "key").groupBy("doc_id", "tag", "n_shingles").agg(F.collect_set(F.struct("often", "key", "rank")).alias("held"))
    first = F.size("held") - _common("n_shingles", percent, k) + 1
    held = held.filter(first > 0).withColumn("rare", F.slice(F.array_sort("held"), F.lit(1), first)["key"])
    held = materialise(held.withColumn("held", F.array_sort(F.transform("held", lambda x: F.struct(x["rank"], x["key"])))), "near-held")
    rare = materialise(held.select("doc_id", F.explode("rare").alias("key")).distinct(), "near-rare")
    ends = rare.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    ends = materialise(ends, "near-ends")
    lists = materialise(rare.join(ends.select("key"), "key"), "near-lists")
    discard(often, rare)
    return lists, ends, held


def _linked(pairs: DataFrame, held: DataFrame, docs: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a < b), those whose full shingle sets are similar enough."""
    s = held.select("doc_id", "n_shingles", "held")
    both = pairs.join(s.toDF("a", "n_a", "s_a"), "a").join(s.toDF("b", "n_b", "s_b"), "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    both = both.withColumn("shared", F.filter("s_a", lambda x: F.array_contains("s_b.key", x["key"])))
    # the i-th common value is preceded in the union by what precedes it in either sketch, common values once
    of_b = lambda x: F.element_at("s_b", F.array_position("s_b.key", x["key"]).cast("int"))["rank"]
    sampled = F.size(F.filter(F.transform("shared", lambda x, i: x["rank"] + of_b(x) - i), lambda rank: rank < k))
    n = F.size("shared")
    whole = F.greatest("n_a", "n_b") <= k  # then the sketches are the sets
    likely = both.filter(F.when(whole, 100 * n >= percent * (F.col("n_a") + F.col("n_b") - n)).otherwise(sampled >= common_values(percent, k)[-1]))
    likely = materialise(likely.select("a", "b").distinct(), "near-likely")
    sets = sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    full = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = materialise(full.mapInArrow(_confirm(percent), "a long, b long").distinct(), "near-links")
    discard(likely)
    return links


def _tops(pairs: Iterable[tuple[int, int]]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The smallest member of each end's component, and the pairs that joined two."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        up.setdefault(v, v)
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    joined = []
    for u, v in pairs:
        a, b = top(u), top(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            joined.append((u, v))
    return {v: top(v) for v in list(up)}, joined


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, _ = _tops((u, v) for batch in batches for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["doc_id", "component_id"])


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """doc_id and component_id (smallest member) for every end of the edges (a, b); a written table.

    Up to SMALL_EDGES edges are one task's work. More take alternating large-star
    and small-star steps; each round is a written table.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    if edges.count() <= (SMALL_EDGES if small is None else small):
        found = materialise(edges.repartition(1).mapInArrow(_small_components, "doc_id long, component_id long"), "near-components")
        discard(edges)
        return found
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            found = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(edges.select(F.col("v"), F.col("v"))).distinct()
            found = materialise(found, "near-components")
            discard(edges)
            return found
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "near-least")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "near-large")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "near-lower")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = materialise(small, "near-edges")
        discard(edges, least, large, lower)
        edges = small


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*flat)
    if not len(common):
        return out.astype(np.int64)
    sides, found = [], []
    for sets, values in zip((left, right), flat, strict=True):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        rows, at = rows[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((rows[order], at[order]))
        found.append(np.bincount(at, minlength=len(common)))
    sparse = found[0] * found[1] < SPARSE * len(left) * len(right)
    first = [np.concatenate([[0], np.cumsum(x)]) for x in found]
    for c in np.flatnonzero(sparse).tolist():
        x, y = (rows[f[c] : f[c + 1]] for (rows, _), f in zip(sides, first, strict=True))
        out[np.ix_(x, y)] += 1
    place = np.cumsum(~sparse) - 1
    dense = [(rows[~sparse[at]], place[at[~sparse[at]]]) for rows, at in sides]
    for lo in range(0, int((~sparse).sum()), COLUMNS):
        x, y = (np.zeros((len(sets), COLUMNS), np.float32) for sets in (left, right))
        for matrix, (rows, at) in zip((x, y), dense, strict=True):
            a, b = np.searchsorted(at, [lo, lo + COLUMNS])
            matrix[rows[a:b], at[a:b] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _crossed(percent: int):
    def run(block: pa.Table) -> pa.Table:
        side, c = (block.column(x).to_numpy() for x in ("side", "c"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("shingles")]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        edges = []
        if len(x) and len(y):
            shared = _shared([sets[i] for i in x], [sets[i] for i in y])
            n = np.array([len(s) for s in sets])
            linked = (shared > 0) & (100 * shared >= percent * (n[x][:, None] + n[y] - shared)) & (c[x][:, None] != c[y])
            i, j = np.nonzero(linked)
            # no more edges than components: those that join two within the block
            edges = _tops(np.unique(np.stack([c[x][i], c[y][j]], axis=1), axis=0).tolist())[1]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _crossings(sets: DataFrame, found: DataFrame, percent: int, hubs: bool) -> DataFrame:
    """Links between components of one area, from documents outside its largest component to all, or to some as hubs.

    sets: area, doc_id, size (class), n, shingles.
    """
    placed = sets.select("area", "doc_id", "size", "n").join(found, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id")
    placed = materialise(placed, "near-placed")
    most = placed.groupBy("area", "c").agg(F.countDistinct("doc_id").alias("n")).groupBy("area").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("cs"))
    most = materialise(most.filter("cs > 1"), "near-main")
    placed = materialise(placed.join(most, "area"), "near-sides")
    left = placed.filter("c <> main").withColumn("size", F.explode(F.array([F.col("size") + d for d in (-1, 0, 1)])))
    right = placed
    if hubs:  # about one block in each size class of an area
        every = materialise(placed.groupBy("area", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_HASHES)).alias("every")), "near-hubs")
        right = placed.join(every, ["area", "size"]).filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("every")) == 0)
    blocks = lambda df, name: df.groupBy("area", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_HASHES)).alias(name))
    cuts = materialise(blocks(left, "x").join(blocks(right, "y"), ["area", "size"]), "near-blocks")
    salt = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(cuts, ["area", "size"]).withColumn("i", salt("x")).withColumn("j", each("y")).withColumn("side", F.lit(0))
    right = right.join(cuts, ["area", "size"]).withColumn("j", salt("y")).withColumn("i", each("x")).withColumn("side", F.lit(1))
    names = ["area", "doc_id", "size", "i", "j", "side", "c", "n"]
    both = left.select(names).unionAll(right.select(names))
    # a doc_id with several texts has several sets, told apart by their size here and compared all with all
    both = both.join(sets.select("area", "doc_id", "n", "shingles"), ["area", "doc_id", "n"]).select("area", "size", "i", "j", "side", "c", "shingles")
    links = materialise(both.groupBy("area", "size", "i", "j").applyInArrow(_crossed(percent), "a long, b long").distinct(), "near-crossed")
    discard(placed, most, cuts)
    return links


def _rest(lists: DataFrame, ends: DataFrame, found: DataFrame, links: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The components (as `found`, of `links`) after lists over the short length are finished by all comparisons that are left."""
    placed = lists.join(ends.filter(F.col("n") > SHORT_LIST).select("key"), "key").join(found, "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("c"))
    placed = materialise(placed, "near-long")
    mixed = materialise(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key", "lo"), "near-mixed")
    if mixed.isEmpty():
        discard(placed, mixed)
        return found
    members = materialise(placed.join(mixed, "key").select("doc_id", "c", "lo").distinct(), "near-rest")
    areas = components(members.select(F.col("c").alias("a"), F.col("lo").alias("b"))).toDF("c", "area")
    sets = sets_of(docs, members.select("doc_id"), width)
    full = members.select("doc_id", "c").distinct().join(areas, "c").join(sets, "doc_id").withColumn("n", F.expr("length(shingles) div 8"))
    # sets that are similar enough have the same or neighbouring size classes
    step = float(np.log(100 / percent) * (1 + 1e-9))
    full = full.withColumn("size", F.floor(F.log("n") / step) if step > 0 else F.col("n"))
    full = materialise(full.select("area", "size", "n", "doc_id", "shingles"), "near-rest-sets")
    for hubs in (True, False):
        more = _crossings(full, found, percent, hubs)
        if not more.isEmpty():
            links, last = links.union(more), found
            found = components(links)
            discard(last)
    discard(placed, mixed, members, full)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links have 100 * intersection >= percent * union over distinct shingles of
    `width` words, lower-cased in A-Z. A document with fewer words has its whole
    sequence as one shingle; one without words (or null text) is linked with
    nothing. Rows that repeat a doc_id are one node of the graph and all get its
    component. A null doc_id is no node: its row gets the component of documents
    with an equal shingle set and is not kept, or if there are none a null
    component, and is kept. Other columns of docs are ignored. An empty table
    gives none.
    """
    slim = materialise(sketch(docs, width, k), "near-sketches")
    classes = slim.filter("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1 and class_id is not null")
    classes = materialise(classes.select("signature", "class_id"), "near-equal")
    members = slim.join(classes, "signature", "left").select("doc_id", "n_shingles", "sketch", F.hash("signature").alias("tag"), F.coalesce("class_id", "doc_id").alias("class_id"))
    members = materialise(members.withColumn("sketch", F.when(F.col("doc_id") == F.col("class_id"), F.col("sketch"))), "near-classes")
    lists, ends, held = inverted_lists(members.filter("doc_id = class_id and n_shingles > 0"), percent, k)

    # the end of its lists that a document meets most often
    star = lists.join(ends, "key").select("doc_id", F.explode(F.array("lo", "hi")).alias("end")).filter("end <> doc_id")
    met = materialise(star.groupBy("doc_id", "end").agg(F.count("*").alias("times")), "near-met")
    best = met.groupBy("doc_id").agg(F.max(F.struct(F.col("times"), (-F.col("end")).alias("end"))).alias("m")).select("doc_id", (-F.col("m.end")).alias("end"))
    pairs = materialise(best.select(F.least("end", "doc_id").alias("a"), F.greatest("end", "doc_id").alias("b")).distinct(), "near-pairs")
    links = _linked(pairs, held, docs, width, k, percent)
    found = components(links)

    # short lists that are not of one component yet: pairs between different components
    placed = lists.join(ends.filter(F.col("n") <= SHORT_LIST).select("key"), "key").join(found, "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("c"))
    placed = materialise(placed, "near-short")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    both = placed.join(mixed, "key")
    x, y = both.select("key", F.col("doc_id").alias("a"), F.col("c").alias("ca")), both.select("key", F.col("doc_id").alias("b"), F.col("c").alias("cb"))
    more = materialise(x.join(y, "key").filter("a < b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "near-more")
    if not more.isEmpty():
        links, last = links.union(_linked(more, held, docs, width, k, percent)), found
        found = components(links)
        discard(last)
    found = _rest(lists, ends, found, links, docs, width, percent)
    discard(slim, classes, lists, ends, held, met, pairs, placed, more)
    found = found.select(F.col("doc_id").alias("class_id"), "component_id")
    out = members.select("doc_id", "n_shingles", "class_id").join(found, "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """The rows of docs, with all their columns, of which each group of near duplicates has one.

    That with the smallest doc_id stays; a row without an id stays only if no row
    of its group has one. Where ids are missing or repeated, each row is a
    document of its own, whatever its id, and of rows that tie an arbitrary one
    stays. Rows without words are near duplicates of nothing and all stay.
    Columns may have any names. An empty table gives none.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        gone = near_duplicates(docs, width, percent, k).filter("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # written once, so that a row's number is the same wherever it is read
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = materialise(rows, "near-rows")
    found = near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row").getField("text").alias("text")), width, percent, k)
    ids = rows.select("number", F.col("row").getField("doc_id").alias("id"))
    best = found.join(ids, found["doc_id"] == ids["number"]).groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "number"))["number"].alias("number"))
    return rows.join(best.select("number"), "number", "left_semi").select("row.*")
