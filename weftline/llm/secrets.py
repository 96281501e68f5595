"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations only.

Every text, be it the current or an earlier version of a document, is a blob
named by its SHA-256. A ledger, a folder of two append-only tables, holds which
rules each blob was scanned with, and the findings; a rule's name carries its
version. An update scans only unseen pairs of blob and rule, and findings are
joined back to all documents and versions by blob.

Texts are hashed and scanned where they lie. What is unseen is found by a join of
hashes alone; the unseen blobs then meet their texts by a broadcast if they are
few, which is checked, and by a shuffle if they are many. A rule that no blob was
scanned with yet needs no join at all.

A match's place comes from the texts between matches: split() and
regexp_extract_all() with the same pattern give both lengths, and a running sum
over the matches of one blob gives the bounds in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, sha

#: Unseen blobs up to this number are broadcast to the texts: about 100 bytes each.
BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are secrets if the group has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # runs are greedy, so a least length inside the pattern drops the same matches as a check after it
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    # a key's block to its end line, or without one to the end of its lines; no group repeats, which would recurse
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x20\x09-\x0D]*Proc-Type: 4,ENCRYPTED[\x20\x09-\x0D]*DEK-Info: [A-Za-z0-9,-]*)?(?:[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)", base=False),
)

SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, kind string, start long, end long"


def blobs(texts: DataFrame) -> DataFrame:
    """blob, text of every row (null as empty)."""
    return texts.select(sha(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))


def scan(found: DataFrame, rules: tuple[Rule, ...] = RULES, wanted: str | None = None) -> DataFrame:
    """blob, rule, kind, start, end (exclusive, code points) of the matches in blobs (blob, text); equal blobs give them once.

    wanted names a column with the rules' names that a row is scanned with, if not with all.
    """
    each = []
    for k, rule in enumerate(rules):
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        found = found.withColumn(f"m{k}", hits if wanted is None else F.when(F.array_contains(wanted, rule.name), hits))
    for k, rule in enumerate(rules):
        lengths = lambda c: F.transform(c, F.length)
        values = lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)))
        gaps = lengths(F.split("text", rule.pattern, -1))
        hits = F.when(F.size(f"m{k}") > 0, F.arrays_zip(F.slice(gaps, 1, F.size(f"m{k}")).alias("gap"), lengths(F.col(f"m{k}")).alias("size"), values.alias("value")))
        each.append(F.struct(F.lit(k).alias("k"), hits.alias("hits")))
    rows = found.filter(F.greatest(*[F.size(f"m{k}") for k in range(len(rules))], F.lit(0)) > 0).select("blob", F.explode(F.array(*each)).alias("r"))
    rows = rows.select("blob", "r.k", F.posexplode("r.hits").alias("i", "hit")).select("blob", "k", "i", "hit.*")
    rows = rows.distinct()  # the matches of texts that occur more than once
    upto = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") + 1)
    rows = rows.filter(F.col("value") >= of([r.least for r in rules]))
    return rows.select("blob", of([r.name for r in rules]).alias("rule"), of([r.kind for r in rules]).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def opened(spark: SparkSession, ledger: str) -> tuple[DataFrame, DataFrame]:
    """The ledger's tables: blob and rules it was scanned with (a row for each update), and findings. A new folder is an empty ledger."""
    out = []
    for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
        spark.range(0).selectExpr(*[f"cast(null as {kind}) as {column}" for column, kind in (x.split(" ") for x in schema.split(", "))]).write.mode("ignore").parquet(f"{ledger}/{name}")
        out.append(spark.read.schema(schema).parquet(f"{ledger}/{name}"))
    # an update that broke off between its two tables left findings that its repetition writes again
    return out[0], out[1].distinct()


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is new in versions (text; one row per path and version) and add it to the ledger in this folder; gives all findings of these rules.

    A pair of blob and rule that the ledger has is not scanned again. Equal new
    texts in one update are scanned where they lie and reported once.
    """
    spark = versions.sparkSession
    scanned, _ = opened(spark, ledger)
    texts = blobs(versions)
    names = {r.name for r in rules}
    seen = {r[0] for r in scanned.select(F.explode("rules")).distinct().collect()} & names  # no more than there are rules
    listed = lambda some: F.array(*[F.lit(x) for x in sorted(some)]).cast("array<string>")
    done = scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    missing = texts.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(listed(names), F.coalesce("done", listed([]))).alias("rules"))
    missing = materialise(missing.filter(F.size("rules") > 0), "secrets-unseen")
    found = []
    if fresh := tuple(r for r in rules if r.name not in seen):
        found.append(scan(texts, fresh))
    if known := tuple(r for r in rules if r.name in seen):
        part = missing.filter(F.arrays_overlap("rules", listed(seen)))
        few = part.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
        found.append(scan(texts.join(F.broadcast(part) if few else part, "blob"), known, "rules"))
    for rows in found:
        rows.write.mode("append").parquet(f"{ledger}/findings")
    missing.write.mode("append").parquet(f"{ledger}/scanned")
    discard(missing)
    return opened(spark, ledger)[1].filter(F.col("rule").isin(sorted(names)))


def _spans(order: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    return F.array_sort(F.collect_list(F.struct(F.col("start"), place.alias("place"), F.col("kind"), F.col("end"))))


def report(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans for every row of docs (doc_id, text).

    spans lists kind:start:end by start, then by the order of the rules; base_sha256
    is the SHA-256 of that list of base kinds. Null and empty texts have no
    findings: counts of 0, an empty list and its digest. Equal texts have equal
    results, repeated rows a row each. Other columns are ignored.
    """
    kinds, base = [r.kind for r in rules], [r.kind for r in rules if r.base]
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    by = findings.groupBy("blob").agg(_spans(kinds).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base])
    by = by.select("blob", *[f"n_{k}" for k in base], F.sha2(show(F.filter("all", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), show(F.col("all")).alias("spans"))
    by = materialise(by, "secret-spans")  # a join right above an aggregate can't split a blob that many documents hold
    out = docs.select("doc_id", sha(F.col("text")).alias("blob")).join(by, "blob", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", length: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each maximal stretch of findings (of these rules) in `text` replaced by the mark; all other columns and rows stay.

    length names a column of docs that holds the text's length and is set anew
    where the text changes. Null and empty texts stay as they are; repeated rows
    get a row each; columns may have any names. Texts that no rule matches are
    passed on where they lie, only the others are shuffled to their findings.
    """
    upto = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = findings.withColumn("reach", F.max("end").over(upto))
    rows = rows.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = parts.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    parts = materialise(parts, "secret-cuts")  # a join right above an aggregate can't split a blob that many documents hold
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.coalesce(F.col("text").rlike(rule.pattern), F.lit(False))
    # the row's own columns go along as one, so none can clash with the names here
    found = docs.filter(hit).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField("text")
    found = found.withColumn("blob", sha(text)).join(parts, "blob", "left")
    n = F.size("cuts")
    between = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            (F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"]) + 1).cast("int"),
            (F.when(i == n, F.length(text)).otherwise(F.get("cuts", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"])).cast("int"),
        ),
    )
    new = found.withColumn("new", F.when(n > 0, F.array_join(between, mark)).otherwise(text))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            old = F.col("new")
        elif name == length:
            old = F.when(n > 0, F.length("new").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return docs.filter(~hit).union(new.select(*[column(c) for c in docs.columns]))
