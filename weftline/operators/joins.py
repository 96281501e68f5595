"""Equi-joins on keys of the same name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOW = ("inner", "left", "right", "outer")


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_1", "_2"), deal: int = 0) -> DataFrame:
    """Keys, then the other columns of the left, then of the right.

    Null keys match null keys. Without keys an inner join pairs all rows. Other
    columns that both sides have get the suffixes, also where a side is missing;
    an outer join has one such column instead, the right's value where the right
    has a row.

    deal is for few keys with many rows on both sides, where tasks would be as
    few as the keys: each key's right rows are dealt over so many parts, every
    one of which meets all left rows of the key. The left should be the smaller.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    keys = list(keys)
    for df in (left, right):
        df.select(*keys)  # a missing key is an error here
    ours, theirs = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    both = set(ours) & set(theirs)
    a = left.select(*[F.col(f"`{k}`").alias(f"_a{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(ours)], F.lit(True).alias("_in_left"))
    b = right.select(*[F.col(f"`{k}`").alias(f"_b{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(theirs)], F.lit(True).alias("_in_right"))
    if not keys:
        if how != "inner":
            raise ValueError("only an inner join can do without keys")
        out = a.crossJoin(b)
    elif deal:
        if how != "inner":
            raise ValueError("only an inner join can deal its rows")
        # one struct as key: nulls in it are equal, and the number of tasks stays as it is dealt
        a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
        a = a.withColumn("_ka", F.struct(*[F.col(f"_a{i}").alias(f"k{i}") for i in range(len(keys))], F.col("_part").cast("long").alias("part"))).repartition(deal, "_ka")
        part = F.coalesce(F.pmod(F.xxhash64(*b.columns), F.lit(deal)), F.lit(0)).cast("long")
        b = b.withColumn("_kb", F.struct(*[F.col(f"_b{i}").alias(f"k{i}") for i in range(len(keys))], part.alias("part"))).repartition(deal, "_kb")
        out = a.join(b.hint("merge"), F.col("_ka") == F.col("_kb"))
    else:
        # plain equality where no key can be null
        never = [not (left.schema[k].nullable or right.schema[k].nullable) for k in keys]
        on = [F.col(f"_a{i}") == F.col(f"_b{i}") if never[i] else F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))]
        out = a.join(b, on, how)
    columns = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    for i, c in enumerate(ours):
        value = F.col(f"_l{i}")
        if c in both and how == "outer":
            value = F.when(F.col("_in_right"), F.col(f"_r{theirs.index(c)}")).otherwise(value)
        columns.append(value.alias(c + suffixes[0] if c in both and how != "outer" else c))
    for i, c in enumerate(theirs):
        if c not in both or how != "outer":
            columns.append(F.col(f"_r{i}").alias(c + suffixes[1] if c in both else c))
    return out.select(*columns)
