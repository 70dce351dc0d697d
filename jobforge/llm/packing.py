"""Minimum bin slack: texts into containers of equal capacity, as full as possible.

Items are dealt at random into groups of bounded size, and each group is packed by itself, so no task grows with the data; a group leaves at most
its last few containers short. A container starts with the largest item left; a bitset holds the sums that the other items left can make
within the rest of the capacity, grown length by length until the fullest is reached; the items of that sum are taken out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import cut, table
from jobforge.llm import bpe

CAPACITY, GROUP = 4096, 8192


def fullest(lengths: list[tuple[int, int]], room: int) -> list[int]:
    """Lengths, of (length, how many) in falling order, whose sum is the largest that ``room`` holds."""
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n, many in lengths:
        if n > room:
            continue
        for _ in range(min(many, room // n)):
            grown = (reach | reach << n) & limit
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> left & 1:
            taken.append(n)
            left -= n
    return taken


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` (each 1 to capacity) by container."""
    held: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        held.setdefault(sizes[i], []).append(i)
    out = []
    order = sorted(held, reverse=True)
    while order:
        first = order[0]
        chosen = [held[first].pop()]
        for n in fullest([(n, len(held[n])) for n in order if held[n]], capacity - first):
            chosen.append(held[n].pop())
        out.append(chosen)
        order = [n for n in order if held[n]]
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """(doc_id, part, start, n_tokens, container, fill): one row for each text, or each part of a text over the capacity.

    Such a text is cut into full parts and a rest; the full ones are containers by themselves. Texts of no tokens (null, empty) have one row with
    n_tokens 0 and no container. ``start`` is the part's first token, ``fill`` the tokens in its container. Repeated rows are items of their own.

    Groups are packed by themselves, some ``group`` items each. Within a group no container but the last could take any item that is left, so at most
    one container a group is less than half full: the loss by grouping is under one container a group."""
    sized = cut(bpe.encode_column(documents, folder=folder, counts_only=True), "sizes")
    parts = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("part"))
    items = parts.select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part").cast("long") * capacity).alias("n_tokens"))
    whole = items.filter(F.col("n_tokens") == capacity).select("*", F.concat_ws("-", F.lit("f"), "doc_id", "part").alias("container"), F.lit(capacity).cast("long").alias("fill"))
    none = items.filter("n_tokens = 0").select("*", F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("fill"))
    loose = items.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    n_groups = max(1, round(sized.count() / group))

    def of_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True]).reset_index(drop=True)
        name, fill = [""] * len(pdf), [0] * len(pdf)
        sizes = pdf["n_tokens"].tolist()
        for k, chosen in enumerate(pack(sizes, capacity)):
            total = sum(sizes[i] for i in chosen)
            for i in chosen:
                name[i], fill[i] = f"g{key[0]}-{k}", total
        return pdf.assign(container=name, fill=fill)[["doc_id", "part", "start", "n_tokens", "container", "fill"]]

    kind = sized.schema["doc_id"].dataType.simpleString()
    # dealt by place in the written table as well, so that copies of one row spread over groups
    dealt = loose.withColumn("g", F.pmod(F.xxhash64("doc_id", "part", F.monotonically_increasing_id()), F.lit(n_groups)).cast("int")).repartition(n_groups, "g")
    packed = dealt.groupBy("g").applyInPandas(of_group, f"doc_id {kind}, part int, start long, n_tokens long, container string, fill long")
    return packed.unionByName(whole).unionByName(none)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_containers: every document's containers."""
    return containers(table(spark, sf_dir, "documents"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_fill: per kind of container (full parts, packed) how many there are, their tokens and the share of the capacity in use."""
    c = containers(table(spark, sf_dir, "documents")).filter("container IS NOT NULL")
    each = c.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    kind = F.when(F.col("container").startswith("f"), "full part").otherwise("packed")
    return each.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY), 6).alias("used"))
