"""Near-duplicate texts by deletion-variant signatures.

A text's signature is a bit string in which every minwise symbol sets one of 256 bits of its block. The string is cut into segments of
SYMBOLS blocks, fewer than would be needed for one of them to be the same in both texts: one that differs by at most one set bit is enough.
Each segment is indexed under all its variants with one set bit deleted (the wildcard), texts meet by equality of (segment, variant), and a
pair that meets is verified: two sketches first, then the exact measure on the texts. Texts with Jaccard 0.75 fail to meet in any of ten segments
with probability 0.0005, at 0.8 with 0.00002; the README has measured recall.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import cut, drop_cut, keep, scratch, table
from jobforge.llm import fingerprint as fp

SEGMENTS, SYMBOLS = 10, 6
#: Bits in which the first 64 and the other 128 sketch bits of a pair may differ before it is given up: at Jaccard 0.7 expected 9.6 and 19.2.
FIRST_BITS, OTHER_BITS = 20, 36
#: Up to so many 16-byte hashes are broadcast (about 20 MB with their table).
SHORT_LIST = 250_000


def _signatures(batches):
    for b in batches:
        norm = fp.normalised(b.column("text").to_pylist())
        ids, texts = fp.usable(b.column("id"), norm)
        symbols, s0, s1, s2 = fp.sketches(texts)
        cols = {"id": ids, "tid": pa.array([fp.tid(t) for t in texts], pa.binary()), "symbols": pa.array([x.tobytes() for x in symbols[:, : SEGMENTS * SYMBOLS]], pa.binary())}
        cols |= {"s0": pa.array(s0), "s1": pa.array(s1), "s2": pa.array(s2), "packed": pa.array([fp.pack(t) for t in texts], pa.binary())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, symbols, s0, s1, s2, packed) of every row whose normalised text has a shingle; tid is the hash of the normalised text."""
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_signatures, "id string, tid binary, symbols binary, s0 long, s1 long, s2 long, packed binary")


def variants(signed: DataFrame) -> DataFrame:
    """(key, s0): every segment under each of its one-deletion variants."""
    keys = []
    for s in range(SEGMENTS):
        seg = [F.substring("symbols", s * SYMBOLS + i + 1, 1) for i in range(SYMBOLS)]
        keys += [F.xxhash64(F.lit(s * SYMBOLS + d), *(x for i, x in enumerate(seg) if i != d)) for d in range(SYMBOLS)]
    return signed.select("s0", "symbols").distinct().select("s0", F.explode(F.array(*keys)).alias("key"))


def text_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): tids of different similar texts, a < b, verified exactly."""
    v = variants(signed)
    # the two sides are the same plan, so that their exchange is made once
    met = v.alias("x").join(v.alias("y"), F.col("x.key") == F.col("y.key")).select(F.col("x.s0").alias("s0"), F.col("y.s0").alias("t0"))
    met = met.filter((F.col("s0") < F.col("t0")) & (F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) <= FIRST_BITS)).distinct()
    slim = signed.select("tid", "s0", "s1", "s2").distinct()
    twice = slim.groupBy("s0").count().filter("count > 1").select("s0", F.col("s0").alias("t0"))  # different texts under one sketch
    right = slim.select(*(F.col(c).alias(n) for c, n in (("tid", "b"), ("s0", "t0"), ("s1", "t1"), ("s2", "t2"))))
    pairs = met.unionByName(twice).join(slim, "s0").join(right, "t0").filter(F.col("tid") != F.col("b"))
    close = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= OTHER_BITS
    pairs = cut(pairs.filter(close).select(F.least("tid", "b").alias("a"), F.greatest("tid", "b").alias("b")).distinct(), "pairs")
    return verified(pairs, signed)


def verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) of tids whose texts are similar by the exact measure. Only texts that occur in a pair are moved: the list of their
    tids is sent to all tasks where it is short (checked), and joined by a shuffle where it isn't."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= SHORT_LIST else wanted
    texts = signed.select("tid", "packed").join(side, "tid", "left_semi").groupBy("tid").agg(F.first("packed").alias("packed"))
    x, y = texts.alias("x"), texts.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.tid")).select("a", "b", F.col("x.packed").alias("pa")).join(y, F.col("b") == F.col("y.tid")).select("a", "b", "pa", F.col("y.packed").alias("pb"))
    return both.filter(fp.similar("pa", "pb")).select("a", "b")


def similar_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_1, id_2): every pair of different rows with similar texts, the smaller id first (as strings).

    Null, empty and blank texts and texts under five characters have no substring of five and are similar to nothing. Equal texts are similar.
    Rows doubled in full count once. Ties don't arise; further columns are left out; an empty table gives no rows."""
    with scratch(df.sparkSession):
        return keep(cut(_row_pairs(cut(signatures(df, id_col, text_col), "signatures")), "row-pairs"))


def _row_pairs(signed: DataFrame) -> DataFrame:
    pairs = cut(text_pairs(signed), "verified")
    ids = signed.select("tid", "id").distinct()
    other = ids.select(F.col("tid").alias("b"), F.col("id").alias("jd"))
    across = pairs.join(ids.withColumnRenamed("tid", "a"), "a").join(other, "b").select("id", "jd")
    copied = ids.groupBy("tid").count().filter("count > 1").select("tid")
    copies = ids.join(copied, "tid", "left_semi")
    same = copies.join(copies.select("tid", F.col("id").alias("jd")), "tid").filter("id < jd").select("id", "jd")
    return across.unionByName(same).filter("id <> jd").select(F.least("id", "jd").alias("id_1"), F.greatest("id", "jd").alias("id_2"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: all pairs of ads with similar texts."""
    return similar_pairs(table(spark, sf_dir, "ads")).select(F.col("id_1").alias("ad_id_1"), F.col("id_2").alias("ad_id_2"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_groups: one row per ad: the smallest id of its class of connected ads, and its number of links."""
    with scratch(spark):
        return keep(cut(classes(table(spark, sf_dir, "ads")).select(F.col("id").alias("ad_id"), "class_id", "links"), "classes"))


def classes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, links) of every row. Classes and links are found between texts; a text's copies are counted, never paired: a row's links are its text's other
    copies and all copies of the texts similar to it. Rows without a substring of five are classes of their own."""
    signed = cut(signatures(df, id_col, text_col), "signatures")
    pairs = cut(text_pairs(signed), "verified")
    ids = signed.select("tid", "id").distinct()
    size = cut(ids.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "sizes")
    both = pairs.select(F.col("a").alias("id_1"), F.col("b").alias("id_2"))
    both = cut(both.unionByName(both.select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"))), "edges")
    degree = both.join(size.select(F.col("tid").alias("id_2"), "copies"), "id_2").groupBy(F.col("id_1").alias("tid")).agg(F.sum("copies").alias("beyond"))
    label = connected(both).select(F.col("id").alias("tid"), "label")
    texts = size.join(degree, "tid", "left").join(label, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    least = texts.groupBy("label").agg(F.min("least").alias("class_id"))
    found = ids.join(texts.select("tid", "label", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("links")), "tid").join(least, "label")
    every = df.select(F.col(id_col).cast("string").alias("id")).distinct()
    return every.join(found.select("id", "class_id", "links"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def connected(both: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component, by hooking labels and halving paths until nothing changes.

    ``both`` holds every edge in both directions. Each round is written to the shared folder, where it takes the place of the one before; only a count
    returns to the driver."""
    held = cut(both.groupBy(F.col("id_1").alias("id")).agg(F.min("id_2").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        label = held.select("id", "label")
        near = both.join(label.withColumnRenamed("id", "id_2").withColumnRenamed("label", "other"), "id_2").groupBy(F.col("id_1").alias("id")).agg(F.min("other").alias("other"))
        hooked = label.join(near, "id").select("id", F.least("label", "other").alias("next"), "label")
        up = label.select(F.col("id").alias("next"), F.col("label").alias("up"))
        moved = cut(hooked.join(up, "next", "left").select("id", F.least("next", F.coalesce("up", "next")).alias("label"), (F.least("next", F.coalesce("up", "next")) < F.col("label")).alias("moved")), "labels")
        drop_cut(held)
        held = moved
        if not moved.filter("moved").limit(1).count():
            return moved.select("id", "label")


__all__ = ["signatures", "variants", "text_pairs", "verified", "similar_pairs", "connected", "found", "links"]
