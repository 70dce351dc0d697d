"""Batches of texts against all history: an incremental inverted index of rare-token prefixes.

Tokens are hashes of joint minima of a text's substrings of five characters (``fingerprint.tokens``), so what two texts share of them follows the
measure itself, wherever the edits lie: similar texts share SHARED tokens of TOKENS at least, but for a probability of 0.0002 at the threshold.
The order of rarity is frozen from the first batch (hashed counters of a fixed size, so an order that never moves an old posting), and of every
text the prefix is indexed in which two texts that share SHARED tokens can't both miss each other.

A batch's texts that history holds already are repeats. The others' prefixes probe the postings, sketches and set sizes sort out chance
meetings, the texts decide, and postings of the new texts are appended. Postings are kept in segments, bucketed and sorted by token, and
merged in levels. A batch reads the postings, the texts' keys and sizes and, where candidates name them, the texts; a batch whose prefixes are few
is sent to the postings, and a larger one meets them bucket by bucket, so history is never shuffled.

A manifest, renamed into place last, names all tables of the index: after a crash the batch counts as not taken in and can come again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobforge.functions.session import cut, keep, list_names, new_path, read_text, remove, scratch, settings, settle, table, tidy, write_text
from jobforge.llm import fingerprint as fp
from jobforge.llm.near_dup import FIRST_BITS, OTHER_BITS, verified
from jobforge.operators.segments import FAN, Segments

CHUNK = 1 << 12
#: Texts of a file.
FILE = 1 << 17
#: What is left of a batch of up to so many rows is sent to the history's texts (some 10 MB); of a larger one it is joined by a shuffle.
SMALL = 50_000
#: Runs that the registered query takes in at a time: a batch costs some ten jobs, however small it is.
TOGETHER = 6
#: A token in more new texts than this is first held against its earliest text alone; only what that doesn't decide meets all the others.
HOT = 64
EARLIER = {"tid": "b", "s0": "t0", "s1": "t1", "s2": "t2", "n": "m", "first": "earlier"}
MADE = "id string, own struct<created_at:timestamp,date:date,id:string>, tid binary, n int, s0 long, s1 long, s2 long, packed binary, tokens binary"


def token_counts(texts: DataFrame) -> DataFrame:
    """(k, part): document counts of hashed tokens over all rows, CHUNK to a part; COUNTERS numbers (4 MB as int32), whatever the size of the data."""

    def of_partition(batches):
        total = np.zeros(fp.COUNTERS, np.int64)
        for b in batches:
            for t in b.column("tokens").to_pylist():
                np.add.at(total, (np.frombuffer(t, np.uint32) & np.uint32(fp.COUNTERS - 1)).astype(np.int64), 1)
        if total.any():
            for k in range(0, fp.COUNTERS, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([total[k : k + CHUNK].astype("<i4").tobytes()], pa.binary())], ["k", "part"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["part"])
        return pd.DataFrame({"k": [key[0]], "part": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    return texts.select("tokens").mapInArrow(of_partition, "k int, part binary").groupBy("k").applyInPandas(add, "k int, part binary")


def _close() -> Column:
    """Different sketches x.s0 and y.s0 that may belong to similar texts."""
    return (F.col("x.s0") != F.col("y.s0")) & (F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) <= FIRST_BITS)


def _possible() -> Column:
    """An earlier text that a new one's other sketches and set size don't hold apart; sets whose sizes differ by more can't reach the threshold."""
    bits = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return (F.col("earlier") < F.col("first")) & (F.least("n", "m") >= fp.THRESHOLD * F.greatest("n", "m") - 0.5) & (bits <= OTHER_BITS)


def _fingerprints(batches):
    seen = set()  # texts of this partition: copies carry neither text nor tokens
    for b in batches:
        (ids, own), texts = fp.usable([b.column("id"), b.column("own")], fp.normalised(b.column("text").to_pylist()))
        tids = [fp.tid(t) for t in texts]
        fresh = np.array([not (t in seen or seen.add(t)) for t in tids], bool)
        new = [t for t, f in zip(texts, fresh, strict=True) if f]
        toks, *sketches = fp.tokens(new)
        at = np.flatnonzero(fresh)

        def spread(values, kind):
            full = [None] * len(texts)
            for i, v in zip(at, values, strict=True):
                full[i] = v
            return pa.array(full, kind)

        cols = {"id": ids, "own": own, "tid": pa.array(tids, pa.binary()), "n": spread(fp.sizes(new).tolist(), pa.int32())}
        cols |= {f"s{k}": spread(s.tolist(), pa.int64()) for k, s in enumerate(sketches)}
        cols |= {"packed": spread([fp.pack(t) for t in new], pa.binary()), "tokens": spread([t.tobytes() for t in toks], pa.binary())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


class HistoryIndex:
    """The index under ``path``: tables of texts (one row for each different text, with its first bearer) and of postings, the frozen counters and
    the manifests, of which the highest counts."""

    def __init__(self, spark: SparkSession, path: str, small: int = SMALL, hot: int = HOT, fan: int = FAN):
        self.spark, self.path, self.small, self.hot, self._df = spark, path, small, hot, None
        self.segments = Segments(spark, path, "postings", {"token": "int", "s0": "bigint"}, ("token",), fan)

    def manifest(self) -> dict:
        """version, texts: [folder, rows], postings: [folder, buckets, rows, level]."""
        names = [n for n in list_names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if not names:
            return {"version": 0, "texts": [], "postings": [], "counters": None}
        return json.loads(read_text(self.spark, f"{self.path}/{max(names, key=lambda n: int(n[9:-5]))}"))

    def _texts(self, m: dict) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{t}" for t, _ in m["texts"]))

    def _counters(self, m: dict, new: DataFrame):
        if self._df is None:
            if m["counters"] is None:
                at = f"counters-{uuid.uuid4().hex[:12]}"
                token_counts(new).coalesce(1).write.parquet(f"{self.path}/{at}")
                m["counters"] = at
            counts = np.zeros(fp.COUNTERS, np.int32)
            for r in self.spark.read.parquet(f"{self.path}/{m['counters']}").collect():  # 256 rows at most
                counts[r.k * CHUNK : (r.k + 1) * CHUNK] = np.frombuffer(r.part, "<i4")
            self._df = self.spark.sparkContext.broadcast(counts)  # 4 MB, always
        return self._df

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Take in a batch (id, created_at, date, text) and give the ids in it that repeat an earlier row, of history or of the batch.

        Earlier is by created_at, date, id, nulls first. Null and empty texts and texts under five characters repeat nothing and aren't kept. Rows
        doubled in full count once. Batches must come in order of created_at. An empty batch gives no rows; one that is taken in twice repeats itself."""
        m = self.manifest()
        with scratch(self.spark):
            out = self._ingest(m, batch)
            out = self.spark.createDataFrame([], "id string") if out is None else keep(out)
        settle(self.spark)
        return out

    def _ingest(self, m: dict, batch: DataFrame) -> DataFrame | None:
        spark = self.spark
        key = F.col("id").cast("string")
        slim = batch.select(key.alias("id"), F.struct("created_at", "date", key.alias("id")).alias("own"), "text")
        made = cut(slim.mapInArrow(_fingerprints, MADE), "made")
        size = made.count()  # from the files' footers
        if not size:
            return None
        few = size <= self.small
        near = F.broadcast if few else (lambda df: df)  # what follows from few rows is short as well

        # one row a text, with its first bearer; texts that history holds are left out
        whole = [F.first(c, True).alias(c) for c in ("n", "s0", "s1", "s2", "packed", "tokens")]
        texts = made.groupBy("tid").agg(F.min("own").alias("first"), *whole)
        if m["texts"]:
            known = self._texts(m).select("tid").join(near(made.select("tid").distinct()), "tid", "left_semi")
            texts = texts.join(near(known), "tid", "left_anti")
        at = f"texts-{uuid.uuid4().hex[:12]}"
        with tidy(spark):
            texts.coalesce(max(1, -(-size // FILE))).write.parquet(f"{self.path}/{at}")
        new = spark.read.schema(texts.schema).parquet(f"{self.path}/{at}")
        count = new.count()
        if not count:
            remove(spark, f"{self.path}/{at}")
            return cut(made.select("id").distinct(), "repeats")
        counters = self._counters(m, new)

        def postings(batches):
            for b in batches:
                t = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32).reshape(-1, fp.TOKENS)
                kept = fp.prefixes(t, counters.value)
                yield pa.RecordBatch.from_arrays([pa.array(kept.ravel().view(np.int32)), pa.array(np.repeat(b.column("s0").to_numpy(zero_copy_only=False), fp.PREFIX))], ["token", "s0"])

        segment = self.segments.write(new.select("tokens", "s0").mapInArrow(postings, "token int, s0 long"), count * fp.PREFIX)
        after = {"version": m["version"] + 1, "texts": [*m["texts"], [at, count]], "postings": [*m["postings"], segment], "counters": m["counters"]}
        # each bucket is one file and sorted as written, so joins of buckets need no sort
        with settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            hits = self._hits_of_few(after, new, segment) if few else self._hits(after, new, segment)
            marked = new.select("tid", "first").join(near(hits.withColumn("near_dup", F.lit(True))), "tid", "left")
            mine = made.select("id", "tid", "own").join(near(marked), "tid", "left")
            out = cut(mine.filter(F.col("first").isNull() | (F.col("own") > F.col("first")) | F.col("near_dup")).select("id").distinct(), "repeats")
        after["postings"], gone = self.segments.merged(after["postings"])
        write_text(spark, f"{self.path}/manifest-{after['version']}.json", json.dumps(after))
        for s in gone:  # named by no manifest that counts
            self.segments.forget(s)
        return out

    def _met(self, x: DataFrame, after: dict) -> DataFrame:
        """(s0, t0): sketches of new texts, of which ``x`` has the postings, and of any texts that share a token of their prefixes, close enough to each
        other; texts under one sketch included. Buckets meet buckets."""
        meetings = [x.alias("x").join(self.segments.table(s).alias("y"), F.col("x.token") == F.col("y.token")).filter(_close()) for s in after["postings"]]
        met = [m.select(F.col("x.s0").alias("s0"), F.col("y.s0").alias("t0")) for m in meetings]
        return reduce(DataFrame.unionByName, [*met, x.select("s0", F.col("s0").alias("t0"))]).distinct()

    def _hits_of_few(self, after: dict, new: DataFrame, segment: list) -> DataFrame:
        """(tid): the texts of a small batch that are similar to an earlier one. What they meet is sent to the index's texts, which are read once."""
        met = self._met(self.segments.table(segment), after)
        right = self._texts(after).select(*(F.col(c).alias(o) for c, o in EARLIER.items()), F.col("packed").alias("theirs"))
        left = new.select("tid", "s0", "s1", "s2", "n", "first")
        pairs = right.join(F.broadcast(met), "t0").join(F.broadcast(left), "s0").filter(_possible()).select("tid", "theirs")
        return pairs.join(new.select("tid", "packed").hint("shuffle_merge"), "tid").filter(fp.similar("packed", "theirs")).select("tid").distinct()

    def _hits(self, after: dict, new: DataFrame, segment: list) -> DataFrame:
        """(tid): the new texts that are similar to an earlier one. Of history only what candidates name is moved."""
        held = self._texts(after)
        own = self.segments.table(segment)
        parts, x = [], own
        hot = own.groupBy("token").count().filter(F.col("count") > self.hot).select("token")
        if hot.limit(1).count():
            hot = cut(hot, "hot")
            posted = own.join(hot, "token").join(new.select("s0", "first"), "s0")
            earliest = posted.groupBy("token").agg(F.min(F.struct("first", "s0")).alias("e")).select("token", F.col("e.s0").alias("t0"))
            star = posted.join(earliest, "token").select("s0", "t0").distinct()
            parts.append(cut(self._decided(star, new, held), "hits"))
            x = own.join(cut(new.select("tid", "s0").join(parts[0], "tid", "left_anti").select("s0").distinct(), "undecided"), "s0", "left_semi")

        parts.append(self._decided(cut(self._met(x, after), "met"), new, held))
        return reduce(DataFrame.unionByName, parts).distinct()

    def _decided(self, met: DataFrame, new: DataFrame, held: DataFrame) -> DataFrame:
        """(tid): the new texts that are similar to an earlier one they met."""
        left = met.join(new.select("tid", "s0", "s1", "s2", "n", "first"), "s0")
        right = held.select(*(F.col(c).alias(o) for c, o in EARLIER.items()))
        pairs = right.join(left, "t0").filter(_possible()).select(F.col("tid").alias("a"), "b").distinct()
        return verified(cut(pairs, "candidates"), held).select(F.col("a").alias("tid")).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: ads whose text is similar to an earlier ad's, taken in as the first run, which is the history, and then TOGETHER later runs at a time."""
    ads = table(spark, sf_dir, "ads").select("id", "created_at", "date", "text")
    return repeats(spark, by_run(ads, TOGETHER)).select(F.col("id").alias("ad_id"))


def by_run(df: DataFrame, together: int = 1) -> list[DataFrame]:
    """A table parted by created_at, in order: the first run, then so many at a time; rows without a stamp belong to the first part."""
    stamp = F.col("created_at")
    stamps = sorted(r[0] for r in df.filter(stamp.isNotNull()).select("created_at").distinct().collect())  # stamps of import runs, not of rows
    if len(stamps) < 2:
        return [df]
    return [df.filter(stamp.isNull() | (stamp == F.lit(stamps[0])))] + [df.filter(stamp.between(F.lit(stamps[a]), F.lit(stamps[min(a + together, len(stamps)) - 1]))) for a in range(1, len(stamps), together)]


def repeats(spark: SparkSession, batches: list[DataFrame], path: str | None = None, **options) -> DataFrame:
    """(id): all repeats in consecutive batches. An index that isn't given a ``path`` is removed at the end."""
    at = path or new_path(spark, "history")
    index = HistoryIndex(spark, at, **options)
    out = reduce(DataFrame.unionByName, [index.ingest(b) for b in batches])
    if path is None:
        for s in index.manifest()["postings"]:
            index.segments.forget(s)
        remove(spark, at)
    return out
