"""Session helpers: table access, the shared folder and lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used when, and only when, the session names no shared folder (tests, single machine).
_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Paths that the open scopes own, the innermost last.
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or an own one where it is unset and the master is local; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="jobforge-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a while; a double underscore stands for a dot."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """Writes made meanwhile leave no shuffle files behind: what they wrote is in the shared folder."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors. Within ``scratch`` the table goes at its end."""
    path = new_path(df.sparkSession, label)
    if _SCOPES:
        _SCOPES[-1].append(path)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``cut`` writes meanwhile are removed at the end, but for those handed to ``keep``; what is used later may rest on those only."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for path in own:
            remove(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """A table fresh from ``cut`` outlives the innermost scope and belongs to the one around it, if any."""
    if _SCOPES and df._cut_path in _SCOPES[-1]:
        _SCOPES[-1].remove(df._cut_path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df._cut_path)
    return df


def settle(spark: SparkSession) -> None:
    """Let go of what finished steps hold: broadcasts and shuffles are cleaned only once the driver's garbage is collected, which a long run of small jobs may put off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote and nobody needs any more."""
    for own in _SCOPES:
        if df._cut_path in own:
            own.remove(df._cut_path)
    remove(df.sparkSession, df._cut_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole or not at all (written aside, then renamed)."""
    jvm = spark._jvm
    p, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise FileExistsError(path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any file system."""
    return "\n".join(r.value for r in spark.read.text(path).collect())


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: they may run elsewhere, without it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="jobforge-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def num_partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def guid(col) -> "F.Column":
    """A guid as lower-case 8-4-4-4-12, whatever form it was written in (upper case, braces, no dashes); null stays null and text that is no guid is only trimmed and lower-cased."""
    c = F.lower(F.trim(col))
    hexes = F.regexp_replace(c, "[^0-9a-f]", "")
    parts = F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.regexp_like(c, F.lit(r"^\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$")), parts).otherwise(c)


__all__ = ["table", "shared_dir", "new_path", "cut", "scratch", "keep", "settle", "drop_cut", "settings", "tidy", "remove", "write_text", "read_text", "list_names", "num_partitions", "ship", "guid"]
