"""What the operators share: table access, shared scratch space, folds."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` has it.
SPACE = "[\\x20\\x09-\\x0D]"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session; they don't inherit the driver's module path, on one machine neither."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "loomgraph").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(archive)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` if set; on a single machine a temporary folder, which
    becomes that setting; on a cluster that names none, the warehouse, which is
    shared as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        own = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(_remove_local, own)
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomgraph"
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and no more.

    ``keep`` writes a DataFrame and returns it as read back (lineage ends there);
    ``drop`` deletes one that is no longer needed.  What is not dropped stays while
    the result may still be read, under one folder per operator call.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def apart(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from all of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def blanked_blocks(data: bytes, table: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text after ``bytes.translate(table)`` in blocks of about ``size`` bytes that end at blanks, so that no word is cut."""
    at = 0
    while at < len(data):
        block = data[at : at + size].translate(table)
        while at + len(block) < len(data) and (cut := block.rfind(b" ")) < 0:  # one word over a whole block
            block += data[at + len(block) : at + len(block) + size].translate(table)
        if at + len(block) < len(data):
            block = block[: cut + 1]
        yield block
        at += len(block)
