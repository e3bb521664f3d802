"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (the same set that bytes.split() splits on).
WORD = r"[^\x20\x09-\x0D]+"
WS_BYTES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one, if there are no other machines."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docspark-checkpoint-")
    return _local[context.applicationId]


_scratch: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.search(r"/table-[0-9a-f]{32}$", folder):
            delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside are deleted at the end; write what is to stay before that."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        for path in paths:
            delete(spark, path)


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, learn_from=None, unlabelled: int = 0) -> DataFrame:
    """Bounded fitting sample: up to ``rows`` labelled documents of each class, in hash order of doc_id.

    Documents over ``max_chars`` characters stay out of the *fit* (never out of the scoring).
    ``learn_from`` is a predicate on doc_id for rows that may be learned from. ``unlabelled`` documents are
    drawn from all of these rows, whether they have labels or not, and marked ``drawn``; what isn't also
    taken for its label has y null. Returns (doc_id, text, y, drawn), at most ``2 * rows + unlabelled`` rows.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_from is not None:
        y = y.where(learn_from)
    y = y.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    pick = y.where("y = 0").orderBy(*order).limit(rows).unionByName(y.where("y = 1").orderBy(*order).limit(rows))
    pick = pick.withColumn("drawn", F.lit(False))
    if unlabelled:
        ids = docs.select("doc_id").where("doc_id IS NOT NULL")
        ids = ids if learn_from is None else ids.where(learn_from)
        ids = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
        pick = pick.unionByName(ids.select("doc_id", F.lit(None).cast("int").alias("y"), F.lit(True).alias("drawn")))
        pick = pick.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("drawn").alias("drawn"))
    # at most 2 * rows + unlabelled pairs of two numbers: bounded by parameters, whatever the corpus
    found = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(pick), "doc_id")
    return found.limit(2 * rows + unlabelled)


def labelled_share(labels: DataFrame, label: str, learn_from=None) -> float | None:
    """The share of label 1 among the labelled rows that may be learned from; None without any."""
    usable = labels.where(F.col(label).isin(0, 1))
    usable = usable if learn_from is None else usable.where(learn_from)
    share = usable.agg(F.avg(label)).first()[0]
    return None if share is None else float(share)


def crc_remainder(doc_id: str, modulus: int):
    """crc32 of the document id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def process_cache(key, make):
    """``make()`` once per Python worker process; workers are reused by later tasks."""
    import sys

    store = sys.__dict__.setdefault("_docspark_process_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]
