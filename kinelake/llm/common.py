"""What the corpus operators share: scratch tables, range buckets, document order and a few columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import small_batches as small_batches  # the operators take it from here
from ..operators.numbering import range_of

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fresh(wish: str, *taken: DataFrame) -> str:
    """A column name like wish that none of the tables has."""
    used, name = {c.lower() for df in taken for c in df.columns}, wish
    while name.lower() in used:
        name = f"_{name}"
    return name


def one_label(labelled: DataFrame, label: Column) -> DataFrame:
    """doc_id, label of each labelled document once; label is an aggregate, which settles conflicting rows."""
    return labelled.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(label.alias("label"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (a test) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kinelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and where: its lineage ends there, and lost executors lose nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    return stored_at(df, name)[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder as it is dealt over partitions: the same rows, in order, stay in the same ones."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: which fold a row falls in (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def cut_points(df: DataFrame, key: str, buckets: int) -> list:
    """At most buckets - 1 ascending values of an integer key that cut its rows into near-equal ranges."""
    return cuts_and_hot(df, key, buckets)[0]


def cuts_and_hot(df: DataFrame, key: str, buckets: int) -> tuple[list, list]:
    """cut_points, and those of them (None: the null key) that alone hold the rows of a whole range or more.

    One pass over that column alone; the driver receives only the cut points.
    """
    if buckets < 2:
        return [], []
    at = [i / buckets for i in range(1, buckets)]
    q, rows, there = df.agg(F.percentile_approx(key, at, 50 * buckets), F.count("*"), F.count(key)).first()
    q = q or []
    hot = sorted({a for a, b in zip(q, q[1:]) if a == b})
    return sorted(set(q)), hot + [None] * ((rows - there) * buckets > rows)


def bucket_of(key: Column | str, cuts: list) -> Column:
    """The number of cut points at or below key: ascending buckets from 0, in which null falls in 0."""
    return F.coalesce(range_of(F.col(key) if isinstance(key, str) else key, cuts), F.lit(0))


def ordered_parts(docs: DataFrame, ranges: int, ascending: bool = True) -> tuple[Column, int, bool]:
    """(part, number of parts, whether a doc_id is cut up): near-equal ranges of doc_id (nulls are the least), from 0 in order.

    A doc_id that alone fills a range, or the null one, is cut further into as many parts, by crc32 of text, ascending.
    """
    cuts, hot = cuts_and_hot(docs.select("doc_id"), "doc_id", ranges)
    edges = [None, *cuts]  # the least doc_id of each range
    cut_up = [e in hot for e in edges]
    order = range(len(edges)) if ascending else reversed(range(len(edges)))
    base, total = [0] * len(edges), 0
    for i in order:
        base[i] = total
        total += 1 + ranges * cut_up[i]
    at = bucket_of("doc_id", cuts)
    if not hot:
        return (at if ascending else F.lit(len(cuts)) - at), total, False
    table = lambda v, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in v]), at)
    own = table(cut_up, "boolean") & F.col("doc_id").eqNullSafe(table(edges, "long"))
    sub = F.floor(F.crc32(F.coalesce("text", F.lit("")).cast("binary")) * F.lit(ranges) / F.lit(1 << 32))
    rest = F.when(table(cut_up, "boolean"), F.lit(ranges)).otherwise(F.lit(0)) if ascending else F.lit(0)
    return (table(base, "int") + F.when(own, sub if ascending else sub + 1).otherwise(rest)).cast("int"), total, True
