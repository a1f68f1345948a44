"""What the operators of this subpackage share: code shipping, splits of rows, numbers of rows."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.storage import discard, scratch, stored

__all__ = ["discard", "few", "load", "numbered", "remainder", "sample_by", "sent", "ship", "stored"]

#: Rows of a task, about, and tasks at least, of a shuffled table whose size is known.
PART_ROWS, LEAST_PARTS = 5_000, 8
#: Narrow tables (ids, keys, numbers) are sent to every task up to this many rows (some MB).
SENT_ROWS = 400_000

#: A table of groups is sent to every task up to this many rows.
SENT_GROUPS = 10_000
#: Hash ranges of a key's rows when they are numbered.
SALTS = 256

#: Rows of an Arrow batch between Spark and Python where the session leaves Spark's default: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1_000
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark application; a session's own batch size stays."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(scratch(), f"{os.path.basename(top)}_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(d, x)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)  # executors fetch it from the driver while the application runs
    _shipped.add(app)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, whose work is that of about `rows` rows, in few tasks and files if they are few: a session may have any number of shuffle partitions."""
    return df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))


def sent(table: DataFrame, most: int | None = None) -> DataFrame:
    """A narrow table to join with, sent to every task if it has `most` (SENT_ROWS) rows at most."""
    return F.broadcast(table) if table.count() <= (SENT_ROWS if most is None else most) else table


def sample_by(rows: DataFrame, group: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """(group, doc_id) of at most `most` ids of each group, those whose hashes are smallest; an id on many rows counts once.

    A threshold on the hash, from the groups' counts of ids, leaves about that many before they are made distinct and ranked, so that
    neither a hot group nor a hot id is sorted whole.
    """
    share = rows.groupBy(group).agg((F.lit(1.2 * most + 50) / F.approx_count_distinct(doc_id, 0.02)).alias("share_"))
    share = stored(share, "sample-shares", 1)
    if share.count() <= SENT_GROUPS:
        share = F.broadcast(share)
    hashed = rows.select(group, doc_id, (F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u_"))
    near = hashed.join(share, group).filter("u_ <= share_").select(group, doc_id, "u_").distinct()
    ranked = near.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy("u_", doc_id)))
    return ranked.filter(F.col("rank_") <= most).select(group, doc_id)


def numbered(rows: DataFrame, key: str, name: str = "k_") -> DataFrame:
    """rows with a running number (from 1) within their key, in the order of a hash of all their columns: reruns agree but for rows equal
    in every column, which are alike.  A hot key stays spread: over its partitions, and where numbers are added up over SALTS hash ranges."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    placed = stored(rows.withColumn("hash_", whole).withColumn("salt_", F.pmod("hash_", F.lit(SALTS))).withColumn("part_", F.spark_partition_id()), "numbered")
    per = placed.groupBy(key, "salt_", "hash_", "part_").agg(F.count(F.lit(1)).alias("n_"))
    upto = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = per.groupBy(key, "salt_").agg(F.sum("n_").alias("n_"))
    salts = salts.select(key, "salt_", upto(Window.partitionBy(key).orderBy("salt_")).alias("salts_"))
    per = per.select(key, "salt_", "hash_", "part_", upto(Window.partitionBy(key, "salt_").orderBy("hash_", "part_")).alias("before_"))
    within = F.row_number().over(Window.partitionBy(key, "hash_", "part_").orderBy(F.lit(1)))
    out = placed.withColumn(name, within).join(per, [key, "salt_", "hash_", "part_"]).join(salts, [key, "salt_"])
    return out.withColumn(name, F.col(name) + F.col("before_") + F.col("salts_")).select(*rows.columns, name)
