"""A table that takes each row once: appends that may be retried, or die half-way, leave one copy.

Rows are laid out by slot, a hash of their id, so a file holds a narrow range of slots; its ids have a Parquet Bloom
filter. What is in the table is said by manifests, one for each batch, with a row for each of its files: a batch is there
when its manifest is, which is one file that appears at once. Data without a manifest is a batch that died; nobody reads
it, and the retry writes it anew.

An append leaves out what is stored already by an anti-join, and reads for this only files whose slots the new rows have,
of these only the ids, and of up to FEW new rows only the row groups that the Bloom filters let through.

One writer at a time. Rows without an id are not taken: they could not be told from their retries. Of rows with one id in
a batch one stays. A batch that is named again is not taken again, whatever it holds. An empty batch is committed empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from palimpsest.sources.tables import CODEC

SLOTS = 4096
#: New ids that are sought by value; Parquet filters take lists up to this long.
FEW = 10
MANIFEST = "batch string, file string, first_slot int, last_slot int, n long"


def _slot(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SLOTS)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of the table: batch, file, first_slot, last_slot, n; an empty batch has one without a file."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], MANIFEST)


def candidate_files(rows: DataFrame, path: str, key: str) -> list[str]:
    """Files of the table that can hold ids of rows."""
    slots = rows.select(_slot(key).alias("_slot")).distinct()  # at most SLOTS
    files = manifest(rows.sparkSession, path).where("file is not null")
    met = files.join(F.broadcast(slots), (F.col("first_slot") <= F.col("_slot")) & (F.col("_slot") <= F.col("last_slot")), "left_semi")
    return sorted(r[0] for r in met.select("file").collect())


def _stored_ids(rows: DataFrame, path: str, key: str) -> DataFrame | None:
    files = candidate_files(rows, path, key)
    if not files:
        return None
    kind = rows.schema[key]
    stored = rows.sparkSession.read.schema(StructType([kind])).parquet(*files)
    few = [r[0] for r in rows.select(key).limit(FEW + 1).collect()]
    return stored.where(F.col(key).isin(few)) if len(few) <= FEW else stored


def append_once(rows: DataFrame, path: str, batch: str, key: str = "episode_id") -> int:
    """Appends what is not stored yet as the named batch; the number of rows that were new."""
    spark = rows.sparkSession
    known = manifest(spark, path).where(F.col("batch") == batch)
    if not known.isEmpty():
        return 0
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    stored = _stored_ids(new, path, key)
    new = new if stored is None else new.join(stored, key, "left_anti").select(*rows.columns)
    data = f"{path}/data/batch={batch}"
    laid = new.withColumn("_slot", _slot(key)).repartitionByRange("_slot").sortWithinPartitions("_slot", key)
    laid.write.mode("overwrite").option("compression", CODEC).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(data)
    written = spark.read.schema(laid.schema).parquet(data)
    files = written.groupBy(F.input_file_name().alias("file")).agg(F.min("_slot").alias("first_slot"), F.max("_slot").alias("last_slot"), F.count("*").alias("n"))
    files = files.select(F.lit(batch).alias("batch"), "file", "first_slot", "last_slot", "n").coalesce(1).collect()  # a row for each file of the batch
    lines = [tuple(r) for r in files] or [(batch, None, None, None, 0)]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return sum(r["n"] for r in files)


def appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches that are there."""
    files = [r[0] for r in manifest(spark, path).where("file is not null").select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
