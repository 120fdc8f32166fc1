"""Loading only the files that were not loaded before.

The target folder holds ``lines`` and a ``ledger``. A batch writes its lines, good and rejected ones apart, below the identity
of its checkpoint and its number, and then its page of the ledger: a row per file with the number of lines of each
kind. The page is what makes a batch count: readers take only batches that have one. A batch that is run again
after a failure replaces its own lines and page and nothing else; a new checkpoint has another identity, so it never writes
over what an older one loaded, and it passes over the files that the ledger names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from medweave import schemas as S
from medweave.functions.claims import not_blank
from medweave.sources.tables import convert, load_paths

STOP, APART = "stop", "apart"
LEDGER = StructType([
    StructField("file", StringType()), StructField("loaded", LongType()), StructField("rejected", LongType()),
    StructField("load_id", StringType()), StructField("load_batch", LongType()),
])
_MALFORMED = "_malformed"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _stored(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The files loaded into ``out``: lines taken and rejected, checkpoint identity and batch."""
    return _stored(spark, f"{out.rstrip('/')}/ledger", LEDGER)


def _lines(spark: SparkSession, out: str, target: StructType, accepted: bool) -> DataFrame:
    schema = StructType([
        *[StructField(f.name, f.dataType) for f in target], StructField("loaded_from", StringType()), StructField("fields", StringType()), StructField("reason", StringType()),
        StructField("load_id", StringType()), StructField("load_batch", LongType()), StructField("accepted", BooleanType()),
    ])
    stored = _stored(spark, f"{out.rstrip('/')}/lines", schema).where(F.col("accepted") == accepted)
    return stored.join(ledger(spark, out).select("load_id", "load_batch").distinct(), ["load_id", "load_batch"], "left_semi")


def loaded_rows(spark: SparkSession, out: str, target: StructType) -> DataFrame:
    """All rows loaded so far, with the file and the batch each came from."""
    return _lines(spark, out, target, True).select(*target.fieldNames(), "loaded_from", "load_id", "load_batch")


def rejected_lines(spark: SparkSession, out: str, target: StructType) -> DataFrame:
    """All lines kept apart so far: the line, or the fields of it, and what is wrong with them."""
    return _lines(spark, out, target, False).select("fields", "reason", "loaded_from", "load_id", "load_batch")


def _reason(target: StructType) -> Column:
    """What keeps a line from being loaded: its number of fields, or the columns whose text cannot be read."""
    unread = [
        F.when(not_blank(F.col(f.name)).isNotNull() & convert(F.col(f.name), f.dataType, False).isNull(), F.lit(f.name)) for f in target
    ]
    listed = F.array_join(F.array_compact(F.array(*unread)), ", ")
    return F.when(F.col(_MALFORMED).isNotNull(), F.lit("wrong number of fields")).when(listed != "", F.concat(F.lit("cannot read "), listed))


def copy_new_files(
    spark: SparkSession,
    folder: str,
    file: str,
    target: StructType,
    out: str,
    checkpoint: str,
    delimiter: str = ",",
    header: bool = True,
    quote: str = "",
    max_files: int | None = None,
    on_error: str = STOP,
) -> DataFrame:
    """Load the files that appeared since the last call below the folder ``out`` and return all its rows.

    A line with another number of fields than ``target``, or with a value that its type cannot hold, stops the load
    with ``on_error="stop"``, as it does in a plain load: its batch leaves nothing, and the next call begins with it. With
    ``"apart"`` such lines are written beside the rows (:func:`rejected_lines`). No files, no rows.
    """
    if on_error not in (STOP, APART):
        raise ValueError(f"on_error must be {STOP!r} or {APART!r}, got {on_error!r}")
    strict, out, names = on_error == STOP, out.rstrip("/"), target.fieldNames()
    glob, pattern = load_paths(folder, file)
    reader = spark.readStream.option("sep", delimiter).option("header", header).option("quote", quote)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if strict:
        reader = reader.schema(S.text_schema(names)).option("mode", "FAILFAST")
    else:
        reader = reader.schema(S.text_schema([*names, _MALFORMED])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _MALFORMED)
    raw = reader.csv(glob).where(F.col("_metadata.file_path").rlike(pattern))
    values = [convert(F.col(f.name), f.dataType, strict).alias(f.name) for f in target]
    reason = F.lit(None).cast("string") if strict else _reason(target)
    line = F.lit(None).cast("string") if strict else F.when(reason.isNotNull(), F.coalesce(_MALFORMED, F.concat_ws(delimiter, *[F.coalesce(n, F.lit("")) for n in names])))
    rows = raw.select(*values, F.col("_metadata.file_path").alias("loaded_from"), line.alias("fields"), reason.alias("reason")).withColumn(
        "accepted", F.col("reason").isNull()
    )

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        load_id = own.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        earlier = ledger(own, out).where((F.col("load_id") != load_id) | (F.col("load_batch") != number)).select(F.col("file").alias("loaded_from"))
        place = f"load_id={load_id}/load_batch={number}"
        batch.join(earlier, "loaded_from", "left_anti").write.mode("overwrite").partitionBy("accepted").parquet(f"{out}/lines/{place}")
        # What was written is what the page says, whatever the files hold by now.
        stored = StructType([StructField("loaded_from", StringType()), StructField("accepted", BooleanType())])
        written = own.read.schema(stored).parquet(f"{out}/lines/{place}")
        page = written.groupBy(F.col("loaded_from").alias("file")).agg(F.count_if(F.col("accepted")).alias("loaded"), F.count_if(~F.col("accepted")).alias("rejected"))
        page.write.mode("overwrite").parquet(f"{out}/ledger/{place}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return loaded_rows(spark, out, target)
