"""Reading claims, vocabulary, nested records and plain files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from medweave import schemas as S


def _delimited(spark: SparkSession, paths: str | list[str], names: list[str], sep: str = ",") -> DataFrame:
    """Text fields by position, no quoting, header line skipped, empty fields as empty text."""
    reader = spark.read.schema(S.text_schema(names)).option("header", True).option("sep", sep).option("quote", "")
    return reader.csv(paths).na.fill("")


def read_beneficiary(spark: SparkSession, paths_by_year: dict[str, str | list[str]]) -> DataFrame:
    """Yearly beneficiary files in one frame, the year in front."""
    year, *names = S.LAYOUTS["beneficiary"]
    found = None
    for value, paths in paths_by_year.items():
        part = _delimited(spark, paths, names).select(F.lit(str(value)).alias(year), *names)
        found = part if found is None else found.unionByName(part)
    return found


def read_claim_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Carrier claims that come in several files, each with its own header."""
    return _delimited(spark, paths, S.LAYOUTS["carrier"])


def read_claims(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    return _delimited(spark, path, S.LAYOUTS[kind])


def read_vocabulary(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A tab-separated vocabulary file; rows with another number of fields are dropped.

    ``ordinal`` is the place of the row in its file: later rows of a code replace earlier ones.
    """
    schema = S.cdm_schema(table)
    names = schema.fieldNames()
    ordinal = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    ).alias("ordinal")
    lines = spark.read.text(path).select(F.split(F.rtrim("value", F.lit("\r")), "\t", -1).alias("f"), ordinal)
    rows = lines.where((F.size("f") == len(names)) & (F.lower(F.col("f")[0]) != names[0]))
    typed = []
    for i, field in enumerate(schema):
        c = F.col("f")[i]
        if field.dataType.typeName() == "date":
            c = F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(p))) for p in ("yyyyMMdd", "yyyy-MM-dd")])
        elif field.dataType.typeName() != "string":
            c = c.try_cast(field.dataType)
        typed.append(c.alias(field.name))
    return rows.select(*typed, "ordinal")


def read_gz(spark: SparkSession, path: str | list[str], schema: StructType, partitions: int | None = None) -> DataFrame:
    """Gzip-compressed delimited files. One such file is one task, so its rows are spread afterwards."""
    df = spark.read.schema(schema).option("header", True).option("quote", "").csv(path)
    return df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Read by the extension of ``name`` (or of the path): parquet, json, jsonl, tsv, else csv with a header.

    Quotes inside a quoted csv field are doubled.
    """
    ext = (name or path).rsplit(".", 1)[-1].lower()
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext in ("json", "jsonl"):
        return spark.read.json(path)
    return spark.read.option("header", True).option("escape", '"').option("sep", "\t" if ext == "tsv" else ",").csv(path)


def _local(path):
    """A path without scheme, for comparing."""
    return F.regexp_replace(path, "^[a-z0-9]+:/*", "/")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, name, relative, size`` of the files in a folder, without reading them.

    Readers pass over empty files, so the names come from the file index and the sizes are joined to them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    paths = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    sizes = files.select(_local(F.col("path")).alias("_at"), "length")
    listed = paths.withColumn("_at", _local(F.col("path"))).join(sizes, "_at", "left")
    return listed.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.substring("_at", F.length(_local(F.lit(folder.rstrip("/")))) + 2, F.length("_at")).alias("relative"),
        F.coalesce("length", F.lit(0)).cast("long").alias("size"),
    )


def read_hits(
    spark: SparkSession, path: str | list[str], hit_schema: StructType | None = None, per_line: bool = False
) -> DataFrame:
    """Responses with their records under ``data.hits``, one per file or one per line: a row per record.

    Give the schema of a record to save the pass that infers it.
    """
    reader = spark.read.option("multiLine", not per_line)
    if hit_schema is not None:
        reader = reader.schema(f"data struct<hits:array<{hit_schema.simpleString()}>>")
    return reader.json(path).select(F.explode("data.hits").alias("_h")).select("_h.*")


def read_sql_table(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A table of the catalog, or of a database when its connection options are given.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel.
    """
    if jdbc is None:
        return spark.table(name)
    return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
