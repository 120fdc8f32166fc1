"""Creating, loading and writing tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from medweave import schemas as S
from medweave.functions.claims import not_blank, parse_date
from medweave.operators.combine import table_for_file
from medweave.sources.files import list_files

# The row that describes the converted source.
CDM_SOURCE = {
    "cdm_source_name": "Medicare Claims Synthetic Public Use Files (SynPUFs)",
    "cdm_source_abbreviation": "synPuf",
    "cdm_version": "5.2.2",
}


def convert(c: Column, kind: DataType, strict: bool) -> Column:
    """Text to the type of a target column; empty text is NULL, dates come with or without dashes.

    ``strict`` raises on what cannot be read, otherwise it becomes NULL.
    """
    if kind.typeName() == "date":
        parsed = parse_date(c)
        bad = not_blank(c).isNotNull() & parsed.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")).otherwise(parsed) if strict else parsed
    if kind.typeName() == "string":
        return not_blank(c)
    return not_blank(c).cast(kind) if strict else not_blank(c).try_cast(kind)


# --- creating ------------------------------------------------------------------------------------------


def create_cdm_tables(spark: SparkSession, database: str, release_date: str | None = None) -> list[str]:
    """Create the CDM tables that do not exist yet; describe the source in ``cdm_source`` once."""
    for table in S.CDM_TABLES:
        name = f"{database}.{table}"
        if not spark.catalog.tableExists(name):
            spark.createDataFrame([], S.cdm_schema(table)).write.format("parquet").saveAsTable(name)
    if spark.table(f"{database}.cdm_source").isEmpty():
        row = spark.range(1).select(
            *[
                (F.to_date(F.lit(release_date)) if release_date else F.current_date()).alias(f.name)
                if f.name == "cdm_release_date"
                else F.lit(CDM_SOURCE.get(f.name)).cast(f.dataType).alias(f.name)
                for f in S.cdm_schema("cdm_source")
            ]
        )
        row.write.insertInto(f"{database}.cdm_source")
    return [f"{database}.{t}" for t in S.CDM_TABLES]


def mapping_schema(mapping: list[tuple[str, str, str]], pk: str | list[str] | None = None) -> StructType:
    """Schema of a field mapping (path, column, ``String`` or ``Float``); repeated columns count once."""
    keys = [pk] if isinstance(pk, str) else list(pk or [])
    kinds = {"String": StringType(), "Float": DoubleType()}
    columns = {column: kinds[kind] for _, column, kind in mapping}
    return StructType([StructField(c, k, c not in keys) for c, k in columns.items()])


def create_tables(spark: SparkSession, database: str, tables: dict[str, StructType]) -> None:
    for name, schema in tables.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.createDataFrame([], schema).write.format("parquet").saveAsTable(f"{database}.{name}")


# --- loading by position ---------------------------------------------------------------------------------


def load_paths(folder: str, file: str) -> tuple[str, str]:
    """What to list and which of the listed paths to take: ``file`` itself and its numbered parts, ``name_<digits>.csv``.

    A part may be a file or a folder of files.
    """
    name, *extension = file.split(".", 1)
    tail = "".join(f".{e}" for e in extension)
    taken = "".join((re.escape(name), r"(?:_\d+)?", re.escape(tail)))
    return f"{folder.rstrip('/')}/{name}*{tail}", rf"/{taken}(?:/[^/]+)?$"


def _quoted(reader, quote: str | None):
    """A quote inside quotes is doubled; without a quote character there is no quoting."""
    return reader.option("quote", quote).option("escape", quote) if quote else reader.option("quote", "")


def positional(
    spark: SparkSession, folder: str, file: str, target: StructType, delimiter: str | None = None,
    header: bool = False, quote: str | None = '"', csv: bool = True, columns: list[str] | None = None, strict: bool = True,
) -> DataFrame:
    """Fields by position as the columns of ``target`` (or the named ones, the rest NULL)."""
    glob, pattern = load_paths(folder, file)
    names = columns or target.fieldNames()
    sep = delimiter or {True: ",", False: "\t"}[csv]
    reader = spark.read.schema(S.text_schema(names)).options(sep=sep, header=header)
    raw = _quoted(reader, quote if csv else None).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(glob)
    raw = raw.where(F.col("_metadata.file_path").rlike(pattern))
    return raw.select(
        *[(convert(F.col(f.name), f.dataType, strict) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in target]
    )


def copy_into(
    spark: SparkSession, table: str, folder: str, file: str, delimiter: str | None = None,
    header: bool = False, quote: str | None = '"', csv: bool = True, columns: list[str] | None = None,
) -> int:
    """Append files to a table by column position; the number of rows loaded.

    ``quote=None`` switches quoting off; with ``csv=False`` there is none and the delimiter is a tab.
    """
    df = positional(spark, folder, file, spark.table(table).schema, delimiter, header, quote, csv, columns)
    return _insert(df, table)


def _insert(df: DataFrame, table: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table)
    return seen.get["n"]


def load_stage_file(
    spark: SparkSession, path: str, table: str, null_if: str = "", enclosed_by: str | None = '"', on_error: str = "ABORT_STATEMENT"
) -> int:
    """One file into one table; any bad row stops the load unless ``on_error`` is ``CONTINUE``."""
    target = spark.table(table).schema
    strict = on_error == "ABORT_STATEMENT"
    reader = spark.read.schema(S.text_schema(target.fieldNames())).option("header", True).option("nullValue", null_if)
    raw = _quoted(reader, enclosed_by).option("mode", "FAILFAST" if strict else "DROPMALFORMED").csv(path)
    return _insert(raw.select(*[convert(F.col(f.name), f.dataType, strict).alias(f.name) for f in target]), table)


# --- loading by name ---------------------------------------------------------------------------------------


def named(spark: SparkSession, path: str, target: StructType) -> DataFrame:
    """A file with a header as the columns of ``target``; columns it lacks are NULL, others are dropped.

    A column of ``target`` is also found under the name that files give it (``schemas.HEADER_NAMES``).
    """
    raw = spark.read.option("header", True).csv(path)
    in_files = {own: given for names in S.HEADER_NAMES.values() for own, given in names.items()}
    found = {f.name: n for f in target for n in (in_files.get(f.name), f.name) if n in raw.columns}
    return raw.select(
        *[
            (convert(F.col(f"`{found[f.name]}`"), f.dataType, False) if f.name in found else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target
        ]
    )


def load_csv_to_table(spark: SparkSession, path: str, table: str) -> int:
    """Append a file to a table by column name; the number of rows loaded."""
    return _insert(named(spark, path, spark.table(table).schema), table)


def discover_and_load(spark: SparkSession, folder: str, database: str, sample: str) -> DataFrame:
    """Load every ``<name>_<sample>.csv`` into the table of that name: one status row per file.

    Status is loaded, empty, unmapped or failed. There are as many files as tables, so the loop over
    them only starts jobs.
    """
    entry = F.element_at(F.split("relative", "/"), 1)
    suffix = f"_{sample}.csv"
    files = (
        list_files(spark, folder, recursive=True)
        .groupBy(entry.alias("file")).agg(F.sum("size").alias("size"))
        .where(F.col("file").endswith(suffix))
        .withColumn("name", F.expr(f"substring(file, 1, length(file) - {len(suffix)})"))
    )
    tables = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(database) if not t.isTemporary], "table string")
    rows = []
    for f in table_for_file(files, tables).orderBy("file").toLocalIterator():
        if f["size"] == 0 or f["table"] is None:
            rows.append((f["file"], f["table"], "empty" if f["size"] == 0 else "unmapped", 0, None))
            continue
        try:
            n = load_csv_to_table(spark, f"{folder.rstrip('/')}/{f['file']}", f"{database}.{f['table']}")
            rows.append((f["file"], f["table"], "loaded", n, None))
        except Exception as e:  # one bad file must not stop the others
            rows.append((f["file"], f["table"], "failed", 0, str(e)))
    return spark.createDataFrame(rows, "file string, table string, status string, n_rows long, error string")


# --- writing ---------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, name: str, mode: str = "append") -> None:
    """Append to a table, or replace it with ``mode='replace'``."""
    df.write.mode("overwrite" if mode == "replace" else mode).format("parquet").saveAsTable(name)


def truncate_and_reload(df: DataFrame, table: str) -> None:
    """Replace the contents of a table, by position; the table stays."""
    df.write.mode("overwrite").insertInto(table, overwrite=True)


def write_cdm_csv(tables: dict[str, DataFrame], folder: str, sample: str | int) -> None:
    """``<table>_<sample>.csv`` folders with the fixed header, NULL as an empty field."""
    for table in S.OUTPUT_TABLES:
        if table in tables:
            df = tables[table].select(*S.cdm_schema(table).fieldNames()).toDF(*S.cdm_header(table))
            df.write.option("header", True).option("nullValue", "").option("quote", "").csv(f"{folder.rstrip('/')}/{table}_{sample}.csv")


def merge_samples(spark: SparkSession, folder: str, table: str, samples: list[int]) -> DataFrame:
    """The files of all samples of a table in one frame, with the sample each row came from."""
    names = S.cdm_schema(table).fieldNames()
    paths = [f"{folder.rstrip('/')}/{table}_{n}.csv" for n in samples]
    raw = spark.read.schema(S.text_schema(names)).option("header", True).option("quote", "").csv(paths)
    return raw.withColumn("sample", F.regexp_extract("_metadata.file_path", f"/{table}_([0-9]+)[.]csv", 1).cast("int"))


def to_csv_rfc4180(df: DataFrame, path: str) -> None:
    """CSV with CRLF line ends; quotes only where needed, quotes inside doubled."""
    kept = df.drop("_rescued_data")
    options = {
        "header": True, "quote": '"', "escape": '"', "lineSep": "\r\n", "nullValue": "", "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    kept.write.options(**options).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    df.drop("_rescued_data").write.option("ignoreNullFields", False).json(path)
