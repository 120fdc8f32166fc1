"""Checks on input folders and delimited files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from medweave.session import settle
from medweave.sources.files import list_files

DELIMITERS = (",", "\t", "|", ";")
FILES = "*.{[cC][sS][vV],[tT][xX][tT]}"
ISSUE = "file string, level string, issue string, line long, found int, expected int, detail string"


def check_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of a folder as issue rows: missing, nothing but empty files, single empty files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([(folder, "error", "not found", None, None, None, None)], ISSUE)
    files = list_files(spark, folder, recursive=True)
    filled = files.agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest")).where(F.col("largest") == 0)
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("line", "long"), ("found", "int"), ("expected", "int"), ("detail", "string"))]
    nothing = filled.select(F.lit(folder).alias("file"), F.lit("error").alias("level"), F.lit("folder is empty").alias("issue"), *blank)
    empty = files.where(F.col("size") == 0).select(
        F.col("path").alias("file"), F.lit("warning").alias("level"), F.lit("file is empty").alias("issue"), *blank
    )
    return nothing.unionByName(empty)


# --- lines and records of delimited files ----------------------------------------------------------------
#
# A quoted field may hold delimiters and line ends, so whether a line begins a record depends on all quotes before it in
# its file. Every file split counts its own quotes: with an even number it leaves the state it found, with an odd
# number it turns it. These parities, combined along the splits of a file, give each split the state it begins with, and all
# splits find their record borders at the same time. The same pass gives the numbers of lines before a split.


def file_lines(spark: SparkSession, folder: str, pattern: str = FILES) -> DataFrame:
    """``file, block, at, value`` of all lines of the files whose names match the glob ``pattern``.

    ``at`` follows the lines of a split, and is the same whenever one plan reads this frame, as all its reads are cut into
    the same tasks: a line's place in its split is its ``at`` less the least one there.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _in_split() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("at")


def _placed(lines: DataFrame) -> DataFrame:
    """``row`` of each line in its split, from 1, and whether the quotes before it in the split turn the state."""
    turned = (F.coalesce(F.sum("quotes").over(_in_split().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).cast("int")
    return lines.withColumns({"row": F.row_number().over(_in_split()), "turned": turned})


def file_splits(lines: DataFrame) -> DataFrame:
    """Per split: the ``at`` of its first line, ``lines`` in it and ``before`` it, whether it begins inside quotes (``inside``), the line its first record
    border ``carried`` over from earlier splits lies in, and of its file the last line of the first record (``head_end``),
    the number of lines (``total``) and whether its last quote is left open (``open``).

    One row per split; only these rows are put in order per file.
    """
    lines = _placed(lines.select("file", "block", "at", _quotes(F.col("value")).alias("quotes")))
    # Of each split for both states it may begin with: the last line that begins a record, and the first one but line 1 of the file.
    begins = lambda state: (F.col("turned") == state)
    later = (F.col("row") > 1) | (F.col("block") > 0)
    found = lines.groupBy("file", "block").agg(
        F.min("at").alias("first_at"), F.count(F.lit(1)).alias("lines"), (F.sum("quotes") % 2).cast("int").alias("parity"),
        F.array(*[F.max(F.when(begins(s), F.col("row"))) for s in (0, 1)]).alias("last"),
        F.array(*[F.min(F.when(begins(s) & later, F.col("row"))) for s in (0, 1)]).alias("first"),
    )
    along = Window.partitionBy("file").orderBy("block")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumns({
        "before": F.coalesce(F.sum("lines").over(before), F.lit(0)), "inside": (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"),
        "total": F.sum("lines").over(whole), "open": (F.sum("parity").over(whole) % 2) == 1,
    })
    found = found.withColumns({
        "own_last": F.col("before") + F.get("last", F.col("inside")), "own_first": F.col("before") + F.get("first", F.col("inside")),
    })
    return found.withColumns({
        "carried": F.max("own_last").over(before), "head_end": F.coalesce(F.min("own_first").over(whole) - 1, F.col("total")),
    }).select("file", "block", "first_at", "lines", "before", "inside", "carried", "head_end", "total", "open")


def numbered_lines(spark: SparkSession, folder: str, pattern: str = FILES) -> DataFrame:
    """``file, line, value`` of all text lines; the line number counts from 1 in each file."""
    raw = file_lines(spark, folder, pattern)
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first_at", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    line = F.col("before") + F.col("at") - F.col("first_at") + 1
    return raw.join(splits, ["file", "block"]).select("file", line.cast("long").alias("line"), "value")


def _delimiters(text: Column, state: Column) -> Column:
    """How often ``text`` holds each delimiter outside quotes, when it begins in ``state`` (1: inside quotes)."""
    # Quotes cut the text into parts that lie outside and inside in turns.
    parts = F.split(text, '"', -1)
    outside = F.array_join(F.filter(parts, lambda _, i: (i + state) % 2 == 0), "")
    return F.array(*[(F.length(outside) - F.length(F.replace(outside, F.lit(d), F.lit("")))).cast("int") for d in DELIMITERS])


def records(spark: SparkSession, folder: str, pattern: str = FILES) -> DataFrame:
    """The records of the delimited files below a folder, quoted fields over several lines included.

    Columns: ``file``, ``line`` its first line, ``counts`` of each of DELIMITERS outside quotes, ``blank`` (one line of
    nothing), ``utf8``, ``open`` (its last quote is never closed) and, of the first record of a file only, its ``text``.
    The folder is read twice: once for the splits, once for the records.
    """
    raw = file_lines(spark, folder, pattern)
    lines = raw.join(file_splits(raw), ["file", "block"]).withColumn("line", (F.col("before") + F.col("at") - F.col("first_at") + 1).cast("long"))
    value = F.regexp_replace("value", "\r$", "")
    # Only the lines of a file's first record keep their text, and not if it is the whole file for want of a quote.
    head = (F.col("line") <= F.col("head_end")) & ~(F.col("open") & (F.col("head_end") == F.col("total")))
    both = F.array(*[_delimiters(value, F.lit(s)) for s in (0, 1)])
    narrow = lines.select(
        "file", "block", "at", "line", "inside", "carried", "total", F.col("open").alias("file_open"), _quotes(F.col("value")).alias("quotes"), both.alias("both"),
        (value == "").alias("empty"), F.is_valid_utf8("value").alias("utf8"), F.when(head, F.struct("line", value.alias("text"))).alias("head"),
    )
    placed = _placed(narrow)
    placed = placed.withColumn("state", (F.col("inside") + F.col("turned")) % 2)
    start = F.coalesce(F.max(F.when(F.col("state") == 0, F.col("line"))).over(_in_split()), "carried").cast("long")
    each = placed.withColumns({"start": start, "counts": F.get("both", F.col("state"))})
    grouped = each.groupBy("file", "start").agg(
        *[F.sum(F.get("counts", F.lit(i))).cast("int").alias(f"n{i}") for i in range(len(DELIMITERS))],
        (F.bool_and("empty") & (F.count(F.lit(1)) == 1)).alias("blank"), F.bool_and("utf8").alias("utf8"),
        (F.max("line") == F.first("total")).alias("is_last"), F.first("file_open").alias("file_open"),
        F.sort_array(F.collect_list("head")).alias("texts"),
    )
    return grouped.select(
        "file", F.col("start").alias("line"), F.array(*[f"n{i}" for i in range(len(DELIMITERS))]).alias("counts"), "blank", "utf8",
        (F.col("is_last") & F.col("file_open")).alias("open"),
        F.when(F.size("texts") > 0, F.array_join(F.transform("texts", lambda t: t["text"]), "\n")).alias("text"),
    )


def check_delimited(spark: SparkSession, folder: str, max_rows: int | None = None, max_errors: int | None = None) -> DataFrame:
    """Issue rows for the delimited files below a folder.

    Checked are the names in the header record and that every record has as many fields; all records, or the first
    ``max_rows`` of each file. Quoted fields may hold delimiters and line ends; issues name the line a record begins in.
    The delimiter is the one the header holds most of. All wrong records are listed, or with ``max_errors`` that many per
    file and one more issue with the number of the rest. A file whose first line is blank has no header row and
    is not checked further, nor is one that is not UTF-8. A quote that is never closed is an issue of its record.
    Problems of ``.txt`` files are warnings; blank lines are skipped.
    """
    found = settle(records(spark, folder))  # narrow rows, written once for all the checks below: the folder is read twice in all
    # Per file from its first record: delimiter, width and level. Joined to the records of the same file.
    best = F.array_max(F.array(*[F.struct(F.get("counts", F.lit(i)).alias("n"), F.lit(-i).alias("rank"), F.lit(i).alias("i")) for i in range(len(DELIMITERS))]))
    text_file = F.lower("file").endswith(".txt")
    per_file = found.groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"), F.count(F.lit(1)).alias("n_records"),
        F.max(F.when(F.col("line") == 1, F.struct(best.alias("best"), "blank", "text"))).alias("head"),
    ).withColumns({"text_file": text_file, "level": F.when(text_file, "warning").otherwise("error")})

    def issue(df: DataFrame, text: str, level: Column | str = "level", **values: Column) -> DataFrame:
        kinds = {"line": "long", "found": "int", "expected": "int", "detail": "string"}
        return df.select(
            "file", (F.lit(level) if level == "warning" else F.col("level")).alias("level"), F.lit(text).alias("issue"),
            *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()],
        )

    foreign = per_file.where(~F.col("utf8"))
    headless = per_file.where(F.col("utf8") & F.col("head.blank"))
    usable = per_file.where(F.col("utf8") & ~F.col("head.blank") & ~(F.col("text_file") & (F.col("head.best.n") == 0))).select(
        "file", "level", "n_records", F.regexp_replace("head.text", "^﻿", "").alias("head"), F.col("head.best.i").alias("i"), (F.col("head.best.n") + 1).alias("expected"),
    )
    sign = F.element_at(F.array(*map(F.lit, DELIMITERS)), F.col("i") + 1)
    # Delimiters outside quotes are those with an even number of quotes behind them.
    names = F.split("head", F.concat(F.lit("["), sign, F.lit("](?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")), -1)
    named = usable.select("file", "level", "expected", F.posexplode(names).alias("at", "name"))
    named = named.withColumn("name", F.trim(F.trim("name"), F.lit('"')))
    unnamed = named.where(F.col("name") == "")
    repeated = named.where(F.col("name") != "").groupBy("file", "level", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    ranked = found.where((F.col("line") > 1) & ~F.col("blank"))
    body = ranked.join(usable.drop("head"), "file").withColumn("found", F.get("counts", F.col("i")) + 1)
    if max_rows is not None:
        body = body.withColumn("_nth", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_nth") <= max_rows)
    bad = body.where((F.col("found") != F.col("expected")) & ~F.col("open"))
    listed, more = bad, None
    if max_errors is not None:
        listed = bad.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_r") <= max_errors)
        more = bad.groupBy("file", "level").agg((F.count(F.lit(1)) - max_errors).alias("n")).where("n > 0")
    issues = [
        issue(foreign, "not valid UTF-8", "warning"),
        issue(headless, "has no header row", line=F.lit(1)),
        issue(unnamed, "header column has no name", line=F.lit(1), found=F.col("at") + 1, expected=F.col("expected")),
        issue(repeated, "header column appears more than once", line=F.lit(1), found=F.col("n"), expected=F.lit(1), detail=F.col("name")),
        issue(listed, "wrong number of fields", line=F.col("line"), found=F.col("found"), expected=F.col("expected")),
        issue(found.where("open").join(usable.select("file", "level"), "file"), "quoted field is not closed", line=F.col("line")),
        issue(usable.where("n_records = 1"), "header only", "warning"),
    ]
    if more is not None:
        issues.append(issue(more, "more lines with the wrong number of fields", found=F.col("n")))
    return reduce(DataFrame.unionByName, issues)
