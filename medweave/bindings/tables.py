"""Ids, dimensions, loading and writing: the test tables written to files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from medweave import schemas as S
from medweave.bindings import feeds
from medweave.bindings.common import day, query
from medweave.operators import combine, ids, skew
from medweave.plans import claims as C
from medweave.session import new_folder
from medweave.sources import files, publish, tables
from medweave.streaming.incremental import copy_new_files, ledger, rejected_lines

# --- ids and dimensions ---------------------------------------------------------------------------------------


@query("assign_ids", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 99 AS id, o_orderkey, o_totalprice FROM orders")
def assign_ids(t):
    return ids.assign_ids(t.orders.select("o_orderkey", "o_totalprice"), "id", [F.desc("o_totalprice"), "o_orderkey"], 100)


@query("assign_ids_unordered", "SELECT count(*) AS n, count(*) AS distinct_ids, CAST(5 AS BIGINT) AS low, count(*) + 4 AS high FROM lineitem")
def assign_ids_unordered(t):
    """Dense ids without a shuffle: as many as rows, none twice, no gap."""
    got = ids.assign_ids(t.lineitem, "id", base=5)
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct_ids"), F.min("id").alias("low"), F.max("id").alias("high"))


_DIM = "dim AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS brand_id FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 25))"


def _dim(t):
    return ids.assign_ids(t.part.where("p_size < 25").select("p_brand").distinct(), "brand_id", ["p_brand"])


@query("new_keys", f"WITH {_DIM} SELECT DISTINCT p_brand || p_type AS p_brand FROM part WHERE p_brand || p_type NOT IN (SELECT p_brand || 'ECONOMY' FROM dim)")
def new_keys(t):
    kinds = t.part.select(F.concat("p_brand", "p_type").alias("p_brand"))
    return ids.new_keys(kinds, _dim(t).select(F.concat("p_brand", F.lit("ECONOMY")).alias("p_brand")), ["p_brand"])


@query("lookup_dim", f"WITH {_DIM} SELECT p_partkey, brand_id FROM part p LEFT JOIN dim ON dim.p_brand = CASE WHEN p_type <> 'ECONOMY' THEN p.p_brand END")
def lookup_dim(t):
    facts = t.part.select("p_partkey", F.when(F.col("p_type") != "ECONOMY", F.col("p_brand")).alias("p_brand"))
    return ids.lookup_dim(facts, _dim(t), ["p_brand"], "brand_id").select("p_partkey", "brand_id")


@query(
    "upsert_dim",
    """WITH old AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS name_id FROM (SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY')),
       fresh AS (SELECT p_name, min(p_partkey) AS seen FROM part WHERE p_name NOT IN (SELECT p_name FROM old) GROUP BY p_name)
       SELECT p_name, name_id, false AS is_new FROM old UNION ALL
       SELECT p_name, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY seen), true FROM fresh""",
)
def upsert_dim(t):
    old = ids.assign_ids(t.part.where("p_type = 'ECONOMY'").select("p_name").distinct(), "name_id", ["p_name"])
    keys = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("seen"))
    return ids.upsert_dim(old, keys, ["p_name"], "name_id", ["seen"], ids.next_id(old, "name_id", 1)).drop("seen")


@query("id_state", "SELECT 'person' AS counter, count(*) + 1 AS next_id FROM customer")
def id_state(t):
    """Counters saved after numbering the customers and loaded again."""
    people = ids.assign_ids(t.customer.select("c_custkey"), "person_id", ["c_custkey"])
    path = new_folder(t.spark, "state")
    ids.save_state(t.spark, ids.load_state(t.spark, None) | {"person": ids.next_id(people, "person_id", 1)}, path)
    state = ids.load_state(t.spark, path)
    return t.spark.createDataFrame(list(state.items()), "counter string, next_id long").where("counter = 'person'")


@query(
    "skew_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, n_name FROM lineitem LEFT JOIN nation ON n_nationkey = ascii(l_returnflag) - 60""",
)
def skew_join(t):
    """A join on three hot keys, each split into several pieces."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.ascii("l_returnflag") - 60).alias("k"))
    return skew.skew_join(lines, t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), ["k"], "left").drop("k")


@query("skew_semi_join", "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def skew_semi_join(t):
    wanted = t.lineitem.where("l_returnflag <> 'N'").select("l_returnflag").distinct()
    return skew.skew_join(t.lineitem, wanted, ["l_returnflag"], "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))


@query("merge_insert", "SELECT o_orderkey, 'old' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'O'")
def merge_insert(t):
    old = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("src"))
    new = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("new").alias("src"))
    return combine.merge_insert(old, new, ["o_orderkey"])


@query("union_parts", "SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def union_parts(t):
    return combine.union_parts([t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))])


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_rows(t):
    return combine.distinct_rows(t.lineitem.select("l_orderkey", "l_returnflag"))


@query(
    "table_for_file",
    'SELECT DISTINCT p_name AS name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size < 3) THEN upper(p_name) END AS "table" FROM part',
)
def table_for_file(t):
    names = t.part.where("p_size < 3").select(F.upper("p_name").alias("table")).distinct()
    return combine.table_for_file(t.part.select(F.col("p_name").alias("name")).distinct(), names)


@query("clashes", "SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10 AND p_name IN (SELECT p_name FROM part WHERE p_size > 40)")
def clashes(t):
    named = t.part.select(F.col("p_name").alias("name"), "p_size")
    return combine.clashes(named.where("p_size < 10"), named.where("p_size > 40"))


# --- claims and vocabulary files -----------------------------------------------------------------------------------


def _write_feed(t, kind, part=None):
    """A feed as a comma-separated folder with a header, in file order."""
    path = new_folder(t.spark, kind) + ".csv"
    df = C.conform(feeds.feed(t, kind), kind)
    if part is not None:
        df = df.where(part)
    df.write.options(header=True, quote="\0", nullValue="", emptyValue="").csv(path)
    return path


def _feed_sql(kind, columns):
    used = ", ".join(columns)
    return f"WITH f AS ({feeds.FEED_SQL[kind].format(**{s: s for s in feeds._SOURCES})}) SELECT {used} FROM f"


_READ = {
    "inpatient": ["DESYNPUF_ID", "CLM_ID", "SEGMENT", "CLM_FROM_DT", "PRVDR_NUM", "OT_PHYSN_NPI", "ICD9_DGNS_CD_10", "HCPCS_CD_45"],
    "outpatient": ["DESYNPUF_ID", "CLM_ID", "CLM_THRU_DT", "ADMTNG_ICD9_DGNS_CD", "ICD9_PRCDR_CD_1", "HCPCS_CD_1"],
    "prescription": ["DESYNPUF_ID", "PDE_ID", "SRVC_DT", "PROD_SRVC_ID", "TOT_RX_CST_AMT"],
}
for _kind, _columns in _READ.items():

    @query(f"read_claims_{_kind}", _feed_sql(_kind, _columns))
    def _read(t, kind=_kind, columns=_columns):
        return files.read_claims(t.spark, kind, _write_feed(t, kind)).select(*columns)


_CARRIER = ["DESYNPUF_ID", "CLM_ID", "ICD9_DGNS_CD_8", "PRF_PHYSN_NPI_13", "TAX_NUM_2", "LINE_ALOWD_CHRG_AMT_1", "LINE_ICD9_DGNS_CD_13"]


@query("read_claim_parts", _feed_sql("carrier", _CARRIER))
def read_claim_parts(t):
    first = F.col("ICD9_DGNS_CD_8") < "D2"
    paths = [_write_feed(t, "carrier", first), _write_feed(t, "carrier", ~first)]
    return files.read_claim_parts(t.spark, paths).select(*_CARRIER)


_BENE = ["FILE_YEAR", "DESYNPUF_ID", "BENE_BIRTH_DT", "BENE_DEATH_DT", "BENE_COUNTY_CD", "PLAN_CVRG_MOS_NUM", "PPPYMT_CAR"]


@query("read_beneficiary", _feed_sql("beneficiary", [c if c != "PPPYMT_CAR" else "'' AS PPPYMT_CAR" for c in _BENE]))
def read_beneficiary(t):
    paths = {}
    for year in ("2008", "2009", "2010"):
        paths[year] = new_folder(t.spark, "beneficiary")
        rows = C.conform(feeds.feed(t, "beneficiary"), "beneficiary").where(F.col("FILE_YEAR") == year).drop("FILE_YEAR")
        rows.write.options(header=True, quote="\0", emptyValue="").csv(paths[year])
    return files.read_beneficiary(t.spark, paths).select(*_BENE)


@query("skip_header_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def skip_header_rows(t):
    ids_ = F.when(F.col("o_orderstatus") == "P", '"DESYNPUF_ID"').otherwise(F.col("o_orderkey").cast("string"))
    return C.skip_header_rows(t.orders.select("o_orderkey", ids_.alias(C.PERSON))).drop(C.PERSON)


@query("has_service_date", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def has_service_date(t):
    when = F.when(F.col("o_orderstatus") == "F", "20080101").when(F.col("o_orderstatus") == "O", "")
    return C.has_service_date(t.orders.select("o_orderkey", when.alias("d")), "d").drop("d")


@query("read_vocabulary", "SELECT p_partkey AS concept_id, p_name AS concept_name, p_type AS domain_id, '9\"0.' || p_size AS concept_code, DATE '1970-01-01' AS valid_start_date FROM part WHERE p_brand <> 'Brand#2'")
def read_vocabulary(t):
    """Parts as a tab-separated file; rows of one brand lack a field and are dropped."""
    path = new_folder(t.spark, "CONCEPT")
    short = F.when(F.col("p_brand") != "Brand#2", F.lit(""))
    fields = [F.col("p_partkey").cast("string"), "p_name", "p_type", F.lit("V"), F.lit("C"), F.lit("S"), F.concat(F.lit('9"0.'), "p_size"), F.lit("19700101"), F.lit("20991231"), short]
    body = t.part.select(F.concat_ws("\t", *fields).alias("value"))
    head = t.spark.createDataFrame([("\t".join(S.cdm_schema("concept").fieldNames()),)], "value string")
    head.unionByName(body).write.text(path)
    got = files.read_vocabulary(t.spark, path, "concept")
    return got.select("concept_id", "concept_name", "domain_id", "concept_code", "valid_start_date")


# --- plain files ---------------------------------------------------------------------------------------------------

_PART = "p_partkey, p_name, p_brand, p_size"


@query("read_gz", f"SELECT {_PART} FROM part")
def read_gz(t):
    path = new_folder(t.spark, "gz")
    part = t.part.select(*_PART.split(", "))
    part.write.options(header=True, compression="gzip").csv(path)
    return files.read_gz(t.spark, path, part.schema)


for _ext in ("parquet", "json", "tsv", "csv"):

    @query(f"read_files_{_ext}", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
    def _read_files(t, ext=_ext):
        path = f"{new_folder(t.spark, 'plain')}.{ext}"
        out = t.part.select(F.col("p_partkey").cast("string"), "p_name", "p_brand").write
        if ext in ("csv", "tsv"):
            out.options(header=True, sep="\t" if ext == "tsv" else ",").csv(path)
        else:
            out.format(ext).save(path)
        return files.read_files(t.spark, path).select("p_partkey", "p_name", "p_brand")


@query("list_files", "SELECT 'o_orderstatus=' || o_orderstatus AS folder, true AS filled FROM orders GROUP BY o_orderstatus")
def list_files(t):
    path = new_folder(t.spark, "listed")
    t.orders.write.partitionBy("o_orderstatus").parquet(path)
    found = files.list_files(t.spark, path, recursive=True)
    return found.groupBy(F.substring_index("relative", "/", 1).alias("folder")).agg((F.min("size") > 0).alias("filled"))


@query("publish_no_clobber", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def publish_no_clobber(t):
    """Files are moved once; a second output with the same names is refused as a whole."""
    staged, again, out = (new_folder(t.spark, n) for n in ("staged", "again", "out"))
    t.orders.select("o_orderkey").write.parquet(f"{staged}/data")
    publish.publish_no_clobber(t.spark, staged, out)
    name = files.list_files(t.spark, f"{out}/data").first()["name"]
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(t.spark._jsc.hadoopConfiguration())
    t.orders.select("o_orderkey").write.parquet(f"{again}/data")
    fs.rename(path(files.list_files(t.spark, f"{again}/data").first()["path"]), path(f"{again}/data/{name}"))
    try:
        publish.publish_no_clobber(t.spark, again, out)
        raise AssertionError("a clash was not refused")
    except FileExistsError:
        pass
    return t.spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("to_csv_rfc4180", "SELECT p_partkey, p_name || ', \"x\"' AS p_name, '  ' || p_brand || ' ' AS p_brand FROM part")
def to_csv_rfc4180(t):
    path = new_folder(t.spark, "rfc")
    df = t.part.select("p_partkey", F.concat("p_name", F.lit(', "x"')).alias("p_name"), F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("p_brand"), F.lit(1).alias("_rescued_data"))
    tables.to_csv_rfc4180(df, path)
    return t.spark.read.options(header=True, escape='"').schema("p_partkey long, p_name string, p_brand string").csv(path)


@query("to_json", "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part")
def to_json(t):
    path = new_folder(t.spark, "json")
    tables.to_json(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")), path)
    return t.spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


# --- tables ----------------------------------------------------------------------------------------------------------


def _database(t) -> str:
    """A new database below the shared folder."""
    name = f"medweave_{uuid.uuid4().hex[:12]}"
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{new_folder(t.spark, name)}'")
    return name


_TARGET = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()), StructField("o_orderdate", DateType()),
    StructField("o_totalprice", DoubleType()), StructField("o_orderpriority", StringType()),
])
_ORDERS = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("o_orderdate"), "o_totalprice", "o_orderpriority", "o_orderstatus")


def _samples(t, folder, sep=","):
    """Two samples of orders, and a table whose name only starts the same."""
    for n, part in ((1, "o_orderstatus = 'F'"), (2, "o_orderstatus <> 'F'")):
        _orders(t).where(part).drop("o_orderstatus").write.options(header=True, sep=sep).csv(f"{folder}/orders_{n}.csv")
    _orders(t).write.options(header=True, sep=sep).csv(f"{folder}/orders_extra.csv")


def _target(t, name="orders"):
    database = _database(t)
    tables.create_tables(t.spark, database, {name: _TARGET})
    return database, f"{database}.{name}"


@query("copy_into", _ORDERS)
def copy_into(t):
    folder = new_folder(t.spark, "copy")
    _samples(t, folder)
    _, table = _target(t)
    tables.copy_into(t.spark, table, folder, "orders.csv", header=True, quote=None)
    return t.spark.table(table)


@query("copy_into_columns", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS DATE) AS o_orderdate, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders")
def copy_into_columns(t):
    """Chosen columns of a tab-separated text file without a header."""
    folder = new_folder(t.spark, "copy-columns")
    t.orders.select("o_orderkey", "o_orderpriority").write.options(sep="\t").csv(f"{folder}/orders.csv")
    _, table = _target(t)
    tables.copy_into(t.spark, table, folder, "orders.csv", csv=False, columns=["o_orderkey", "o_orderpriority"])
    return t.spark.table(table)


@query("copy_new_files", _ORDERS)
def copy_new(t):
    """The second call loads only the files that came after the first."""
    folder, out, checkpoint = (new_folder(t.spark, n) for n in ("arriving", "loaded", "offsets"))
    parts = ["o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus = 'P'"]
    for n, part in enumerate(parts):
        _orders(t).where(part).drop("o_orderstatus").write.option("header", True).csv(f"{folder}/orders_{n}.csv")
        loaded = copy_new_files(t.spark, folder, "orders.csv", _TARGET, out, checkpoint)
    return loaded.select(*_TARGET.fieldNames())


@query(
    "copy_new_files_apart",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS loaded, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS rejected,
         CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS BIGINT) AS rejected_keys FROM orders GROUP BY o_orderstatus""",
)
def copy_new_apart(t):
    """Lines with a price that is no number are kept apart; a second checkpoint finds nothing left to load."""
    folder, out, first, second = (new_folder(t.spark, n) for n in ("arriving", "loaded", "offsets", "offsets"))
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    for n, status in enumerate(("F", "O", "P")):
        _orders(t).where(F.col("o_orderstatus") == status).drop("o_orderstatus").withColumn("o_totalprice", price).write.option("header", True).csv(f"{folder}/orders_{n}.csv")
        copy_new_files(t.spark, folder, "orders.csv", _TARGET, out, first, on_error="apart")
    copy_new_files(t.spark, folder, "orders.csv", _TARGET, out, second, on_error="apart")
    status = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.regexp_extract("file", "orders_([0-9])", 1).cast("int") + 1)
    files = ledger(t.spark, out).groupBy(status.alias("o_orderstatus")).agg(F.sum("loaded").alias("loaded"), F.sum("rejected").alias("rejected"))
    lines = rejected_lines(t.spark, out, _TARGET).select(
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.regexp_extract("loaded_from", "orders_([0-9])", 1).cast("int") + 1).alias("o_orderstatus"),
        F.split("fields", ",")[0].cast("long").alias("key"),
    )
    keys = lines.groupBy("o_orderstatus").agg(F.sum("key").alias("keys"))
    return files.join(keys, "o_orderstatus", "left").select("o_orderstatus", "loaded", "rejected", F.coalesce("keys", F.lit(0).cast("long")).alias("rejected_keys"))


@query("load_csv_to_table", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders")
def load_csv_to_table(t):
    """By name: columns in another order, one missing, one too many."""
    path = new_folder(t.spark, "named")
    _orders(t).select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey").write.option("header", True).csv(path)
    _, table = _target(t)
    tables.load_csv_to_table(t.spark, path, table)
    return t.spark.table(table)


@query(
    "discover_and_load",
    """SELECT 'ORDERS_7.csv' AS file, 'orders' AS "table", 'loaded' AS status, count(*) AS n FROM orders UNION ALL SELECT 'other_7.csv', NULL, 'unmapped', 0 UNION ALL SELECT 'part_7.csv', 'part', 'empty', 0""",
)
def discover_and_load(t):
    folder = new_folder(t.spark, "discover")
    _orders(t).drop("o_orderstatus").write.option("header", True).csv(f"{folder}/ORDERS_7.csv")
    _orders(t).write.option("header", True).csv(f"{folder}/other_7.csv")
    _orders(t).write.option("header", True).csv(f"{folder}/orders_8.csv")
    t.orders.where(F.isnull("o_orderkey")).select("o_orderstatus").coalesce(1).write.text(f"{folder}/part_7.csv")
    database, _ = _target(t)
    tables.create_tables(t.spark, database, {"part": _TARGET})
    return tables.discover_and_load(t.spark, folder, database, "7").select("file", "table", "status", F.col("n_rows").alias("n"))


@query("load_stage_file", _ORDERS)
def load_stage_file(t):
    path = new_folder(t.spark, "stage")
    _orders(t).drop("o_orderstatus").write.options(header=True, quoteAll=True).csv(path)
    _, table = _target(t)
    tables.load_stage_file(t.spark, path, table)
    return t.spark.table(table)


@query("write_table", "SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_orderkey")
def write_table(t):
    """Replaced once, then appended to; read back by name."""
    table = f"{_database(t)}.kept"
    keys = t.orders.select("o_orderkey", "o_orderstatus")
    tables.write_table(keys.where("o_orderstatus = 'P'"), table)
    tables.write_table(keys, table, "replace")
    tables.write_table(keys.where("o_orderstatus = 'F'"), table)
    return files.read_sql_table(t.spark, table).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("truncate_and_reload", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def truncate_and_reload(t):
    table = f"{_database(t)}.reloaded"
    rows = t.orders.select("o_custkey", "o_orderstatus")
    tables.write_table(rows, table)
    tables.truncate_and_reload(rows.distinct(), table)
    return t.spark.table(table)


@query("create_cdm_tables", "SELECT 'tables' AS what, 39 AS n UNION ALL SELECT 'cdm_source', 1 UNION ALL SELECT 'location', count(DISTINCT c_nationkey) FROM customer")
def create_cdm_tables(t):
    """Created once; a second call leaves them alone and describes the source only once."""
    database = _database(t)
    tables.create_cdm_tables(t.spark, database, "2020-01-01")
    tables.create_cdm_tables(t.spark, database)
    rows = t.customer.select(F.col("c_nationkey").cast("long").alias("location_id")).distinct()
    C.to_cdm(rows, "location").write.insertInto(f"{database}.location")
    counts = [t.spark.table(f"{database}.{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n") for n in ("cdm_source", "location")]
    names = t.spark.sql(f"SHOW TABLES IN {database}").where("NOT isTemporary").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tables").alias("what"), "n")
    return C.union_facts([names, *counts])


_MERGE = "SELECT c_custkey AS person_id, CAST(1 + c_nationkey % 2 AS INTEGER) AS sample, 1900 + c_nationkey AS year_of_birth FROM customer"


@query("merge_samples", _MERGE)
def merge_samples(t):
    """Persons written as CSV per sample and read back as one table."""
    folder = new_folder(t.spark, "cdm")
    people = t.customer.select(F.col("c_custkey").alias("person_id"), (F.lit(1900) + F.col("c_nationkey")).alias("year_of_birth"), (1 + F.col("c_nationkey") % 2).alias("s"))
    for n in (1, 2):
        tables.write_cdm_csv({"person": C.to_cdm(people.where(F.col("s") == n), "person")}, folder, n)
    merged = tables.merge_samples(t.spark, folder, "person", [1, 2])
    return merged.select(F.col("person_id").cast("long"), "sample", F.col("year_of_birth").cast("int"))


@query("append_unmapped", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def append_unmapped(t):
    """The log of unknown codes grows by each sample."""
    path = new_folder(t.spark, "unmapped")
    for status in ("F", "O", "P"):
        C.append_unmapped(t.orders.where(F.col("o_orderstatus") == status), path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_artifact",
    """SELECT p_name, p_size, 'c1' AS _consent_group, 'D1' AS _dbgap_accession, 'open_access' AS _access_tier, 'u' AS _exported_for, '2026-01-01' AS _access_expires_at, 'r-1' AS _request_id
       FROM part WHERE p_size >= 25""",
)
def export_artifact(t):
    """Artifact table of a request over files, delivered as CSV and read back."""
    from medweave.plans import export

    location, out = new_folder(t.spark, "study"), new_folder(t.spark, "delivered")
    t.part.write.option("header", True).csv(location)
    catalog = t.spark.createDataFrame([("D1", location + "/", "c1", "open_access", "s")], "dataset_id string, volume_location string, consent_group string, access_tier string, dbgap_status string")
    request = {"request_id": "r-1", "dataset": "D1", "submitter": "u", "selected_columns": ["P_NAME", "p_size"], "cohort_filter": {"column": "p_size", "op": "gte", "value": "25"}}
    made = export.export_artifact(t.spark, catalog, _database(t), request, "boss", "2026-01-01")
    export.deliver(t.spark, made["table"], "csv", out)
    got = t.spark.read.option("header", True).csv(out).drop("_exported_at")
    return got.withColumn("p_size", F.col("p_size").cast("int"))


@query("append_audit", 'SELECT event_type AS action_type, count(*) AS n FROM events GROUP BY ALL')
def append_audit(t):
    from medweave.plans import governance as g

    table = f"{_database(t)}.audit_events"
    for part in ("value >= 10", "value < 10"):
        events = g.event_envelope(t.events.where(part), F.col("user_id").cast("string"), F.col("event_type"), F.lit("r"), "allowed", F.struct("value"), F.col("ts"))
        g.append_audit(events, table)
    return t.spark.table(table).groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "describe_table",
    """SELECT i AS position, c AS "column", k AS type, true AS nullable FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_orderdate', 'date')) v(i, c, k)""",
)
def describe_table(t):
    from medweave.operators.quality import describe_table as describe

    table = f"{_database(t)}.described"
    tables.write_table(t.orders.select("o_orderkey", day("o_orderdate").alias("o_orderdate")), table)
    return describe(t.spark, table)
