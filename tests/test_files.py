"""Loading, publishing and checking files."""

import gzip

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from medweave import schemas as S
from medweave.operators import ordering, quality
from medweave.sources import checks, files, publish, tables
from medweave.streaming.incremental import copy_new_files, ledger, rejected_lines

T = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("day", DateType())])


@pytest.fixture
def database(spark, tmp_path):
    name = f"db_{abs(hash(str(tmp_path))) % 10**9}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/warehouse'")
    tables.create_tables(spark, name, {"person": T, "observation": T})
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def kept(spark, table):
    return sorted((tuple(r) for r in spark.table(table).select("id", "name", F.col("day").cast("string")).collect()), key=repr)


def test_by_position_picks_numbered_files_only(spark, tmp_path, database):
    data = tmp_path / "data"
    put(data, "person.csv", "x,y,z\n1,a,20080101\n")
    put(data, "person_2.csv", 'x,y,z\n2,"q",2008-01-02\n')
    put(data, "person_xyz.csv", "x,y,z\n3,c,\n")
    put(data, "person_period_1.csv", "x,y,z\n4,c,\n")
    assert tables.copy_into(spark, f"{database}.person", str(data), "person.csv", ",", True, None) == 2
    assert kept(spark, f"{database}.person") == [(1, "a", "2008-01-01"), (2, '"q"', "2008-01-02")]  # quoting is off


def test_by_position_with_quotes_columns_and_text_format(spark, tmp_path, database):
    data = tmp_path / "data"
    put(data, "person.csv", '5,"a, ""b"""\n6,\n')
    tables.copy_into(spark, f"{database}.person", str(data), "person.csv", columns=["id", "name"])
    put(data, "observation.csv", 'x"\t7\n')
    tables.copy_into(spark, f"{database}.observation", str(data), "observation.csv", csv=False, columns=["name", "id"])
    assert kept(spark, f"{database}.person") == [(5, 'a, "b"', None), (6, None, None)]
    assert kept(spark, f"{database}.observation") == [(7, 'x"', None)]


def test_a_bad_value_stops_a_load_by_position(spark, tmp_path, database):
    put(tmp_path / "data", "person.csv", "1,a,2008\n")
    with pytest.raises(Exception, match="not a date"):
        tables.copy_into(spark, f"{database}.person", str(tmp_path / "data"), "person.csv")


def test_gz(spark, tmp_path, database):
    data = tmp_path / "data"
    put(data, "person.csv.gz", gzip.compress(b"id,name,day\n1,a,20080101\n"))
    assert tables.copy_into(spark, f"{database}.person", str(data), "person.csv.gz", header=True) == 1
    assert files.read_gz(spark, str(data), S.text_schema(T.fieldNames()), 4).rdd.getNumPartitions() == 4


def test_by_name_orders_casts_and_drops(spark, tmp_path, database):
    path = put(tmp_path / "data", "f.csv", "day,extra,id\n20080131,x,1\n2008-02-01,x,oops\n")
    assert tables.load_csv_to_table(spark, path, f"{database}.person") == 2
    assert kept(spark, f"{database}.person") == [(1, None, "2008-01-31"), (None, None, "2008-02-01")]


def test_discovery_reports_every_file(spark, tmp_path, database):
    data = tmp_path / "data"
    put(data, "PERSON_3.csv", "id,name\n1,a\n")
    put(data, "observation_3.csv", b"")
    put(data, "unknown_3.csv", "id\n1\n")
    put(data, "person_4.csv", "id\n1\n")
    got = tables.discover_and_load(spark, str(data), database, "3").collect()
    assert sorted((r["file"], r["table"], r["status"], r["n_rows"]) for r in got) == [
        ("PERSON_3.csv", "person", "loaded", 1), ("observation_3.csv", "observation", "empty", 0), ("unknown_3.csv", None, "unmapped", 0),
    ]


def test_stage_file_stops_at_bad_rows(spark, tmp_path, database):
    good = put(tmp_path / "data", "g.csv", 'id,name,day\n1,"a, b",2008-01-01\n2,,\n')
    assert tables.load_stage_file(spark, good, f"{database}.person") == 2
    assert kept(spark, f"{database}.person") == [(1, "a, b", "2008-01-01"), (2, None, None)]
    bad = put(tmp_path / "data", "b.csv", "id,name,day\nx,a,2008-01-01\n")
    with pytest.raises(Exception):
        tables.load_stage_file(spark, bad, f"{database}.person")
    assert spark.table(f"{database}.person").count() == 2


def test_publish_all_or_nothing(spark, tmp_path):
    staged, out = tmp_path / "staged", tmp_path / "out"
    put(staged, "a.csv", "1")
    (staged / "sub").mkdir()
    put(staged / "sub", "b.csv", "2")
    assert publish.publish_no_clobber(spark, str(staged), str(out)) == 2
    assert (out / "sub" / "b.csv").read_text() == "2"
    for i in range(7):
        put(out, f"c{i}.csv", "old")
        put(staged, f"c{i}.csv", "new")
    put(staged, "fresh.csv", "new")
    with pytest.raises(FileExistsError, match="7 file.*c0.csv.* and 2 more"):
        publish.publish_no_clobber(spark, str(staged), str(out))
    assert not (out / "fresh.csv").exists() and (out / "c0.csv").read_text() == "old"


def test_nothing_written_is_refused(spark, tmp_path):
    put(tmp_path / "staged", "a.csv", b"")
    for staged in ("staged", "missing"):
        with pytest.raises(ValueError, match="nothing was written"):
            publish.publish_no_clobber(spark, str(tmp_path / staged), str(tmp_path / "out"))


def test_new_files_only(spark, tmp_path):
    data, out, checkpoint = tmp_path / "data", str(tmp_path / "out"), str(tmp_path / "cp")
    put(data, "person_1.csv", "id,name,day\n1,a,20080101\n")
    put(data, "person_other.csv", "id,name,day\n9,a,20080101\n")
    assert copy_new_files(spark, str(data), "person.csv", T, out, checkpoint).count() == 1
    put(data, "person_2.csv", "id,name,day\n2,b,\n")
    got = copy_new_files(spark, str(data), "person.csv", T, out, checkpoint)
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    assert copy_new_files(spark, str(data), "person.csv", T, out, checkpoint).count() == 2


def test_strict_incremental_load(spark, tmp_path):
    """A bad value stops a batch and leaves nothing of it; once the file is mended the load goes on."""
    data, out, checkpoint = tmp_path / "data", str(tmp_path / "out"), str(tmp_path / "offsets")
    data.mkdir()
    load = lambda at=checkpoint, **o: sorted((r.id, r.name) for r in copy_new_files(spark, str(data), "person.csv", T, out, at, **o).collect())
    assert load() == [] and load() == []  # no file yet
    put(data, "person.csv", "id,name,day\n1,a,20080101\n")
    assert load() == [(1, "a")]
    for text in ("2,b,2008-13-01\n", "x,b,\n", "2,b\n"):
        put(data, "person_2.csv", f"id,name,day\n5,fine,\n{text}")
        with pytest.raises(Exception, match="not a date|CAST_INVALID|MALFORMED|FAILED_READ"):
            load()
        assert [r.load_batch for r in ledger(spark, out).collect()] == [0]
    put(data, "person_2.csv", "id,name,day\n2,b,\n")
    assert load() == [(1, "a"), (2, "b")]


def test_a_new_checkpoint_loads_nothing_twice(spark, tmp_path):
    data, out = tmp_path / "data", str(tmp_path / "out")
    load = lambda at, **o: sorted(r.id for r in copy_new_files(spark, str(data), "person.csv", T, out, str(tmp_path / at), **o).collect())
    put(data, "person.csv", "id,name,day\n1,a,\n")
    assert load("one") == [1]
    put(data, "person_2.csv", "id,name,day\n2,b,\n")
    assert load("two") == [1, 2]  # its batch 0 is not the other one's
    put(data, "person_3.csv", "id,name,day\n3,c,\n")
    assert load("one") == [1, 2, 3] and load("two", max_files=1) == [1, 2, 3]
    assert sorted((r.file.rsplit("/", 1)[1], r.loaded) for r in ledger(spark, out).collect()) == [("person.csv", 1), ("person_2.csv", 1), ("person_3.csv", 1)]


def test_a_batch_that_is_run_again(spark, tmp_path):
    """Without its page of the ledger a batch does not count, and the repeated one replaces it."""
    import shutil

    data, out, checkpoint = tmp_path / "data", tmp_path / "out", tmp_path / "offsets"
    put(data, "person.csv", "id,name,day\n1,a,\n2,b,\n")
    assert copy_new_files(spark, str(data), "person.csv", T, str(out), str(checkpoint)).count() == 2
    (checkpoint / "commits" / "0").unlink()
    (checkpoint / "commits" / ".0.crc").unlink(missing_ok=True)
    shutil.rmtree(out / "ledger")
    from medweave.streaming.incremental import loaded_rows

    assert loaded_rows(spark, str(out), T).count() == 0
    assert copy_new_files(spark, str(data), "person.csv", T, str(out), str(checkpoint)).count() == 2
    assert ledger(spark, str(out)).count() == 1


def test_rejected_lines(spark, tmp_path):
    data, out, checkpoint = tmp_path / "data", str(tmp_path / "out"), str(tmp_path / "offsets")
    put(data, "person.csv", "id,name,day\n1,a,20080101\nx,b,2008-02-30\n3,c\n4,d,,9\n,,\n")
    got = copy_new_files(spark, str(data), "person.csv", T, out, checkpoint, on_error="apart")
    assert sorted((r.id or 0, r.name) for r in got.collect()) == [(0, None), (1, "a")]
    assert sorted((r.fields, r.reason) for r in rejected_lines(spark, out, T).collect()) == [
        ("3,c", "wrong number of fields"), ("4,d,,9", "wrong number of fields"), ("x,b,2008-02-30", "cannot read id, day"),
    ]
    assert [(r.loaded, r.rejected) for r in ledger(spark, out).collect()] == [(2, 3)]
    with pytest.raises(ValueError):
        copy_new_files(spark, str(data), "person.csv", T, out, checkpoint, on_error="skip")


def issues(df):
    return sorted(((r["file"].rsplit("/", 1)[-1], r["level"], r["issue"], r["line"], r["found"]) for r in df.collect()), key=repr)


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".") and publish.PREFIX not in str(p)}


def staged_files(folder, n=40):
    for i in range(n):
        put(folder, f"part-{i % 3}/f{i}.csv", f"row {i}\n" if i else "")


def failing(monkeypatch, after, error):
    """From the ``after``-th rename on, renames raise ``error`` (once for errors that the publish answers itself)."""
    seen, whole = [], publish._Store.rename

    def rename(self, source, target):
        seen.append(source)
        if len(seen) == after or len(seen) > after and not isinstance(error, Exception):
            raise error
        whole(self, source, target)

    monkeypatch.setattr(publish._Store, "rename", rename)


def test_a_failed_publish_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    staged, out = tmp_path / "staged", tmp_path / "out"
    staged_files(staged)
    put(out, "old.csv", "old\n")
    before = tree(staged), tree(out)
    failing(monkeypatch, 17, OSError("no space"))
    with pytest.raises(OSError, match="no space"):
        publish.publish_no_clobber(spark, str(staged), str(out))
    assert (tree(staged), tree(out)) == before and publish.unfinished(spark, str(out)) == []
    assert publish.publish_no_clobber(spark, str(staged), str(out)) == 40
    assert tree(out) == before[0] | before[1] and tree(staged) == {}


@pytest.mark.parametrize("forward", [True, False])
def test_a_lost_driver(spark, tmp_path, monkeypatch, forward):
    """Left in the middle, a publish is finished or taken back later, as often as it is asked for."""
    staged, out = tmp_path / "staged", tmp_path / "out"
    staged_files(staged)
    before = tree(staged)
    failing(monkeypatch, 12, KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        publish.publish_no_clobber(spark, str(staged), str(out), threads=1)
    monkeypatch.undo()
    assert len(publish.unfinished(spark, str(out))) == 1 and 0 < len([n for n in tree(out) if n.startswith("part-")]) < 40
    assert spark.read.text(str(out), recursiveFileLookup=True).count() < 40  # readers pass over the manifest
    moved = publish.recover(spark, str(out), forward)
    assert moved == (29 if forward else 11)
    assert (tree(staged), tree(out)) == (({}, before) if forward else (before, {}))
    assert publish.recover(spark, str(out), forward) == 0


def test_a_name_taken_meanwhile(spark, tmp_path, monkeypatch):
    staged, out = tmp_path / "staged", tmp_path / "out"
    staged_files(staged)
    before = tree(staged)
    failing(monkeypatch, 5, KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        publish.publish_no_clobber(spark, str(staged), str(out), threads=1)
    monkeypatch.undo()
    rest = next(n for n in tree(staged))
    put(out, rest, "someone else's")
    with pytest.raises(FileExistsError):
        publish.recover(spark, str(out))
    assert tree(out) == {rest: "someone else's"} and tree(staged) == before
    (out / f"{publish.PREFIX}x" / publish.FILES).mkdir(parents=True)  # a manifest that was never whole
    assert publish.recover(spark, str(out)) == 0 and publish.unfinished(spark, str(out)) == []


def test_delimited_checks(spark, tmp_path):
    data = tmp_path / "data"
    put(data, "good.csv", "﻿a,b\n1,2\n\n3,\"x, y\"\n")
    put(data, "tabs.csv", "a\tb\n1\t2,3\n")
    put(data, "head.csv", "id,,ID\n1,2,3\n")
    put(data, "rows.csv", "a;b\n" + "1\n" * 12 + "1;2\n")
    put(data, "only.csv", "a|b\n")
    put(data, "one.csv", "a\n1\n2\n")
    put(data, "log.txt", "started\nsome text, with a comma\n")
    put(data, "table.txt", "a,b\n1\n")
    put(data, "latin.csv", b"a,b\n\xe9,1\n")
    wrong = "wrong number of fields"
    assert sorted(issues(checks.check_delimited(spark, str(data), max_errors=10)), key=repr) == sorted([
        ("head.csv", "error", "header column has no name", 1, 2), ("head.csv", "error", "header column appears more than once", 1, 2),
        *[("rows.csv", "error", wrong, n, 1) for n in range(2, 12)], ("rows.csv", "error", f"more lines with the {wrong}", None, 2),
        ("only.csv", "warning", "header only", None, None), ("table.txt", "warning", wrong, 2, 1), ("latin.csv", "warning", "not valid UTF-8", None, None),
    ], key=repr)


def test_row_limit_of_delimited_checks(spark, tmp_path):
    put(tmp_path / "data", "f.csv", "a,b\n" + "1,2\n" * 5 + "1\n")
    assert checks.check_delimited(spark, str(tmp_path / "data"), max_rows=5).count() == 0
    assert checks.check_delimited(spark, str(tmp_path / "data"), max_rows=6).count() == 1


def brute_records(text):
    """(first line, fields) of every record of ``text``, by RFC 4180 quoting, character by character."""
    out, fields, line, start, inside, any_char = [], 1, 1, 1, False, False
    for c in text:
        inside ^= c == '"'
        if c == "\n":
            line += 1
        if c == "\n" and not inside:
            out.append((start, fields, any_char))
            fields, start, any_char = 1, line, False
        else:
            fields += c == "," and not inside
            any_char = True
    if any_char:
        out.append((start, fields, True))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_quoted_records_over_many_splits(spark, tmp_path, seed):
    """Fields with delimiters, doubled quotes and many line ends, cut into splits anywhere."""
    rng, want = random.Random(seed), []
    for name in ("one.csv", "two.CSV", "three.csv"):
        rows = ["id,\"na\nme, of\",x"]
        for i in range(rng.choice([0, 200, 700])):
            field = "".join(rng.choice(["a", ",", "\n", '""', " ", "b" * 30, "\n" * 20]) for _ in range(rng.randrange(0, 9)))
            rows.append(f'{i},"{field}"' + ",z" * rng.choice([1, 1, 1, 0, 2]))
        text = "\n".join(rows) + "\n" * rng.randrange(2) + ('7,"open\n\n' if name == "three.csv" else "")
        put(tmp_path / "data", name, text)
        found = brute_records(text)
        want += [(name, start, fields) for start, fields, full in found if full]
        unclosed = text.count('"') % 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("6000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = checks.records(spark, str(tmp_path / "data")).where("NOT blank").collect()
            assert sorted((r.file.rsplit("/", 1)[1], r.line, r.counts[0] + 1) for r in got) == sorted(want)
            assert {r.text for r in got if r.line == 1} == {'id,"na\nme, of",x'}
            assert sum(r.open for r in got) == unclosed
            issues_ = issues(checks.check_delimited(spark, str(tmp_path / "data")))
            wrong = [(f, "error", "wrong number of fields", line, n) for f, line, n in want if line > 1 and n != 3]
            last = max(line for f, line, _ in want if f == "three.csv")
            assert sorted(x for x in issues_ if x[2].startswith("wrong")) == sorted(w for w in wrong if w[0] != "three.csv" or w[3] != last)
            assert [x[:4] for x in issues_ if x[2] == "quoted field is not closed"] == [("three.csv", "error", "quoted field is not closed", last)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_without_a_header(spark, tmp_path):
    put(tmp_path / "data", "blank.csv", "\na,b\n1\n")
    put(tmp_path / "data", "open.csv", 'a,"b\n1,2\n')
    put(tmp_path / "data", "other.dat", "1\n")
    assert sorted(issues(checks.check_delimited(spark, str(tmp_path / "data")))) == [
        ("blank.csv", "error", "has no header row", 1, None), ("open.csv", "error", "quoted field is not closed", 1, None), ("open.csv", "warning", "header only", None, None),
    ]


def test_checks_read_a_folder_twice(spark, tmp_path):
    put(tmp_path / "data", "f.csv", "a,b\n1\n")
    plan = checks.records(spark, str(tmp_path / "data"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2 and "SinglePartition" not in plan
    assert "FileScan text" not in checks.check_delimited(spark, str(tmp_path / "data"))._jdf.queryExecution().executedPlan().toString()


def test_line_numbers_over_several_splits(spark, tmp_path):
    put(tmp_path / "data", "f.csv", "".join(f"{i},{'x' * 50}\n" for i in range(1, 40_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = checks.numbered_lines(spark, str(tmp_path / "data"))
        assert lines.where(F.substring_index("value", ",", 1).cast("long") != F.col("line")).count() == 0
        assert lines.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folders(spark, tmp_path):
    assert issues(checks.check_folder(spark, str(tmp_path / "no")))[0][1:3] == ("error", "not found")
    put(tmp_path / "d", "a.csv", b"")
    assert {x[1:3] for x in issues(checks.check_folder(spark, str(tmp_path / "d")))} == {("error", "folder is empty"), ("warning", "file is empty")}
    put(tmp_path / "d", "b c+d.csv", "x")
    assert issues(checks.check_folder(spark, str(tmp_path / "d"))) == [("a.csv", "warning", "file is empty", None, None)]


def test_cdm_registry():
    assert len(S.CDM_TABLES) == 39 and sum(S.primary_key(t) is not None for t in S.CDM_TABLES) == 36
    assert [len(S.LAYOUTS[k]) for k in ("beneficiary", "inpatient", "outpatient", "carrier", "prescription")] == [33, 81, 76, 142, 8]
    assert S.LAYOUTS["carrier"][25] == "TAX_NUM_1" and S.LAYOUTS["carrier"][129] == "LINE_ICD9_DGNS_CD_1"
    assert S.foreign_keys("person")["location_id"] == ("location", "location_id")
    assert S.foreign_keys("concept_relationship")["concept_id_2"] == ("concept", "concept_id")
    assert "fact_id_1" not in S.foreign_keys("fact_relationship")
    assert not S.cdm_schema("person")["person_id"].nullable and S.cdm_schema("person")["provider_id"].nullable


def test_all_foreign_keys_of_a_table(spark):
    death = spark.createDataFrame([(1, 5, None), (2, 6, 9)], "person_id long, death_type_concept_id long, cause_concept_id long").withColumn("cause_source_concept_id", F.lit(5))
    person = spark.createDataFrame([(1,)], "person_id long")
    concept = spark.createDataFrame([(5,), (6,)], "concept_id long")
    got = quality.check_fk({"death": death, "person": person, "concept": concept}, "death", S.foreign_keys("death"))
    assert sorted((r["column"], r["value"], r["orphans"]) for r in got.collect()) == [("cause_concept_id", "9", 1), ("person_id", "2", 1)]


def test_every_page_has_one_plan(spark):
    """Ties included: the pages follow each other without a gap, and a page far in reads the folders it lies in."""
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 10).alias("x"), "id", F.create_map(F.lit("m"), F.col("id")).alias("m"))
    want = sorted((r.x, r.id) for r in df.collect())
    for order in (["x"], [F.col("x")]):
        pages = ordering.Pages(df, order)
        got = [[(r.x, r.id) for r in pages.page(n, 33).collect()] for n in range(1, 18)]
        assert [x for page in got for x in page] == want and got[16] == [] and all(len(p) == 33 for p in got[:15])
    near, far = (pages.page(n, 20)._jdf.queryExecution().executedPlan().toString() for n in (1, 24))
    assert "PartitionFilters: [" in far and "_range" in far.split("PartitionFilters: [")[1].split("]")[0]
    assert [line.split("(")[0].strip() for line in near.splitlines() if "Exchange" in line or "TakeOrdered" in line] == [line.split("(")[0].strip() for line in far.splitlines() if "Exchange" in line or "TakeOrdered" in line]
    assert [r["x"] for r in ordering.page(df.select("x"), ["x"], 0, 20).collect()] == [0] * 20
    assert ordering.page(df.where("x < 0"), ["x"], 1).count() == 0