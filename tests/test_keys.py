"""The key report against plain Python, and the plan it runs with."""

import random
import re
from collections import Counter

from medweave import schemas as S
from medweave.operators.keys import FOREIGN, NOT_NULL, PRIMARY, SLOTS, TableRules, key_report
from medweave.session import pieces


def brute(data, rules):
    out = []
    for table, own in rules.items():
        if table not in data:
            continue
        rows = data[table]
        if own.key:
            seen = Counter(tuple(r[c] for c in own.key) for r in rows)
            missing = sum(n for k, n in seen.items() if None in k)
            bad = {k: n for k, n in seen.items() if n > 1 and None not in k}
            out.append((table, PRIMARY, ",".join(own.key), None, sum(bad.values()) + missing, len(bad) + (missing > 0)))
        for column, (parent, key) in own.references.items():
            if parent in data and rules[parent].key == [key]:
                held = {str(r[key]) for r in data[parent] if r[key] is not None}
                lost = Counter(r[column] for r in rows if r[column] is not None and str(r[column]) not in held)
                out.append((table, FOREIGN, column, parent, sum(lost.values()), len(lost)))
        out += [(table, NOT_NULL, c, None, sum(r.get(c) is None for r in rows), 0) for c in own.required]
    return sorted(out, key=repr)


def test_report(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, *range(12)])
    data = {
        "place": [{"id": k, "name": rng.choice(["a", None])} for k in (1, 2, 2, 3, None, None, 5)],
        "pair": [{"x": rng.choice(["1", "11", None]), "y": rng.choice(["1", "11", "1:1"])} for _ in range(40)],
        # a third of all rows with one value, held or not
        "fact": [{"id": i, "a": pick() if i % 3 else 1, "b": pick() if i % 3 else 99, "self": rng.choice([i, None, -i])} for i in range(300)],
    }
    rules = {
        "place": TableRules(["id"], {}, ["id", "name"]), "pair": TableRules(["x", "y"], {"x": ("absent", "id")}),
        "fact": TableRules(["id"], {"a": ("place", "id"), "b": ("place", "id"), "self": ("fact", "id"), "id": ("pair", "x")}, ["a", "unknown"]),
        "absent": TableRules(["id"]),
    }
    types = {"place": "id long, name string", "pair": "x string, y string", "fact": "id long, a int, b long, self long"}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], types[t]) for t, rows in data.items()}
    report = key_report(frames, rules)
    assert sorted(map(tuple, report.collect()), key=repr) == brute(data, rules)
    empty = {t: df.where("false") for t, df in frames.items()}
    assert all(r.rows == r["keys"] == 0 for r in key_report(empty, rules).collect())


def test_plan_reads_each_table_once(spark, tmp_path):
    frames = {}
    for table in ("person", "location", "visit_occurrence", "death"):
        spark.createDataFrame([], S.cdm_schema(table)).write.parquet(f"{tmp_path}/{table}")
        frames[table] = spark.read.parquet(f"{tmp_path}/{table}")
    plan = key_report(frames, S.cdm_rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("Exchange hashpartitioning(space") == 2
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_all_rules_are_there():
    rules = S.cdm_rules()
    assert sum(bool(r.key) for r in rules.values()) == 36 and sum(len(r.references) for r in rules.values()) == 134


def test_nothing_is_gathered_per_value(spark):
    """Lists per value made the aggregation sort and spill; the rows of a value are now sorted once, in pieces that are not merged."""
    frames = {t: spark.createDataFrame([], S.cdm_schema(t)) for t in ("person", "location", "death")}
    plan = key_report(frames, S.cdm_rules())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("ObjectHashAggregate|SortAggregate|collect_list|lambda", plan)
    assert re.search(rf"Exchange hashpartitioning\(space[^\n]* {pieces(spark)}\), REPARTITION_BY_NUM", plan)


def test_numbers_and_blanks(spark):
    """Numbers are keys by how they read; an empty text is a value like others, in keys and in references."""
    rows = {"one": [("",), ("",), ("7",), (None,)], "two": [(7, "", None), (8, "x", None), (8, None, "x")]}
    frames = {"one": spark.createDataFrame(rows["one"], "id string"), "two": spark.createDataFrame(rows["two"], "n long, s string, q string")}
    rules = {"one": TableRules(["id"], {}, ["id"]), "two": TableRules(["n", "s"], {"n": ("one", "id"), "s": ("one", "id")}, ["s", "q", "none"])}
    data = {"one": [dict(id=r[0]) for r in rows["one"]], "two": [dict(zip("nsq", r)) for r in rows["two"]]}
    assert sorted(map(tuple, key_report(frames, rules).collect()), key=repr) == brute(data, rules)


def test_more_references_than_one_space_counts(spark):
    """A table with many references has several spaces; its key breaks once, and every reference is held against it."""
    rng, names = random.Random(9), [f"r{k}" for k in range(2 * SLOTS + 3)]
    data = {
        "place": [{"id": k} for k in (1, 2, 2, 2, 3, None, None, 5)],
        "fact": [{"id": i, **{n: rng.choice([None, 2, 2, *range(8)]) for n in names}} for i in range(60)],
    }
    rules = {"place": TableRules(["id"], {}, ["id"]), "fact": TableRules(["id"], {n: ("place", "id") for n in names}, [*names, "id"])}
    frames = {"place": spark.createDataFrame([(r["id"],) for r in data["place"]], "id long")}
    frames["fact"] = spark.createDataFrame([tuple(r.values()) for r in data["fact"]], "id long, " + ", ".join(f"{n} long" for n in names))
    assert sorted(map(tuple, key_report(frames, rules).collect()), key=repr) == brute(data, rules)


def test_values_are_shuffled_once(spark):
    """Each value went through two shuffles, once per rule it has; now through one as one row, and only what breaks a rule goes on."""
    frames = {t: spark.createDataFrame([], S.cdm_schema(t)) for t in ("person", "location", "death")}
    plan = key_report(frames, S.cdm_rules())._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window|hashpartitioning\(space[^\n]*rule", plan)
    again = plan.index("REPARTITION_BY_NUM")
    assert re.search(r"Filter [^\n]*0#\S* [^\n]*= 0", plan[again:])
