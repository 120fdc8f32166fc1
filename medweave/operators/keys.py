"""Key and NOT NULL rules of many tables as one report.

Every table is scanned once: its key, its references and its missing values are turned from columns into rows
(space, key, slot). A space is a table whose key a value belongs to with up to ``SLOTS`` of the references to it, or as many NOT NULL
columns; a table with more references has several spaces, and its key is in each. One grouping by (space, key) counts the
rows per slot, slot 0 being the key itself, with a map-side combine, so a value in every row (concept 0) is one row per task, and
one row per value goes through the shuffle, whatever refers to it. It shows whether the table holds the value;
only values that break a rule go on and are unfolded into their rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from medweave.session import pieces

PRIMARY, FOREIGN, NOT_NULL = "primary key", "foreign key", "not null"
REPORT = "table string, rule string, columns string, parent string, rows long, keys long"
SLOTS = 8  # references that are counted side by side; each is a number in every row of the grouping


@dataclass
class TableRules:
    """What must hold for one table: its key, its references (column -> (parent table, parent's key)), columns without NULL."""

    key: list[str] | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


def _text(columns: list[str]) -> Column:
    """Key columns as one text, each behind its length, so that no two keys read alike; NULL if any part is."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    if len(parts) == 1:
        return parts[0]
    return F.concat(*[x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)])


def _numbered(rules: dict[str, TableRules], present: set[str]) -> list[tuple[str, str, list[str], str | None]]:
    """(table, kind, columns, parent) of every rule that can be checked, in order; its place is its number."""
    out: list[tuple[str, str, list[str], str | None]] = []
    for table, own in rules.items():
        if table not in present:
            continue
        if own.key:
            out.append((table, PRIMARY, own.key, None))
        for column, (parent, key) in own.references.items():
            # A reference to something else than the parent's one-column key has no space to be looked up in.
            if parent in present and rules.get(parent, TableRules()).key == [key]:
                out.append((table, FOREIGN, [column], parent))
        out += [(table, NOT_NULL, [c], None) for c in own.required]
    return out


def _spaces(numbered: list[tuple[str, str, list[str], str | None]]) -> list[tuple[int | None, list[int], bool]]:
    """(rule of the key, rules by slot, whether it is its key's first space) of every space; those of NOT NULL columns have no key."""
    keys = {table: i for i, (table, kind, _, _) in enumerate(numbered) if kind == PRIMARY}
    slots: dict[str | None, list[int]] = {table: [] for table in keys}
    for i, (_, kind, _, parent) in enumerate(numbered):
        if kind != PRIMARY:
            slots.setdefault(parent, []).append(i)  # NOT NULL columns have no parent
    return [(keys.get(t), own[at : at + SLOTS], at == 0) for t, own in slots.items() for at in range(0, max(len(own), 1), SLOTS)]


def _entries(df: DataFrame, entries: list[tuple[int, tuple[str, str, list[str], str | None], bool]]) -> DataFrame:
    """``entry, key`` of one table: one row per key (in each of its spaces) and non-NULL reference, and one per missing value (with an empty key)."""
    present, items, primary = set(df.columns), {}, []
    for entry, (_, kind, columns, _), first in entries:
        if kind == NOT_NULL:
            missing = F.col(f"`{columns[0]}`").isNull() if columns[0] in present else F.lit(True)
            items[str(entry)] = F.when(missing, F.lit(""))
        elif all(c in present for c in columns):
            items[str(entry)] = _text(columns)
            primary += [entry] if kind == PRIMARY and first else []
    if not items:
        return df.select(F.lit(0).alias("entry"), F.lit("").alias("key")).where("false")
    turned = df.select(*[item.alias(entry) for entry, item in items.items()]).unpivot([], list(items), "entry", "key")
    # A key with a NULL part belongs to no value: it is counted by its rule alone.
    return turned.select(F.col("entry").cast("int").alias("entry"), "key").where(F.col("key").isNotNull() | F.col("entry").isin(primary))


def key_report(tables: dict[str, DataFrame], rules: dict[str, TableRules]) -> DataFrame:
    """One row per rule whose tables are given: the ``rows`` that break it and the distinct ``keys`` among them (0 for NOT NULL).

    A primary key is broken by all rows of a repeated key and by rows with a NULL part, a reference by rows whose value
    the parent's key lacks; NULL references break nothing. Columns a frame lacks count as NULL.
    """
    spark = next(iter(tables.values())).sparkSession
    found = _numbered(rules, set(tables))
    spaces, width = _spaces(found), SLOTS + 1
    by_table: dict[str, list[tuple[int, tuple[str, str, list[str], str | None], bool]]] = {t: [] for t, *_ in found}
    rule_of = [-1] * (len(spaces) * width)
    for space, (key, slots, first) in enumerate(spaces):
        for slot, rule in enumerate([key, *slots]):
            if rule is not None:
                rule_of[space * width + slot] = rule
                by_table[found[rule][0]].append((space * width + slot, found[rule], first))
    entries = reduce(DataFrame.unionByName, [_entries(tables[t], own) for t, own in by_table.items()])
    placed = entries.select((F.col("entry") / width).cast("int").alias("space"), "key", (F.col("entry") % width).alias("slot"))
    names = [str(slot) for slot in range(width)]
    counted = placed.groupBy("space", "key").agg(*[F.count(F.when(F.col("slot") == int(n), 1)).alias(n) for n in names])

    # A value the table holds breaks its key by coming again, said by the first space; one it lacks breaks all that have it.
    holders, is_first = F.col("0"), F.col("space").isin([i for i, (_, _, first) in enumerate(spaces) if first])
    broken = counted.where((holders == 0) | (is_first & (F.col("key").isNull() | (holders > 1))))
    held = F.col("0") > 0
    alone = broken.select("space", "key", *[F.col(n) if n == "0" else F.when(held, 0).otherwise(F.col(n)).alias(n) for n in names])
    turned = alone.repartition(pieces(spark), "space", "key").drop("key").unpivot(["space"], names, "slot", "n").where(F.col("n") > 0)
    each = turned.select(F.array(*map(F.lit, rule_of))[F.col("space") * width + F.col("slot").cast("int")].alias("rule"), "n")
    is_required = F.col("rule").isin([i for i, r in enumerate(found) if r[1] == NOT_NULL])
    summed = each.groupBy("rule").agg(F.sum("n").alias("rows"), F.sum(F.when(is_required, 0).otherwise(1)).alias("keys"))

    listed = spark.createDataFrame([(i, t, kind, ",".join(c), p) for i, (t, kind, c, p) in enumerate(found)], "rule int, table string, kind string, columns string, parent string")
    none = F.lit(0).cast("long")
    return listed.join(summed, "rule", "left").select(
        "table", F.col("kind").alias("rule"), "columns", "parent", F.coalesce("rows", none).alias("rows"), F.coalesce("keys", none).alias("keys")
    )
