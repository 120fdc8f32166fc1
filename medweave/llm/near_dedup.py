"""Near duplicates by min-max hashing of word shingles.

A text's set holds its distinct shingles of ``width`` words (lower-cased A-Z, parted at ASCII white space); fewer
words are one shingle, no words are the empty set, which is linked with nothing. Under each permutation of the
shingles both the least and the greatest value go into the signature, so that 32 permutations give 64 values.
Bands of three values propose pairs (a pair of similarity 0.8 shares none of the 21 bands once in three million
times); a pair counts only when the whole sets confirm it.

Equal sets are one class before anything is paired. Every class is first compared with the least one
it shares a bucket with, then, as long as it lies outside its bucket's largest component, with one class of that in
each turn; a large group of near copies so costs a few comparisons per class, not one per pair. All pairs that share a band and lie in different
components are compared in the end, whatever a bucket's size,
but for those whose counts of rare shingles, or whose sets' parities, show that they cannot be similar enough: a parity
is one bit per group of shingles, whether a set holds an odd number of the group, and each bit in which two sets differ
is a shingle that only one of them holds.

A NULL text is empty. A row without a doc_id is linked with nothing and stays. Rows that repeat a doc_id and a text
are one document; two texts under one doc_id are looked at each for itself, and the document goes if one of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table
from medweave.session import settle

PERMUTATIONS, ROWS = 32, 3
PIVOT_TURNS = 1  # comparisons with a pivot per bucket before all pairs between components
BANDS = 2 * PERMUTATIONS // ROWS
WORDS_KEPT = 200_000  # word hashes a Python worker remembers before it starts again
BATCH_WORDS = 1 << 19  # words that are hashed at a time
PARITIES = [f"p{k}" for k in range(8)]  # columns of 64 bits: sets that differ in a few hundred shingles are told apart by them
SKETCH = "doc_id long, n_shingles long, high long, low long, bands array<long>"


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x):
    """A one-to-one scramble of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int):
    import numpy as np

    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingles(text: bytes | None, width: int, words: WordHashes):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np

    split = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    hashes = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    size, factors = min(width, len(split)), odd_numbers(7, width)
    if not size:
        return hashes
    total = np.full(len(split) - size + 1, size, np.uint64)
    for k in range(size):
        total += hashes[k : len(split) - size + 1 + k] * factors[k]
    return np.unique(mixed(total))


def signatures(sets: list):
    """Least and greatest value of each non-empty set under each permutation: one row per value, one column per set."""
    import numpy as np

    flat, begins = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    for k, factor in enumerate(odd_numbers(11, PERMUTATIONS)):
        value = flat * factor
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xD6E8FEB86659FD93)
        out[k] = np.minimum.reduceat(value, begins)
        out[PERMUTATIONS + k] = np.maximum.reduceat(value, begins)
    return out


def band_keys(signature):
    """One 64-bit key per band and set."""
    import numpy as np

    a, b, c = odd_numbers(13, ROWS)
    keys = [mixed(mixed(signature[3 * k] * a + np.uint64(k)) + signature[3 * k + 1] * b) + signature[3 * k + 2] * c for k in range(BANDS)]
    return mixed(np.array(keys))


def batches_of(batches: Iterator, width: int) -> Iterator:
    """(doc_ids, sets) of some rows at a time."""
    import pyarrow as pa

    words, ids, sets, size = WordHashes(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            ids.append(doc_id)
            sets.append(shingles(text.as_py(), width, words))
            size += len(sets[-1])
            if size >= BATCH_WORDS:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row the size of its set, a 128-bit fingerprint of it and its band keys (none for the empty set)."""

    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for ids, sets in batches_of(batches, width):
            full = [s for s in sets if len(s)]
            keys = band_keys(signatures(full)).T.astype(np.uint64).view(np.int64) if full else np.empty((0, BANDS), np.int64)
            ends = np.cumsum([0] + [BANDS * bool(len(s)) for s in sets]).astype(np.int32)
            print_of = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(print_of[:, 0].copy()), pa.array(print_of[:, 1].copy()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(keys).reshape(-1))),
            ], ["doc_id", "n_shingles", "high", "low", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, SKETCH)


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for ids, sets in batches_of(batches, width):
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "rep long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable, of all nodes of ``edges`` (a, b)."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_to"))
        ahead = lower.select(F.col("node").alias("_at"), F.col("_to").alias("_ahead"))
        jumped = lower.join(ahead, lower["_to"] == ahead["_at"], "left")
        labels = settle(jumped.select("node", F.least("_to", "_ahead").alias("label"), (F.least("_to", "_ahead") != F.col("_old")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. The wide rows meet ``a``, which may be one pivot of many, where AQE splits them."""
    other, pivot = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_y")), sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_x"))
    small, large = F.least(F.size("_x"), F.size("_y")), F.greatest(F.size("_x"), F.size("_y"))
    both = pairs.join(other, "b").join(pivot, "a").where(100 * small >= percent * large)
    shared = both.select("a", "b", (F.size("_x") + F.size("_y")).alias("_sum"), F.size(F.array_intersect("_x", "_y")).alias("_both"))
    return shared.where(100 * F.col("_both") >= percent * (F.col("_sum") - F.col("_both"))).select("a", "b")


def with_labels(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key``, ``rep``, ``label`` of the buckets that more than one component shares."""
    if labels is not None:
        buckets = buckets.join(labels, buckets["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    open_keys = buckets.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    return buckets.join(open_keys, "key", "left_semi").select("key", "rep", "label")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def mains(opened: DataFrame) -> DataFrame:
    """Per bucket the component that most of its classes are in."""
    sizes = opened.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy("key").agg(F.max_by("label", "_n").alias("_main"))


def to_least(buckets: DataFrame) -> DataFrame:
    """Each class with the least class it shares a bucket with."""
    least = buckets.groupBy("key").agg(F.min("rep").alias("_pivot"))
    return buckets.join(least, "key").groupBy("rep").agg(F.min("_pivot").alias("a")).where("a < rep").select("a", F.col("rep").alias("b"))


def to_pivots(opened: DataFrame, turn: int) -> DataFrame:
    """Classes outside their bucket's largest component with one class of it, another one in each turn."""
    split = opened.join(mains(opened), "key")
    inside = split.where("label = _main").groupBy("key").agg(F.min(F.xxhash64(F.lit(turn), "rep")).alias("_rank"))
    pivots = opened.withColumn("_rank", F.xxhash64(F.lit(turn), "rep")).join(inside, ["key", "_rank"]).select("key", F.col("rep").alias("_pivot"))
    return split.where("label != _main").join(pivots, "key").select(*ordered("rep", "_pivot")).distinct()


def shared_by_few(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups of up to three classes (``a``, ``c``, ``b``; fewer repeat a member) and how many shingles only they hold, among the classes of ``opened``."""
    held = sets.join(opened.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("shingles").alias("shingle"))
    holders = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor("rep").alias("_x"))
    third = F.when(F.col("_n") == 3, F.col("_x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))).otherwise(F.col("a"))
    return holders.where("_n <= 3").groupBy("a", third.alias("c"), "b").agg(F.count(F.lit(1)).alias("shared"))


def parities(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Per class of ``opened`` 64 bits in each column of ``PARITIES``, the parity of how many of its shingles fall on the bit."""
    held = sets.join(opened.select("rep").distinct(), "rep", "left_semi").select("rep", F.explode("shingles").alias("s"))
    held = held.select("rep", F.pmod("s", F.lit(len(PARITIES))).alias("_at"), F.expr("shiftleft(1L, CAST((s >> 8) & 63 AS INT))").alias("_bit"))
    return held.groupBy("rep").agg(*[F.bit_xor(F.when(F.col("_at") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(PARITIES)])


def class_sizes(opened: DataFrame, sets: DataFrame, few: DataFrame) -> DataFrame:
    """Per class ``rep`` its component ``label``, ``size`` of its set, ``common``, the shingles that more than three classes hold, and its ``PARITIES``.

    A doc_id with two sets has no parities (NULL).
    """
    rare = few.select(F.explode(F.array_distinct(F.array("a", "c", "b"))).alias("rep"), "shared").groupBy("rep").agg(F.sum("shared").alias("_rare"))
    # a doc_id with two texts has two sets, whose rare shingles are counted together: bounds that hold for both
    sizes = sets.select("rep", F.size("shingles").cast("long").alias("_n")).groupBy("rep").agg(F.min("_n").alias("size"), F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_sets"))
    own = opened.select("rep", "label").distinct().join(sizes, "rep").join(rare, "rep", "left").join(parities(opened, sets), "rep", "left")
    common = F.when(F.col("_sets") == 1, F.col("size") - F.coalesce("_rare", F.lit(0))).otherwise(F.col("_most"))
    return own.select("rep", "label", "size", common.alias("common"), *[F.when(F.col("_sets") == 1, F.col(c)).alias(c) for c in PARITIES])


def may_link(x: str, y: str, percent: int, shared: Column) -> Column:
    """Whether two classes of different components can be similar enough, if they have ``shared`` rare shingles in common."""
    most = F.least(f"{x}.common", f"{y}.common") + shared
    return (F.col(f"{x}.label") != F.col(f"{y}.label")) & (100 * most >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size") - most))


def may_equal(x: str, y: str, percent: int) -> Column:
    """Whether two classes can be similar enough by their parities: sets of ``n`` shingles together may differ in ``n * (100 - percent) / (100 + percent)``."""
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITIES), F.lit(0))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size")), F.lit(True))


def across(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket in different components that can be similar enough.

    A shingle that at most three open classes hold is rare. Two classes share at most the smaller one's common shingles
    and the rare ones they hold both; pairs with rare ones in common are listed by those, all others meet in their
    buckets, where that bound and their parities let only few of them through.
    """
    few = settle(shared_by_few(opened, sets))
    sizes = settle(class_sizes(opened, sets, few))
    listed = few.select(F.explode(F.array_distinct(F.array(*[F.struct(*ordered(p, q)) for p, q in (("a", "c"), ("c", "b"), ("a", "b"))]))).alias("p"), "shared")
    listed = listed.where("p.a < p.b").groupBy("p.a", "p.b").agg(F.sum("shared").alias("shared"))
    of_rare = listed.join(sizes.alias("x"), F.col("a") == F.col("x.rep")).join(sizes.alias("y"), F.col("b") == F.col("y.rep"))
    of_rare = of_rare.where(may_link("x", "y", percent, F.col("shared"))).select("a", "b")
    marked = settle(opened.select("key", "rep").join(sizes, "rep"))
    outside = marked.join(mains(opened), "key").where(F.col("label") != F.col("_main")).drop("_main")
    x, y = marked.alias("x"), outside.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & may_link("x", "y", percent, F.lit(0)) & may_equal("x", "y", percent))
    return met.select(*ordered("x.rep", "y.rep")).unionByName(of_rare).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (the least doc_id reachable) and ``kept`` (doc_id is component_id)."""
    rows = settle(sketches(docs, width))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = settle(rows.where(linked).groupBy("high", "low").agg(F.min("doc_id").alias("rep")))
    named = rows.join(classes.select("high", "low", "rep"), ["high", "low"]).where(linked)
    banded = settle(named.where("doc_id = rep").select("rep", F.explode("bands").alias("key")))
    buckets = settle(with_labels(banded.select("key", "rep", F.col("rep").alias("label")), None).select("key", "rep"))
    wanted = buckets.select("rep").distinct()
    sets = settle(whole_sets(docs.select("doc_id", "text").join(wanted, docs["doc_id"].cast("long") == wanted["rep"], "left_semi"), width).where(F.size("shingles") > 0).distinct())

    edges = labels = tested = None
    for turn in range(PIVOT_TURNS + 2):
        opened = settle(with_labels(buckets, labels)) if turn else buckets
        pairs = to_least(opened) if turn == 0 else to_pivots(opened, turn) if turn <= PIVOT_TURNS else across(opened, sets, percent)
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if turn:
                continue
            break
        found = settle(confirmed(pairs, sets, percent).distinct())
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, label long")
    own = rows.join(classes.withColumnRenamed("rep", "_rep"), ["high", "low"], "left")
    found = own.join(labels, own["_rep"] == labels["node"], "left")
    component = F.when(linked, F.coalesce("label", "_rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id of their component stands for."""
    lost = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_lost"], "left_anti")


@query("op5_near_dedup")
def op5(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), width=4)
