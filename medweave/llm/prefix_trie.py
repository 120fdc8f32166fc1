"""Trie of conversation prefixes from sorted sequences, longest common prefixes and range minima.

A turn is a code of 16 bytes (of the SHA-256 of its role and text) and its number of words. Conversations are sorted
by their sequences of codes and dealt out by range, so one prefix's members lie side by side. A task takes one range,
with the row before it and the row behind it as neighbours, and computes the longest common prefix (LCP) of each row
with the one before. A sparse table holds the minima of all runs of 2^k LCPs; with it every candidate prefix, (row, depth)
where the prefix is new, binary-searches its left and its right extent by itself: as far as the LCPs stay at or above
its depth. Everything a node reports is a sum or count over its extent, so prefix sums give it without a walk:

* members: rows of the extent; children: rows whose LCP is the node's depth and that go on, plus the first;
* leaves: rows that the next row does not continue; saved tokens: words below the node, of all its rows less those of new prefixes.

A node that holds the first or last row of a range may go on in the next one. Such nodes, at most two sequences' depths
per range, carry the hash of their prefix, and their parts are added up by it; all others are complete where they are
found. A group of equal conversations of any size is parted by conv_id like all other rows; the hash over the ids that end at a node
within one range is taken there, and for the rest the ids go in order, in pieces, through one running SHA-256, which cannot be parted.

Turns are in order of turn (NULL first), then code. NULL roles and texts are empty; repeated rows are turns of
their own. Rows without a conv_id belong to no conversation. No conversations, no nodes. A conversation is held as
20 bytes a turn by one task, never its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table
from medweave.session import settle

CODE = 16
ENDS_PIECE = 1 << 16  # conv_ids in one row of a run that crosses a border
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, part int, piece int, ends binary"
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = ("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("int")


def code(role: Column, text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the role's length, the role and the text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, CODE)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of ``code`` and ``words`` in order."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), code(empty("role"), empty("text")).alias("code"), n_words(empty("text")).alias("words")).alias("t")
    )
    own = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words")))
    return each.groupBy("conv_id").agg(own.alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, mod: int = 4) -> DataFrame:
    """Each conversation behind the first turns of the one its ``every`` conversations share: crc32(conv_id) % ``mod`` of them."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(mod)).cast("int")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, mod - 1).alias("_head"))
    joined = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def dealt(convs: DataFrame) -> DataFrame:
    """``part``, ``key`` (all codes), ``words``, ``conv_id`` in ranges of the sorted keys, and each range's neighbours (``own`` false)."""
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["code"])), "")).alias("key"), F.col("turns")["words"].alias("words"))
    ranged = settle(flat.repartitionByRange(n, "key", "conv_id").withColumn("part", F.spark_partition_id()))
    place = F.struct("key", "conv_id", "words")
    edges = settle(ranged.groupBy("part").agg(F.min(place).alias("low"), F.max(place).alias("high")))
    full = sorted(r.part for r in edges.select("part").collect())  # numbers of ranges only
    rows = ranged.select("part", "key", "words", "conv_id", F.lit(True).alias("own"))
    for side, pairs in (("high", zip(full, full[1:], strict=False)), ("low", zip(full[1:], full, strict=False))):
        beside = convs.sparkSession.createDataFrame(list(pairs), "part int, to int").join(edges, "part")
        rows = rows.unionByName(beside.select(F.col("to").alias("part"), f"{side}.key", f"{side}.words", f"{side}.conv_id", F.lit(False).alias("own")))
    return rows.repartitionById(n, "part").sortWithinPartitions("part", "key", "conv_id")


class Range:
    """The nodes of one range of sorted sequences."""

    def __init__(self, part: int, codes: bytes, lengths, words, conv_ids, before: tuple | None, behind: tuple | None) -> None:
        """``before`` and ``behind``: the key of the neighbouring row, None at the ends of all rows."""
        import numpy as np

        self.part, self.codes, self.length, self.conv_ids = part, codes, lengths, conv_ids
        n = len(lengths)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        halves = np.frombuffer(codes, "<u8").reshape(-1, 2)
        row = np.repeat(np.arange(n), lengths)
        depth = np.arange(len(row)) - self.start[row]
        prior = np.maximum(row - 1, 0)
        comparable = (row > 0) & (depth < lengths[prior])
        same = comparable & (halves[np.where(comparable, self.start[prior] + depth, 0)] == halves).all(axis=1)
        self.lcp = lengths.copy()
        first = np.unique(row[~same], return_index=True)
        self.lcp[first[0]] = depth[~same][first[1]]
        key = lambda i: codes[self.start[i] * CODE : self.start[i + 1] * CODE]
        self.key = key
        #: LCP with the row before the range and the one behind it; -1 where there is none.
        self.lcp[0] = -1 if before is None else common(before[0], key(0))
        after = np.concatenate([self.lcp[1:], [-1 if behind is None else common(key(n - 1), behind[0])]])
        self.leaves = np.concatenate([[0], np.cumsum(after < lengths)])
        self.upto = np.concatenate([[0], np.cumsum(words)])  # words of turns before a place of the flat sequence
        shared = self.upto[self.start[:-1] + np.maximum(self.lcp, 0)] - self.upto[self.start[:-1]]
        self.shared = np.concatenate([[0], np.cumsum(shared)])
        goes_on = np.flatnonzero((self.lcp < lengths) & (np.arange(n) > 0))
        self.branches = np.sort(self.lcp[goes_on] * n + goes_on)  # rows that branch off at a depth, by depth and row
        self.minima = [self.lcp]
        while 2 << (len(self.minima) - 1) <= n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def extents(self, row, depth):
        """First and last row of the range that share ``depth`` turns with ``row``, for many candidates at a time."""
        left, right = row.copy(), row.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            table, width = self.minima[k], 1 << k
            fits = right + width < len(self.lcp)
            fits[fits] = table[right[fits] + 1] >= depth[fits]
            right[fits] += width
            fits = left - width >= 0
            fits[fits] = table[left[fits] - width + 1] >= depth[fits]
            left[fits] -= width
        return left, right

    def nodes(self):
        """Columns of all nodes that have a row here, in the order of NODE."""
        import numpy as np

        n, length = len(self.length), self.length
        fresh = np.maximum(self.lcp, 0)
        fresh[0] = -1  # the first row brings all its prefixes, the root included
        count = length - fresh
        row = np.repeat(np.arange(n), count)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + fresh[row] + 1
        left, right = self.extents(row, depth)
        members = right - left + 1
        continues = (left == 0) & (self.lcp[0] >= depth)  # known from the range before
        at = self.start[left]
        above = np.where(depth > 0, self.upto[at + np.maximum(depth - 1, 0)] - self.upto[at], 0)
        saved = self.shared[right + 1] - self.shared[left + 1] - (members - 1) * above
        saved += np.where(continues, self.shared[left + 1] - self.shared[left] - above, 0)
        own_child = (length[left] > depth) & ~((left == 0) & (self.lcp[0] > depth))
        children = np.searchsorted(self.branches, depth * n + right, side="right") - np.searchsorted(self.branches, depth * n + left, side="right") + own_child
        leaves = self.leaves[right + 1] - self.leaves[left]
        small = sparse_minima(self.conv_ids)
        level = np.frexp(members.astype(np.float64))[1] - 1
        smallest, parent = np.empty(len(row), np.int64), np.full(len(row), -1)
        for k in np.unique(level):
            m = level == k
            smallest[m] = np.minimum(small[k][left[m]], small[k][right[m] - (1 << int(k)) + 1])
        border = (left == 0) | (right == n - 1)
        # A node's parent is the candidate above it on its row's path, or the one that holds the LCP if it is the row's first.
        up_left, up_right = self.extents(row, np.maximum(depth - 1, 0))
        up_border = (depth > 0) & ((up_left == 0) | (up_right == n - 1))
        level = np.frexp((up_right - up_left + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = level == k
            parent[m] = np.minimum(small[k][up_left[m]], small[k][up_right[m] - (1 << int(k)) + 1])
        # Of the rows below a node only the first can have just its turns, and then its copies follow.
        ends_here = length[left] == depth
        last_copy = np.where(ends_here, self.copies_end(left), left - 1)
        return row, depth, left, members, children, leaves, saved, smallest, parent, border, up_border, last_copy

    def copies_end(self, row):
        """The last row that equals each of ``row``."""
        import numpy as np

        new = np.flatnonzero(np.concatenate([self.lcp[1:] != self.length[1:], [True]]) | np.concatenate([self.length[1:] != self.length[:-1], [True]]))
        return new[np.searchsorted(new, row)]

    def batches(self) -> Iterator:
        import numpy as np
        import pyarrow as pa

        row, depth, left, members, children, leaves, saved, smallest, parent, border, up_border, last_copy = self.nodes()
        names = [c.split()[0] for c in NODE.split(", ")]
        types = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(name, types[c.split()[1]]) for name, c in zip(names, NODE.split(", "), strict=True)])
        known: dict[tuple, bytes] = {}

        def prefix(i: int, d: int) -> bytes:
            """The hash of a border prefix, found once per first row and depth; a sequence's prefixes are hashed in one go."""
            if (i, d) not in known:
                running = hashlib.sha256()
                known[i, 0] = running.digest()
                for e, at in enumerate(range(int(self.start[i]), int(self.start[i + 1])), 1):
                    running.update(self.codes[at * CODE : (at + 1) * CODE])
                    known[i, e] = running.copy().digest()
            return known[i, d]

        for at in range(0, len(row), 1 << 16):
            part = slice(at, at + (1 << 16))
            own_border, own_up, i, d = border[part], up_border[part], row[part].tolist(), depth[part].tolist()
            ends, pieces = [], []
            for k, (first, last, b) in enumerate(zip(left[part].tolist(), last_copy[part].tolist(), own_border.tolist(), strict=True)):
                if not b:
                    ends.append(hashlib.sha256(",".join(map(str, self.conv_ids[first : last + 1].tolist())).encode()).hexdigest() if last >= first else NO_ENDS)
                    continue
                ends.append(None)
                pieces += [(k, p, self.conv_ids[q : min(last + 1, q + ENDS_PIECE)].astype("<i8").tobytes()) for p, q in enumerate(range(first, last + 1, ENDS_PIECE))]
            nodes = [prefix(a, b) if own else None for a, b, own in zip(i, d, own_border.tolist(), strict=True)]
            parents = [prefix(a, b - 1) if own else None for a, b, own in zip(i, d, own_up.tolist(), strict=True)]
            up = pa.array(parent[part], mask=own_up | (depth[part] == 0))
            size = len(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(depth[part]), pa.array(smallest[part]), up, *[pa.array(c[part].astype(np.int64)) for c in (members, children, leaves, saved)],
                pa.array(ends, pa.string()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), pa.array(np.full(size, self.part, np.int32)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()),
            ], schema=schema)
            for k, p, ids in pieces:
                yield pa.RecordBatch.from_pylist([{"node": nodes[k], "part": self.part, "piece": p, "ends": ids}], schema=schema)


def common(a: bytes, b: bytes) -> int:
    """Codes that two keys begin with."""
    import numpy as np

    n = min(len(a), len(b)) // CODE
    differ = np.flatnonzero((np.frombuffer(a, "<u8", 2 * n) != np.frombuffer(b, "<u8", 2 * n)).reshape(n, 2).any(axis=1))
    return int(differ[0]) if len(differ) else n


def sparse_minima(values) -> list:
    import numpy as np

    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def ranges(batches: Iterator) -> Iterator:
    import numpy as np

    def done(part, kept):
        own = [k for k in kept if k[3]]
        at = next(i for i, k in enumerate(kept) if k[3])
        before, behind = (kept[at - 1] if at else None), (kept[at + len(own)] if at + len(own) < len(kept) else None)
        lengths = np.fromiter((len(k[0]) // CODE for k in own), np.int64, len(own))
        words = np.concatenate([np.zeros(0, np.int64), *[np.asarray(k[1], np.int64) for k in own]])
        return Range(part, b"".join(k[0] for k in own), lengths, words, np.fromiter((k[2] for k in own), np.int64, len(own)), before, behind).batches()

    part, kept = None, []
    for batch in batches:
        words = batch.column("words")
        for k, (p, key, conv_id, own) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("part", "key", "conv_id", "own")], strict=True)):
            if p != part and kept:
                yield from done(part, kept)
                kept = []
            part = p
            kept.append((key, words[k].values.to_numpy(), conv_id, own))
    if kept:
        yield from done(part, kept)


def ends_hash(batches: Iterator) -> Iterator:
    """``node`` and the hash over its ids, from pieces in order of node, range and piece."""
    import numpy as np
    import pyarrow as pa

    node, running = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
            if own != node:
                if running is not None:
                    yield out()
                node, running, comma = own, hashlib.sha256(), ""
            running.update((comma + ",".join(map(str, np.frombuffer(ids.as_py(), "<i8").tolist()))).encode())
            comma = ","
    if running is not None:
        yield out()


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the prefixes of ``convs`` (conv_id, turns): the columns of RESULT."""
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(dealt(convs).mapInArrow(ranges, NODE))
    whole = found.where("depth IS NOT NULL")
    pieces = found.where("depth IS NULL").select("node", "part", "piece", "ends")
    ends = pieces.repartition(n, "node").sortWithinPartitions("node", "part", "piece").mapInArrow(ends_hash, "node binary, ends_sha256 string")
    sums = whole.where("node IS NOT NULL").groupBy("node").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS], F.first("parent").alias("parent")
    )
    border = settle(sums.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    inner = whole.where("node IS NULL")
    below = inner.where("parent IS NOT NULL").drop("parent_conv_id").unionByName(border, allowMissingColumns=True)
    up = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    root = border.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    under = below.where("parent IS NOT NULL").join(up, "parent")
    return inner.where("parent IS NULL").select(*RESULT).unionByName(under.select(*RESULT)).unionByName(root.select(*RESULT))


SQL = r"""
WITH turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, turn
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list({'code': code, 'words': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, code) AS turns FROM turn GROUP BY conv_id
), number AS (SELECT CAST(range AS BIGINT) AS i FROM range(256)
), step AS (
  -- the CRC-32 table: eight shifts of each byte
  SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS v FROM number
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM step
), chosen AS (
  SELECT conv_id, turns, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(t[1 + (xor(c, b) % 256)], c // 256)), CAST(4294967295 AS BIGINT)) % 4 AS INTEGER) AS h
  FROM conv, crc_table
), whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM chosen c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefix AS (
  SELECT conv_id, d AS depth, len(turns) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE turns[d].words END AS words,
    md5(array_to_string(list_transform(turns[1:d], lambda x: x.code), ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.code), ',')) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole)
), node AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefix GROUP BY node
), child AS (SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent
), above AS (SELECT DISTINCT a.node AS top, b.node AS below FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), summed AS (
  SELECT top, CAST(sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM above JOIN node ON node.node = below LEFT JOIN child c ON c.parent = below GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN summed ON top = n.node LEFT JOIN node p ON p.node = n.parent LEFT JOIN child c ON c.parent = n.node
"""


@query("op12_prefix_trie", SQL)
def op12(spark, folder):
    return trie(rebuilt(sequences(table(spark, folder, "conversations"))))
