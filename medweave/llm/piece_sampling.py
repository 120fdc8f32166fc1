"""Sampled segmentations of whole texts into the pieces of a SentencePiece model, and lossless decoding.

A segmentation is drawn with probability proportional to exp(weight * sum of piece scores): forward filtering sums
over all paths of the piece lattice, backward sampling draws the last piece, then the one before, to the start.
The model's pieces hold their space marks in front only (others are an error), so that the lattice of a text falls
into those of its words with the spaces before them; a word's filtered lattice is kept by its worker in a table of bounded
size. New words are filtered forward together, position by position, whatever their lengths; substrings are looked up by 64-bit rolling
hashes in a sorted table of the pieces, and only those that are pieces are gone on with. A draw starts at its node's first edge. Random numbers are a hash of the seed, the row key, the word's place and the step: a row's
segmentation does not depend on partitions, batches or repeated runs. Characters the model lacks become UTF-8 bytes, and so
does a literal space mark (U+2581), which keeps decoding lossless.

NULL and empty texts have no pieces and decode to the empty text. Repeated rows are drawn alike, as they have one key.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from medweave.llm.common import query, table, unused
from medweave.llm.near_dedup import mixed

MARK, BARRED = "▁", "￾"  # the space mark; what stands for a literal one in the lattice, a noncharacter no piece holds
WEIGHT = 0.001  # scores of this kind of model are ranks; at 0 all segmentations are equally likely
KEPT_EDGES, KEPT_WORD = 4_000_000, 200  # edges a worker keeps before it starts again; longer words are not kept
TOGETHER, LONGEST_TOGETHER = 1 << 17, 64  # characters that are filtered at a time, and a word's greatest length; longer ones go one by one
BATCH_BYTES = 1 << 21
SEED = 17
LEADING = 20  # bits of a hash that say where to look; most substrings are no piece, and nothing has theirs
BASE = 0x9E3779B97F4A7C15  # of the rolling hash, modulo 2^64


class Lattices:
    """Filtered lattices of words, one after the other: every node's edges lead back, with cumulative probabilities."""

    def __init__(self, model_file: str, weight: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = range(model.get_piece_size())
        self.bytes_of = [model.id_to_piece(k).replace(MARK, " ").encode() for k in size]
        self.byte_ids, self.pieces = [0] * 256, {}
        for k in size:
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of[k] = b""
            else:
                self.pieces[piece] = (k, weight * model.get_score(k))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece reaches over a word's end")
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10 * weight
        self.table()
        self.clear()

    def table(self) -> None:
        """The pieces by hash: sorted hashes, the id and score of each, and where each leading bits begin. ASCII the model lacks is one byte."""
        import numpy as np

        lacking = {c: (self.byte_ids[ord(c)], self.unknown) for c in map(chr, range(128)) if c != " " and c not in self.pieces}
        looked_up = self.pieces | lacking
        self.letters = np.zeros(0x110000, bool)
        self.letters[[ord(p) for p in looked_up if len(p) == 1]] = True
        hashes = np.array([rolled(p) for p in looked_up], np.uint64) * np.uint64(BASE)  # once more, for leading bits of single characters
        order = np.argsort(hashes)
        ids, scores = zip(*looked_up.values(), strict=True)
        self.hashes, self.ids, self.scores = hashes[order], np.array(ids, np.int32)[order], np.array(scores)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        counts = np.bincount((hashes >> np.uint64(64 - LEADING)).astype(np.int64), minlength=1 << LEADING)
        self.crowd = int(counts.max())  # hashes that share their leading bits, at most
        self.leading = np.where(counts > 0, np.cumsum(counts) - counts, -1).astype(np.int32)
        steps = np.full((2, TOGETHER + LONGEST_TOGETHER + 1), BASE, np.uint64)
        steps[1], steps[:, 0] = pow(BASE, -1, 1 << 64), 1
        self.powers, self.inverses = np.cumprod(steps, 1)  # modulo 2^64

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.cumulative, self.piece, self.back, self.first = array("d"), array("i"), array("i"), array("i")
        self.nodes = 0

    def node(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def edges(self, node: int, found: list[tuple[float, int, int]]) -> None:
        """Edges (probability, piece, node before) of ``node``, which is the newest; -1 is the start."""
        so_far = 0.0
        self.first.append(len(self.piece))
        for p, piece, back in found:
            so_far += p
            self.cumulative.append(node + so_far)
            self.piece.append(piece)
            self.back.append(back)
        self.cumulative[-1] = node + 1.0

    def add(self, word: str) -> int:
        """Forward filtering of ``word``; the node at its end."""
        text, pieces = word.replace(MARK, BARRED).replace(" ", MARK), self.pieces
        total, at = [0.0], [-1]
        for end in range(1, len(text) + 1):
            ways = []
            for begin in range(max(0, end - self.longest), end):
                hit = pieces.get(text[begin:end])
                if hit is not None:
                    ways.append((total[begin] + hit[1], hit[0], at[begin]))
            if text[end - 1] not in pieces:
                raw = word[end - 1].encode()
                back = at[end - 1]
                for b in raw[:-1]:
                    node = self.node()
                    self.edges(node, [(1.0, self.byte_ids[b], back)])
                    back = node
                ways.append((total[end - 1] + self.unknown, self.byte_ids[raw[-1]], back))
            most = max(w for w, _, _ in ways)
            shares = [exp(w - most) for w, _, _ in ways]
            whole = sum(shares)
            node = self.node()
            self.edges(node, [(s / whole, piece, back) for s, (_, piece, back) in zip(shares, ways, strict=True)])
            total.append(most + log(whole))
            at.append(node)
        return at[-1]

    def look_up(self, values):
        """Where in the table each hash is; -1 where it is not."""
        import numpy as np

        at = self.leading[values >> np.uint64(64 - LEADING)]
        left = np.flatnonzero(at >= 0)
        found = np.full(len(values), -1, np.int32)
        for _ in range(self.crowd):
            hit = self.hashes[at[left]] == values[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
        return found

    def add_together(self, codes, sizes):
        """``add`` for many words, their characters one after the other, each of which is a piece or one byte: nodes go by position, then by word."""
        import numpy as np

        many, begins = len(codes), np.cumsum(sizes) - sizes
        place = np.arange(many) - np.repeat(begins, sizes)
        sums = np.zeros(many + 1, np.uint64)
        np.cumsum(codes * self.inverses[:many], out=sums[1:])
        order = np.argsort(place.astype(np.uint8), kind="stable")  # of the nodes; those of one position stand together
        rank = np.empty(many + 1, np.int32)
        rank[order] = np.arange(many)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place))])
        edges = []
        for length in range(min(self.longest, len(bounds) - 1), 0, -1):  # the earliest begin comes first
            node = np.arange(bounds[length - 1], many)
            end = order[node]
            found = self.look_up((sums[end + 1] - sums[end + 1 - length]) * self.powers[end + 1])
            hit = np.flatnonzero(found >= 0)
            node, end = node[hit], end[hit]
            back = np.where(node < bounds[length], -1, rank[end - length])
            edges.append((node, found[hit], back))
        counts = np.zeros(many, np.int64)
        for node, _, _ in edges:
            counts[node] += 1
        first = np.concatenate([[0], np.cumsum(counts)])
        free, entry, back = first[:-1].copy(), np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        for node, found, before in edges:
            entry[free[node]], back[free[node]] = found, before
            free[node] += 1
        scores, upto, total = self.scores[entry], np.empty(first[-1]), np.zeros(many + 1)  # the last total is the start's
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own, start, n = slice(first[lo], first[hi]), first[lo:hi] - first[lo], counts[lo:hi]
            ways = total[back[own]] + scores[own]
            most = np.maximum.reduceat(ways, start)
            shares = np.exp(ways - np.repeat(most, n))
            whole = np.add.reduceat(shares, start)
            total[lo:hi] = most + np.log(whole)
            shares /= np.repeat(whole, n)
            sums_of = np.cumsum(shares)
            upto[own] = np.minimum(sums_of - np.repeat(sums_of[start] - shares[start], n), 1.0)
        upto[first[1:] - 1] = 1.0  # the last character by itself is always a way
        base = self.nodes
        self.first.frombytes((first[:-1] + len(self.piece)).astype(np.int32).tobytes())
        self.cumulative.frombytes((np.repeat(np.arange(base, base + many), counts) + upto).tobytes())
        self.piece.frombytes(self.ids[entry].tobytes())
        self.back.frombytes(np.where(back >= 0, back + base, -1).astype(np.int32).tobytes())
        self.nodes += many
        return base + rank[begins + sizes - 1]

    def learn(self, words: list[str]) -> list[int]:
        """The end nodes of distinct new words."""
        import numpy as np

        if not words:
            return []
        text = "".join(words).replace(MARK, BARRED).replace(" ", MARK)
        codes, sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        together = np.logical_and.reduceat(self.letters[codes], begins) & (sizes <= LONGEST_TOGETHER)
        ends = np.empty(len(words), np.int64)
        for k in np.flatnonzero(~together).tolist():
            ends[k] = self.add(words[k])
        codes, sizes = codes[np.repeat(together, sizes)].astype(np.uint64), sizes[together]
        made, at, upto = [], 0, np.cumsum(sizes)
        while at < len(sizes):
            before = upto[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(upto, before + TOGETHER, side="right")))
            made.append(self.add_together(codes[before : upto[to - 1]], sizes[at:to]))
            at = to
        if made:
            ends[together] = np.concatenate(made)
        return ends.tolist()

    def ends(self, words: list[str]) -> list[int]:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        made = dict(zip(new, self.learn(new), strict=True))
        long = {w: node for w, node in made.items() if len(w) > KEPT_WORD}
        known.update(made)
        found = list(map(known.__getitem__, words))
        for word in long:
            del known[word]
        return found


def rolled(text: str) -> int:
    """The rolling hash of a text's code points."""
    value = 0
    for c in text:
        value = (value * BASE + ord(c)) % (1 << 64)
    return value


@cache
def lattices(model_file: str, weight: float) -> Lattices:
    return Lattices(model_file, weight)


def units(text: str) -> list[str]:
    """Words with the spaces before them; the text's start counts as one."""
    import re

    return re.findall(r" *[^ ]+| +", f" {text}") if text else []


def sample(own: Lattices, keys: list[int], texts: list[str]) -> list:
    """Piece ids of each text."""
    import numpy as np

    if not texts:
        return []  # numpy splits nothing into one part
    if len(own.cumulative) > KEPT_EDGES:
        own.clear()
    split = [units(t) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    node = np.array(own.ends([w for s in split for w in s]), np.int64)
    # a word's random numbers start from its row's key and its place in the row
    place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = mixed(np.repeat(np.array(keys, np.uint64), sizes) + mixed(place.astype(np.uint64)))
    arrays = ((own.cumulative, np.float64), (own.piece, np.int32), (own.back, np.int32), (own.first, np.int32))
    cumulative, piece, back, first = (np.frombuffer(a, t) for a, t in arrays) if own.nodes else (None,) * 4
    active, step, drawn = np.arange(len(node)), 0, []
    while len(active):
        u = (mixed(start[active] + np.uint64(step)) >> np.uint64(34)).astype(np.float64) / (1 << 30)
        upto, edge = node[active] + u, first[node[active]]
        late = np.flatnonzero(cumulative[edge] <= upto)
        while len(late):  # a node's last edge is above any draw
            edge[late] += 1
            late = late[cumulative[edge[late]] <= upto[late]]
        drawn.append((active, piece[edge]))
        node[active] = back[edge]
        active, step = active[back[edge] >= 0], step + 1
    n_pieces = np.zeros(len(node), np.int64)
    for word, _ in drawn:
        n_pieces[word] += 1
    ends = np.cumsum(n_pieces)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    for k, (word, got) in enumerate(drawn):  # the last piece was drawn first
        ids[ends[word] - 1 - k] = got
    cuts = np.concatenate([[0], ends])[np.cumsum(sizes)] if len(ends) else np.zeros(len(texts), np.int64)
    return np.split(ids, cuts[:-1])


def row_seed(key: str | None, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b"" if key is None else b"k" + key.encode(), seed)


def in_runs(keys: Iterable[str | None], texts: Iterable[str | None]) -> Iterator[tuple[list, list[str]]]:
    run, size = ([], []), 0
    for key, text in zip(keys, texts, strict=True):
        run[0].append(key)
        run[1].append(text or "")
        size += len(run[1][-1])
        if size >= BATCH_BYTES:
            yield run
            run, size = ([], []), 0
    if run[0]:  # nothing is left where the last text filled its run
        yield run


def text_of(own: Lattices, packed: bytes | None) -> str:
    import numpy as np

    # the first space stands for the text's start
    return b"".join(map(own.bytes_of.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))[1:].decode()


def encode_sampled(
    docs: DataFrame, model_file: str, key: Column, weight: float = WEIGHT, seed: int = SEED, result: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` and the piece ids of ``text``, unsigned little-endian 32-bit integers, drawn by ``key``.

    With ``decoded``, also the text that these ids decode to, by the worker that drew them: ``decode`` behind it needs a second one.
    """

    @F.arrow_udf("ids binary, decoded string")
    def encode(keys, texts):
        import pyarrow as pa

        own, out, back = lattices(model_file, weight), [], []
        for some, run in in_runs(keys.to_pylist(), texts.to_pylist()):
            made = [ids.astype("<u4").tobytes() for ids in sample(own, [row_seed(k, seed) for k in some], run)]
            out += made
            back += [text_of(own, ids) if decoded else None for ids in made]
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(back, pa.string())], ["ids", "decoded"])

    # Spark copies a deterministic call into all that takes its result, decode() for one, and draws anew for each.
    once = encode.asNondeterministic()
    (both,) = unused(docs, "_drawn")
    drawn = docs.withColumn(both, once(key.cast("string"), F.col("text").cast("string")))
    return drawn.withColumns({result: F.col(both)["ids"]} | ({decoded: F.col(both)["decoded"]} if decoded else {})).drop(both)


def decode(ids: Column, model_file: str, weight: float = WEIGHT) -> Column:
    """The text of piece ids, whichever segmentation they are."""

    @F.arrow_udf("string")
    def texts_of(packed):
        import pyarrow as pa

        own = lattices(model_file, weight)
        return pa.array([text_of(own, p) for p in packed.to_pylist()], pa.string())

    return texts_of(ids)


@query("op9_sampled_pieces")
def op9(spark, folder):
    from public_tokenizers import path

    model = path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode_sampled(docs, model, F.col("doc_id"), decoded="decoded")
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"),
    )
