"""Token ids of whole texts as the tokenizers library gives them.

A tokenizer whose words never reach over white space gives a text the ids of its words, one after the
other. The ids of each distinct word are then asked from the library once per Python worker and kept
in a table of bounded size; other tokenizers encode whole texts.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

WORDS_KEPT = 1_000_000  # entries of a worker's table before it is emptied and filled again: about 200 MB
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")
#: Letters, then ASCII punctuation without quotes; no digits.
SIMPLE = re.compile(rf"([{LETTERS}]*)([!-&(-/:-@\[-`{{-~]{{0,8}})")


@cache
def library(path: str):
    """The tokenizer in the file ``path``, without truncation or padding."""
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def ids_per_word(tokenizer) -> bool:
    """Whether white space gives no ids and parts the words: tried for every ASCII white space character."""
    plain = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    probes = ("ab", "Don't", "12,", "é")
    return all(not plain(c) and all(plain(f"{p}{c}{q}") == plain(p) + plain(q) for p in probes for q in probes) for c in " \t\n\x0b\x0c\r")


class Encoder:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT) -> None:
        self.tokenizer, self.words_kept = library(path), words_kept
        self.by_word, self.letters = ids_per_word(self.tokenizer), letter_table(self.tokenizer)
        self.known, self.tails = {}, {}

    def encode(self, texts: Iterable[bytes | None], run_bytes: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text, none for NULL and empty texts; new words are learned for many texts at a time."""
        run, size = [], 0
        for text in texts:
            run.append(text or b"")
            size += len(run[-1])
            if size >= run_bytes:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[bytes]) -> Iterator[bytes]:
        if not self.by_word:
            yield from (pack(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids) for text in run)
            return
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array(run, pa.large_binary()).cast(pa.large_string()))  # an empty word at white ends has no ids
        each = split.values.dictionary_encode()  # the table is asked once for each word of a run
        known, words = self.known, each.dictionary.cast(pa.large_binary()).to_pylist()
        found = list(map(known.get, words))
        unknown = [k for k, own in enumerate(found) if own is None]
        if unknown and len(known) + len(unknown) > self.words_kept:
            known.clear()
            known.update((word, own) for word, own in zip(words, found, strict=True) if own is not None)  # what this run uses stays
        self._learn([words[k] for k in unknown])
        for k in unknown:
            found[k] = known[words[k]]
        ids = pa.array(found, pa.large_binary()).take(each.indices)  # lie one after the other in its memory
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        for begin, end in zip(ends, ends[1:]):
            yield data[begin:end].to_pybytes() if end > begin else b""

    def _learn(self, words: Iterable[bytes]) -> None:
        """Letters with punctuation behind them need only the merges; the rest goes through the whole library."""
        others, pieces = [], self.tokenizer.model.tokenize
        for word in words:
            text = word.decode()
            if self.letters and (m := SIMPLE.fullmatch(text)):
                ids = [p.id for p in pieces(m[1].translate(self.letters))] if m[1] else []
                self.known[word] = pack(ids + self._tail(m[2]) if m[2] else ids)
            else:
                others.append((word, text))
        found = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False) if others else []
        for (word, _), one in zip(others, found, strict=True):
            self.known[word] = pack(one.ids)

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            self.tails[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.tails[text]


def letter_table(tokenizer) -> dict[int, str] | None:
    """What the library makes of each letter before the merges; None if a word of them is not made letter by letter."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return None
    before = lambda text: [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]
    table = {ord(c): "".join(before(c)) for c in LETTERS}
    whole = "".join(table[ord(c)] for c in LETTERS)
    parted = before(LETTERS) == [whole] and before(f"{LETTERS}.") == [whole, *before(".")]
    return table if parted and before(LETTERS[::-1]) == ["".join(table[ord(c)] for c in LETTERS[::-1])] else None


def pack(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@cache
def encoder(path: str, words_kept: int = WORDS_KEPT) -> Encoder:
    """The encoder of this Python process."""
    return Encoder(path, words_kept)
