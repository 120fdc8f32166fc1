"""Byte-level BPE against the tokenizers library."""

import hashlib
from array import array

from hypothesis import given, settings, strategies as st
from public_tokenizers import path

from medweave.llm.bpe import Bpe, bpe, decode_documents, encode_documents, word_pattern
from medweave.llm.common import QUERIES, table
from medweave.llm.tokens import library

BYTE = path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def plain(text):
    return library(BYTE).encode(text or "", add_special_tokens=False).ids


def ids_of(own, texts):
    return [list(array("i", one)) for one in own.encode(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAé'.,1 \n\t\x1c\x85\xa0<|>endoftextstar語"))), max_size=4))
def test_texts(texts):
    assert ids_of(bpe(BYTE), texts) == [plain(t) for t in texts]
    assert [bpe(BYTE).decode(i) for i in map(plain, texts)] == texts


def test_character_classes():
    own, theirs = word_pattern(), library(BYTE).pre_tokenizer
    for c in map(chr, range(0x250)):
        text = f"a{c}1{c}!{c} {c}{c}"
        assert [m.span() for m in own.finditer(text)] == [span for _, span in theirs.pre_tokenize_str(text)], hex(ord(c))


def test_long_words_and_specials():
    texts = ["ab" * 3000, "a" * 70 + "é" * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "=" * 1000, "the " * 2000, " " * 500, None, "'s don't we'll"]
    assert ids_of(bpe(BYTE), texts) == [plain(t) for t in texts]
    for size in (1, 2, 3, 63, 64, 65):
        assert ids_of(bpe(BYTE), ["etaoin" * size][:size]) == [plain("etaoin" * size)]
    assert bpe(BYTE).merge_long(b"thetheremother") == plain("thetheremother")


def test_table_is_bounded():
    small = Bpe(BYTE, kept_words=3, kept_bytes=20)
    texts = ["one two three four five", "", "six, seven", "one's five <|endoftext|>"]
    for _ in range(3):
        assert ids_of(small, texts) == [plain(t) for t in texts]
        assert ids_of(small, texts[::-1]) == [plain(t) for t in texts[::-1]]


def test_decode():
    for ids in ([], [50256, 40, 50256], [447], [447, 247, 3], [10**6, 40]):
        assert bpe(BYTE).decode(ids) == library(BYTE).decode(ids, skip_special_tokens=False)


def test_odd(spark, odd, none):
    back = decode_documents(encode_documents(odd, BYTE), BYTE).collect()
    want = sorted((repr(r.doc_id), plain(r.text), r.text or "") for r in odd.collect())
    assert sorted((repr(r.doc_id), r.ids, r.text) for r in back) == want
    once = encode_documents(odd, BYTE, decoded=True).collect()
    assert sorted((repr(r.doc_id), r.ids, r.text) for r in once) == want
    assert encode_documents(none, BYTE).count() == 0 and decode_documents(encode_documents(none, BYTE), BYTE).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_documents(nothing, BYTE).first().text == ""


def test_query(spark):
    df = QUERIES["op13_bpe"](spark, FOLDER)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = table(spark, FOLDER, "documents").collect()
    want = sorted((r.doc_id, len(plain(r.text)), sha(",".join(map(str, plain(r.text)))), sha(r.text or "")) for r in rows)
    assert sorted(map(tuple, df.collect())) == want
