"""BPE against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Encoder, bpe, decode

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " \n\t ", "Hello, World's end!!", "a" * 5000, "Σίσυφος ΟΔΥΣΣΕΥΣ", "naïve café ÀÉÎ ﬁ", "x<|endoftext|>y <|startoftext|>",
    "<|ENDOFTEXT|> <|x", "1234567890 ½ ² ٣", "日本語のテキスト 한국어 हिन्दी", "é İ İ ǅ", "\x00\x01 ​ z", "😀👨‍👩‍👧 !!!???", "don't I'LL we've 'S",
    "aaa aaaa aaaaaaa", "� new\u0085line", "word " * 3000, "İstanbul ẞ ǅ", "ẛ̣ Å",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        yield len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


def test_against_library(spark):
    docs = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe(docs, PATH, ids=True).collect()}
    assert len(rows) == len(TEXTS)
    for i, (n, ids, text) in enumerate(expected(TEXTS)):
        r = rows[i]
        assert " ".join(map(str, r.token_ids)) == ids, TEXTS[i]
        assert (r.n_tokens, r.decoded) == (n, text), TEXTS[i]
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert decode(r.token_ids, PATH) == text


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = bpe(docs, PATH).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_sha256) for r in got] == [(n, hashlib.sha256(i.encode()).hexdigest()) for n, i, _ in expected(texts)]


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_table(spark, rows):
    docs = spark.createDataFrame([(1, "a")][:rows], "doc_id long, text string")
    assert bpe(docs, PATH).count() == rows


def test_every_code_point():
    """Alone, between letters, and with marks before and after that could move or compose."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    points = [c for c in [*range(0x34000), *range(0x34000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    encoder = Encoder(PATH)
    wrong = []
    for low in range(0, len(points), 2048):
        part = [chr(c) for c in points[low : low + 2048]]
        texts = [t for c in part for t in (c, f"x{c}y", f"a\u0323{c}\u0301")]
        # One text of many is much quicker than many texts; parts that differ are looked at one by one.
        whole = [" ".join(texts)]
        if [next(encoder.encode(whole))[0]] != [" ".join(map(str, library.encode(whole[0], add_special_tokens=False).ids))]:
            ids = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
            wrong += [ascii(t) for t, (mine, *_), i in zip(texts, encoder.encode(texts), ids, strict=True) if mine != i]
    assert not wrong, (len(wrong), wrong[:40])
