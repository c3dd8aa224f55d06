import os

import pytest

from keystrata.llm.queries import TOKENIZERS
from keystrata.llm.tokens import decode_corpus, encode_corpus, encode_text, encoder, pieces

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no rank file")
TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world", "<|endoftext|> is text", "naïve café — 日本語 🙂🏽", "a" * 5_000, "word " * 20_000, "x1y22z333 " * 9_000,
    "don't we'll I'm THEY'RE  two  spaces\r\n\tend ", "\x1c\x1f\x85  odd blanks here", "é" * 40, "\u0000\u0001",
]


def test_round_trip_and_defined_results(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = encode_corpus(df, "doc_id", "text", RANKS)
    ids = {r.id: r.ids for r in got.collect()}
    assert ids[0] == [] and ids[1] == []
    assert len(ids) == len(TEXTS)
    back = {r.id: r.text for r in decode_corpus(got, "id", "ids", RANKS).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))


def test_cutting_at_safe_places_changes_nothing():
    enc = encoder(RANKS)
    for t in TEXTS:
        if t:
            for longest in (1, 7, 100):
                assert "".join(pieces(t, longest)) == t
                assert encode_text(enc, t, longest) == enc.encode_ordinary(t)


def test_as_the_other_library_has_it():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = encoder(RANKS)
    for text in TEXTS[4:]:
        assert encode_text(enc, text) == t.encode(text, add_special_tokens=False).ids


def test_empty_table_and_damaged_bytes(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", RANKS).count() == 0
    half = encoder(RANKS).encode_ordinary("日")[:1]
    r = decode_corpus(spark.createDataFrame([(1, half), (2, None)], "id long, ids array<int>"), "id", "ids", RANKS).sort("id").collect()
    assert r[0].text is None and r[0].raw is not None and r[1].raw is None
