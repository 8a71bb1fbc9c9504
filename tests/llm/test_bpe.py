import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallgrass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.Bpe(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    got = OURS.encoded(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert OURS.decoded(got) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=0, max_codepoint=0x24F), st.sampled_from(list("\n\t\r  　'srelldm漢字😀"))), max_size=60))
def test_equals_the_library(text):
    same(text)


def test_special_tokens_long_words_and_repeats():
    rng = random.Random(1)
    same("<|endoftext|>")
    same("a <|endoftext|> b  <|endoftext|>\n\n<|endoftext|")
    same("".join(rng.choice("abcde") for _ in range(20_000)))
    same("   " * 500 + "x")
    same("ab" * 3000 + " " + "é" * 999)


def test_any_ids_decode_as_the_library_does():
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert OURS.decoded(np.array(ids, "<u4").tobytes()) == THEIRS.decode(ids, skip_special_tokens=False)


def test_full_dict_starts_again():
    small = bpe.Bpe(bpe.read_spec(PATH), remembered=3)
    text = "one two three four five six one two"
    assert small.encoded(text) == OURS.encoded(text) and len(small) + len(small.older) <= 4
    assert small.encoded(text * 3) == OURS.encoded(text * 3)


def test_operator_with_nulls_clashes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "héllo", 9), (2, None, 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs, PATH), PATH, "ids_")
    rows = sorted((r.doc_id, r.ids, r.decoded) for r in out.collect())
    assert rows == [(1, 9, "héllo"), (2, 9, ""), (2, 9, ""), (3, 9, "")]
    once = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert sorted((r.doc_id, r.decoded) for r in once) == [(i, d) for i, _, d in rows]
    assert bpe.encode(docs.where("doc_id > 9"), PATH).collect() == []
