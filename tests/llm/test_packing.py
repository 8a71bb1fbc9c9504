import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallgrass.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def checked(rows, got, capacity):
    """Every id of every document in one piece, every sequence gapless; returns the share of padding."""
    library = Tokenizer.from_file(PATH)
    of: dict = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    want: dict = {}
    for doc, text, *_ in rows:
        want.setdefault(doc, []).append(ids_of(library, text))
    assert of.keys() == want.keys()
    for doc, pieces in of.items():
        texts = want[doc]
        assert sum(p.length for p in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = texts[0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                part = array("I", ids[at : at + p.length]).tobytes()
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part) and p.length > 0
                at += p.length
            assert at == len(ids)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(r.length for r in got))


def corpus(n):
    rng = random.Random(n)
    words = ["The", "naïve", "ÉCOLE", "it's", "I'LL", "42", "x=1;", "×", "ß", "don't", "…", "漢字", "é", "<|endoftext|>", "a b", "\x1c", "İ", "ΑΣ", "--", "word", "Größe"]
    rows = []
    for i in range(n):
        size = int(rng.paretovariate(0.7)) * rng.choice([1, 3, 20])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=min(size, 9000))), "x"))
    return [*rows, (n, None, "x"), (n + 1, "", "x"), (n + 2, "word " * 30_000, "x"), *[(n + 3, "same text again", "x")] * 60]


@pytest.mark.parametrize("level_rows", [packing.LEVEL_ROWS, 700])
def test_every_id_is_packed_once_with_little_padding(spark, level_rows):
    rows = corpus(700)
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, end_id=2, level_rows=level_rows)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert checked(rows, got.collect(), 4096) < 0.02


def test_ids_are_those_of_the_library(monkeypatch):
    words, library, rng = packing.Words(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH), random.Random(4)
    parts = ["A", "É", "ß", "'S", "'ll", "'", "9", " ", "\n", "\t", "!", "_", "Ü", "zz", "÷", "µ", "é", "\r\n", "\x0b", "'RE", "ÿ", "Ð", "s", "t", "ve", "longerword", "'d", "'m", "'v", "''", "\x00", "<|endoftext|>"]
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    monkeypatch.setattr(packing, "CHUNK", 300)
    for plain in (True, False):
        for _ in range(120):
            texts = ["".join(rng.choices(parts[:-2] if plain else parts, k=rng.randint(0, 14))) for _ in range(40)]
            got = [ids.tolist() for ids in words.encoded(texts)]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.encoded([]) == [] and [len(x) for x in words.encoded(["", "  ", "a"])] == [0, 0, 1]


def test_pieces_fill_their_class():
    for n in range(1, 20_000):
        pieces = packing.cuts(n, 4096)
        assert sum(pieces) == n and min(pieces) > 0
        for p in pieces:
            _, most = packing.class_of(p, 4096)
            assert 4096 * 0.98 <= most * p <= 4096 or 4096 - most * p < 64
    assert len({packing.class_of(n, 4096) for n in range(1, 4097)}) == 127


def test_empty_table_and_clashing_columns(spark):
    none = packing.packed(spark.createDataFrame([], SCHEMA), PATH, end_id=2)
    assert none.count() == 0
    got = packing.packed(spark.createDataFrame([(None, "a b c", "x")], SCHEMA), PATH, end_id=2).collect()
    assert [(r.doc_id, r.doc_tokens) for r in got] == [(None, 4)] * len(got)
