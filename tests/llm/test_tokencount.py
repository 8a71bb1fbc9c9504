import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import tokencount
from tallgrass.llm.bpe import Bpe, read_spec

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_after_random_edits_equal_a_full_count():
    rng, bpe = random.Random(9), Bpe(read_spec(PATH))
    parts = ["word", " ", "  ", "\n", "\n\n", "'s", "'ll", "12", "é", "漢", "!", "…", " ", "a", " the", "'r", "e"]
    for trial in range(150):
        text = "".join(rng.choices(parts, k=rng.choice([0, 3, 40, 900, 3000])))
        c = tokencount.Counted(text, bpe)
        for _ in range(12):
            at, gone = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 7, 60, 2000])
            new = "".join(rng.choices(parts, k=rng.choice([0, 0, 1, 2, 9, 500])))
            c.edit(at, gone, new)
            at = min(max(at, 0), len(text))
            text = text[:at] + new + text[at + gone :]
            assert c.text == text
            words = bpe.pattern.findall(text)
            assert [x for a, _ in c.leaves for x in a] == [len(w) for w in words], (trial, text)
            assert c.total == sum(len(bpe[w]) // 4 for w in words) and c.chars[1] == len(text)


def test_only_the_neighbourhood_is_encoded():
    bpe = Bpe(read_spec(PATH))
    c = tokencount.Counted("some words of a text " * 20_000, bpe)
    before = c.encoded
    c.edit(200_000, 3, "xyz ")
    assert c.encoded - before < 12


def test_operator(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "x"), (3, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "three four"), (1, 1, 100, 0, " five"), (2, 0, None, None, "new text"), (9, 0, 0, 0, "a")], "doc_id long, seq int, start int, removed int, inserted string")
    got = {r.doc_id: r for r in tokencount.edited_counts(tokencount.with_edits(docs, edits), PATH).collect()}
    assert (got[1].n_tokens, got[1].n_tokens_edited) == (2, 4)
    assert (got[2].n_tokens, got[2].n_tokens_edited, got[3].n_tokens_edited) == (0, 2, 1)
    assert tokencount.edited_counts(tokencount.with_edits(docs.where("doc_id > 9"), edits), PATH).collect() == []


def test_stored_trees_take_a_second_batch_of_edits(spark, tmp_path):
    """The second batch reads trees from a table and encodes only around its edits; counts equal a full recount."""
    rng, bpe = random.Random(4), Bpe(read_spec(PATH))
    texts = [(i, None if i == 3 else " ".join(rng.choices(["word", "it's", "12", "é", "\n\n", "longer-word", "漢"], k=2000)), "x") for i in range(12)]
    tokencount.counted(spark.createDataFrame(texts, "doc_id int, text string, lengths string"), PATH).write.parquet(f"{tmp_path}/0")
    plain = {i: t or "" for i, t, _ in texts}
    for batch in (1, 2):
        edits = []
        for i in plain:
            n = len(plain[i])
            at = rng.randint(0, n)
            edits.append((i, [(at, 5, "new words' ll"), (n // 2, 0, "é"), (n + 9, 3, None)] if i % 4 else None))
            if i % 4:
                for a, gone, new in [(at, 5, "new words' ll"), (n // 2, 0, "é"), (n + 9, 3, "")]:
                    a = min(a, len(plain[i]))
                    plain[i] = plain[i][:a] + new + plain[i][a + gone :]
        e = spark.createDataFrame(edits, f"doc_id int, edits {tokencount.EDITS}")
        before = spark.read.parquet(f"{tmp_path}/{batch - 1}").drop("edits")
        tokencount.edited(before.join(e, "doc_id"), PATH).write.parquet(f"{tmp_path}/{batch}")
        got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/{batch}").collect()}
        assert {i: r.text for i, r in got.items()} == plain and got[1].lengths == "x"
        assert all(r.n_tokens == sum(len(bpe[w]) // 4 for w in bpe.pattern.findall(r.text)) for r in got.values())
        assert all((r.n_reencoded > 0) == (i % 4 > 0) and r.n_reencoded < 60 for i, r in got.items())
    wrong = spark.read.parquet(f"{tmp_path}/2").withColumn("text", F.concat("text", F.lit("x")))
    with pytest.raises(Exception, match="not that of its text"):
        tokencount.edited(wrong, PATH).collect()
