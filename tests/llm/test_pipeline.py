import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from tallgrass.llm import neardup
from tallgrass.llm.common import saved
from tests.llm.test_linededup import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in pipe.STAGES:
        before = docs
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        at[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns or name == "tokens"
        assert set(at[name][1]) <= set(at[name][0])
    # language: all of these documents have letters of learned languages
    assert len(at["language"][1]) > 0.97 * len(at["language"][0])
    # lines
    a, b = at["lines"]
    want = brute([(i, r.text) for i, r in a.items()], 20)
    assert {i: r.text for i, r in b.items()} == {i: t for i, t in want.items() if t == a[i].text or t.strip()}
    # near-duplicates: whoever goes has a similar document before it, nobody who stays has one
    a, b = at["near_duplicates"]
    ones = neardup.Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    sets = {i: neardup.weighted(r.text or "", ones) for i, r in a.items()}
    similar = {i: [j for j in a if j != i and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.85] for i in a}
    assert all(not [j for j in similar[i] if j in b] for i in b)
    rough = {i: [j for j in a if j < i and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.75] for i in a}
    assert all(rough[i] for i in a if i not in b)
    # mixture: a part is drawn
    a, b = at["mixture"]
    assert 0.4 * len(a) < len(b) <= len(a)
    # tokens
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in at["tokens"][1].items():
        ids = t.encode(at["tokens"][0][i].text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in pipe.STAGES:
        docs = saved(stage(spark, docs, SF), "test-empty")
    assert docs.collect() == []
