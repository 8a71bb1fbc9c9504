import random
from collections import Counter

import numpy as np

from tallgrass.llm import neardup
from tallgrass.llm.shingles import shingles


def test_every_shingle_has_its_own_frequency(spark, monkeypatch):
    """Shingles of two and three among many documents too; in many groups and ranges, with copies and small chunks."""
    monkeypatch.setattr(neardup, "PER_GROUP", 3000)
    monkeypatch.setattr(neardup, "PER_RANGE", 9000)
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 200)
    rng = random.Random(6)
    texts = []
    for i in range(900):
        own = " ".join(f"w{rng.getrandbits(40)}" for _ in range(12))
        texts.append(f"{own} " + " ".join(f"p{i // 3}.{k}" for k in range(6 if i % 2 else 4)))
    texts += [texts[5], texts[5], "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    size = neardup.size_of(docs)
    assert size.groups > 5 and size.bits > 1 and size.total == 904
    want = Counter(int(k) for t in texts for k in shingles(t, 5)[0])
    assert {2, 3} <= set(want.values())
    f = neardup.document_frequencies(docs)
    assert dict(zip(f.keys.tolist(), f.documents.tolist(), strict=True)) == {k: n for k, n in want.items() if n > 1}
    nodes, total = neardup.signed_nodes(docs)
    got = {r.rep: r for r in nodes.collect()}
    assert total == 904 and sorted(got) == [i for i in range(904) if i not in (900, 901)] and got[5].n == 3
    for i, r in got.items():
        assert np.frombuffer(r.known, np.uint32).tolist() == [want[int(k)] for k in shingles(texts[i], 5)[0]]
