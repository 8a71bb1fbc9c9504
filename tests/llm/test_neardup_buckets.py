import random

from tallgrass.llm import neardup
from tallgrass.llm.shingles import weighted_jaccard


def test_one_bucket_of_many_clusters_and_chains(spark):
    """All texts in one bucket (no rows in a band): every link between them counts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = []
    for g in range(30):
        t = [word() for _ in range(60)]
        for _ in range(1 + g % 6):  # a chain: each text is an edit of the one before
            rows.append((len(rows), " ".join(t)))
            at = rng.randrange(60)
            t[at] = word()
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = neardup.weights_of(neardup.document_frequencies(docs))
    sets = [(i, neardup.weighted(t, idf)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if weighted_jaccard(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert 30 <= len({find(i) for i in root}) < len(rows) - 30
    member = neardup.classes(docs, bands=1, rows=0)
    assert {r.rep: r.class_id for r in member.collect()} == {i: find(i) for i in root}
