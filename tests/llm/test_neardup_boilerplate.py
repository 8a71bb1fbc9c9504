import random

from pyspark.sql import functions as F

from tallgrass.llm import neardup
from tallgrass.llm.shingles import weighted_jaccard


def linked(rows, idf, least):
    """Pairs of different texts that are similar by brute force."""
    sets = [(i, neardup.weighted(t, idf)) for i, t in rows]
    return {(i, j): s for k, (i, x) in enumerate(sets) for j, y in sets[:k] if (s := weighted_jaccard(x, y)) >= least}


def boilerplate():
    """Pairs of texts that share a long passage with all others, and a little with each other only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage, rows = [word() for _ in range(104)], []
    for _ in range(120):
        own = [word() for _ in range(8)]
        for _ in range(2):
            rows.append((len(rows), " ".join([*passage, *own, *(word() for _ in range(rng.randint(2, 9)))])))
    return rows


def test_links_of_boilerplate_are_found(spark):
    rows = boilerplate()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    idf = neardup.weights_of(neardup.document_frequencies(docs))
    want = linked(rows, idf, 0.8)
    assert len(want) > 100
    got = {r.rep: r.class_id for r in neardup.classes(docs).collect()}
    found = sum(got[i] == got[j] for i, j in want)
    assert found >= 0.99 * len(want)
    sure = [p for p, s in want.items() if s >= 0.83]
    assert sum(got[i] == got[j] for i, j in sure) >= 0.99 * len(sure)


def test_bound_loses_no_similar_pair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for n in (3, 200, 250, 258, 300, 520, 1100):
        base = [word() for _ in range(n)]
        for edits in (0, 1, 4, 9, 20):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = word()
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(t + t[:5] * rng.randint(1, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = neardup.weights_of(neardup.document_frequencies(docs))
    sent = spark.sparkContext.broadcast(weights)
    d = neardup.signatures(neardup.with_key(docs), sent).withColumn("ones", F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x)))
    assert len({len(r.bits) for r in d.collect()}) > 2
    other = d.select(*(F.col(c).alias(f"other_{c}") for c in ("doc_id", "total", "bits", "ones")))
    passed = {(r.doc_id, r.other_doc_id) for r in d.crossJoin(other).where(neardup.may_reach(0.8)).select("doc_id", "other_doc_id").collect()}
    want = linked(rows, weights, 0.8)
    assert len(want) > 60 and all({p, p[::-1]} <= passed for p in want)
    assert len(passed) < 0.5 * len(rows) ** 2
