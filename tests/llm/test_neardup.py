import random

import numpy as np

from tallgrass.llm import neardup
from tallgrass.llm.components import stars
from tallgrass.llm.shingles import Sampler, shingles, weighted_jaccard, word_hashes


def test_word_hashes_depend_on_the_word_alone():
    a, b = word_hashes("one  two\nThree one"), word_hashes("x one")
    assert len(a) == 4 and a[0] == a[3] == b[1] and len(set(a.tolist())) == 3 and a[2] == word_hashes("THREE")[0]
    assert len(word_hashes("")) == 0 and len(word_hashes(" \n")) == 0


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 250).astype(np.uint64))
    b = np.unique(np.concatenate([a[:180], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    wa, wb = rng.uniform(0.5, 4, len(a)), rng.uniform(0.5, 4, len(b))
    s = Sampler(4000)
    assert abs((s.samples(a, wa) == s.samples(b, wb)).mean() - weighted_jaccard((a, wa), (b, wb))) < 0.03


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    e = spark.createDataFrame([*chain, *star, (200, 201), (201, 200), (300, 300), (None, 5)], "a long, b long")
    got = {r.node: r.root for r in stars(e).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, shared = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "ONE two\n")], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 160))]
        if g % 3 == 0:
            base[:60] = shared
        for _ in range(rng.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 12])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, "x " * 30 + "tail") for i in range(50)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string").repartition(6)
    idf = neardup.weights_of(neardup.document_frequencies(docs))
    sets = {i: neardup.weighted(t or "", idf) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or len(sets[i][0]) and weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in sets}
    kept = neardup.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in sets}) and kept.columns == docs.columns


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    out = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert out == [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True)]
    assert neardup.deduplicated(docs).count() == 2
    assert neardup.near_duplicates(docs.where("doc_id > 5")).collect() == []


def test_shingles_of_short_texts():
    assert len(shingles("a b", 5)[0]) == 1 and len(shingles("", 5)[0]) == 0 and len(shingles("a b c d e f", 5)[0]) == 2


def test_frequencies_of_frequent_shingles_at_two_sizes(spark, monkeypatch):
    """At any size nearly all once-only shingles have the weight of one document, and frequent ones their own."""
    monkeypatch.setattr(neardup, "CHUNK_DOCS", 300)
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    for n in (2000, 6000):
        rows = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(40)) + (f" {common}" if i % 10 == 0 else "")) for i in range(n)]
        f = neardup.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert f.total == n
        s, _ = neardup.shingles(common, 5)
        at = np.searchsorted(f.keys, s)
        assert (f.keys[at] == s).all() and (f.documents[at] > 0.875 * n / 10).all() and (f.documents[at] <= n / 10).all()
        assert len(f.keys) == len(s)  # no rare one is taken for a frequent one
        idf = neardup.weights_of(f)
        _, w = neardup.weighted(rows[1][1], idf)
        assert (w == idf.rest).all() and idf.weights.max() < idf.rest


def test_links_are_counted_by_class(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(w if i != 7 * k else f"x{k}" for i, w in enumerate(words))) for k in range(1, 4)] + [(4, " ".join(words)), (5, " ".join(words)), (9, "another text of its own here")]
    got = {r.doc_id: (r.class_id, r.class_texts, r.class_links) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == (9, 1, 0) and got[1][:2] == (1, 4) and 3 <= got[1][2] <= 6 and got[4] == got[5] == got[1]
