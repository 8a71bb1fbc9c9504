import random

from tallgrass.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least):
    at = sorted((i, no, line) for i, t in rows if t is not None for no, line in enumerate(t.split("\n")) if len(line) >= least or line.strip())
    near = lambda x, line: x == line or min(len(x), len(line)) >= least and abs(len(x) - len(line)) < 2 and distance(x, line) < 2
    gone = {(i, no) for k, (i, no, line) in enumerate(at) if any(near(x, line) for _, _, x in at[:k])}
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in rows}


def corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("abé 漢") for _ in range(rng.randint(5, 14))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "short\nshort\n\n"), (3, "x" * 3000 + "\n" + "x" * 3001)]
    for i in range(4, 90):
        lines = []
        for _ in range(rng.randint(1, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_lines string, line_key int")
    got = {r.doc_id: r for r in linededup.deduplicated(docs.repartition(5), min_chars=7).collect()}
    want = brute(rows, 7)
    assert {i: r.text for i, r in got.items()} == want
    assert got[4].n_lines == "clash" and got[4].n_lines_ > 0


def test_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a line of some length here"), (1, "a line of some length here"), (2, "a line of some length there"), (None, "a line of some length here!")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in linededup.deduplicated(docs).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("None", "a line of some length here!")]
    assert linededup.deduplicated(docs.where("doc_id > 5")).collect() == []
