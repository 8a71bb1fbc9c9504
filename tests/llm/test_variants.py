import itertools
import random
import zlib
from collections import Counter

import pytest

from tallgrass.llm import variants as V


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(texts, min_chars=6, min_n=5):
    """Runs, deletions, all pairs of words and chains, plainly."""
    counts = Counter()
    for doc_id, text in texts:
        run = ""
        for c in (text or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_n}
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return rows


def made(df):
    return [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]


def corpus(seed: int):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abÀ×", k=rng.randint(5, 9))) for _ in range(60)]
    words[:6] = ["aaabbb", "aaabb", "aabbbb", "baabbb", "aaabbbb", "aaaabbb"]
    words += ["a" * k for k in range(5, 12)] + ["b" * 70, "b" * 69, "b" * 40 + "a" + "b" * 29, "longer" * 40, "longer" * 39 + "longor"]
    texts = []
    for k in range(120):
        chosen = rng.choices(words, weights=[1 / (1 + i) ** 1.6 for i in range(len(words))], k=rng.randint(0, 120))
        texts.append((k if k % 17 else 7, rng.choice([" ", "\n", "-1"]).join(w.upper() if rng.random() < 0.2 else w for w in chosen)))
    return [*texts, (900, None), (901, ""), (902, "b" * 70 + " " + ("b" * 69 + ",") * 30), *texts[:9]]


@pytest.mark.parametrize("most", [1, 3, 2000])
def test_variants_equal_all_pairs(spark, most):
    texts = corpus(most)
    got = made(V.variants(spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string"), most=most))
    assert len(got) == len(set(got)) and set(got) == expected(texts)
    assert any(r[2] > 1 for r in got) and any(r[3] for r in got)


def test_each_pair_is_accepted_once():
    rng = random.Random(3)
    for _ in range(200):
        size, behind = rng.randint(1, 6), rng.choice(["", "a", "b"])
        strings = list({"".join(rng.choices("ab", k=rng.choice([size, size - 1]))) for _ in range(12)})
        if not any(len(s) == size for s in strings):
            continue
        got = [*V.Acceptor(strings).pairs(size, behind)]
        want = {frozenset(p) for p in itertools.combinations(strings, 2) if one_edit(*p) and (len(p[0]) == len(p[1]) == size or len(p[0]) != len(p[1]))}
        seen = {frozenset(p) for p in got}
        assert len(got) == len(set(map(frozenset, got)))
        # pairs whose edit place may lie behind the rest belong to another partition
        assert seen <= want and all(len(min(p, key=len)) < size and (max(p, key=len) + behind)[size:].startswith(max(p, key=len)[-1]) for p in want - seen)


def test_equal_right_languages_are_one_state():
    a = V.Acceptor(["nation", "station", "ration", "rations", "nations"])
    assert len(a.out) == 14  # a trie of these has 31
    assert sorted(a.common(a.start, a.start)) == sorted(["nation", "station", "ration", "rations", "nations"])


def test_chains_of_forms_end_at_their_root(spark):
    texts = [(1, " ".join(["lettera"] * 4000 + ["letterb"] * 5 + ["lettebb"] * 1 + ["lettexa"] * 800 + ["lettexb"] * 160 + ["letzexb"] * 32 + ["lotzexb"] * 6))]
    got = {r[0]: r for r in made(V.variants(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert set(got.values()) == expected(texts)
    assert got["lotzexb"][5] == "lettera" and got["lotzexb"][3] == "letzexb"


def test_empty_tables_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert made(V.variants(spark.createDataFrame([], schema))) == []
    got = made(V.variants(spark.createDataFrame([(None, "abcdef " * 5)], schema)))
    assert got == [("abcdef", 5, 0, None, None, "abcdef")]
