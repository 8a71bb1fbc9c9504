"""Motifs are sought in whole texts, also behind character 200 and across tiles."""

import math

import pytest

from tallgrass.operators import intervals
from tallgrass.plans import interval_plans

PWM = {"m1": [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.25, 0.25, 0.25, 0.25]], "m2": [[0.9, 0.03, 0.04, 0.03], [0.1, 0.4, 0.4, 0.1]]}


def brute(seq_id, text):
    found, x = set(), ["ACGT".find(c) for c in text.upper()]
    for m, rows in PWM.items():
        plus = [[math.log((p + 1e-6) / 0.25) for p in row] for row in rows]
        low, high = sum(map(min, plus)), sum(map(max, plus))
        for strand, t in (("+", plus), ("-", [r[::-1] for r in plus[::-1]])):
            for at in range(len(x) - len(t) + 1):
                w = x[at : at + len(t)]
                if min(w) >= 0 and (score := (sum(r[c] for r, c in zip(t, w, strict=True)) - low) / (high - low)) >= 0.75:
                    found.add((seq_id, m, at, strand, round(score, 6)))
    return found


def rows(df):
    return sorted((r.seq_id, r.motif_id, r.start, r.strand, round(r.score, 6)) for r in df.collect())


TEXTS = [(1, "x" * 250 + "ata ac\ngt é 😀 ATG"), (2, "acgtta" * 70), (3, ""), (4, "a"), (5, None)]


def test_hits_behind_character_200(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = sorted(h for i, t in TEXTS for h in brute(i, t or ""))
    assert any(h[2] > 250 for h in want)
    assert rows(interval_plans.i11(docs)) == want


@pytest.mark.parametrize("tile", [1, 2, 7, 65536])
def test_tiles_do_not_matter(spark, tile):
    text = "acgttan" * 13
    seq = spark.createDataFrame([(1, text.upper())], "seq_id long, sequence string")
    assert rows(intervals.scan_pwm(seq, PWM, 0.75, tile=tile)) == sorted(brute(1, text))
