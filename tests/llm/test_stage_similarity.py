"""The pipeline's near-duplicates stage against brute force at 0.80."""

import corpus_pipeline
import numpy as np
from helpers import DOC, prose, words

from quarrylog.llm import neardup


def test_stage_links_from_080(spark):
    rng = np.random.default_rng(21)
    rows = []
    for b in range(40):
        base = prose(rng, 204, 5000).split()
        for k in range(4):
            w = base.copy()
            for at in rng.choice(40, int(rng.integers(0, 6)), replace=False) * 5:
                w[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((4 * b + k, " ".join(w), "en", "a", 0))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(r[1]) for r in rows)]
    least, between = list(range(len(rows))), 0
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a // 4 * 4, a):
                both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                between += 80 * either <= 100 * both < 85 * either
                if 100 * both >= 80 * either:
                    least[a] = least[b] = min(least[a], least[b])
        if _ == 4:
            break
    assert between > 10
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(least))
    assert len(kept) < neardup.near_duplicates(docs).where("kept").count()


def test_matches():
    assert neardup.matches(85) == 36 and neardup.matches(80) < 36
