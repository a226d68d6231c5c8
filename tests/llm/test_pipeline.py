"""The pipeline against a brute-force version of each stage, from documents to packed sequences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import DOC, prose, words

from quarrylog.llm import mixing, packing, quality
from quarrylog.llm.common import blocks
from quarrylog.llm.queries import tokenizer_path


def badness(model, text):
    """The trees walked node by node."""
    (b,) = blocks(pa.array([text]))
    x, total = quality.statistics(b)[1][0], model.bias
    for at in model.roots.tolist():
        while model.left[at] != at:
            at = int(model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at])
        total += model.value[at]
    return 1 / (1 + math.exp(-total))


def good(model, text):
    w = (text or "").encode().split()
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and badness(model, text) < quality.REJECT_AT


def leaders(rows):
    """The smallest id of each component of documents whose 5-word shingles are alike by 0.8 or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i for i in root if root[i] == i}


def test_every_stage_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = np.random.default_rng(14)
    rows, labels = [], []
    for i in range(160):
        text = prose(rng, 90, 6000)
        if i % 4 == 1:  # junk, marked as such
            text = "\n".join(f"{w.upper()}!! | ###" for w in text.split())
        rows.append((i, text + f" write to u{i}@h.example or 10.0.{i}.1", None if i % 9 == 0 else "en", "abc"[i % 3], 90))
        labels.append((i, int(i % 4 != 1), 0))
    edited = lambda t, n: " ".join(f"e{k}" if k % 90 in range(40, 40 + n) else w for k, w in enumerate(t.split()))
    rows += [(200 + i, rows[4 * i][1], "en", "a", 0) for i in range(5)] + [(300 + i, edited(rows[4 * i][1], 4), "en", None, 0) for i in range(8)] + [(400 + i, edited(rows[4 * i][1], 30), "en", "c", 0) for i in range(4)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, "too short", "en", "b", 2)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model is not None and len(model.roots) > 1

    stay = [r for r in rows if good(model, r[1])]
    assert {r[0] for r in stay} >= {i for i in range(160) if i % 4 != 1} and not any(r[0] < 160 and r[0] % 4 == 1 for r in stay)
    first = leaders([(r[0], r[1]) for r in stay])
    stay = [r for r in stay if r[0] in first]
    assert not any(200 <= r[0] < 400 for r in stay) and any(r[0] >= 400 for r in stay)
    hide = lambda t: re.sub(r"10\.0\.\d+\.1", "[IP]", re.sub(r"\S+@h\.example", "[EMAIL]", t))
    stay = {r[0]: (hide(r[1]), *r[2:]) for r in stay}

    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 2:
            assert {r.doc_id: tuple(r)[1:] for r in seen.collect()} == stay and seen.count() == len(stay)
    times = Counter(r.doc_id for r in seen.collect())
    assert all(tuple(r)[1:] == stay[r.doc_id] for r in seen.collect()) and max(times.values()) <= 2
    sizes = {i: len(v[0].split()) for i, v in stay.items()}
    names = sorted({v[2] for v in stay.values()}, key=lambda x: (x is None, x or ""))
    total = [sum(sizes[i] for i, v in stay.items() if v[2] == x) for x in names]
    for x, target in zip(names, mixing.shared_targets(total, [[3, 1, 2][k % 3] for k in range(len(names))], 1.5 * sum(total), 2), strict=True):
        assert abs(sum(n * sizes[i] for i, n in times.items() if stay[i][2] == x) - target) <= 100

    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, n in times.items():
        ids = [*tok.encode(stay[i][0], add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), packing.SIZE)):
            part = np.array(ids[at : at + packing.SIZE], np.uint32)
            want[i, p, at, len(part), zlib.crc32(part.astype("<u4").tobytes())] += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(b[0] == sum(a) for a, b in zip(own, own[1:], strict=False)) and sum(own[-1]) <= packing.SIZE
    lengths = Counter(r.length for r in out)
    assert len(held) == packing.lower_bound(lengths, packing.SIZE)
