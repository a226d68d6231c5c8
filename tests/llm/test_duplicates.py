"""Near-duplicates and repeated strings against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOC, odd, prose, words

from quarrylog.llm import neardup, substrings
from quarrylog.llm.common import blocks
from quarrylog.llm.ngram import range_shard


def components(rows):
    """doc_id -> (shingles, component) by comparing all sets."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    group = {}
    for k, (i, _) in enumerate(sets):
        group.setdefault(find(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in group.items()}
    return sorted(((i, len(s), i if not s else least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def family(rng, n):
    """A base text and many near copies with more or fewer edits, and some unrelated texts that share a passage."""
    base, rows = prose(rng, 120, 5000).split(), []
    passage = prose(rng, 60, 5000)
    for i in range(n):
        w = base.copy()
        for k in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((3 * i, " ".join(w), "en", "a", 0))
        rows.append((3 * i + 1, " ".join(base) if i % 3 == 0 else prose(rng, int(rng.integers(1, 80)), 5000) + " " + passage, "en", "b", 0))
        rows.append((3 * i + 2, prose(rng, int(rng.integers(0, 40)), 5000), "en", "b", 0))
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(neardup, "LIST_BLOCK", 8)
        monkeypatch.setattr(neardup, "GUEST_BLOCK", 4)
    docs = spark.createDataFrame(family(np.random.default_rng(4), 70), DOC).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars")).repartition(4)
    got = neardup.near_duplicates(docs).collect()
    want = components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each(spark):
    docs = odd(spark)
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    # 4 twice and 5 are one group; empty texts are linked with nothing
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((i, t) for i, t, *_ in [(1, None), (2, ""), (None, "no id here at all"), (3, " \n\t "), (4, "one two three"), (6, "x" * 50_000)]), key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def brute(rows):
    """rows in order: n_bytes, n_removed, n_spans, sha of what is left."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        cover, new = bytearray(len(b)), []
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
                new.append(p)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((len(b), sum(cover), spans, hashlib.sha256(bytes(c for c, f in zip(b, cover, strict=True) if not f)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_SLICES", hot)
    rng = np.random.default_rng(6)
    shared = [prose(rng, 50, 300) for _ in range(4)]
    texts = []
    for i in range(120):
        parts = [prose(rng, int(rng.integers(0, 40)), 300)]
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(0, 4))]
            cut = int(rng.integers(0, len(s) - 30))
            parts += [s[cut:] if i % 2 else s[:cut], prose(rng, int(rng.integers(0, 20)), 300)]
        texts.append("é ".join(parts) if i % 7 else "a" * int(rng.integers(90, 400)))
    texts += [texts[3], texts[5], texts[5], "", None, "ab" * 300, "x" * 99, "x" * 100]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = substrings.remove(spark.createDataFrame(rows, DOC).repartition(5), with_text=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute([(r[0], r[1]) for r in rows])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_repeated_strings_odd_rows(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(None, text, "en", "a", 0), (7, text, "en", "a", 0), (7, text, "en", "a", 0), (7, text + "!", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOC).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = {(r.doc_id, r.n_bytes): r for r in substrings.remove(docs).collect()}
    n = len(text)
    assert got[None, n].n_removed == 0 and got[7, n].n_removed == n and got[7, n + 1].n_removed == n
    assert got[6, 50_000].n_removed == 49_999 and got[1, 0].n_spans == 0  # a run of one character repeats itself from its second window
    assert substrings.remove(spark.createDataFrame([], DOC)).count() == 0


def test_anchors_spread_over_shards():
    rng = np.random.default_rng(9)
    text = pa.array([prose(rng, 20_000, 20_000)])
    h = np.concatenate([substrings.anchors(b)[4] for b in blocks(text)])
    n = np.bincount(range_shard(h, 32).astype(np.int64), minlength=32)
    assert len(h) > 1000 and n.max() < 2 * n.mean()


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    for _ in range(60):
        t = rng.integers(0, rng.choice([2, 4, 257]), int(rng.integers(1, 150))).astype(np.int16)
        own = t.tolist()
        assert substrings.suffix_array(t, depth=160).tolist() == sorted(range(len(own)), key=lambda i: own[i:])
        a, b = rng.integers(0, len(own), 40), rng.integers(0, len(own), 40)
        got = substrings.common_prefixes(substrings.packed(t, 30), a, b, 20)
        for i, j, n in zip(a, b, got, strict=True):
            k = 0
            while k < 20 and max(i, j) + k < len(own) and own[i + k] == own[j + k]:
                k += 1
            assert n == k or (i == j and n == 20)
