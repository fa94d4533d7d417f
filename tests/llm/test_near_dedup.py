"""Near-duplicate groups against all pairs by brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tarn.llm import flat, near_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows, k):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def edited(rng, words, share):
    return [w if rng.random() > share else f"z{rng.randrange(10**9)}" for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for n, share in ((60, 0.045), (40, 0.02), (30, 0.08), (5, 0.03)):
        base = rng.choices(vocabulary, k=150)
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base, share)) for _ in range(n)]
    chain = rng.choices(vocabulary, k=200)
    for step in range(15):
        rows.append(" ".join(chain[step * 6 :] + rng.choices(vocabulary, k=step * 6)))
    rows += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(60)]
    rows += ["Same Words here", "same words HERE", "one", "ONE", "one two", "", " \t\n", None, "\x0b"]
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, (None, rows[0]), (None, "quite alone in this"), (3, rows[3]), (5, "another text under a repeated id")]


@pytest.mark.parametrize("all_pairs,block", [(12, 64), (2, 8)])
def test_groups_match_brute_force(spark, monkeypatch, all_pairs, block):
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "OPEN_BLOCK", block)
    rows = corpus(all_pairs)
    got = near_dedup.near_groups(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), shingle=2).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, 2), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_rows_and_one_per_group(spark):
    assert near_dedup.near_groups(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (9, "x"), (8, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, cls string")
    kept = near_dedup.one_per_group(spark, docs)
    assert kept.columns == ["doc_id", "text", "cls"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 8, 9]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for n, share in ((1, 1.0), (3, 0.5), (50, 0.8), (500, 0.8), (500, 0.2)):
        common = rng.integers(0, 2**63, max(1, round(n * share)), dtype=np.uint64)
        own = [rng.integers(0, 2**63, n - len(common), dtype=np.uint64) for _ in range(2)] if n > len(common) else [common[:0]] * 2
        a, b = np.concatenate([common, own[0]]), np.concatenate([common, own[1]])
        s = near_dedup.fast_sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != np.iinfo(np.uint64).max).all()
        errors.append(abs((s[0] == s[1]).mean() - len(common) / (2 * max(n, len(common)) - len(common))))
    assert max(errors) < 0.2 and errors[0] == 0
    assert flat.hash_of("A", fold=True) == flat.hash_of("a", fold=True)
