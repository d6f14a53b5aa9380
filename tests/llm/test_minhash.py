"""Near-dedup and components against brute force."""

import random

import numpy as np
import pytest

from stemma.llm import minhash
from stemma.llm.components import components

SCHEMA = "doc_id long, text string, kept string, root long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def by_force(rows):
    sets = {}
    for n, (i, t) in enumerate(rows):
        sets[n] = (i, plain(t))
    up = {i: i for i, _ in rows if i is not None}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    real = [(i, s) for i, s in sets.values() if i is not None and s]
    for n, (i, a) in enumerate(real):
        for j, b in real[n + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((str((i, len(s), None if i is None else root(i), i is None or root(i) == i)) for i, s in sets.values()))


def near(rng, words, rate):
    return [rng.choice(["new", "other", "word"]) + str(rng.random()) if rng.random() < rate else w for w in words]


def corpus(seed=1):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(3000)]
    rows, passage = [], rng.choices(pool, k=60)
    for _ in range(12):
        base = rng.choices(pool, k=rng.randint(8, 200))
        rows += [near(rng, base, rng.choice([0, 0.005, 0.02, 0.05, 0.08])) for _ in range(8)]
    for _ in range(40):
        rows.append(passage + rng.choices(pool, k=rng.randint(5, 90)))
    rows += [rng.choices(pool, k=50) for _ in range(30)]
    texts = [rng.choice([" ", "\n", " \t"]).join(r) for r in rows]
    texts = [t.upper() if rng.random() < 0.1 else t for t in texts] + [None, "", "  \n", "one", "ONE", "one two", "One  Two", "é É", "É É"]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts)) + [(None, texts[0]), (None, None), (ids[0], texts[0]), (ids[1], texts[50])]


@pytest.mark.parametrize("bucket,block", [(200, 20_000), (4, 6), (2, 3)])
def test_same_as_all_pairs(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LISTED", 8 if bucket == 2 else 256)
    rows = corpus(bucket)
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == by_force(rows)


def test_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    got = minhash.near_duplicates(docs(spark, [(3, None), (4, "")])).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_keys_find_every_pair_under_the_threshold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 65536, minhash.PARTS).astype("<u2")
        b = a.copy()
        wrong = rng.choice(minhash.PARTS, minhash.MOST, replace=False)
        b[wrong] ^= 1
        assert set(minhash.keys(a[None])[0]) & set(minhash.keys(b[None])[0])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(x[:3500]), np.unique(x[500:])
    equal = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(equal - 0.75) < 0.15


def test_odd_sketches_never_leave_out_a_linked_pair():
    rng = np.random.default_rng(6)
    for n in (1, 4, 20, 170, 900, 6000):
        for _ in range(150):
            x = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
            gone = n // 7
            a, b = x[:n], np.concatenate([x[gone:n], x[n : n + (n - gone) * 4 // 3 - (n - gone)]])
            if minhash.linked(np.sort(a), np.sort(b)):
                apart = np.bitwise_count(minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).sum()
                assert apart <= minhash.odd_limit(np.array([len(a) + len(b)]))[0]


def test_components(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(5, 5)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {v: v for e in links for v in e}
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {v: r for v, r in up.items() if v != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
