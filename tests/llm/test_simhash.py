import random
import re

import numpy as np
import xxhash

from guardlake.llm import common, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(nodes, near):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if near(a, b) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {n: top(n) for n in nodes}


def test_every_word_decodes_and_near_words_share_a_key():
    table = simhash.golay_table()
    assert (table >= 0).all()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 600, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for fps in (a, b):
        own = [set() for _ in fps]
        for at, key in simhash.fuzzy_keys(fps, table):
            for i, k in zip(at.tolist(), key.tolist()):
                own[i].add(k)
        keys.append(own)
    assert all(x & y for x, y in zip(*keys))


def test_groups_match_comparing_all(awkward, spark, nothing):
    rows = awkward.collect()
    prints = {i: fingerprint(r.text) for i, r in enumerate(rows)}
    of_print = linked(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            root = of_print[prints[i]]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, prints[i], least.get(of_print[prints[i]])) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.id, r.fp % 2**64, r.component) for r in simhash.near_groups(awkward).collect()), key=str)
    assert got == want
    assert simhash.near_groups(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} >= {c for _, _, c in want if c is not None}


def test_large_keys_are_cut_into_blocks(spark):
    rng = random.Random(4)
    core = rng.getrandbits(64)
    fps = {core}
    while len(fps) < 400:
        x = rng.choice(list(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    want = linked([f for (f,) in signed], lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    for block in (7, 50, 10_000):
        roots = {r.node: r.root for r in common.components(simhash.links(frame, block)).collect()}
        assert all(roots.get(f, f) == want[f] for (f,) in signed)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    frame = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    roots = {r.node: r.root for r in common.components(frame).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}}
