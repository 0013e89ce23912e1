import re
from collections import Counter, defaultdict

import numpy as np

from guardlake.llm import mixing

RUN = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights):
    capped, out = set(), {}
    while True:
        rest = 1.5 * sum(sizes) - sum(2.0 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        out = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if out[i] > 2.0 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in capped else out[i] for i in range(len(sizes))]
        capped |= over


def test_targets():
    for sizes in ([100, 100, 100], [1, 1000, 5], [0, 10, 0, 7], [5], [0, 0]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert np.allclose(mixing.targets(sizes, weights), plain_targets(sizes, weights))
        else:
            assert mixing.targets(sizes, weights) == [0.0] * len(sizes)


def test_mix_of_awkward_rows(awkward, nothing):
    rows = awkward.collect()
    got = mixing.mix(awkward).collect()
    assert Counter((r.id, r.size, r.source) for r in got) == Counter(
        (r.doc_id, len(RUN.findall(r.text or "")), r.source) for r in rows
    )
    names = sorted({r.source for r in rows if r.source is not None}) + [None]
    sizes = [sum(len(RUN.findall(r.text or "")) for r in rows if r.source == n) for n in names]
    want = dict(zip(names, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[names.index(r.source)] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    for name in names:
        assert abs(taken[name] - want[name]) <= 2 * mixing.BLOCK_WORDS + 0.01 * want[name]
    again = mixing.mix(awkward.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_many_buckets_of_a_stream_are_one_stream(awkward, monkeypatch):
    sizes = mixing.sized(awkward).where("size > 0").cache()
    catalogue = mixing.sources(sizes)
    for rows in (3, 20, 10_000):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        placed = mixing.streams(sizes, catalogue).collect()
        assert len(placed) == sizes.count()
        for no, source in enumerate(catalogue):
            at = 0
            for r in sorted((r for r in placed if r.source_no == no), key=lambda r: r.begin):
                assert (r.begin, r.end) == (at, at + r.size)
                at = r.end
            assert at == source.size


def test_blocks_cover_what_is_taken_and_documents_keep_their_words(awkward):
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.id: r.taken for r in mixing.mix(docs).collect()}
    blocks = mixing.mixed_blocks(docs).collect()
    per = Counter()
    for b in blocks:
        per[b.id] += b.n_words
    assert all(per[i] == t for i, t in taken.items())
    assert len({(b.shard, b.slot) for b in blocks}) == len({(b.source_no, b.epoch, b.block) for b in blocks})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = {r.doc_id: RUN.findall(r.text or "") for r in docs.collect()}
    words = Counter()
    for r in mixed.collect():
        own = RUN.findall(r.text)
        words[r.doc_id] += len(own)
        spare = iter(texts[r.doc_id])
        assert all(w in spare for w in own) and r.n_chars == len(r.text)
    assert all(words[i] == t for i, t in taken.items())


def test_shards_draw_every_slot_once():
    slots, per_shard = [1000, 37, 0, 5000], 256
    shards = -(-sum(slots) // per_shard)
    drawn = [mixing.ShardCounts(slots, shards, per_shard, 3).of(s) for s in range(shards)]
    path = mixing.ShardCounts(slots, shards, per_shard, 3)
    assert all((a == b).all() for s in range(shards) for a, b in zip(path.of(s), drawn[s]))
    assert np.array_equal(sum(c for c, _ in drawn), slots)
    assert all(np.array_equal(b + c, n) for (c, b), (_, n) in zip(drawn, drawn[1:]))
    assert all(c.sum() == per_shard for c, _ in drawn[:-1])
    big = np.array([3 * 10**9, 10**9, 7])
    got = mixing.hypergeometric(big, 2 * 10**9, np.random.default_rng(1))
    assert got.sum() == 2 * 10**9 and (got <= big).all() and abs(got[0] / 1.5e9 - 1) < 1e-3


def test_permutations():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, (1, n)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, (1, 2)).tolist() != mixing.permuted(np.arange(1000), 1000, (1, 3)).tolist()


def test_large_draws_follow_the_exact_law():
    """Small numbers against the probabilities themselves, large ones against mean, variance and the normal limit."""
    import math

    rng = np.random.default_rng(5)
    good, bad, number = 30, 50, 20
    seen = Counter(mixing.large_hypergeometric(good, bad, number, rng) for _ in range(4000))
    chi = 0.0
    for k in range(21):
        want = 4000 * math.comb(good, k) * math.comb(bad, number - k) / math.comb(good + bad, number)
        if want >= 5:
            chi += (seen[k] - want) ** 2 / want
    assert chi < 40
    good, bad, number = 3 * 10**12, 10**12, 10**11
    p = good / (good + bad)
    spread = math.sqrt(number * p * (1 - p) * (good + bad - number) / (good + bad - 1))
    z = np.array([(mixing.large_hypergeometric(good, bad, number, rng) - number * p) / spread for _ in range(300)])
    assert abs(z.mean()) < 0.25 and 0.8 < z.std() < 1.2 and abs((np.abs(z) < 1).mean() - 0.683) < 0.1
    for few in (0, 1, 3):
        assert 0 <= mixing.large_hypergeometric(few, 10**10, 10**9, rng) <= few
    assert mixing.large_hypergeometric(10**10, 5, 10**10, rng) >= 10**10 - 5


def test_many_sources_cost_what_their_shards_hold(spark):
    import time

    rows = [(i, f"word{i} " * 3, f"s{i:05d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    got = mixing.mix(docs).collect()
    assert len(got) == 4000 and abs(sum(r.taken for r in got) - 18_000) < 1_000 and time.time() - began < 60
