import hashlib
import random
import re
from collections import defaultdict

from guardlake.llm import exact


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    out = []
    for bare, members in groups.items():
        most = max(len(r.text or "") for r in members)
        keep = min((r.doc_id is None, r.doc_id or 0) for r in members if len(r.text or "") == most)
        keep = None if keep[0] else keep[1]
        for r in members:
            kept = r.doc_id == keep and len(r.text or "") == most
            out.append((r.doc_id, keep, len(members), kept, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **more):
    rows = exact.exact_groups(docs, **more).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.sha256) for r in rows), key=str)


def test_groups_match_plain_comparison(awkward):
    assert found(awkward) == plain(awkward.collect())


def test_clashing_chunk_hashes_are_told_apart(awkward, spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 9000))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    assert found(docs, hash_bytes=1) == plain(docs.collect())


def test_keep_one_and_empty(awkward, nothing):
    kept = exact.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = {(r[0], r[4]) for r in plain(awkward.collect()) if r[3]}
    got = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_groups(nothing).count() == 0 and exact.keep_one(nothing).count() == 0


def test_chunks_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    parts = [body, b"moved " * 7 + body, b""]
    chunks = [{p[a:b] for a, b in zip([0, *e[:-1]], e)} for p, e in zip(parts, exact.chunk_bounds(parts))]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 and not chunks[2]
    assert exact.chunk_bounds([body])[0] == exact.chunk_bounds(parts)[0]
