import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from guardlake.llm import packing
from guardlake.llm.common import tokenizer_path

WORDS = "word_bpe_49k.json"


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORDS)).encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_and_places(awkward, nothing):
    capacity = 64
    packed = packing.pack(awkward, tokenizer_path(WORDS), capacity=capacity)
    rows = packed.collect()
    want = Counter()
    for r in awkward.collect():
        ids = ids_of(r.text)
        for p, start in enumerate(range(0, len(ids), capacity)):
            data = np.array(ids[start : start + capacity], dtype="<u4").tobytes()
            want[r.doc_id, p, start, len(data) // 4, zlib.crc32(data)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / capacity + 1
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in bins.items()}
    assert packing.pack(nothing, tokenizer_path(WORDS)).count() == 0


def test_many_buckets_rank_every_length_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = [(i, 0, (i * 37) % 11 + 1) for i in range(500)] + [(i, 1, 5) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, piece int, length long")
    bins = defaultdict(list)
    for r in packing.place(items, 16).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 700
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16


@pytest.mark.parametrize("text", [
    "Grüße, ΣΊΣΥΦΟΣ x y　z a\x1cb\x0bc\x85d", "don't we'll I'M 12345 a--b!!", "é ́x İstanbul ﬁ ǅ",
    "<|endoftext|> a<|startoftext|>b <|end oftext|>", "日本語 テキスト\nالعربية", "\U0001f600\U0001f600x ퟿", "a\r\nb\tc  d",
])
def test_remembered_stretches_give_the_tokenizers_ids(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = packing.pieces(docs, tokenizer_path(WORDS)).first()
    assert np.frombuffer(row.ids, dtype="<u4").tolist() == ids_of(text)


def test_forgetting_words_changes_nothing(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeÉ9.,") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").coalesce(1)
    for remember in (20, 600_000):
        rows = packing.pieces(docs, tokenizer_path(WORDS), remember=remember).collect()
        assert {r.id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in rows} == {**{i: ids_of(t) for i, t in enumerate(texts)}, 99: [1]}


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        packing.Words(tokenizer_path("byte_bpe_50k.json"), 1, 100)


def test_plan_is_gapless_and_tight():
    rng = random.Random(6)
    for capacity in (10, 97, 4096):
        for _ in range(10):
            counts = Counter(rng.choice((rng.randint(1, capacity), rng.randint(1, max(1, capacity // 6)))) for _ in range(rng.randint(1, 900)))
            runs, bins = packing.packing_plan(dict(counts), capacity)
            content, large = defaultdict(list), Counter()
            for n, number in counts.items():
                own = sorted(r for r in runs if r[0] == n)
                for run, stop in zip(own, [r[1] for r in own[1:]] + [number]):
                    for k in range(run[1], stop):
                        spot = run[2] + (k - run[1]) // run[3]
                        content[spot].append((run[4] + (k - run[1]) % run[3] * n, n))
                        large[spot] += 3 * n > capacity
            assert len(content) == bins and max(large.values(), default=0) <= 2
            for parts in content.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert sum(counts.values()) == sum(map(len, content.values()))


def test_plan_size_does_not_follow_the_data():
    few = {n: 3 for n in range(1, 513)}
    many = {n: 3_000_000 for n in range(1, 513)}
    assert len(packing.packing_plan(many, 512)[0]) < 4 * len(packing.packing_plan(few, 512)[0])
