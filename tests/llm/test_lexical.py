import math
import re
from collections import Counter

from guardlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for name, text in items:
        found = []
        for i, c in counted:
            n = sum(c.values())
            score = 0
            for t in set(terms_of(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(name, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(found)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_ranks_match_scoring_all(spark, awkward, monkeypatch):
    monkeypatch.setattr(lexical, "SEED_ROWS", 5)
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 7)
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    texts = [t for _, t in docs if t]
    items = [(0, texts[8][:60]), (1, texts[4]), (2, None), (3, " .,;"), (4, "zzzzzz"), (5, texts[12]), (6, texts[30]), (7, "É_é A1 a1"), (8, texts[5])]
    items += [(9, "no id"), (9, texts[20]), (5, texts[12])]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS name", "4 AS block")
    for block_terms in (1_000_000, 60):
        got = lexical.ranked(awkward, frame, block_terms=block_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        want = plain(docs, list(dict.fromkeys(items)))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_ties_go_to_smaller_ids_in_hot_groups(spark):
    docs = [(i, "alpha beta beta" if i % 3 else f"alpha w{i}") for i in range(400, 0, -1)]
    items = [(1, "beta"), (2, "alpha"), (3, "w9 alpha beta")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.ranked(*frames).collect())) == sorted(plain(docs, items))


def test_no_rows(spark, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(nothing, items).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), items).count() == 0
    assert lexical.ranked(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 5)
    text = "Ab-c é9 " * 20 + "x" * 40
    assert [w.decode() for part in lexical.words(text.encode()) for w in part] == terms_of(text)


def test_bounds_leave_rows_unscored(spark):
    """Short vectors and rows without the heavy terms are ruled out before they are scored."""
    import numpy as np
    import pyarrow as pa

    block = lexical.Block([[b"a", b"b"]])
    block.weigh(1000, {0: 5, 1: 900})
    rows = [[0], [1], [0, 1]] * 10
    impacts = [[900_000] * len(r) for r in rows]
    norm = [math.sqrt(sum(block.weight[t] * x * x for t, x in zip(r, v))) for r, v in zip(rows, impacts)]
    lists = [pa.array(v, pa.list_(pa.int32())) for v in (rows, impacts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(norm), *lists], names=["id", "norm", "terms", "impacts"])
    found = lexical.Found(10, np.array([int(block.weight.sum()) * 900_000]))
    assert lexical.search_bucket(block, lexical.Bucket(batch), [0], found) == [0]
    assert found.rows[0][2].tolist() == list(range(2, 30, 3))
    found = lexical.Found(10, np.array([10**12]))
    assert lexical.search_bucket(block, lexical.Bucket(batch), [0], found) == []
