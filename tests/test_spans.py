import random
import re

import pytest
from pyspark.sql import functions as F

from guardlake.functions import text as tx
from guardlake.operators import spans

RULES = (tx.Entity("MAIL", "[a-z]+@[a-z]+\\.[a-z]+"), tx.Entity("HOST", "[a-z]+\\.[a-z]+"), tx.Entity("WORD", "[a-z]{4,}"), tx.Entity("NO", "[0-9]+"))


def plain(text, rules):
    """Matches in the order in which they win; each stays unless it meets one that stayed."""
    found = sorted(
        (place, m.start() - m.end(), m.start(), e.name, m.end(), m[0]) for place, e in enumerate(rules) for m in re.finditer(e.pattern, text or "")
    )
    stay = []
    for _, _, start, name, end, value in found:
        if all(end <= a or b <= start for a, b, *_ in stay):
            stay.append((start, end, name, value))
    return sorted(stay)


def test_overlaps_are_settled_and_redacted_in_one_pass(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab@.c 1é😀") for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(400, None), (401, ""), (402, "abcd@ef.gh"), (403, "xx abcd@ef.gh.ij 12"), (404, "a.b" * 3000)]
    df = spark.createDataFrame(texts, "id bigint, t string").repartition(3)
    want = {i: plain(t, RULES) for i, t in texts}
    found = spans.entity_spans(df, "id", "t", RULES)
    for rows in (found, found.orderBy(F.desc("start")).unionByName(found)):
        got = {}
        for r in spans.resolve(rows, "id").collect():
            got.setdefault(r.id, []).append((r.start, r.end, r.entity, r.value))
        assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    redacted = {r.id: r.t for r in spans.redact_spans(df, "id", "t", spans.resolve(found, "id")).collect()}
    for i, t in texts:
        made, at = "", 0
        for start, end, name, _ in want[i]:
            made, at = made + t[at:start] + f"<{name}>", end
        assert redacted[i] == (None if t is None else made + t[at:])


def test_priority_is_named_not_found_by_order(spark):
    df = spark.createDataFrame([(1, "mail abcd@ef.gh")], "id bigint, t string")
    found = spans.entity_spans(df, "id", "t", RULES).withColumn("priority", 9 - F.col("priority"))
    got = sorted((r.entity, r.value) for r in spans.resolve(found, "id").collect())
    assert got == [("HOST", "ef.gh"), ("WORD", "abcd"), ("WORD", "mail")]


def test_names_of_several_words(spark):
    texts = [
        (1, "So Ada Lovelace, met (Charles  Babbage)!\nAda ran."), (2, "Ada Lovelace King and Ada Lovelace\tKing-Noel"), (3, None), (4, ""),
        (5, "King Ada Lovelace King Ada"), (6, "é😀 Ada Lovelace"),
    ]
    names = [("Ada Lovelace",), ("Charles Babbage",), ("Ada",), ("Ada Lovelace King",), ("King Ada",), (None,), (" ",)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    table = spark.createDataFrame(names, "n string")
    found = spans.name_spans(df, "id", "t", table, "n")
    got = {}
    for r in spans.resolve(found, "id").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.value))
    by_id = dict(texts)
    assert {i: sorted(v) for i, v in got.items()} == {
        1: [(3, 15, "Ada Lovelace"), (22, 38, "Charles Babbage"), (41, 44, "Ada")],
        2: [(0, 17, "Ada Lovelace King"), (22, 34, "Ada Lovelace")],
        5: [(5, 22, "Ada Lovelace King"), (23, 26, "Ada")],
        6: [(3, 15, "Ada Lovelace")],
    }
    assert all(by_id[i][a:b].replace("  ", " ") == v for i, rows in got.items() for a, b, v in rows)
    with pytest.raises(ValueError):
        spans.name_spans(df, "id", "t", spark.createDataFrame([("a b c",)], "n string"), "n", max_words=2)
