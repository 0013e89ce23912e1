import random

import pytest
from pyspark.sql import functions as F

from guardlake.operators import leak


def brute(texts, secrets):
    return {
        i for i, t in texts if t is not None and any(s in t or s[::-1] in t for s in secrets if s)
    }


def test_address_join_equals_containment(spark):
    rng = random.Random(3)
    secrets = ["a@b.de", "ab.c@d.org", "b@c.com", "x1@y2.de", "q" * 70 + "@b.de", "a@" + "r" * 80 + ".de"]
    texts = []
    for i in range(600):
        text = "".join(rng.choice("ab.@cde org") for _ in range(rng.randrange(25)))
        if i % 3 == 0:
            s = rng.choice(secrets)
            text += rng.choice(["", "z", " ", "@"]) + (s if i % 2 else s[::-1]) + rng.choice(["", "m", ".", "@a"])
        texts.append((i, text))
    texts += [(1000, None), (1001, ""), (1002, "@"), (1003, "q" * 69 + "@b.de"), (1004, "zq" * 500 + "q" * 70 + "@b.dex")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    table = spark.createDataFrame([(s,) for s in secrets] + [(None,)], "s string")
    got = {r.id for r in leak.leaked(df, "id", ["t"], table, "s").where("t").collect()}
    assert got == brute(texts, secrets)
    inline = {r.id for r in df.where(leak.holds_secret(F.col("t"), secrets)).collect()}
    assert inline == got


def test_any_secret_equals_containment(spark):
    rng = random.Random(4)
    secrets = ["abc", "b d", "é😀", "cab@", "a@b", "dd"]
    texts = [(i, "".join(rng.choice("abcd @é😀") for _ in range(rng.randrange(14)))) for i in range(800)]
    df = spark.createDataFrame(texts + [(9999, None)], "id bigint, t string")
    table = spark.createDataFrame([(s,) for s in secrets], "s string")
    got = {r.id for r in leak.leaked(df, "id", ["t"], table, "s").where("t").collect()}
    assert got == brute(texts, secrets)


def test_several_text_columns(spark):
    df = spark.createDataFrame([(1, "me: a@b.de", "none"), (2, "no", "ed.b@a"), (3, "no", None)], "id bigint, x string, y string")
    table = spark.createDataFrame([("a@b.de",)], "s string")
    got = {tuple(r) for r in leak.leaked(df, "id", ["x", "y"], table, "s").collect()}
    assert got == {(1, True, False), (2, False, True)}


def test_many_lengths_long_secrets_and_shared_anchors(spark):
    rng = random.Random(5)
    letters = "abcdefgh @é😀\n"
    secrets = ["".join(rng.choice(letters) for _ in range(n)) for n in range(1, 601)][8:]
    secrets += ["https://example.com/same/start/of/all/" + str(i) * 3 for i in range(50)] + ["", "a@b@c", "@end", "end@"]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(900)))) for i in range(120)]
    texts += [(200 + i, "x" + s + "y") for i, s in enumerate(secrets[::7])]
    texts += [(400 + i, "x" + s[::-1][1:]) for i, s in enumerate(secrets[::9])] + [(None, "id " + secrets[300])]
    df = spark.createDataFrame(texts, "id bigint, t string")
    table = spark.createDataFrame([(s,) for s in secrets], "s string")
    got = {r.id for r in leak.leaked(df, "id", ["t"], table, "s").where("t").collect()}
    assert got == brute(texts, secrets) and None in got


def test_no_secrets(spark):
    df = spark.createDataFrame([(1, "a@b")], "id bigint, x string")
    table = spark.createDataFrame([("",), (None,)], "s string")
    assert leak.leaked(df, "id", ["x"], table, "s").count() == 0


def test_exact_guess_has_no_trim_or_fold(spark):
    turns = spark.createDataFrame([(0, "a@b.de"), (0, " a@b.de"), (0, "A@b.de"), (1, "a@b.de"), (1, None)], "level int, text string")
    secrets = spark.createDataFrame([(0, "a@b.de"), (0, "a@b.de"), (1, "c@d.de")], "level int, secret string")
    got = leak.with_exact_guess(turns, "level", "text", secrets, "secret")
    assert {(r.level, r.text): r.correct for r in got.collect()} == {
        (0, "a@b.de"): True, (0, " a@b.de"): False, (0, "A@b.de"): False, (1, "a@b.de"): False, (1, None): False
    }
    assert got.count() == 5


def test_inline_list_is_bounded():
    with pytest.raises(ValueError):
        leak.holds_secret(F.lit("x"), [str(i) for i in range(leak.MAX_INLINE_SECRETS + 1)])


def test_short_secrets_and_bytes_of_other_scripts(spark):
    rng = random.Random(6)
    secrets = ["a", "zq", "é", "xyz", "日本", "😀"]
    texts = [(i, "".join(rng.choice("bcdxyzq日本é ") for _ in range(rng.randrange(6)))) for i in range(300)]
    texts += [(900, "Ã©"), (901, None), (902, "")]
    df = spark.createDataFrame(texts, "id bigint, t string").repartition(3)
    for some in (secrets, secrets[1:], secrets[3:4], secrets[4:]):
        table = spark.createDataFrame([(s,) for s in some], "s string")
        got = {r.id for r in leak.leaked(df, "id", ["t"], table, "s").where("t").collect()}
        assert got == brute(texts, some)


def test_anchors_are_the_rarest_windows_and_texts_stay_home(spark, monkeypatch):
    """Secrets that begin alike meet texts at their rare end; what travels is far below the texts."""
    monkeypatch.setattr(leak, "CUT_BYTES", 1000)
    monkeypatch.setattr(leak, "PIECE_BYTES", 500)
    rng = random.Random(7)
    secrets = [f"the common start of it {'q' * (i % 3)}{i:04d}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(["the", "common", "start", "of", "it"]) for _ in range(400))) for i in range(300)]
    texts += [(400 + i, "x" * 600 + secrets[i] + texts[i][1]) for i in range(0, 200, 5)]
    texts += [(900, secrets[7][:-1]), (901, secrets[8] * 3)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    table = spark.createDataFrame([(s,) for s in secrets], "s string")
    assert {r.id for r in leak.leaked(df, "id", ["t"], table, "s").collect()} == brute(texts, secrets)
    flat = df.select("id", F.col("t").cast("binary").alias("_text"))
    whole = leak.secret_forms(table, "s").select(F.col("_secret").cast("binary").alias("_secret"))
    anchors = leak.anchored(whole, leak.window_counts(flat, whole))
    assert anchors.count() == 2 * len(secrets)
    starts = [r for r in anchors.collect() if bytes(r["_secret"]).startswith(b"the")]
    assert all(r["_before"] > len("the common") for r in starts)
    cut = leak.pieces_at(flat, ["id"], anchors, {}).agg(F.sum(F.octet_length("_piece"))).first()[0]
    assert cut < 0.1 * sum(len(t) for _, t in texts)


def test_overlapping_places_of_an_anchor_are_one_piece(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "a" * 30 + "b")], "id bigint, t string")
    table = spark.createDataFrame([("a" * 40,), ("a" * 20 + "b",)], "s string")
    assert {r.id for r in leak.leaked(df, "id", ["t"], table, "s").collect()} == {1, 2}
    flat = df.select("id", F.col("t").cast("binary").alias("_text"))
    whole = leak.secret_forms(table, "s").select(F.col("_secret").cast("binary").alias("_secret"))
    pieces = leak.pieces_at(flat, ["id"], leak.anchored(whole, leak.window_counts(flat, whole)), {})
    assert pieces.where("id = 1").agg(F.sum(F.octet_length("_piece"))).first()[0] <= 2 * 5000
