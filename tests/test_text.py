import random
import re

from pyspark.sql import functions as F

from guardlake.functions import fixed_values as fv
from guardlake.functions import text as tx
from guardlake.functions import verdicts as vd

PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_null_keeping_inequality_and_length(spark):
    rows = [(None, "x" * 31), (fv.GIVE_AWAY_COMPLETION, "x" * 30), ("other", None), ("", "é😀" * 16)]
    got = values(spark, rows, "c string, t string", tx.differs(F.col("c"), fv.GIVE_AWAY_COMPLETION), tx.longer_than(F.col("t")))
    assert got == [(True, True), (False, False), (True, False), (True, True)]


def test_truncation_counts_code_points(spark):
    rows = [("😀" * 2001,), ("a" * 2000,), (None,)]
    got = values(spark, rows, "t string", tx.truncated(F.col("t")))
    assert got == [("😀" * 2000,), ("a" * 2000,), (None,)]


def test_redaction_equals_plain_pattern_on_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.@-c1 %") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["x" * 5000 + "@" + "y" * 5000 + ".de", "a@b.com-x@c.org", "a@b.comx@c.org", "<EMAIL_ADDRESS>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    redacted = tx.redact(F.col("t"))
    got = df.select("t", redacted.alias("r"), tx.redact(redacted).alias("again"), tx.entity_values(F.col("t"), tx.EMAIL_ADDRESS).alias("v"))
    for row in got.collect():
        assert row.r == PLAIN_EMAIL.sub("<EMAIL_ADDRESS>", row.t)
        assert row.v == PLAIN_EMAIL.findall(row.t)
        assert row.again == row.r


def test_redacts_several_entities_and_custom_ones(spark):
    text = "My mail: temp@slkd.com and My passport: 191280342 and my phone number: (212) 555-1234."
    got = values(spark, [(text,)], "t string", tx.redact(F.col("t"), tx.DEFAULT_ENTITIES))
    assert got == [("My mail: <EMAIL_ADDRESS> and My passport: <PASSPORT> and my phone number: <PHONE_NUMBER>.",)]
    custom = tx.entities_from_json('[{"name": "SHOE", "patterns": ["size [0-9]+", "eu[0-9]{2}"]}]')
    got = values(spark, [("size 4 or eu42",)], "t string", tx.redact(F.col("t"), custom))
    assert got == [("<SHOE> or <SHOE>",)]


def test_token_cap(spark):
    assert values(spark, [("  a b\n\nc\td ",), ("",), (None,)], "t string", tx.token_cap(F.col("t"), 3)) == [
        ("a b c",), ("",), (None,)
    ]


def test_labels_softmax_and_class_modes(spark):
    rows = [([0.0, 2.0],), ([2.0, 0.0],), ([0.1, 0.2],), ([1.0, 1.0],), ([0.0, 0.0, 3.0],)]
    s = F.col("s")
    got = values(
        spark, rows, "s array<double>", vd.argmax_label(s, ["LABEL_0", "LABEL_1", "LABEL_2"]), vd.class_verdict(s),
        vd.class_verdict(s, "confidence"), F.round(F.array_max(vd.softmax(s)), 4),
    )
    assert got == [
        ("LABEL_1", True, True, 0.8808), ("LABEL_0", False, False, 0.8808), ("LABEL_1", True, False, 0.525),
        ("LABEL_0", False, False, 0.5), ("LABEL_2", True, False, 0.9094),
    ]


def test_refusal_markers(spark):
    rows = [("NOT ALLOWED", None), ("not allowed", None), (None, "it did not pass"), (None, "timeout"), (None, None)]
    got = values(spark, rows, "r string, e string", vd.refused(F.col("r"), F.col("e")), vd.other_error(F.col("e")))
    assert got == [(True, None), (False, None), (True, None), (False, "timeout"), (False, None)]


def test_structured_verdict(spark):
    rows = [('{"answer": "a", "credential": true, "reasoning": "r"}',), ("no json",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(vd.parse_verdict(F.col("t")).alias("v")).select("v.*").collect()
    assert tuple(got[0]) == ("a", True, "r", None)
    assert (got[1].credential, got[1]._corrupt) == (None, "no json")


def test_status_name_messages_fallback(spark):
    got = values(spark, [(True, True), (True, False), (False, True)], "u boolean, h boolean", vd.guard_status(F.col("u"), F.col("h")))
    assert got == [("hit",), ("pass",), ("off",)]
    got = values(
        spark, [(["b", "a"],), ([],)], "f array<string>", vd.config_name(F.lit("m"), F.col("f"))
    )
    assert got == [("m a b",), ("m",)]
    made = spark.createDataFrame([("hi", True), ("yo", False)], "t string, s boolean").select(
        vd.prompt_messages(F.col("t"), "simple", "structured", F.col("s")).alias("m")
    ).collect()
    assert [[(m.role, m.content) for m in r.m] for r in made] == [
        [("system", "structured"), ("user", "hi")], [("system", "simple"), ("user", "yo")]
    ]
    assert values(spark, [(None,), ("x",)], "t string", vd.with_fallback(F.col("t"))) == [(fv.FALLBACK_RESPONSE,), ("x",)]


def test_unknown_role_is_an_error():
    import pytest

    with pytest.raises(ValueError):
        vd.message("tool", F.lit("x"))
