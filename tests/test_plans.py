import pytest
from pyspark.sql import functions as F

from guardlake.functions import fixed_values as fv
from guardlake.operators.curate import class_quota
from guardlake.plans import ablation, corpus, evaluation, registered, turns
from guardlake.sources import writers
from tests.conftest import plan_of

LEVELS = [
    {"level": 0, "use_prompt_protection": False, "use_output_rail": False, "use_tool_rails": False, "emails": ["a@b.de"]},
    {"level": 1, "use_prompt_protection": False, "use_output_rail": True, "use_tool_rails": False, "emails": ["c@d.de"]},
    {"level": 2, "use_prompt_protection": True, "use_output_rail": True, "use_tool_rails": True, "emails": []},
]


def test_guarded_turn(spark):
    rows = [
        (1, 0, "a@b.de", "never shown"), (2, 0, "bad", "mail a@b.de"), (3, 1, "a@b.de", "mail a@b.de"),
        (4, 2, "bad", "mail a@b.de"), (5, 2, "good", "fine"), (6, 0, "x", None), (7, 0, "y", "say EMAIL_ADDRESS"),
        (8, 0, "a@b.de" + "x" * 1994 + "cut", "ok"),
    ]
    df = spark.createDataFrame(rows, "id int, level int, text string, response string")
    got = {r.id: r for r in turns.guard_turns(df, LEVELS, F.col("text") == "bad", ["id"]).collect()}
    assert got[1].correct and got[1].response is None and got[1].output_rail_status is None
    assert (got[2].response, got[2].tool_rail_hit, got[2].prompt_protection_status) == ("mail a@b.de", False, "off")
    assert not got[3].correct and got[3].response == "mail <EMAIL_ADDRESS>"
    assert (got[3].tool_rail_hit, got[3].output_rail_hit, got[3].tool_rail_status) == (False, True, "off")
    # The marker the tool rail leaves also counts for the output rail.
    assert (got[4].prompt_protection_hit, got[4].tool_rail_hit, got[4].output_rail_hit) == (True, True, True)
    assert (got[5].prompt_protection_status, got[5].output_rail_status) == ("pass", "pass")
    assert got[6].response == fv.FALLBACK_RESPONSE
    assert got[7].tool_rail_hit and not got[7].output_rail_hit and got[7].tool_rail_status == "off"
    assert len(got[8].text) == fv.MAX_INPUT_CHARS and not got[8].correct
    total = {(r.guard, r.level, r.status): r.n_turns for r in turns.guard_summary(turns.guard_turns(df, LEVELS, F.lit(False), ["id"])).collect()}
    assert total[(None, None, None)] == 21 and total[("output_rail", 1, "hit")] == 1


def test_ablation_gate_blocks_and_rails_redact(spark):
    prompts = spark.createDataFrame(
        [(1, "bad", "mail a@b.de"), (2, "good", "ed.b@a reversed"), (3, "good", "clean"), (4, "good", None)],
        "id bigint, data string, response string",
    )
    secrets = spark.createDataFrame([("a@b.de",)], "email string")
    gate = F.col("data") == "bad"
    configs = [ablation.GuardConfig(f) for f in ((), ("use_output_rail",), ("use_pretrained_classifier",))]
    wide = ablation.ablation_wide(prompts, "id", "response", gate, configs, "m", secrets, "email")
    got = {r.id: r for r in wide.collect()}
    assert got[1]["m"] == "mail a@b.de" and got[1]["m use_output_rail"] == "mail <EMAIL_ADDRESS>"
    assert got[1]["m use_pretrained_classifier"] == fv.GATE_RESPONSE
    assert got[4]["m"] == fv.FALLBACK_RESPONSE
    assert [got[i]["leaks for config: m"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [got[i]["leaks for config: m use_output_rail"] for i in (1, 2, 3, 4)] == [False, True, False, False]
    rates = ablation.leak_rate(prompts, "id", "response", gate, configs, "m", secrets, "email").collect()
    assert {r.config_name: (r.n_prompts, r.n_leaks, r.leak_rate) for r in rates} == {
        "m": (4, 2, 0.5), "m use_output_rail": (4, 1, 0.25), "m use_pretrained_classifier": (4, 1, 0.25)
    }
    long = ablation.ablation_long(prompts, "id", "response", gate, configs, "m", secrets, "email")
    again = ablation.leak_rate_of(long).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rates}
    pivoted = {r.id: r["m"] for r in ablation.to_wide(long, "id", ["m"], "leak").collect()}
    assert pivoted == {1: True, 2: True, 3: False, 4: False}
    with pytest.raises(ValueError):
        ablation.GuardConfig(("use_magic",))


def test_evaluation_fails_on_a_null_prediction(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "text string, y boolean")
    fine = evaluation.evaluate(df, {"d": F.col("text") == "a"}, "y", "text", "set").first()
    assert (fine.dataset, fine.model, fine.f1, fine.tn) == ("set", "d", 1.0, 1)
    with pytest.raises(Exception, match="no prediction for text"):
        evaluation.evaluate(df, {"d": F.when(F.col("text") == "a", True)}, "y", "text", "set").collect()


def test_corpus_is_balanced_disjoint_and_written_by_split(spark, tmp_path):
    rows = [(i, f"t{i}", i % 2 == 0, [float(i % 7), float(i % 11), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, text string, prompt_injection boolean, v array<double>")
    built = corpus.build_corpus(df.where("prompt_injection"), df.where("NOT prompt_injection"), 51, "id", "v", 0, 1)
    path = str(tmp_path / "corpus")
    writers.write_splits(built, path)
    back = spark.read.parquet(path)
    assert back.count() == 51 and back.select("id").distinct().count() == 51
    assert {r.prompt_injection: r["count"] for r in back.groupBy("prompt_injection").count().collect()} == class_quota(51)
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 40, "test": 5, "val": 6}


def test_no_plan_has_a_cartesian_product_or_nested_loop(spark, data):
    for name in ("ablation_leak_rate", "leak_reversed", "exact_guess", "policy_hits", "exemplar_similarity",
                 "turn_guard", "corpus_split", "corpus_attack", "history_last10", "progression", "prf1"):
        plan = plan_of(registered.QUERIES[name](spark, data))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scans_read_only_what_they_need(spark, data):
    plan = plan_of(registered.redact_email(spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    assert "Exchange" not in plan_of(registered.corpus_hash_split(spark, data))
    assert "Exchange" not in plan_of(registered.turn_guard(spark, data))
    assert "PushedFilters: [In(lang, [de,en])" in plan_of(registered.corpus_benign(spark, data))


def test_split_never_shuffles_texts(spark, data):
    docs = registered.table(spark, data, "documents").withColumn("prompt_injection", F.col("doc_id") % 2 == 0)
    from guardlake.operators.ordering import exact_split

    plan = plan_of(exact_split(docs, "doc_id", "prompt_injection"))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("text" in line for line in exchanges)
    assert plan.count("text#") and "BroadcastHashJoin" in plan
