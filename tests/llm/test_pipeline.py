import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from guardlake.llm import mixing, packing, quality
from guardlake.llm.common import table
from guardlake.session import settled
from tests.llm.test_exact import plain as exact_plain
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import fingerprint, linked


def test_every_stage_against_its_plain_version(spark, data):
    docs = table(spark, data, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "source mixing", "best-fit packing"
    ]
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(settled(stage(spark, states[-1], data), "state"))
    assert all(s.columns == docs.columns for s in states[1:-1])
    raw, good, single, apart, mixed, packed = (s.collect() for s in states)

    stats = settled(quality.statistics(docs), "statistics")
    scores = quality.scored(stats, quality.fit(stats, table(spark, data, "labels")))
    want = {r.id for r in scores.where("predicted = 1").collect()}
    assert {r.doc_id for r in good} == want and set(good) <= set(raw)
    bad = {r.doc_id for r in table(spark, data, "labels").where("quality = 0").collect()}
    assert len(bad & want) <= 0.1 * len(bad)

    assert {r.doc_id for r in single} == {r[0] for r in exact_plain(good) if r[3]} and set(single) <= set(good)

    prints = {r.doc_id: fingerprint(r.text) for r in single}
    of_print = linked(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: 1 << 62)
    for i, f in prints.items():
        least[of_print[f]] = min(least[of_print[f]], i)
    assert {r.doc_id for r in apart} == set(least.values()) and set(apart) <= set(single)

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {r.doc_id: words(r.text) for r in apart}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += words(r.text)
    assert all(taken[i] <= 2 * n for i, n in size.items()) and set(taken) <= set(size)
    names = sorted({r.source for r in apart})
    sizes = [sum(size[r.doc_id] for r in apart if r.source == n) for n in names]
    for name, aim in zip(names, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        got = sum(taken[r.doc_id] for r in apart if r.source == name)
        assert abs(got - aim) <= 0.02 * aim + 2 * mixing.LEAST_BLOCKS

    assert sum(r.length for r in packed) == sum(len(ids_of(r.text)) for r in mixed)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= 1.05 * sum(fill.values()) / packing.CAPACITY + 1


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing, data):
    """Nulls, ties, repeats, rows that share an id or have none, clashing columns; and no rows at all."""
    stages = dict(corpus_pipeline.STAGES)
    twins = spark.createDataFrame([(3, "alpha beta gamma delta epsilon"), (3, "zeta eta theta iota kappa"), (None, "zeta eta theta iota kappa")],
                                  "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    twins = twins.withColumn("n_chars", F.length("text").cast("long"))
    docs = awkward.unionByName(twins, allowMissingColumns=True)
    for rows in (docs, nothing):
        number, kept = rows.count(), rows
        for name in ("quality classifier", "exact dedup", "SimHash near-dedup", "source mixing"):
            kept = settled(stages[name](spark, kept, data), "awkward_stage")
            assert kept.columns == rows.columns
            assert kept.count() <= (number if name != "source mixing" else 3 * number)
        packed = settled(stages["best-fit packing"](spark, kept, data), "awkward_packed").collect()
        assert sum(r.length for r in packed) == sum(len(ids_of(r.text)) for r in kept.collect())
    single = settled(stages["SimHash near-dedup"](spark, docs, data), "awkward_single").collect()
    texts = Counter(r.text for r in single)
    assert max(texts.values()) == 1 and texts["alpha beta gamma delta epsilon"] == 1 and texts["zeta eta theta iota kappa"] == 1
    assert sum(not (r.text or "").split() for r in single) == 1
