"""Small tables with the awkward cases every operator must define."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, copies, repeated rows, ties, one very long text, and clashing extra columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [None, None, "", " \n\t ", "one", "one two three", "One  two\nthree", prose(5000) + "\n" + prose(20_000)]
    passage = "\n".join(prose(9) + "." for _ in range(5))
    texts += [passage, passage, "intro here\n" + passage + "\nend here", passage.replace(" ", "  ")]
    base = prose(300)
    texts += [base, base + " tail", base.upper(), base.replace(base.split()[50], "changed")]
    texts += [prose(rng.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "row", "size", "begin", "end", "own_id", "mark", "rank", "gone", "bucket", "n_lines", "mix_id"):
        frame = frame.selectExpr("*", f"concat('x', doc_id) AS {name}")
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
