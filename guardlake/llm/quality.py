"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from guardlake.llm.common import bounded_batches, per_text
from guardlake.session import settled

#: At most about this many labelled rows are fitted, chosen by a hash of the id.
FIT_ROWS = 200_000
#: Random features, seeds of the frequencies, folds of the calibration, and tasks that sum normal equations.
FEATURES, SEED, FOLDS, FIT_TASKS = 256, 17, 4, 8
#: Widths of the Gaussian kernel (times the root of the number of statistics) and ridge weights that are tried.
WIDTHS, RIDGES = (0.5, 1.0, 2.0), (1e-3, 1e-2, 1e-1, 1.0)
#: Scores from which a document counts as good, and calibration bins kept of the out-of-fold scores.
GOOD, BINS = 0.3, 2_000

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "high_bytes",
    "marked_words", "pipes", "bangs", "distinct_words", "log_distinct", "top_word", "echoes", "distinct_triples",
    "log_lines", "line_words", "line_spread", "distinct_lines", "line_stops", "short_lines", "sentence_words",
    "capital_words", "upper_words", "byte_entropy", "word_entropy", "common_letters", "long_words", "single_letters",
)


def statistics_of(text: str) -> list[float]:
    """The document statistics of one text; all are 0 for a text without words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    high = int(counts[128:].sum())
    blanks = int(counts[9:14].sum() + counts[32])
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    plain = int(counts[44] + counts[46] + counts[39] + counts[45] + counts[63] + counts[59] + counts[58])
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    often = np.fromiter(kinds.values(), dtype=np.float64, count=len(kinds)) / n
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    triples = set(zip(words, words[1:], words[2:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    in_line = np.array([x.count(b" ") + 1 for x in lines], dtype=np.float64)
    shares = counts[counts > 0] / size
    stops = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    letters = max(1, upper + lower + high)
    ends = sum(w[-1] in b"*$%&#!~^+=<>|@" for w in words)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), upper / letters, digits / size, plain / size,
        (marks - plain) / size, high / size, ends / n, int(counts[124]) / n, int(counts[33]) / n, len(kinds) / n,
        np.log1p(len(kinds)) / np.log1p(n), often.max(), echoes / max(1, n - 1), len(triples) / max(1, n - 2),
        np.log1p(len(lines)), np.log1p(in_line.mean()), in_line.std() / in_line.mean(),
        len(set(lines)) / len(lines), sum(x.rstrip().endswith(b".") for x in lines) / len(lines),
        float((in_line <= 3).mean()), np.log1p(n / max(1, stops)), sum(65 <= w[0] <= 90 for w in words) / n,
        sum(len(w) > 1 and w.isupper() for w in words) / n, float(-(shares * np.log2(shares)).sum()),
        float(-(often * np.log2(often)).sum()) / np.log2(n + 1), int(counts[[97, 101, 105, 110, 114, 115, 116]].sum()) / max(1, size - blanks),
        float((lengths > 20).mean()), float((lengths == 1).mean()),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, stats)``: one pass over whole texts, null as empty."""

    def make():
        def work(ids, texts):
            return {"id": ids, "stats": pa.array([statistics_of(t) for t in texts], pa.list_(pa.float64()))}

        return work

    return per_text(docs, id_col, text_col, "id ID_TYPE, stats array<double>", make)


def held_out(id_column: Column) -> Column:
    """Rows that no fit sees: checksum of the id as text divisible by five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Means and scales of the statistics, frequencies and phases of the features, ridge weights, calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels) if len(stats) else np.zeros(0)


def features(stats: np.ndarray, mean, scale, frequencies, phases) -> np.ndarray:
    """A constant and cosines whose products approximate a Gaussian kernel over the standardised statistics."""
    x = np.clip((stats - mean) / scale, -8, 8)
    wave = np.cos(x @ frequencies + phases) * np.sqrt(2 / frequencies.shape[1])
    return np.concatenate([np.ones((len(x), 1)), wave], axis=1)


def rising(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: centres and levels of the pooled blocks, by rising score."""
    blocks: list[list[float]] = []
    for s, y, w in zip(scores, labels, weights):
        blocks.append([s * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fitted_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(label_id, y)`` of the rows that are fitted: labelled, not held out, at most about ``fit_rows`` by a hash of the id.

    Of several labels of an id their mean counts, null labels do not.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "label_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    return known


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``fit`` looks at. Their ids are broadcast, a number bounded by ``fit_rows``: texts stay where they are."""
    known = settled(fitted_labels(labels, id_col, label_col, fit_rows).select("label_id"), "fitted_ids")
    return docs.join(F.broadcast(known), docs[id_col] == known["label_id"], "left_semi")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """The model from ``stats`` (settled) and the labels of rows that are not held out.

    Of several labels of an id their mean counts, null labels do not. Each of ``FIT_TASKS`` tasks sums
    the normal equations of its rows per fold and kernel width; Spark adds the sums up, and only they (of a size
    fixed by ``FEATURES``) reach the driver. Ridge weight and width are those with the least error out of fold, and
    the calibration is fitted to out-of-fold scores, pooled to ``BINS`` bins. Without any label all scores are 0.5.
    """
    spark = stats.sparkSession
    known = fitted_labels(labels, id_col, label_col, fit_rows)
    rows = stats.join(known, stats["id"] == known["label_id"])
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(FOLDS)).cast("int")
    rows = settled(rows.select("stats", "y", fold.alias("fold")).repartition(FIT_TASKS), "fit_rows")
    n_stats = len(STATISTICS)
    moments = rows.select(
        F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(n_stats) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    if not moments.n:
        zero = np.zeros(n_stats)
        return Model(zero, zero + 1, np.zeros((n_stats, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([0.5]))
    mean = np.array([moments[f"m{i}"] for i in range(n_stats)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(n_stats)])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    base = rng.standard_normal((n_stats, FEATURES)) / np.sqrt(n_stats)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)

    size = FEATURES + 2
    upper = np.triu_indices(size)

    def sums(batches):
        acc = np.zeros((len(WIDTHS), FOLDS, size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_stats)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            f = batch.column(2).to_numpy(zero_copy_only=False)
            for w, width in enumerate(WIDTHS):
                z = np.concatenate([features(x, mean, scale, base / width, phases), y[:, None]], axis=1)
                for k in range(FOLDS):
                    acc[w, k] += z[f == k].T @ z[f == k]
        flat = [m[upper] for m in acc.reshape(-1, size, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["fit", "part"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": frame["fit"][:1], "part": [np.sum(np.stack(frame["part"]), axis=0)]})

    summed = rows.mapInArrow(sums, "fit int, part array<double>").groupBy("fit").applyInPandas(added, "fit int, part array<double>")
    normal = np.zeros((len(WIDTHS) * FOLDS, size, size))
    for r in summed.collect():
        normal[r.fit][upper] = r.part
        normal[r.fit] += np.triu(normal[r.fit], 1).T
    normal = normal.reshape(len(WIDTHS), FOLDS, size, size)

    def solve(m: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.eye(size - 1) * ridge * max(1.0, m[0, 0]) / FEATURES
        penalty[0, 0] = 1e-9
        return np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1])

    best = None
    for w in range(len(WIDTHS)):
        every = normal[w].sum(axis=0)
        for ridge in RIDGES:
            folds = [solve(every - normal[w, k], ridge) for k in range(FOLDS)]
            error = sum(m[-1, -1] - 2 * c @ m[:-1, -1] + c @ m[:-1, :-1] @ c for c, m in zip(folds, normal[w]))
            if best is None or error < best[0]:
                best = (error, w, ridge, np.stack(folds), solve(every, ridge))
    _, w, _, folds, weights = best
    frequencies = base / WIDTHS[w]

    @F.pandas_udf("double")
    def out_of_fold(stat: pd.Series, fold: pd.Series) -> pd.Series:
        z = features(np.stack(stat), mean, scale, frequencies, phases)
        return pd.Series(np.einsum("ij,ij->i", z, folds[fold.to_numpy()]))

    scored = rows.select(out_of_fold("stats", "fold").alias("s"), "y")
    scored = settled(scored, "out_of_fold")
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    step = max((high - low) / BINS, 1e-12)
    bins = scored.groupBy(F.floor((F.col("s") - low) / step).alias("bin")).agg(
        F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")
    ).orderBy("bin").collect()
    knots, levels = rising(*(np.array([float(r[c]) for r in bins]) for c in ("s", "y", "n")))
    # one label at either end of each step keeps scores inside (0, 1) and rising with the raw score
    levels = np.concatenate([[levels[0] / 2], levels, [(1 + levels[-1]) / 2]])
    spread = max(high - low, 1e-6)
    knots = np.concatenate([[min(low, knots[0]) - spread], knots, [max(high, knots[-1]) + spread]])
    return Model(mean, scale, frequencies, phases, weights, knots, levels)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``held_out``, ``score`` and ``predicted``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(stat: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(stat)) if len(stat) else [], dtype=float)

    made = stats.withColumn("held_out", held_out(F.col("id"))).withColumn("score", score("stats"))
    return made.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def text_score(model: Model, spark) -> object:
    """A column function from texts to scores, for filters that keep rows where they are."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics_of(t or "") for t in text]).reshape(-1, len(STATISTICS))), dtype=float)

    return score
