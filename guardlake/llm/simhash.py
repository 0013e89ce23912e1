"""SimHash near-dedup with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from guardlake.llm.common import components, per_text, unused
from guardlake.session import settled

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fixed value: generator polynomial of the perfect binary Golay code (23, 12, 7).
GOLAY_GENERATOR = 0b101011100011
#: Lowest bit and width of the three segments of a fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one key that are compared in one place; keys with more are cut into blocks of this size.
BLOCK = 2_048
#: Fingerprints whose keys, about a hundred each, one task spells out.
TASK_PRINTS = 20_000


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of a text's word shingles as a signed long.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle, a text without words (or null) has fingerprint 0.
    """

    def make():
        digest = xxhash.xxh64_intdigest

        def fingerprint(text: str) -> int:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            k = min(SHINGLE_WORDS, len(words))
            stops = (ends[k - 1 :] - 1).tolist()
            starts = [0, *ends[: len(words) - k].tolist()]
            hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 65_536):
                part = hashes[at : at + 65_536]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)

        def work(ids, texts):
            return {"id": ids, "fp": pa.array([fingerprint(t) for t in texts], pa.int64())}

        return work

    return per_text(docs, id_col, text_col, "id ID_TYPE, fp long", make)


def golay_table() -> np.ndarray:
    """For each 23-bit word the index (0-4095) of the one codeword within three bits of it."""
    words = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        row = GOLAY_GENERATOR << bit
        words ^= np.where(np.arange(4096) >> bit & 1, row, 0)
    ones = 1 << np.arange(23)
    a, b, c = (x.ravel() for x in np.meshgrid(np.arange(23), np.arange(23), np.arange(23)))
    errors = np.unique(np.concatenate([[0], ones, ones[a[a < b]] | ones[b[a < b]], (ones[a] | ones[b] | ones[c])[(a < b) & (b < c)]]))
    table = np.full(1 << 23, -1, dtype=np.int16)
    for e in errors.tolist():
        table[words ^ e] = np.arange(4096, dtype=np.int16)
    return table


def fuzzy_keys(fps: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the keys of each fingerprint (unsigned): ``(positions, keys)``. Two at four bits or fewer share one.

    A segment's indices are those its own word and every word one bit away decode to (one or six of them), so
    segments that differ in two bits or fewer share an index. Of three segments with four errors in all, either
    one has none, then another has two at most: keys of an exact segment and an index of another. Or each has one
    at least, then two have exactly one and the third two at most: keys of one exact half of each of the two and an
    index of the third.
    """
    at = np.arange(len(fps))
    words = [(fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    halves = []
    for (_, width), w in zip(SEGMENTS, words):
        low = width // 2
        halves.append((w & ((1 << low) - 1), w >> low))
    for m, (_, width) in enumerate(SEGMENTS):
        near = np.stack([table[words[m]], *(table[words[m] ^ (1 << bit)] for bit in range(width))], axis=1)
        near.sort(axis=1)
        first = np.ones(near.shape, dtype=bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(first)
        index = near[row, col].astype(np.int64)
        p, q = (s for s in range(3) if s != m)
        exact = [words[p], words[q]]
        exact += [halves[p][i] << 11 | halves[q][j] for i in (0, 1) for j in (0, 1)]
        for kind, e in enumerate(exact):
            yield at[row], (np.int64(m * 6 + kind) << 40) | (e[row] << 12) | index


def keyed(distinct: DataFrame) -> DataFrame:
    """``(key, fp)``: each distinct fingerprint under all its keys."""

    def run(batches):
        table = golay_table()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for begin in range(0, len(fps), 8_192):
                part = fps[begin : begin + 8_192]
                for at, keys in fuzzy_keys(part.view(np.uint64), table):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (signed, distinct): each one's smallest linked-in-this-set fingerprint, as ``(a, b)``.

    Breadth first: a found fingerprint is compared with those not reached yet, so nothing is kept per pair.
    """
    left, found, roots = np.sort(fps), [], []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= MAX_BITS
            if near.any():
                new = left[near]
                found.append(new)
                roots.append(np.full(len(new), root))
                front.extend(new)
                left = left[~near]
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(roots), np.concatenate(found)) if found else (none, none)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all within four bits of each other, and no others.

    Fingerprints of a key are compared in one place, where only a tree of what is linked leaves. Keys with more than
    ``block`` fingerprints are dealt out as pairs of blocks, so none grows past two blocks in one place.
    """
    tasks = max(1, -(-distinct.count() // TASK_PRINTS))
    pairs = settled(keyed(distinct.repartition(tasks, "fp")), "keys")
    large = pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = settled(large.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large_keys")
    whole = pairs
    if not large.isEmpty():
        cut = pairs.join(large, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = cut.where("blocks is not null").select("key", "fp", own.alias("own"), other.alias("other"))
        lower, upper = F.least("own", "other"), F.greatest("own", "other")
        dealt = dealt.select(F.xxhash64("key", lower, upper).alias("key"), "fp")
        whole = cut.where("blocks is null").select("key", "fp").unionByName(dealt)

    def run(batches):
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(key, fp):
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.append(0, edge), np.append(edge, len(key))
            size = ends - starts
            two = starts[size == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
            seen = [(np.minimum(a, b)[near], np.maximum(a, b)[near])]
            seen += [stars(np.unique(fp[s:e])) for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist())]
            a, b = np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen])
            if len(a):
                both = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut:
                yield from out(key[:cut], fp[:cut])
        if len(rest_key):
            yield from out(rest_key, rest_fp)

    together = whole.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id, fp, component)`` per row; ``component`` is the smallest id of the group of linked rows.

    Rows of one fingerprint are one node, so copies of any number fold before keys are made. Null and empty
    texts have fingerprint 0 and link like any other. A null id never names a group that has another. Repeated rows
    are reported each. An empty table gives no rows.
    """
    rows = settled(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = settled(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, block))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = settled(named, "named")
    least = settled(named.groupBy("root").agg(F.min("least").alias("component")), "least")
    of_fp = settled(named.join(least, "root").select("fp", "component"), "components")
    return rows.join(of_fp, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, columns as they were: that of the smallest id (null last), then of the smallest text digest.

    Rows are told apart by id and text, so rows that share an id, or have none, fold as well; of rows equal in both one stays.
    """
    own, digest, first = (unused(docs, n) for n in ("own_key", "text_digest", "row_of_key"))
    keyed = docs.withColumn(digest, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    by_order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(digest).alias("digest"))
    spelled = lambda id_, digest_: F.concat_ws("|", F.col(id_).cast("string"), F.col(digest_)).alias(own)
    groups = near_groups(keyed.select(by_order.alias(own), F.col(text_col).alias("text")), own, "text")
    stay = settled(groups.select(spelled("component.id", "component.digest")).distinct(), "stay")
    # One shuffle serves the join and the fold of repeated rows: both go by the spelled key.
    kept = keyed.select(*docs.columns, spelled(id_col, digest)).join(stay.hint("merge"), own, "left_semi")
    repeats = Window.partitionBy(own).orderBy(F.lit(0))
    return kept.withColumn(first, F.row_number().over(repeats)).where(F.col(first) == 1).select(*docs.columns)
