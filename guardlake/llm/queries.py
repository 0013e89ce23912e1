"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from guardlake.llm import chat, exact, html_text, lexical, licences, lines, mixing, packing, quality, repair, search, simhash, vantage
from guardlake.llm.common import table, tokenizer_path
from guardlake.session import settled


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "sentence_ids", F.array_join("licences", ",").alias("licences"), "n_unmatched"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settled(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.scored(stats, model).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    checked = cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(settled(checked, "pieces")).withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page", "html")
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(
        F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search.top_k(vectors.where(search.divisible(F.col("id"))), vectors)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    output = chat.render(chat.final_messages(chat.rows_as_log(rows)))
    read = output.select("conv_id", chat.formatted(F.col("segments")).alias("whole"), chat.loss_text(F.col("segments")).alias("loss"))
    read = read.withColumn("turns", chat.parsed(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair.summaries(settled(repair.repaired(repair.damaged(rows)), "edits"), rows.select(F.col("conv_id").alias("conv")))
    return found.withColumnRenamed("conv", "conv_id")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vantage.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vantage.nearest(vectors.where(F.col("id") % 50 == 0), vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_source_mixing": op9_source_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Both readings of each document, and one step per rule, in order, over the spelled sentences of each."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licences.known_sentences().items())
    steps = [f"WITH known(sentence, name) AS (VALUES {known})", "d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents)"]
    rules = licences.spelled_rules()
    for x, reading in (("a", licences.BY_LINE), ("b", licences.JOINED)):
        text = "coalesce(text, '')"
        for pattern, by in reading:
            text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by.replace('$', chr(92)))}, 'g')"
        steps += [
            f"cut_{x} AS (SELECT r, string_split(trim(lower({text}), ' ' || chr(10)), chr(10)) AS parts FROM d)",
            f"flat_{x} AS (SELECT r, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM cut_{x})",
            f"named_{x} AS (SELECT r, regexp_replace(string_agg('<' || coalesce(name, '?') || '>', '' ORDER BY i), '(<\\?>)+', '<?>', 'g') AS ids"
            f" FROM flat_{x} LEFT JOIN known USING (sentence) GROUP BY r)",
            f"{x}0 AS (SELECT r, ids, ids AS s, [] :: VARCHAR[] AS f FROM named_{x})",
        ]
        for i, (name, pattern) in enumerate(rules):
            p, n = _quoted(pattern), _quoted(name)
            steps.append(
                f"{x}{i + 1} AS (SELECT r, ids, replace(s, {p}, '<=>') AS s,"
                f" CASE WHEN contains(s, {p}) AND NOT list_contains(f, {n}) THEN list_append(f, {n}) ELSE f END AS f FROM {x}{i})"
            )
    n = len(rules)
    count = "length(regexp_replace(replace({}, '<?>', ''), '[^<]', '', 'g'))"
    steps.append(
        f"both_readings AS (SELECT r, {count.format('b.ids')} > {count.format('a.ids')} AS swap, a.ids AS ai, b.ids AS bi,"
        f" a.f AS af, b.f AS bf, a.s AS sa, b.s AS sb FROM a{n} a JOIN b{n} b USING (r))"
    )
    return (
        ", ".join(steps) + " SELECT doc_id, CASE WHEN swap THEN bi ELSE ai END AS sentence_ids,"
        " array_to_string(CASE WHEN swap THEN list_concat(bf, list_filter(af, lambda l : NOT list_contains(bf, l)))"
        " ELSE list_concat(af, list_filter(bf, lambda l : NOT list_contains(af, l))) END, ',') AS licences,"
        " length(regexp_replace(regexp_replace(CASE WHEN swap THEN sb ELSE sa END, '<[=?]>', '', 'g'), '[^<]', '', 'g')) :: INTEGER AS n_unmatched"
        " FROM both_readings JOIN d USING (r)"
    )


SQL: dict[str, str] = {
    "op1_license_scans": _licence_sql(),
    "op2_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents),
        filled AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
            FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        w AS (
            SELECT doc_id, place, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c
            FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
        later AS (
            SELECT doc_id, place, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS nth
            FROM w WHERE c IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, place + k AS place FROM later, range(3) AS r(k) WHERE nth > 1),
        kept AS (
            SELECT l.doc_id, l.i, l.line FROM l LEFT JOIN filled f USING (doc_id, i)
            LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.place = f.place WHERE g.place IS NULL),
        texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM kept GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
               len(string_split(coalesce(d.text, ''), chr(10))) :: INTEGER AS n_lines,
               CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(t.n, 0) END :: INTEGER AS n_removed
        FROM documents d LEFT JOIN texts t USING (doc_id)
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p : p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
    "op8_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        told AS (
            SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e') AS safe,
                   replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e'), ':', '\\c') AS safe_role
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) :: BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(14 + length(safe) + length(safe_role)) :: BIGINT AS formatted_chars
        FROM told GROUP BY conv_id
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY bare) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op11_lexical_search": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents),
        i AS (
            SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM benchmark),
        s AS (SELECT count(*) AS n_docs, sum(len(terms)) :: BIGINT AS n_terms FROM d WHERE len(terms) > 0),
        p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, s GROUP BY term, n_docs),
        scored AS (
            SELECT item_id, i.text, r, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) :: BIGINT AS score
            FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, i.text, r, doc_id),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank :: INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id :: VARCHAR, ' ') || ':' || coalesce(turn :: VARCHAR, ' ') AS k
            FROM conversations),
        kinds AS (
            SELECT *, xor(list_reduce(
                list_transform(range(1, length(k) + 1), lambda i : ord(substr(k, i, 1)) :: BIGINT),
                lambda c, b : list_reduce(
                    range(8), lambda x, j : CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384 :: BIGINT) ELSE x >> 1 END, xor(c, b)),
                4294967295 :: BIGINT), 4294967295 :: BIGINT) % 20 AS kind
            FROM keyed),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM kinds),
        placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64),
                sha256(length(role) || ':' || role || text)) AS i
            FROM d),
        faulty AS (
            SELECT *, CASE
                WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed),
        r AS (
            SELECT conv_id, i, role, text, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t,
                   CASE WHEN fault IN ('blank', 'duplicate') THEN 1000 ELSE 0 END AS gone,
                   CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS c
            FROM faulty),
        sizes AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
        back AS (
            SELECT conv_id, n + 1 AS i, [0, 10, 5, 0] AS h, CAST(NULL AS INTEGER[]) AS a FROM sizes
            UNION ALL
            SELECT conv_id, i, [
                least(e[1], 5 + e[3], 10 + e[4]), least(e[2], 5 + e[3], 10 + e[4]), least(e[3], 5 + e[4]), least(e[4], 5 + e[3])], a
            FROM (
                SELECT b.conv_id, r.i, b.h AS a, [
                    least(2 + h[1], 1 + t + gone + h[3], CASE c WHEN 1 THEN t + gone + h[2] WHEN 2 THEN t + gone + h[3] ELSE 1000 END),
                    least(2 + h[2], 1 + t + gone + h[3], CASE c WHEN 2 THEN t + gone + h[3] ELSE 1000 END),
                    least(2 + h[3], 1 + t + gone + h[4], CASE c WHEN 3 THEN t + gone + h[4] ELSE 1000 END),
                    least(2 + h[4], 1 + t + gone + h[3], CASE c WHEN 2 THEN t + gone + h[3] ELSE 1000 END)] AS e
                FROM back b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
        moves AS (
            SELECT b.conv_id, b.i, q, CASE q WHEN 2 THEN 3 ELSE 2 END AS nx, r.c, r.role, r.text, coalesce(r.t, 0) AS t,
                   CASE WHEN r.i IS NOT NULL AND 2 + a[q + 1] = h[q + 1] THEN 'D'
                        WHEN 5 + h[CASE q WHEN 2 THEN 4 ELSE 3 END] = h[q + 1] THEN 'I'
                        WHEN r.i IS NOT NULL AND c > 0 AND (c = CASE q WHEN 2 THEN 3 ELSE 2 END OR c = 1 AND q = 0)
                             AND t + gone + a[c + 1] = h[q + 1] THEN 'K'
                        WHEN r.i IS NOT NULL THEN 'R' END AS letter
            FROM back b CROSS JOIN range(4) AS s(q)
            LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
        path AS (
            SELECT conv_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, 0 AS k, CAST(NULL AS VARCHAR) AS letter, CAST(NULL AS VARCHAR) AS line,
                   CAST(0 AS BIGINT) AS cost
            FROM sizes
            UNION ALL
            SELECT m.conv_id, CASE WHEN m.letter = 'I' THEN m.i ELSE m.i + 1 END,
                   CASE m.letter WHEN 'D' THEN m.q WHEN 'K' THEN m.c ELSE m.nx END, p.k + 1, m.letter,
                   CASE m.letter WHEN 'D' THEN NULL WHEN 'K' THEN m.role || ':' || m.text
                        ELSE CASE m.nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE m.letter WHEN 'R' THEN m.text ELSE '' END END,
                   CASE m.letter WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'R' THEN 1 + m.t ELSE m.t END
            FROM path p JOIN moves m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i AND m.q = p.q
            WHERE m.letter IS NOT NULL),
        told AS (
            SELECT conv_id, sum(cost) :: BIGINT AS cost, coalesce(string_agg(letter, '' ORDER BY k), '') AS audit,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS repaired_sha256
            FROM path GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulty GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) :: BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
               coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
