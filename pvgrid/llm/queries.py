"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvgrid.llm.common import table
from pvgrid.llm.decontaminate import decontaminate
from pvgrid.llm.exactdedup import exact_duplicates
from pvgrid.llm.lattice import score_documents
from pvgrid.llm.linedup import drop_repeated_lines
from pvgrid.llm.mixing import mix
from pvgrid.llm.planes import token_digest
from pvgrid.llm.quality import score_quality
from pvgrid.llm.repair import repair
from pvgrid.llm.simhash import near_duplicates
from pvgrid.llm.toolcalls import link_every_call
from pvgrid.llm.toxicity import score_toxicity
from pvgrid.llm.warc import page_records
from pvgrid.llm.whitening import whiten
from pvgrid.session import prepare, staged_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS s, least(10, len(w)) AS l FROM starts),
places AS (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
    FROM d, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l),
hits AS (
    SELECT doc_id, i, p.l, item FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM places) p
    JOIN windows USING (s, l)),
words AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from two views."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice log probability of every document."""
    return score_documents(table(spark, sf_dir, "documents"), PIECES)


# Tools, their parameters, types, and whether they are required.
TOOLS = (("search", "query", "string", True), ("search", "limit", "integer", True),
         ("lookup", "key", "string", True), ("lookup", "exact", "boolean", False), ("lookup", "share", "number", False))


def tool_calls(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a conversation: an assistant's turn calls a tool, the user's next is its result.

    Every seventh conversation forgets a required argument, every fifth gives a number as text, every
    eleventh breaks the JSON, and every fourth call is for a tool that doesn't exist. A call needs the call
    two turns earlier.
    """
    name = "element_at(array('search', 'lookup', 'shell', 'search'), CAST(pmod(conv_id + turn, 4) AS INT) + 1)"
    json = f"""CASE {name}
        WHEN 'lookup' THEN to_json(named_struct('share', length(text) / 8, 'key', IF(conv_id % 7 = 0, NULL, text), 'exact', turn % 3 = 0))
        WHEN 'search' THEN IF(conv_id % 5 = 0, to_json(named_struct('query', text, 'limit', CAST(length(text) AS STRING))),
                              to_json(named_struct('query', text, 'limit', length(text))))
        ELSE to_json(named_struct('line', text)) END"""
    calls = (chats.where("role = 'assistant'").withColumn("json", F.expr(json))
             .selectExpr("conv_id", "concat('c', conv_id, '-', turn) AS call_id", "turn", f"{name} AS name",
                         "IF(conv_id % 11 = 0, substring(json, 1, length(json) - 1), concat('{ ', substring(json, 2))) AS arguments",
                         "IF(turn >= 2, concat('c', conv_id, '-', turn - 2), NULL) AS depends_on"))
    results = (chats.where("role = 'user' AND turn > 0")
               .selectExpr("conv_id", "concat('c', conv_id, '-', turn - 1) AS call_id", "turn", "text AS content"))
    return calls, results


def op5_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered, checked and serialised tool calls of all conversations."""
    calls, results = tool_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(list(TOOLS), "name string, param string, type string, required boolean")
    return link_every_call(calls, results, schemas)


OP5_SQL = """
WITH RECURSIVE calls AS (
    SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn, text,
           CASE (conv_id + turn) % 4 WHEN 1 THEN 'lookup' WHEN 2 THEN 'shell' ELSE 'search' END AS name,
           CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS depends_on
    FROM conversations WHERE role = 'assistant'),
results AS (
    SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text AS content
    FROM conversations WHERE role = 'user' AND turn > 0),
chain AS (
    SELECT call_id, CAST(0 AS BIGINT) AS level FROM calls
    WHERE depends_on IS NULL OR depends_on NOT IN (SELECT call_id FROM calls)
    UNION ALL
    SELECT c.call_id, level + 1 FROM calls c JOIN chain p ON c.depends_on = p.call_id),
checked AS (
    SELECT c.*, level, d.call_id IS NULL AND c.depends_on IS NOT NULL AS lost,
           CASE WHEN name = 'shell' THEN 'unknown_tool' WHEN conv_id % 11 = 0 THEN 'not_json'
                WHEN name = 'lookup' AND conv_id % 7 = 0 THEN 'missing:key'
                WHEN name = 'search' AND conv_id % 5 = 0 THEN 'type:limit' END AS wrong,
           CASE WHEN conv_id % 11 = 0 THEN NULL
                WHEN name = 'shell' THEN '{"line":' || to_json(text) || '}'
                WHEN name = 'lookup' THEN '{"exact":' || CASE WHEN turn % 3 = 0 THEN 'true' ELSE 'false' END
                    || CASE WHEN conv_id % 7 = 0 THEN '' ELSE ',"key":' || to_json(text) END
                    || ',"share":' || regexp_replace(CAST(length(text) / 8 AS VARCHAR), '[.]0$', '') || '}'
                ELSE '{"limit":' || CASE WHEN conv_id % 5 = 0 THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END
                    || ',"query":' || to_json(text) || '}' END AS args
    FROM calls c JOIN chain USING (call_id) LEFT JOIN (SELECT call_id FROM calls) d ON c.depends_on = d.call_id),
linked AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, level, name, depends_on,
           args, content, c.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS is_result,
           concat_ws(',', wrong, CASE WHEN lost THEN 'missing_call' END) AS errors
    FROM checked c FULL JOIN results r ON c.call_id = r.call_id)
SELECT conv_id, call_id, turn, level,
       CASE WHEN NOT is_call THEN 'orphan_result' WHEN is_result THEN 'answered' ELSE 'unanswered' END AS state,
       CASE WHEN is_call THEN CAST(1 AS BIGINT) END AS n_calls, CASE WHEN is_result THEN CAST(1 AS BIGINT) END AS n_results,
       CASE WHEN is_call THEN errors = '' END AS valid, CASE WHEN is_call THEN errors END AS errors,
       '{' || concat_ws(',', '"arguments":' || args, '"depends_on":"' || depends_on || '"', '"id":"' || call_id || '"',
                        '"level":' || level, '"name":"' || name || '"', '"result":' || to_json(content), '"turn":' || turn)
       || '}' AS canonical_json
FROM linked
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target of the source and words taken of every document."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src, md5(CAST(doc_id AS VARCHAR)) AS place,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
    FROM documents),
s AS (
    SELECT *, 1 + (row_number() OVER (ORDER BY no_src, src) - 1) % 3 AS weight
    FROM (SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, no_src)),
n AS (SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS need, (SELECT sum(source_size) FROM s) AS budget FROM s),
l AS (
    SELECT *, need < (budget - coalesce(sum(3 * source_size) OVER below, 0))
                     / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER below, 0) AS DOUBLE) AS is_full
    FROM n WINDOW below AS (ORDER BY need, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT src, no_src, source_size, CAST(budget AS BIGINT) AS budget,
           CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
                ELSE weight * ((budget - (SELECT coalesce(sum(3 * source_size), 0) FROM l WHERE is_full))
                               / CAST((SELECT sum(weight) FROM l WHERE NOT is_full) AS DOUBLE)) END AS target
    FROM l),
p AS (
    SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY src, no_src ORDER BY place) AS upto
    FROM d JOIN t USING (src, no_src)),
c AS (
    SELECT p.*, epoch, (epoch * source_size + upto) / target AS finish
    FROM p, (SELECT unnest([0, 1, 2]) AS epoch) WHERE target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, no_src, src, epoch, place) AS spent FROM c),
k AS (SELECT doc_id, count(*) AS copies FROM o WHERE spent <= budget GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM p LEFT JOIN k USING (doc_id)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "copies")


def op8_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and check sum of every document's ids, from the files written."""
    return token_digest(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for every document, and the size of its group."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {WHITE}, '') AS norm FROM documents),
r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the check sum of what is left of every document."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
keyed AS (SELECT *, translate(trim(line, {WHITE}), {LOWER}) AS k FROM lines),
repeated AS (
    SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def damage(chats: DataFrame) -> DataFrame:
    """Turns as a faulty export leaves them: by a check sum some are lost, emptied, cut, repeated or given to the user."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]).cast("binary")) % 20
    rows = chats.select("conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"), kind.alias("kind"))
    return (rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
        .drop("copy"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text's digest of every conversation after damage."""
    chats = table(spark, sf_dir, "conversations")
    found = repair(damage(chats)).withColumnRenamed("conv_id", "conv")
    ids = chats.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
            .select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    turn = "c"
    for _ in range(8):
        turn = f"list_transform([{turn}], lambda x: {step.format('x')})[1]"
    fold = turn.replace("[c]", "[xor(c, CAST(ord(ch) AS BIGINT))]", 1)
    return f"xor(list_reduce(string_split({text}, ''), lambda c, ch: {fold}, CAST(4294967295 AS BIGINT)), 4294967295)"


# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Moves: from, to, edits, cost.
OP11_SQL = """
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM (SELECT *, %CRC% % 20 AS kind FROM raw) WHERE kind <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
placed AS (
    SELECT conv_id, turn, role, text, i, count(*) OVER (PARTITION BY conv_id) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
           lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS follower,
           regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
    FROM numbered),
faulty AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
           left(role, 1) AS initial FROM placed),
ins(p, q, e, c, t) AS (VALUES
    (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
    (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (3, 2, 'I', 3, chr(10) || 'user:'),
    (2, 3, 'I', 3, chr(10) || 'assistant:'), (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(p, q, e, c, initial) AS (VALUES
    (0, 0, 'D', 4, ''), (1, 1, 'D', 4, ''), (2, 2, 'D', 4, ''), (3, 3, 'D', 4, ''),
    (0, 2, 'R', 3, ''), (1, 2, 'R', 3, ''), (3, 2, 'R', 3, ''), (2, 3, 'R', 3, ''),
    (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a')),
path AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS edits, '' AS body
    FROM faulty WHERE i = 1
    UNION ALL
    SELECT conv_id, i, n, state, cost, edits, body FROM (
        SELECT p.conv_id, f.i, p.n, d.q AS state, p.cost + ins.c + d.c + CASE WHEN d.e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
               p.edits || ins.e || d.e AS edits,
               p.body || ins.t || CASE d.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
                                  ELSE chr(10) || CASE d.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END AS body
        FROM path p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
        JOIN ins ON ins.p = p.state JOIN edit d ON d.p = ins.q
        WHERE (d.e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (d.initial = '' OR d.initial = f.initial))
    QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, edits) = 1),
ends AS (
    SELECT conv_id, p.cost + ins.c AS cost, edits || ins.e AS audit, body || ins.t AS body
    FROM path p JOIN ins ON ins.p = p.state WHERE p.i = p.n AND ins.q IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p.cost + ins.c, edits || ins.e) = 1),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (follower IS NOT NULL AND initial || left(follower, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(substring(body, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON ids.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON ids.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("%CRC%", _crc32("name"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, size and digest of every page's record, read back from the archives written."""
    return page_records(table(spark, sf_dir, "pages"), staged_path(spark, "warc"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
n AS (
    SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
           row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place
    FROM p),
r AS (SELECT *, payload_bytes < 1000 OR place = 1 AS is_whole FROM n)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN is_whole THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT is_whole THEN last END AS refers_to
FROM r
"""

def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components, their share of the variance and the exact deviation of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


_BUILD = {f.__name__: f for f in (
    op1_decontaminate, op2_quality, op3_toxicity, op4_lattice, op5_toolcalls, op6_mixing, op7_simhash, op8_planes, op9_exact,
    op10_lines, op11_repair, op12_warc, op13_whitening)}

SQL = {"op1_decontaminate": OP1_SQL, "op5_toolcalls": OP5_SQL, "op6_mixing": OP6_SQL, "op9_exact": OP9_SQL, "op10_lines": OP10_SQL,
       "op11_repair": OP11_SQL, "op12_warc": OP12_SQL}


def _prepared(build):
    return lambda spark, sf_dir: build(prepare(spark), sf_dir)


QUERIES = {name: _prepared(build) for name, build in _BUILD.items()}
