"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import byte_bpe, chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, prefix_trie, secret_scan, sharding, simhash, token_align, toxicity
from normloom.llm.shared import let, shared_folder, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    bpe = byte_bpe.ByteBpe(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", sample), (-7, 1, "assistant", sample)], turns.schema))
    made = chat_format.format_conversations(turns)
    said = lambda back: F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = let(chat_format.read_back(F.col("formatted")), lambda b: F.struct(F.size(b).cast("long").alias("n_turns"), said(b).alias("said")))
    read = made.select("conv_id", "valid", "first_error", back.alias("back"), chat_format.loss_text(F.col("segments")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "back.n_turns", digest("back.said").alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"), "formatted_chars", "valid", "first_error")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, shards=40).drop("text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secret_scan.dictionary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    forest = secret_scan.train(secret_scan.generated_findings(spark), words)
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), forest, words)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("mark").withColumnRenamed("key", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = token_align.Aligner(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligner.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.LineIndex(spark, f"{shared_folder(spark)}/lines-{uuid4().hex}")
    index.insert(docs)
    return index.kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.PrefixTrie(prefix_trie.shared_heads(prefix_trie.ordered(turns)), turns.select("conv_id")).nodes()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_jump_sharding": op4_jump_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_token_align": op11_token_align,
    "op12_line_dedup": op12_line_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Characters that escaping adds to a text: one for each backslash, closing mark, and place where the opening mark begins.
_ADDED = """length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7
                     + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda r: length(r) - 2)), 0)"""
_ROLE = "replace(replace(role, '~', '~0'), ':', '~1')"

ORACLES: dict[str, str] = {
    "op3_chat_format": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
             o AS (SELECT *, row_number() OVER w - 1 AS place, lag(role, 1, 'start') OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             m AS (SELECT *, (before, role) IN (VALUES ('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok,
                     CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length({_ROLE}) + {_ADDED.format(_ROLE)} END AS role_chars, length(text) + {_ADDED.format("text")} AS text_chars FROM o)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(4 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars, bool_and(ok) AS valid, min(place) FILTER (NOT ok)::INT AS first_error
        FROM m GROUP BY conv_id""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                          first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             m AS (SELECT k.*, coalesce(k.doc_id <> r.keep, false) AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY rid, doc_id""",
    "op13_prefix_trie": """
        WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
             bits AS (SELECT i AS byte, list_reduce(list_prepend(i::BIGINT, [x::BIGINT FOR x IN range(8)]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry FROM range(256) t(i)),
             tab AS (SELECT list(entry ORDER BY byte) AS t FROM bits),
             ids AS (SELECT DISTINCT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 4 AS h
                     FROM conversations, tab WHERE conv_id IS NOT NULL),
             t AS (SELECT o.* FROM o JOIN ids USING (conv_id) WHERE place >= h
                   UNION ALL SELECT ids.conv_id, o.place, o.role, o.text FROM ids JOIN o ON o.conv_id = ids.conv_id - ids.conv_id % 20 AND o.place < ids.h),
             s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha256(sha256(role) || text) AS said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
             p AS (SELECT conv_id, depth, words, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) AS size FROM s
                   UNION ALL SELECT ids.conv_id, 0, 0, '', (SELECT count(*) FROM s WHERE s.conv_id = ids.conv_id) FROM ids),
             n AS (SELECT path, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM p GROUP BY path, depth, words),
             c AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
             u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
             a AS (SELECT left(path, 64 * k) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM u) GROUP BY 1)
        SELECT u.conv_id, u.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, u.n_convs, u.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
        FROM u JOIN a USING (path) LEFT JOIN n up ON u.depth > 0 AND up.path = left(u.path, 64 * (u.depth - 1))""",
}
