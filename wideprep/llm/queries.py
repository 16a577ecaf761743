"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, licenses, merkle, packing, pii, sharding, simhash, tokens, toxicity, trie
from .common import held_out, read_table
from .oracle import MERKLE_SQL, TRIE_SQL


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    spans = F.col("pii")

    def of(kind):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s.kind.isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *(of(k) for k in pii.BASE_KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s.score.cast("string")), ",").alias("scores"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_lengths(read_table(spark, sf_dir, "documents")))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.token_lengths(read_table(spark, sf_dir, "documents"))
    return tokens.limits_table(tokens.length_histogram(lengths))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


#: What both rows of conversation -7 say.
CONFLICT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.format_chats(turns).withColumn("turns", chat.parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    back = back.withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_mask")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (op1_pii, op2_packing, op3_ann, op4_langid, op5_token_counts, op6_sharding, op7_simhash, op8_licenses,
                                    op9_toxicity, op10_decontamination, op11_prefix_trie, op12_chat_format, op13_merkle_manifest)}


def _license_sql() -> str:
    def canon(c: str) -> str:
        out = f"regexp_replace(lower({c}), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g'))"

    known = ",\n".join(f"('{s}', {str(p).lower()}, '{n}')" for s, p, n in licenses.known_notices())
    return f"""
WITH known(license, permissive, notice) AS (VALUES {known}),
forms AS (SELECT {canon('notice')} AS form, min({{'l': license, 'p': permissive}}) AS hit FROM known GROUP BY 1),
units AS (
  SELECT doc_id, 0 AS line_no, text AS unit_text FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT, unnest(string_split(text, chr(10))) FROM documents
  WHERE text IS NOT NULL),
canon AS (SELECT doc_id, line_no, {canon('unit_text')} AS form FROM units)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS unit, line_no, hit.l AS license, hit.p AS permissive
FROM canon JOIN forms USING (form) WHERE form <> ''
"""


_DECONTAM_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w, row_number() OVER () AS r FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w, row_number() OVER () AS r FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - {decontam.SHINGLE} + 2),
         lambda i: array_to_string(w[i:i + {decontam.SHINGLE - 1}], ' '))) AS s FROM dw),
bs AS (SELECT DISTINCT r, item_id, unnest(list_transform(range(1, len(w) - {decontam.SHINGLE} + 2),
         lambda i: array_to_string(w[i:i + {decontam.SHINGLE - 1}], ' '))) AS s FROM bw),
sizes AS (SELECT r, count(*) AS n FROM bs GROUP BY r),
both_ AS (SELECT ds.r AS dr, any_value(doc_id) AS doc_id, bs.r AS br, any_value(item_id) AS item_id, count(*) AS shared
          FROM ds JOIN bs USING (s) GROUP BY ds.r, bs.r)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
FROM both_ JOIN sizes ON br = sizes.r WHERE shared >= {decontam.CONTAINMENT} * n
"""

_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(k)),
marked AS (
  SELECT *, contains(role, chr(92)) OR contains(text, chr(92)) AS signs,
         contains(role, '### ') OR contains(role, '</turn>') OR contains(role, ': ') OR contains(text, '### ') OR contains(text, '</turn>') AS marks,
         length(role) + length(text) + 14 AS plain,
         (length(role) - length(replace(role, '### ', ''))) // 4 * 2 + (length(text) - length(replace(text, '### ', ''))) // 4 * 2
         + (length(role) - length(replace(role, '</turn>', ''))) // 7 * 5 + (length(text) - length(replace(text, '</turn>', ''))) // 7 * 5 AS gone,
         length(role) - length(replace(role, chr(92), '')) + length(text) - length(replace(text, chr(92), '')) AS added
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(plain) - CASE WHEN bool_or(signs) OR bool_or(marks) THEN sum(gone) ELSE 0 END
        + CASE WHEN bool_or(signs) THEN sum(added) ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLE = {"op8_licenses": _license_sql(), "op10_decontamination": _DECONTAM_SQL, "op11_prefix_trie": TRIE_SQL,
          "op12_chat_format": _CHAT_SQL, "op13_merkle_manifest": MERKLE_SQL}
