"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tremorlake.llm import alignment, bpe, conversations, decontaminate, fertility, langid, licenses, pairwise, pii, sharding, simhash, substrings, templates
from tremorlake.sources.tables import table

#: Folder of the public vocabulary files; an environment variable or the installed package gives it.
def vocab_path(name: str) -> str:
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Vocabularies of the fertility rules: sentencepiece with byte fallback, and byte-level BPE of many languages.
FERTILITY = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_license_scan(spark, d):
    return licenses.scan_licenses(table(spark, d, "documents"))


@query
def op8_bpe(spark, d):
    return bpe.encode(table(spark, d, "documents"), vocab_path("word_bpe_49k.json"), keep_ids=False)


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32, from its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in out]
    return out


ORACLES["op9_interleaved_shards"] = f"""
WITH crc AS (SELECT {_crc_table()} AS change),
texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM texts),
sums AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(a >> 8, change[xor(a & 255, x) + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
drawn AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, CAST('0x' || substr(md5('42|' || doc_id), 1, 15) AS BIGINT) AS h FROM texts),
ranked AS (SELECT *, (CAST(row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY s) AS frac FROM drawn),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY frac, s, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INT) AS shard, place - ((place * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed JOIN sums USING (doc_id)
"""


@query
def op9_interleaved_shards(spark, d):
    docs = table(spark, d, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.interleaved(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_fertility_rules(spark, d):
    return fertility.measure(table(spark, d, "documents"), [vocab_path(v) for v in FERTILITY])


@query
def op5_pii(spark, d):
    return pii.digest(table(spark, d, "documents"))


@query
def op6_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


ORACLES["op10_substrings"] = r"""
WITH words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h, n FROM words),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows WHERE i + 19 <= n) WHERE r > 1),
marked AS (SELECT w.doc_id, w.i, w.word, coalesce(max(CASE WHEN a.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM words w LEFT JOIN again a ON a.doc_id = w.doc_id AND a.i = w.i),
kept AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS text FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query
def op10_substrings(spark, d):
    out = substrings.remove_repeats(table(spark, d, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_spaced_seeds(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op2_bradley_terry(spark, d):
    return pairwise.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_templates(spark, d):
    return templates.extract(table(spark, d, "pages"))


ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()} AS change), ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
steps(x, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS b FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda a, x: xor(a >> 8, change[xor(a & 255, x) + 1])), 4294967295) % 20 AS k FROM keyed, crc),
bad AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM bad),
faulty AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS x0 FROM placed),
t AS MATERIALIZED (SELECT * FROM faulty),
edits AS MATERIALIZED (SELECT conv_id, i, p, p AS q, 3 AS c, 'D' AS a FROM t, (SELECT unnest([0, 1, 2, 3]) AS p) UNION ALL
  SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END + CASE WHEN t.x = steps.x THEN 0 ELSE 2 END, CASE WHEN t.x = steps.x THEN 'K' ELSE 'R' END FROM t JOIN steps ON t.x = steps.x OR steps.x <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'c': 0, 'a': ''}} AS v FROM t UNION ALL
  SELECT w.conv_id, e.i, e.q, min({{'c': w.v.c + ins.c + e.c, 'a': w.v.a || ins.a || e.a}}) FROM walk w JOIN ins ON ins.p = w.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = ins.q GROUP BY 1, 2, 3),
ends AS (SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (x0 || x NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY 1),
won AS (SELECT w.conv_id, min({{'c': w.v.c + ins.c, 'a': w.v.a || ins.a}}) AS v FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.i JOIN ins ON ins.p = w.q AND ins.q IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, unnest(string_split(v.a, '')) AS e, generate_subscripts(string_split(v.a, ''), 1) AS j FROM won WHERE v.a <> ''),
counted AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
turns AS (SELECT c.*, t.role, t.text, t.x, max(CASE WHEN o = 1 AND e = 'K' AND t.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS s FROM counted c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.i = c.i AND c.e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM turns GROUP BY 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v.c, 0) AS BIGINT) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM d.conv_id
"""


@query
def op13_conversation_repair(spark, d):
    rows = table(spark, d, "conversations")
    return conversations.with_all_ids(conversations.repair(conversations.damage(rows)), rows)


@query
def op11_word_first_language(spark, d):
    return langid.learn_and_identify(table(spark, d, "documents"))


@query
def op12_tokenizer_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"), vocab_path("byte_bpe_50k.json"), vocab_path("piece_bpe_32k.model"))
