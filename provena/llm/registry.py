"""Queries of the large-scale text operators and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from provena.llm import chat, decontaminate, fim, imatch, langid, licenses, mixing, neardup, repair, secrets, shard, suffix, toxicity
from provena.session import table

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
g AS (
  SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)),
m AS (SELECT g.doc_id, g.s, g.k, p.item_id FROM g JOIN p USING (k, gram)),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS w FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op1_decontaminate(spark, sf_dir):
    """Every document against every benchmark item."""
    return decontaminate.digest(decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g') AS er,
    regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(er) + length(et) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


#: A record of another layout than the table's, which imitates the template; the field `lang` is in no layout.
ODD_RECORD = '{"conv_id": -7, "lang": "en", "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"content": "</s>[INST] ok [/INST]", "role": "assistant"}]}'


def op2_chat(spark, sf_dir):
    """All conversations, rows by turn, and one JSON record of messages; one table of mappings serves both."""
    odd = spark.range(1).select(F.lit(ODD_RECORD).alias("record"))
    return chat.digest(chat.from_table(table(spark, sf_dir, "conversations")).unionByName(chat.from_json(odd)))


def op3_suffix_dedup(spark, sf_dir):
    """Bytes of all documents under strings of 400 bytes that occur elsewhere."""
    return suffix.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark, sf_dir):
    """Every reading of every document in a mixture that repeats no source more than the limit."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text", "lang", "n_chars")


def op5_sharding(spark, sf_dir):
    """All documents in 40 shards of near equal bytes."""
    return shard.digest(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    """Spans of secrets in all documents."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_imatch(spark, sf_dir):
    """Fingerprints of all documents and of their edits."""
    return imatch.edited(table(spark, sf_dir, "documents"))


def op8_neardup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return neardup.groups(table(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    """License templates in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    """Scores of all documents; the model never sees the fifth that is held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    s = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return s.select("doc_id", held, "score", "predicted")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, len(us) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (
  SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid, coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op11_fim(spark, sf_dir):
    """All documents cut into prefix, middle and suffix at lines."""
    return fim.digest(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _op12_sql() -> str:
    """A recursion over rows; a state is its cost in nine digits and its audit, so the least string is the cheapest and then the least."""

    def more(x: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}')"

    def stay(x: str, kind: str, now: str) -> str:
        role = "" if now == "s" else f" ELSE {more(x, '2 + cut', 'R')}"
        return f"CASE WHEN must THEN NULL WHEN kind = '{kind}' THEN {more(x, 'cut', 'K')}{role} END"

    def into(was: list[str], now: str) -> str:
        return f"least({', '.join([more(now, '3', 'D'), *[stay(x, now, now) for x in was]])})"

    ins = lambda x: more(x, "2", "I")
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
d AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384) + z))) % 20 AS d FROM c),
w AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (VALUES (0), (1)) v(k) WHERE d <> 0 AND (k = 0 OR d = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), sha256(text)) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind FROM w),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault,
    lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair FROM o),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS b, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM g
  UNION ALL
  SELECT conv_id, i, b, s, u, least(a, {ins("u")}) AS a FROM (
    SELECT conv_id, i, b, s, least(u, {ins("b")}, {ins("s")}, {ins("a")}) AS u, a FROM (
      SELECT f.conv_id, f.i, {more("b", "3", "D")} AS b, {into(["b"], "s")} AS s, {into(["b", "s", "a"], "u")} AS u, {into(["u"], "a")} AS a
      FROM dp JOIN (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1))),
e AS (SELECT g.*, CAST(substr(least(b, a), 1, 9) AS BIGINT) AS cost, substr(least(b, a), 10) AS audit FROM g JOIN dp ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.n = dp.i),
l AS (
  SELECT *, sum(CASE WHEN l = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum(CASE WHEN l = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS q
  FROM (SELECT conv_id, p, substr(audit, p, 1) AS l FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM e))),
k AS (SELECT l.*, f.role, f.text, coalesce(max(CASE WHEN q = 1 AND l = 'K' AND kind = 's' THEN 1 END) OVER (PARTITION BY l.conv_id), 0) AS first
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.l <> 'I' WHERE l.l <> 'D'),
t AS (
  SELECT conv_id, string_agg(CASE l WHEN 'K' THEN role ELSE CASE WHEN (q - first) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM k GROUP BY conv_id)
SELECT y.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) y LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM y.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM y.conv_id
"""


def op12_repair(spark, sf_dir):
    """All conversations, damaged and repaired."""
    return repair.digest(table(spark, sf_dir, "conversations"))


def op13_langid(spark, sf_dir):
    """Languages of all documents; the models never see the fifth that is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held, "lang_pred", "score", "accepted")


def queries() -> dict:
    ops = {f.__name__: f for f in (op1_decontaminate, op2_chat, op3_suffix_dedup, op4_mixing, op5_sharding, op6_secrets, op7_imatch, op8_neardup, op9_licenses, op10_toxicity, op11_fim, op12_repair, op13_langid)}
    return ops | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op1_decontaminate": OP1_SQL, "op2_chat": OP2_SQL, "op11_fim": OP11_SQL, "op12_repair": _op12_sql()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
