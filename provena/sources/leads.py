"""Lead forms in chat messages: four dialects of labelled fields, tried in order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provena.registry import query

# What tells the dialects apart, how each one marks a label, guides that are no values, and the labels of the list form.
LETTER, REGISTERED, RECEIVED, ARRIVED = ":love_letter:", "신규 리드 등록", "*접수일자:*", "신규 리드 도착"
EMOJI_LINE = r"(?sU)^:[a-z0-9_+\-]+:\s*([^:]{1,20}):\s*(.*)$"
STAR_COLON = r"(?U)\*([^*:]{1,20}):\*(\s*[^\n]*)"
STAR_LINE = r"(?U)^\*([^*]{1,20})\*\s*$"
GUIDE = r"(?s)^\(.*\)$"
BULLET = r"(?sU)^\s*[•\-]\s*\*?([^:*]{1,20}?)\*?\s*:\s*(.*)$"
LIST_LABELS = ("경로", "유입경로", "인입 채널", "접수일자", "기업명", "회사", "회사명", "문의처", "담당자", "문의자", "이름", "연락처", "전화", "이메일", "문의내용", "문의", "비고")
LEAST_LABELS = 3
#: Code points that are no characters; they mark labels while a text is cut and are taken out of the text before.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _field(key: Column, value: Column) -> Column:
    return F.struct(_strip(key).alias("key"), _strip(value).alias("value"))


def _lines(c: Column, pattern: str) -> Column:
    """Fields of the lines that have the pattern's two groups."""
    hit = F.filter(c, lambda x: x.rlike(pattern))
    return F.transform(hit, lambda x: _field(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))


def _cut(c: Column) -> Column:
    """Fields of a text in which each label stands between the two marks and its value runs to the next label."""
    pieces = F.split(c, _OPEN)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: _field(F.substring_index(p, _SHUT, 1), F.substring_index(p, _SHUT, -1)))


def _last(fields: Column) -> Column:
    """A map of fields in the order in which labels came first; of a repeated label the last value counts."""
    of = lambda k: F.element_at(F.filter(fields, lambda f: f["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(fields, lambda f: f["key"])), lambda k: F.struct(k, of(k))))


def lead_form(text: Column) -> Column:
    """struct<form, fields> of a message, null if it is no lead form (or null).

    F3: a letter mark and the words of registration; a label in stars has a line of its own, its value is the lines up to the next label
    without blank ones and guides in brackets.  F2: `*label:*` with a value up to the next label.  F1: `:emoji: label: value`, the value on that
    line.  F5: bullets `- label: value` of at least three different known labels.  The first dialect that fits decides, even if it finds no field.
    """
    t = F.regexp_replace(text, f"[{_OPEN}{_SHUT}]", "")
    lines = F.split(t, "\n")
    bare = F.transform(lines, _strip)
    marked = F.transform(F.filter(bare, lambda x: (x != "") & ~x.rlike(GUIDE)), lambda x: F.regexp_replace(x, STAR_LINE, f"{_OPEN}$1{_SHUT}"))
    letter = F.filter(_cut(F.array_join(marked, "\n")), lambda f: f["key"] != "")
    listed = F.filter(_lines(lines, BULLET), lambda f: f["key"].isin(*LIST_LABELS))
    form = lambda name, fields: F.struct(F.lit(name).alias("form"), _last(fields).alias("fields"))
    return (
        F.when(F.contains(t, F.lit(LETTER)) & F.contains(t, F.lit(REGISTERED)), form("F3", letter))
        .when(F.contains(t, F.lit(RECEIVED)), form("F2", _cut(F.regexp_replace(t, STAR_COLON, f"{_OPEN}$1{_SHUT}$2"))))
        .when(F.contains(t, F.lit(ARRIVED)), form("F1", _lines(bare, EMOJI_LINE)))
        .when(F.size(F.array_distinct(F.transform(listed, lambda f: f["key"]))) >= LEAST_LABELS, form("F5", listed)))


#: Messages of parts and documents' texts; the same expression for Spark and the oracle.
_MESSAGES = """SELECT p_partkey AS id, CASE p_partkey % 6
  WHEN 0 THEN concat('신규 리드 도착 :tada:', chr(10), ' :office: 회사: ', p_name, chr(10), ':bust: 담당자: ', p_brand, chr(10), 'no :label here', chr(10), ':memo: 비고: a:', p_type)
  WHEN 1 THEN concat('*접수일자:* ', p_size, chr(10), '*회사:* ', p_name, ' *담당자:* x', chr(10), '*담당자:*', chr(10), p_brand, chr(10), '*비고:* a:', p_type)
  WHEN 2 THEN concat(':love_letter: 신규 리드 등록', chr(10), '*회사*', chr(10), '(name of the firm)', chr(10), p_name, chr(10), '*담당자* ', chr(10), chr(10), p_brand, chr(10), '*비고*', chr(10), 'a:', p_type)
  WHEN 3 THEN concat('Lead', chr(10), '- 회사 : ', p_name, chr(10), '• *담당자*: ', p_brand, chr(10), '- other: x', chr(10), '- 비고: a:', p_type, chr(10), '- 회사: ', p_name)
  WHEN 4 THEN concat('- 회사: ', p_name, chr(10), '- 담당자: ', p_brand, chr(10), '- 회사: ', p_type) ELSE p_name END AS t FROM {part}"""
_LABEL = r"list_last(regexp_extract_all(t, CASE form WHEN 'F1' THEN '(?m)^ *:[a-z]+: *{0}: *(.*)$' WHEN 'F2' THEN '(?m)^\*{0}:\*\s*([^\n]*)' WHEN 'F3' THEN '\*{0}\* *\n(?:\(.*\))?\n*([^*]*[^*\n])' ELSE '(?m)^[-•] \*?{0}\*? ?: (.*)$' END, 1))"


@query("S19_lead_form", rf"""WITH m AS ({_MESSAGES.replace('{', '').replace('}', '')}),
f AS (SELECT id, t, CASE WHEN contains(t, '{LETTER}') THEN 'F3' WHEN contains(t, '{RECEIVED}') THEN 'F2' WHEN contains(t, '{ARRIVED}') THEN 'F1' WHEN len(list_filter(['회사', '담당자', '비고'], lambda l: regexp_matches(t, '(?m)^[-•] \*?' || l || '\*? ?: '))) = 3 THEN 'F5' END AS form FROM m)
SELECT id, form, CASE WHEN form IS NOT NULL THEN {_LABEL.format('회사')} END AS company, CASE WHEN form IS NOT NULL THEN {_LABEL.format('담당자')} END AS person, CASE WHEN form IS NOT NULL THEN {_LABEL.format('비고')} END AS note FROM f""")
def _s19(g):
    m = g.spark.sql(_MESSAGES, part=g.part)
    f = m.select("id", F.explode(F.array(lead_form(F.col("t")))).alias("f"))  # computed once, then read
    at = lambda k: F.col("f.fields")[k]
    return f.select("id", F.col("f.form").alias("form"), at("회사").alias("company"), at("담당자").alias("person"), at("비고").alias("note"))
