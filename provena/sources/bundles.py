"""Source lists: explicit entries, and bundles that take files by pattern.

A bundle's patterns are compiled to anchored regular expressions over a listing of files, which is a DataFrame (of `binaryFile` metadata, or any other).
Excluded files go, files that are registered by themselves are left to their own entry, and overrides are applied in order, a later one on top of an earlier one.

Defined cases: `*` and `?` stay within one folder, `**/` is any number of folders, none too; an excluding or overriding pattern ends in `/**` (everything below), names a
folder, or matches from the right; a root without files is an error unless the bundle is optional; two sources of one id are an error that names them; the
listing's other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from provena.registry import query

#: Fields that an entry takes over from its bundle.
INHERITED = ("source_type", "parser", "sensitivity", "origin", "doc_status", "notes")


def glob_pattern(pattern: str) -> str:
    """The regular expression of a glob, without anchors."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def matches(rel: Column, pattern: str) -> Column:
    """An excluding or overriding pattern on a path below the root."""
    if pattern.endswith("/**"):
        return (rel == pattern[:-3]) | F.startswith(rel, F.lit(pattern[:-2]))
    return rel.rlike(f"(?:^|/){glob_pattern(pattern)}$") | F.startswith(rel, F.lit(pattern.rstrip("/") + "/"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def expand(files: DataFrame, bundle: dict, taken: DataFrame | None = None) -> DataFrame:
    """The entries of one bundle over `files` (path, ...): id, path, from_bundle, inherited and overridden fields, override_reason."""
    root = bundle["root"].rstrip("/") + "/"
    mine = files.where(F.startswith("path", F.lit(root)))
    if not bundle.get("optional") and mine.isEmpty():
        raise FileNotFoundError(f"no files below {root} for {bundle.get('id')}")
    rel = F.substr("path", F.lit(len(root) + 1))
    x = mine.where(rel.rlike(f"^{glob_pattern(bundle['include'])}$"))
    for pattern in bundle.get("exclude") or []:
        x = x.where(~matches(rel, pattern))
    if taken is not None:
        x = x.join(taken.select("path").distinct(), "path", "left_anti")
    rules = bundle.get("overrides") or []
    fields = dict.fromkeys([f for f in INHERITED if f in bundle] + [k for r in rules for k in r if k not in ("match", "reason", "id")])
    put = {f: F.lit(bundle.get(f)).cast("string") for f in fields}
    ident, reason = F.concat(F.lit(bundle["id_prefix"] + "_"), slug(F.regexp_replace(rel, r"\.[^.]*$", ""))), F.lit(None).cast("string")
    for r in rules:
        on = matches(rel, r["match"])
        put = {f: F.when(on, F.lit(r[f]).cast("string")).otherwise(c) if f in r else c for f, c in put.items()}
        ident = F.when(on, F.lit(r["id"])).otherwise(ident) if "id" in r else ident
        reason = F.when(on, F.lit(r.get("reason"))).otherwise(reason)
    return x.select("*", ident.alias("id"), F.lit(bundle["id"]).alias("from_bundle"), *[c.alias(f) for f, c in put.items()], reason.alias("override_reason"))


def sources(files: DataFrame, explicit: DataFrame, bundles: list[dict]) -> DataFrame:
    """All sources: `explicit` (id, path, ...) first, and the files of the bundles that aren't explicit."""
    out = explicit
    for b in bundles:
        out = out.unionByName(expand(files, b, explicit), allowMissingColumns=True)
    twice = [r.id for r in out.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()]
    if twice:
        raise ValueError(f"source ids that are there more than once: {', '.join(twice)}")
    return out


BUNDLES = [
    {"id": "com", "root": "/web/com", "include": "**/*", "id_prefix": "src_com", "exclude": ["en/**", "4*", "blog"], "source_type": "page", "sensitivity": "internal",
     "overrides": [{"match": "**/1*", "sensitivity": "restricted", "reason": "starts with 1"}, {"match": "de/**", "parser": "german"}]},
    {"id": "net", "root": "/web/net", "include": "*/*[0-4]", "id_prefix": "src_net", "source_type": "page", "sensitivity": "public"},
    {"id": "none", "root": "/web/nowhere", "include": "*", "id_prefix": "src_none", "optional": True},
]
#: Pages as files: their top-level domain, language and number, in that order.
_FILES = "SELECT page_id, concat('/web/', regexp_extract(url, 'example[.]([a-z]+)/', 1), '/', regexp_extract(url, 'example[.][a-z]+/([a-z]+)/', 1), '/', regexp_extract(url, '/([0-9]+)', 1), '-', cast(page_id AS string)) AS path FROM {pages}"


@query("S3_bundle_slugs", r"""
WITH f AS (SELECT page_id, '/web/' || regexp_extract(url, 'example[.]([a-z]+)/', 1) AS root, regexp_extract(url, 'example[.][a-z]+/([a-z]+)/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) || '-' || page_id AS name FROM pages),
x AS (SELECT *, root || '/' || lang || '/' || name AS path FROM f)
SELECT page_id, 'src_own_' || page_id AS id, NULL AS from_bundle, 'by hand' AS source_type, 'internal' AS sensitivity, NULL AS parser, NULL AS override_reason FROM x WHERE page_id % 9 = 0
UNION ALL SELECT page_id, 'src_com_' || trim(regexp_replace(lower(lang || '/' || name), '[^a-z0-9]+', '_', 'g'), '_'), 'com', 'page', CASE WHEN name LIKE '1%' THEN 'restricted' ELSE 'internal' END, CASE WHEN lang = 'de' THEN 'german' END, CASE WHEN name LIKE '1%' AND lang <> 'de' THEN 'starts with 1' END
  FROM x WHERE root = '/web/com' AND page_id % 9 <> 0 AND lang <> 'en' AND name NOT LIKE '4%'
UNION ALL SELECT page_id, 'src_net_' || trim(regexp_replace(lower(lang || '/' || name), '[^a-z0-9]+', '_', 'g'), '_'), 'net', 'page', 'public', NULL, NULL FROM x WHERE root = '/web/net' AND page_id % 9 <> 0 AND regexp_matches(name, '[0-4]$')""")
def _s3(g):
    """Pages as files in overlapping bundles; every ninth is registered by itself."""
    files = g.spark.sql(_FILES, pages=g.pages)
    own = files.where("page_id % 9 = 0").select("page_id", "path", F.concat(F.lit("src_own_"), F.col("page_id").cast("string")).alias("id"), F.lit("by hand").alias("source_type"), F.lit("internal").alias("sensitivity"))
    return sources(files, own, BUNDLES).select("page_id", "id", "from_bundle", "source_type", "sensitivity", "parser", "override_reason")
