"""Parsed records to graph elements: one pass over records of thirteen kinds.

A record's payload is a VARIANT.  Its kind picks a handler, a column expression that gives an array of tagged elements: nodes, observations, claims
and edges.  The arrays are exploded once, so records are read once whatever kinds they are, and `merged` and the tags
split the result.  Kinds that only leave evidence give an empty array.

What handlers look up (business domains, needs, capabilities, products) is a registry: configuration of bounded size, held as maps in the plan.

Defined cases: a record without its required field (feature or account name, a known domain) gives nothing, and `skipped` counts it; names are keys after
corporate affixes, brackets, spaces and case are gone; a payload that is no JSON, null, or of an unknown kind gives nothing; repeated
records give repeated elements, which `merged` puts together by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from provena.functions import text as X
from provena.operators.tagging import found_phrases
from provena.registry import query

#: Entries of a registry map; more are no configuration.
MOST = 5_000
ELEMENT = "struct<out: string, type: string, label: string, key: string, to_label: string, to_key: string, statement: string, value: string, props: map<string, string>>"
EVIDENCE_ONLY = ("code_asset", "doc_section")
# Stages that decide a deal, the contact that is a meeting, the mark of a finished axis, and levels from the most specific on.
LOST, WON, MEETING, DONE = ("실패", "실패마감처리"), ("수주고객", "운영고객"), "미팅", "✔"
LEVELS = (("기능명", "기능명"), ("상세분류", "상세분류"), ("영역", "중분류"), ("화면", "대분류"))


@dataclass(frozen=True)
class Registry:
    domains: dict[str, str] = field(default_factory=dict)  # id: name
    targets: dict[str, list[str]] = field(default_factory=dict)  # domain id: industries it targets
    target_rows: dict[str, list[str]] = field(default_factory=dict)  # end of a locator: domain ids
    domain_of: dict[str, list[str]] = field(default_factory=dict)  # value in a cell: domain ids
    domain_split: tuple[str, ...] = ()
    needs: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # id: name, terms
    capabilities: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # id: name, ids of needs it addresses
    hints: dict[str, dict[str, list[str]]] = field(default_factory=dict)  # level: key of a name: capability ids
    products: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, x in self.__dict__.items():
            if len(x) > MOST:
                raise ValueError(f"{name} has {len(x)} entries, more than {MOST}")


def _map(d: dict[str, list[str] | str], kind: str) -> Column:
    if not d:
        return F.create_map().cast(f"map<string, {kind}>")
    put = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), put(v))])


def _s(c: Column | str | None) -> Column:
    return F.lit(None).cast("string") if c is None else c if isinstance(c, Column) else F.lit(c)


def element(out: str, type_: Column | str, key: Column, label=None, to_label=None, to_key=None, statement=None, value=None, props: dict[str, Column] | None = None) -> Column:
    p = F.create_map(*[x for k, v in (props or {}).items() for x in (F.lit(k), v.cast("string"))]) if props else F.create_map()
    parts = {"out": out, "type": type_, "label": label, "key": key, "to_label": to_label, "to_key": to_key, "statement": statement, "value": value}
    return F.struct(*[_s(v).cast("string").alias(k) for k, v in parts.items()], p.cast("map<string, string>").alias("props"))


def node(label: str, key: Column, **props: Column) -> Column:
    return F.when(key.isNotNull() & (key != ""), element("node", label, key, props=props))


def edge(type_: str, label: str, key: Column, to_label: str, to_key: Column) -> Column:
    return F.when(key.isNotNull() & to_key.isNotNull() & (to_key != ""), element("edge", type_, key, label, to_label, to_key))


def claim(kind: str, subject: Column, value: Column, about: str, about_key: Column, statement: Column) -> Column:
    """A claim's key is that of what it says and where: its subject, its value and its record."""
    return element("claim", kind, subject, None, about, about_key, statement, value)


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$['{name}']", kind)


def _flat(c: Column) -> Column:
    return F.nullif(X.squeeze(c), F.lit(""))


def text(name: str) -> Column:
    """A field as one line, null where it is empty."""
    return _flat(_get(name))


def _obs() -> Column:
    return F.col("p.obs")


#: Where a kind of record names its account.
ACCOUNT_CELL = {"activity_row": "$['고객사']", "deal_row": "$['고객사']", "weekly_row": "$['고객사']", "lead_alert": "$.fields['회사']", "meeting_note": "$.counterpart"}


def _prepared(records: DataFrame, r: Registry) -> DataFrame:
    """The payload, and what several elements of a record need: worked out once a row, by an explode of one item that the optimizer doesn't see through."""
    once = lambda df, name, c: df.select(*[k for k in df.columns if k != name], F.explode(F.array(c)).alias(name))
    x = once(records.select("source_id", "locator", "record_kind", "excerpt", "authored_at", "structured"), "v", F.try_parse_json("structured")).drop("structured")
    raw = F.lit(None).cast("string")
    for kind, path in ACCOUNT_CELL.items():
        raw = F.when(F.col("record_kind") == kind, _flat(F.try_variant_get("v", path, "string"))).otherwise(raw)
    x = once(x, "raw", raw)
    name, scope = _scope(r, F.col("raw"))
    name, scope = (F.when(F.col("record_kind").isin("deal_row", "weekly_row"), c).otherwise(d) for c, d in ((name, F.col("raw")), (scope, F.lit(None))))
    x = once(x, "n", F.struct(name.alias("name"), scope.alias("scope"), X.hash_id(F.col("source_id"), F.col("locator")).alias("obs")))
    p = F.struct("raw", "n.name", "n.scope", "n.obs", _account(F.col("n.name")).alias("account"), X.clean_display(F.coalesce("n.name", F.lit(""))).alias("shown"))
    x = once(x, "p", p).drop("raw", "n")
    deal = F.concat(F.col("p.account"), F.lit("|"), F.coalesce(F.nullif(X.match_key(F.col("p.scope")), F.lit("")), F.lit("base")))
    return once(x, "deal", F.when(F.col("record_kind").isin("deal_row", "weekly_row"), deal))


def observation(statement: Column, mentions: list[tuple[str, Column]] = (), event: Column | None = None, more: Column | None = None) -> Column:
    """The record's observation with its links; `more` is an array of further links."""
    links = [edge("MENTIONS", "Observation", _obs(), label, key) for label, key in mentions]
    if event is not None:
        links.append(edge("OBSERVED_IN", "Observation", _obs(), "Event", event))
    own = F.array(element("observation", "record", _obs(), statement=statement), *links)
    return own if more is None else F.concat(own, more)


def _account(c: Column) -> Column:
    return F.nullif(X.match_key(F.coalesce(c, F.lit(""))), F.lit(""))


def _own_account(kind: Column | str | None = None) -> Column:
    """The node of the record's own account."""
    return node("Account", F.col("p.account"), canonical_name=F.col("p.shown"), account_kind=_s(kind))


def _account_node(name: Column, kind: Column | str | None = None) -> Column:
    return node("Account", _account(name), canonical_name=X.clean_display(name), account_kind=_s(kind))


def _domain_links(r: Registry, raw: Column, anchor: str, key: Column, split: bool) -> Column:
    """Claims and edges of the domains that a cell names; a value that isn't settled links nothing."""
    cell = F.coalesce(raw, F.lit(""))
    parts = F.split(cell, "|".join(map(re.escape, r.domain_split))) if split and r.domain_split else F.array(cell)
    ids = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(F.try_element_at(_map(r.domain_of, "array<string>"), F.trim(p)), F.array().cast("array<string>")))))
    return F.flatten(F.transform(ids, lambda d: F.array(
        node("BusinessDomain", d), claim("bd_registry_fact", F.concat(F.lit("in_domain::"), key, F.lit("::"), d), d, "BusinessDomain", d, F.concat(F.lit("recorded in domain "), d)),
        edge("IN_DOMAIN", anchor, key, "BusinessDomain", d))))


def _targets(r: Registry, domain: Column, industries: Column) -> Column:
    return F.flatten(F.transform(industries, lambda i: F.array(
        node("Industry", X.match_key(i), name=i), claim("bd_registry_fact", F.concat(F.lit("bd.targets::"), domain, F.lit("::"), i), i, "BusinessDomain", domain, F.concat(domain, F.lit(" targets "), i)),
        edge("TARGETS", "BusinessDomain", domain, "Industry", X.match_key(i)))))


def _feature(r: Registry) -> Column:
    name, screen, area, sub = (text(n) for n in ("기능명", "대분류", "중분류", "상세분류"))
    key = F.concat_ws("|", *[X.match_key(F.coalesce(c, F.lit(""))) for c in (screen, area, sub, name)])
    since = F.coalesce(text("introduced_in"), F.lit("unknown"))
    centers = F.coalesce(_get("센터구분", "array<string>"), F.array().cast("array<string>"))
    # the most specific level that is known decides
    level = lambda hint, cell: F.when(text(cell).isNotNull(), F.try_element_at(_map(r.hints.get(hint, {}), "array<string>"), X.text_key(text(cell))))
    ids = F.coalesce(*[level(hint, cell) for hint, cell in LEVELS], F.array().cast("array<string>"))
    caps = F.flatten(F.transform(ids, lambda c: F.array(
        node("Capability", c), claim("product_spec", F.concat(F.lit("feature.implements::"), key, F.lit("::"), c), c, "Feature", key, F.concat(name, F.lit(" implements "), c)), edge("IMPLEMENTS", "Feature", key, "Capability", c))))
    own = F.array(
        node("Feature", key, name=name, screen=screen, area=area, sub_area=sub, introduced_in=since, livetalk=F.array_contains(centers, "LiveTalk"), grouptalk=F.array_contains(centers, "GroupTalk")),
        F.when(since != "unknown", claim("product_spec", F.concat(F.lit("feature.introduced_in::"), key), since, "Feature", key, F.concat(name, F.lit(" is there since "), since))))
    return F.when(name.isNotNull(), F.concat(observation(F.concat(F.lit("the map names "), name), [("Feature", key)]), own, caps))


def _domain_record(r: Registry, kind: str, what: str, value: Column, targets: bool) -> Column:
    by_name = {"".join(n.split()).lower(): d for d, n in r.domains.items()}
    d = F.try_element_at(_map(by_name, "string"), X.match_key(F.coalesce(text("BD"), F.lit(""))))
    own = F.array(node("BusinessDomain", d, name=F.try_element_at(_map(r.domains, "string"), d)), claim(kind, F.concat(F.lit(f"bd.{what}::"), d), value, "BusinessDomain", d, F.concat(d, F.lit(f" {what}: "), F.coalesce(value, F.lit("-")))))
    more = _targets(r, d, F.coalesce(F.try_element_at(_map(r.targets, "array<string>"), d), F.array().cast("array<string>"))) if targets else F.array().cast(f"array<{ELEMENT}>")
    return F.when(d.isNotNull(), F.concat(observation(F.concat(F.lit(f"{what} of "), d), [("BusinessDomain", d)]), own, more))


def _bd_row(r: Registry) -> Column:
    value = F.concat_ws("|", *[F.coalesce(text(n), F.lit("")) for n in ("산업", "타겟기업", "BR", "Guest")])
    return _domain_record(r, "bd_registry_fact", "definition", value, True)


def _bd_market(r: Registry) -> Column:
    return _domain_record(r, "market_assessment", "market_size", text("시장사이즈"), True)


def _bd_maturity(r: Registry) -> Column:
    axes = F.coalesce(_get("maturity", "map<string, string>"), F.create_map().cast("map<string, string>"))
    done = F.array_sort(F.map_keys(F.map_filter(axes, lambda k, v: v == DONE)))
    return _domain_record(r, "bd_registry_fact", "maturity", F.array_join(done, "|"), False)


def _bd_targets(r: Registry) -> Column:
    none = F.array().cast("array<string>")
    ends = F.filter(F.array(*map(F.lit, r.target_rows)).cast("array<string>"), lambda e: F.endswith(F.col("locator"), e))
    ids = F.try_element_at(_map(r.target_rows, "array<string>"), F.get(ends, 0))
    industries = F.filter(F.transform(F.split(F.coalesce(text("산업"), F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.flatten(F.transform(F.coalesce(ids, none), lambda d: F.concat(F.array(node("BusinessDomain", d), edge("MENTIONS", "Observation", _obs(), "BusinessDomain", d)), _targets(r, d, industries))))
    return F.when(ids.isNotNull(), observation(F.concat(F.lit("domains of "), F.coalesce(text("산업"), F.lit("-"))), more=pairs))


def _event(type_: Column | str, title: Column, mode: Column | None = None) -> tuple[Column, Column]:
    key = X.hash_id(F.col("source_id"), F.col("locator"), X.text_key(title))
    return key, node("Event", key, event_type=_s(type_), title=F.substring(title, 1, 300), mode=_s(mode))


def _activity(r: Registry) -> Column:
    mode = text("접촉방식")
    title = F.coalesce(text("미팅내용"), F.concat(F.coalesce("p.raw", F.lit("")), F.lit(" contact")))
    event, made = _event(F.when(mode == MEETING, "meeting").otherwise("contact"), title, mode)
    account, name = F.col("p.account"), F.col("p.shown")
    told = F.when(account.isNotNull(), claim("deal_fact", F.concat(F.lit("activity::"), name, F.lit("::"), F.col("locator")), title, "Account", account, F.concat(name, F.lit(": "), title)))
    return F.concat(observation(title, [("Account", account)], event), F.array(made, _own_account(), told))


def _scope(r: Registry, raw: Column) -> tuple[Column, Column]:
    """Account and scope of a cell: the last word is a scope if it is a known one."""
    last = F.substring_index(raw, " ", -1)
    known = last.isin(*r.scopes) & F.contains(raw, F.lit(" ")) if r.scopes else F.lit(False)
    return F.when(known, F.regexp_replace(raw, r"\s\S+$", "")).otherwise(raw), F.when(known, last)


def _deal(r: Registry, stage: Column, amount: Column, domain: str, split: bool, subject: Callable[[Column, Column], Column], more: Callable[[Column, Column, Column], list[Column]], outcome: Column | None = None) -> Column:
    raw, scope, account, shown, key = F.col("p.raw"), F.col("p.scope"), F.col("p.account"), F.col("p.shown"), F.col("deal")
    own = F.array(
        _own_account(F.when(stage == WON[1], "customer")), node("Deal", key, account_canonical=shown, deal_scope=scope, stage_value=stage, outcome=_s(outcome), amount_raw=amount, amount_krw=X.parse_amount(amount)),
        claim("deal_fact", subject(shown, F.coalesce(scope, F.lit("base"))), F.coalesce(stage, F.lit("")), "Deal", key, F.concat(shown, F.lit(" is at "), F.coalesce(stage, F.lit("-")))), edge("WITH_ACCOUNT", "Deal", key, "Account", account))
    return F.when(account.isNotNull(), F.concat(observation(F.concat(raw, F.lit(" at "), F.coalesce(stage, F.lit("-"))), [("Account", account), ("Deal", key)]), own, *more(account, shown, key), _domain_links(r, text(domain), "Deal", key, split)))


def _deal_row(r: Registry) -> Column:
    stage = text("단계")
    outcome = F.when(stage.isin(*LOST), "lost").when(stage.isin(*WON), "won").otherwise("open")

    def more(account: Column, name: Column, key: Column) -> list[Column]:
        industry = text("업권")
        i = X.match_key(industry)
        belongs = F.when(industry.isNotNull(), F.array(
            node("Industry", i, name=industry), edge("MENTIONS", "Observation", _obs(), "Industry", i), claim("deal_fact", F.concat(F.lit("account.industry::"), name), industry, "Account", account, F.concat(name, F.lit(" is in "), industry)),
            edge("BELONGS_TO", "Account", account, "Industry", i))).otherwise(F.array().cast(f"array<{ELEMENT}>"))
        sold = F.flatten(F.transform(F.array_sort(found_phrases(F.coalesce(F.col("excerpt"), F.lit("")), list(r.products))), lambda p: F.array(
            node("Product", X.match_key(p), name=p), claim("deal_fact", F.concat(F.lit("deal.product::"), key, F.lit("::"), p), p, "Deal", key, F.concat(name, F.lit(" buys "), p)), edge("FOR_PRODUCT", "Deal", key, "Product", X.match_key(p)))))
        return [belongs, sold]

    amount = F.coalesce(text("예상매출"), text("금액"), text("예상_매출_금액"))
    return _deal(r, stage, amount, "업무_도메인", True, lambda n, s: F.concat(F.lit("deal.stage::"), n, F.lit("::"), s), more, outcome)


def _weekly(r: Registry) -> Column:
    return _deal(r, text("현재단계"), text("금액"), "업무도메인", False, lambda n, s: F.concat(F.lit("weekly.stage::"), n, F.lit("::"), F.coalesce(text("주차"), F.lit(""))), lambda a, n, k: [])


def _pain(r: Registry) -> Column:
    raw = F.coalesce(text("pain_원문"), F.col("excerpt"))
    term = {t: n for n, (_, terms) in reversed(r.needs.items()) for t in terms}
    order = {n: f"{i:05d}" for i, n in enumerate(r.needs)}
    rank = F.transform(found_phrases(F.coalesce(raw, F.lit("")), list(term)), lambda t: F.try_element_at(_map({t: order[n] + n for t, n in term.items()}, "string"), t))
    known = F.substring(F.array_min(rank), 6, 1 << 20)  # the first need of the registry with a term in the text
    need = F.coalesce(known, X.hash_id(F.col("source_id"), F.col("locator"), X.text_key(raw)))
    name = F.coalesce(F.try_element_at(_map({n: x[0] for n, x in r.needs.items()}, "string"), known), F.substring(raw, 1, 120))
    who = F.filter(F.transform(F.split(F.coalesce(text("고객사"), F.lit("")), "[·,/]"), lambda x: F.trim(x)), lambda x: X.match_key(x) != "")
    asks = F.flatten(F.transform(who, lambda a: F.array(
        _account_node(a, "customer"), edge("MENTIONS", "Observation", _obs(), "Account", _account(a)),
        claim("customer_generalization", F.concat(F.lit("account.need::"), X.clean_display(a), F.lit("::"), need), need, "Need", need, F.concat(X.clean_display(a), F.lit(" has the problem "), name)), edge("HAS_NEED", "Account", _account(a), "Need", need))))
    solves: dict[str, list[str]] = {}
    for c, (_, ns) in r.capabilities.items():
        for n in ns:
            solves.setdefault(n, []).append(c)
    caps = F.coalesce(F.try_element_at(_map(solves, "array<string>"), known), F.array().cast("array<string>"))
    answers = F.flatten(F.transform(caps, lambda c: F.array(
        node("Capability", c), claim("customer_generalization", F.concat(F.lit("need.addressed_by::"), need, F.lit("::"), c), c, "Need", need, F.concat(c, F.lit(" addresses "), name)), edge("ADDRESSED_BY", "Need", need, "Capability", c))))
    return F.concat(observation(F.concat(F.lit("problem: "), F.substring(raw, 1, 200)), [("Need", need)]), F.array(node("Need", need, name=name, canonical=known.isNotNull(), unmapped_raw=F.when(known.isNull(), F.substring(raw, 1, 500)))), asks, answers)


def _lead(r: Registry) -> Column:
    company = F.col("p.raw")
    event, made = _event("contact", F.concat(F.lit("new lead: "), F.coalesce(company, F.lit("no company"))))
    account, name = F.col("p.account"), F.col("p.shown")
    told = F.when(account.isNotNull(), claim("deal_fact", F.concat(F.lit("lead::"), name, F.lit("::"), F.col("locator")), name, "Account", account, F.concat(F.lit("a lead of "), name)))
    return F.concat(observation(F.concat(F.lit("a lead of "), F.coalesce(company, F.lit("no company"))), [("Account", account)], event), F.array(made, _own_account("lead"), told))


def _meeting(r: Registry) -> Column:
    title = F.coalesce(text("title"), text("subject"), F.lit("meeting"))
    event, made = _event("meeting", title, text("mode"))
    account, name = F.col("p.account"), F.col("p.shown")
    told = F.when(account.isNotNull(), claim("deal_fact", F.concat(F.lit("meeting::"), name, F.lit("::"), F.col("locator")), title, "Account", account, F.concat(name, F.lit(" met about "), title)))
    return F.concat(observation(F.concat(F.lit("a note: "), title), [("Account", account)], event), F.array(made, _own_account(), told))


HANDLERS: dict[str, Callable[[Registry], Column]] = {
    "feature_row": _feature, "bd_row": _bd_row, "bd_market": _bd_market, "bd_maturity": _bd_maturity, "bd_targets": _bd_targets, "activity_row": _activity,
    "deal_row": _deal_row, "weekly_row": _weekly, "pain_row": _pain, "lead_alert": _lead, "meeting_note": _meeting,
}


def elements(records: DataFrame, registry: Registry) -> DataFrame:
    """(record_kind, source_id, locator, authored_at, and the fields of an element) of records (source_id, locator, record_kind, excerpt, authored_at, structured as JSON)."""
    x = _prepared(records, registry)
    made = F.lit(None).cast(f"array<{ELEMENT}>")
    for kind, handler in HANDLERS.items():
        made = F.when(F.col("record_kind") == kind, handler(registry).cast(f"array<{ELEMENT}>")).otherwise(made)
    x = x.select("record_kind", "source_id", "locator", "authored_at", F.explode(F.array_compact(made)).alias("e"))
    return x.select("record_kind", "source_id", "locator", "authored_at", "e.*")


def skipped(records: DataFrame, made: DataFrame) -> DataFrame:
    """(record_kind, n) of records with a handler that gave nothing."""
    some = made.select("source_id", "locator", "record_kind").distinct()
    left = records.where(F.col("record_kind").isin(*HANDLERS)).join(some, ["source_id", "locator", "record_kind"], "left_anti")
    return left.groupBy("record_kind").agg(F.count("*").alias("n"))


def merged(made: DataFrame) -> DataFrame:
    """Nodes by (label, key): their sources, and of each property the value of the last record in the order of source and locator that has one."""
    n = made.where("out = 'node'")
    props = n.select("type", "key", "source_id", "locator", F.explode("props").alias("name", "value")).where("value IS NOT NULL")
    props = props.groupBy("type", "key", "name").agg(F.max_by("value", F.struct("source_id", "locator", "value")).alias("value"))
    props = props.groupBy("type", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("props"))
    keys = n.groupBy("type", "key").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("n"))
    return keys.join(props, ["type", "key"], "left")


# records of all kinds from the tables at hand


_RECORDS = [
    ("feature_row", "SELECT 'map' AS source_id, concat('r', cast(p_partkey AS string)) AS locator, p_name AS excerpt, to_json(named_struct('기능명', p_name, '대분류', p_brand, '중분류', p_type, '상세분류', '', '센터구분', array('LiveTalk'), 'introduced_in', CASE WHEN p_size <= 12 THEN 'v1' WHEN p_size <= 25 THEN 'v2' WHEN p_size <= 37 THEN 'v3' ELSE 'unknown' END)) AS structured FROM {part}"),
    ("bd_row", "SELECT 'bd', concat('a', cast(n_nationkey AS string)), n_name, to_json(named_struct('BD', n_name, '산업', r_name, '타겟기업', 'all', 'BR', 'b', 'Guest', 'g')) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"),
    ("bd_market", "SELECT 'bd', concat('m', cast(n_nationkey AS string)), n_name, to_json(named_struct('BD', n_name, '시장사이즈', 'large')) FROM {nation}"),
    ("bd_maturity", "SELECT 'bd', concat('p', cast(n_nationkey AS string)), n_name, to_json(named_struct('BD', CASE WHEN n_nationkey % 5 = 0 THEN 'unheard of' ELSE n_name END, 'maturity', map('idea', '✔', 'sale', '-'))) FROM {nation}"),
    ("bd_targets", "SELECT 'bd', concat('sheet#r', cast(r_regionkey AS string)), r_name, to_json(named_struct('산업', r_name)) FROM {region}"),
    ("activity_row", "SELECT 'log', concat('e', cast(e.event_id AS string)), e.event_type, to_json(named_struct('고객사', CASE WHEN e.event_id % 9 = 0 THEN '' ELSE a.account END, '접촉방식', CASE WHEN e.event_type = 'purchase' THEN '미팅' ELSE e.event_type END, '미팅내용', concat(e.event_type, ' ', cast(e.event_id AS string)))) FROM {events} e JOIN {account} a ON e.user_id = a.custkey"),
    ("deal_row", "SELECT 'log', concat('o', cast(d.deal_id AS string)), concat('order ', d.stage), to_json(named_struct('고객사', concat(a.account, CASE d.deal_id % 3 WHEN 0 THEN ' renewal' WHEN 1 THEN ' pilot' ELSE '' END), '단계', CASE d.outcome WHEN 'won' THEN '수주고객' WHEN 'lost' THEN '실패' ELSE '제안' END, '예상매출', concat(cast(d.deal_id % 50 AS string), '억'), '업권', CASE WHEN d.deal_id % 4 > 0 THEN i.industry END, '업무_도메인', CASE WHEN d.deal_id % 6 = 0 THEN concat(n.domain, '/other') ELSE n.domain END)) FROM {deal} d JOIN {account} a ON d.custkey = a.custkey JOIN {domain} n ON a.nationkey = n.nationkey JOIN {industry} i ON n.regionkey = i.regionkey"),
    ("weekly_row", "SELECT 'plan', concat('s', cast(s_suppkey AS string)), s_name, to_json(named_struct('고객사', s_name, '금액', '3억', '현재단계', 'talks', '주차', concat('W', cast(s_suppkey % 52 AS string)), '업무도메인', n_name)) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"),
    ("pain_row", "SELECT 'pain', concat('h', cast(custkey AS string), ' ', need), need, to_json(named_struct('고객사', concat(account, '·Other ', cast(custkey % 7 AS string)), 'pain_원문', concat('problem with ', need, ' today'))) FROM {has_need}"),
    ("lead_alert", "SELECT 'leads', concat('c', cast(custkey AS string)), account, to_json(named_struct('fields', map('회사', CASE WHEN custkey % 11 = 0 THEN '' ELSE account END))) FROM {account} WHERE kind = 'prospect'"),
    ("meeting_note", "SELECT 'chat', concat('t', cast(conv_id AS string), '.', cast(turn AS string)), text, to_json(named_struct('title', concat('conv ', cast(conv_id AS string)), 'counterpart', CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('Partner ', cast(conv_id % 9 AS string)) END, 'mode', role)) FROM {conversations}"),
    ("code_asset", "SELECT 'code', url, url, '{{}}' FROM {pages}"),
    ("doc_section", "SELECT source, cast(doc_id AS string), text, '{{}}' FROM {documents}"),
]


def corpus_records(g) -> DataFrame:
    parts = []
    for kind, sql in _RECORDS:
        used = {n: getattr(g, n) for n in set(re.findall(r"(?<!\{)\{(\w+)\}", sql))}
        parts.append(g.spark.sql(sql, **used).toDF("source_id", "locator", "excerpt", "structured").withColumn("record_kind", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("authored_at", F.lit(None).cast("timestamp"))


def corpus_registry(g) -> Registry:
    """Configuration from the small tables: nations as domains, regions as industries, part types as capabilities, part names as needs."""
    take = lambda df: df.limit(MOST + 1).collect()
    nations = take(g.nation.join(g.region, g.nation.n_regionkey == g.region.r_regionkey).orderBy("n_nationkey"))
    types = sorted(r[0] for r in take(g.part.select("p_type").distinct()))
    needs = {r.need: (r.need, [r.need]) for r in take(g.part.select(F.col("p_name").alias("need")).distinct().where("length(need) % 2 = 0").orderBy("need"))}
    by = {}
    for r in take(g.addressed_by.orderBy("capability", "need")):
        by.setdefault(r.capability, []).append(r.need)
    ids = {r.n_name: f"bd_{r.n_nationkey}" for r in nations}
    rows: dict[str, list[str]] = {}
    for r in nations:
        rows.setdefault(f"#r{r.n_regionkey}", []).append(ids[r.n_name])
    return Registry(
        domains={i: n for n, i in ids.items()}, targets={ids[r.n_name]: [r.r_name] for r in nations}, target_rows=rows, domain_of={n: [i] for n, i in ids.items()}, domain_split=("/",), needs=needs,
        capabilities={t: (t, [n for n in by.get(t, []) if n in needs]) for t in types}, hints={"영역": {plain_key(t): [t] for t in types}}, products=("URGENT", "HIGH", "LOW"), scopes=("renewal", "pilot"))


def plain_key(s: str) -> str:
    """A name's key on the driver, for names of letters, digits and spaces."""
    return "".join(s.split()).lower()


_K = r"lower(regexp_replace(regexp_replace({}, '(?i)(Inc\.?|Co\.?|Ltd\.?)', ' ', 'g'), '\s+', '', 'g'))"
_D = r"regexp_replace(trim(regexp_replace(regexp_replace({}, '(?i)(Inc\.?|Co\.?|Ltd\.?)', ' ', 'g'), '\s+', ' ', 'g')), '^[ ·,-]+|[ ·,-]+$', '', 'g')"


def _rows(kind: str, frm: str, *outs: tuple[str, str, str]) -> str:
    """SQL rows of one kind: (out, type, key) each, over the relation `frm`; keys that are null don't count."""
    return " UNION ALL ".join(f"SELECT '{kind}' AS record_kind, '{o}' AS out, '{t}' AS type, {k} AS key FROM {frm}" for o, t, k in outs)


_OBS_SQL = "sha256(src || '|' || loc)"
_FEATURE = f"(SELECT *, 'map' AS src, 'r' || p_partkey AS loc, {_K.format('p_brand')} || '|' || {_K.format('p_type')} || '||' || {_K.format('p_name')} AS f FROM part)"
_BD = "(SELECT *, 'bd' AS src, '{0}' || n_nationkey AS loc, 'bd_' || n_nationkey AS d, lower(r_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"
_BDT = "(SELECT *, 'bd' AS src, 'sheet#r' || r_regionkey AS loc, 'bd_' || n_nationkey AS d, lower(replace(r_name, ' ', '')) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"
_ACT = f"(SELECT 'log' AS src, 'e' || event_id AS loc, event_type || ' ' || event_id AS title, CASE WHEN event_id % 9 <> 0 THEN {_K.format('account')} END AS a, CASE WHEN event_id % 9 <> 0 THEN {_D.format('account')} END AS name FROM events JOIN account ON user_id = custkey)"
_DEAL = f"""(SELECT 'log' AS src, 'o' || deal_id AS loc, {_K.format('account')} AS a, {_D.format('account')} AS name, CASE deal_id % 3 WHEN 0 THEN 'renewal' WHEN 1 THEN 'pilot' ELSE 'base' END AS scope, {_K.format('account')} || '|' || CASE deal_id % 3 WHEN 0 THEN 'renewal' WHEN 1 THEN 'pilot' ELSE 'base' END AS k,
  CASE WHEN deal_id % 4 > 0 THEN lower(replace(industry, ' ', '')) END AS i, 'bd_' || n.nationkey AS d, CASE WHEN stage LIKE '%URGENT%' THEN 'URGENT' WHEN stage LIKE '%HIGH%' THEN 'HIGH' WHEN stage LIKE '%LOW%' THEN 'LOW' END AS p FROM deal JOIN account USING (custkey) JOIN domain n USING (nationkey) JOIN industry USING (regionkey))"""
_WEEK = f"(SELECT 'plan' AS src, 's' || s_suppkey AS loc, {_K.format('s_name')} AS a, {_D.format('s_name')} AS name, {_K.format('s_name')} || '|base' AS k, s_suppkey, 'bd_' || s_nationkey AS d FROM supplier)"
_PAIN = f"""(SELECT 'pain' AS src, 'h' || custkey || ' ' || h.need AS loc, x.need, coalesce(x.need, sha256('pain|' || 'h' || custkey || ' ' || h.need || '|' || lower(replace('problem with ' || h.need || ' today', ' ', '')))) AS n, {_K.format('account')} AS a, {_D.format('account')} AS name, 'other' || custkey % 7 AS b, 'Other ' || custkey % 7 AS bname
  FROM has_need h LEFT JOIN (SELECT h2.need AS asked, min(p.p_name) AS need FROM (SELECT DISTINCT need FROM has_need) h2 JOIN (SELECT DISTINCT p_name FROM part WHERE length(p_name) % 2 = 0) p ON contains('problem with ' || h2.need || ' today', p.p_name) GROUP BY 1) x ON x.asked = h.need)"""
_LEAD = f"(SELECT 'leads' AS src, 'c' || custkey AS loc, 'newlead:' || CASE WHEN custkey % 11 = 0 THEN 'nocompany' ELSE lower(replace(account, ' ', '')) END AS title, CASE WHEN custkey % 11 <> 0 THEN {_K.format('account')} END AS a, CASE WHEN custkey % 11 <> 0 THEN {_D.format('account')} END AS name FROM account WHERE kind = 'prospect')"
_MEET = "(SELECT 'chat' AS src, 't' || conv_id || '.' || turn AS loc, 'conv' || conv_id AS title, CASE WHEN conv_id % 5 <> 0 THEN 'partner' || conv_id % 9 END AS a, CASE WHEN conv_id % 5 <> 0 THEN 'Partner ' || conv_id % 9 END AS name FROM conversations)"
_MENTION, _SEEN = ("edge", "MENTIONS", _OBS_SQL), ("observation", "record", _OBS_SQL)
_N18_SQL = " UNION ALL ".join([
    _rows("feature_row", _FEATURE, _SEEN, _MENTION, ("node", "Feature", "f"), ("claim", "product_spec", "CASE WHEN p_size <= 37 THEN 'feature.introduced_in::' || f END"), ("node", "Capability", "p_type"), ("claim", "product_spec", "'feature.implements::' || f || '::' || p_type"), ("edge", "IMPLEMENTS", "f")),
    *[_rows(kind, _BD.format(mark), _SEEN, _MENTION, ("node", "BusinessDomain", "d"), ("claim", claim_kind, f"'bd.{what}::' || d"), ("node", "Industry", "lower(replace(r_name, ' ', ''))"), ("claim", "bd_registry_fact", "'bd.targets::' || d || '::' || r_name"), ("edge", "TARGETS", "d"))
      for kind, mark, claim_kind, what in (("bd_row", "a", "bd_registry_fact", "definition"), ("bd_market", "m", "market_assessment", "market_size"))],
    _rows("bd_maturity", f"(SELECT * FROM {_BD.format('p')} WHERE n_nationkey % 5 <> 0)", _SEEN, _MENTION, ("node", "BusinessDomain", "d"), ("claim", "bd_registry_fact", "'bd.maturity::' || d")),
    _rows("bd_targets", f"(SELECT DISTINCT src, loc FROM {_BDT})", _SEEN), _rows("bd_targets", _BDT, _MENTION, ("node", "BusinessDomain", "d"), ("node", "Industry", "i"), ("claim", "bd_registry_fact", "'bd.targets::' || d || '::' || r_name"), ("edge", "TARGETS", "d")),
    _rows("activity_row", _ACT, _SEEN, ("edge", "MENTIONS", f"CASE WHEN a IS NOT NULL THEN {_OBS_SQL} END"), ("edge", "OBSERVED_IN", _OBS_SQL), ("node", "Event", "sha256(src || '|' || loc || '|' || replace(title, ' ', ''))"), ("node", "Account", "a"), ("claim", "deal_fact", "'activity::' || name || '::' || loc")),
    _rows("deal_row", _DEAL, _SEEN, _MENTION, _MENTION, ("edge", "MENTIONS", f"CASE WHEN i IS NOT NULL THEN {_OBS_SQL} END"), ("node", "Account", "a"), ("node", "Deal", "k"), ("claim", "deal_fact", "'deal.stage::' || name || '::' || scope"), ("edge", "WITH_ACCOUNT", "k"), ("node", "Industry", "i"),
          ("claim", "deal_fact", "CASE WHEN i IS NOT NULL THEN 'account.industry::' || name END"), ("edge", "BELONGS_TO", "CASE WHEN i IS NOT NULL THEN a END"), ("node", "Product", "lower(p)"), ("claim", "deal_fact", "'deal.product::' || k || '::' || p"), ("edge", "FOR_PRODUCT", "CASE WHEN p IS NOT NULL THEN k END"),
          ("node", "BusinessDomain", "d"), ("claim", "bd_registry_fact", "'in_domain::' || k || '::' || d"), ("edge", "IN_DOMAIN", "k")),
    _rows("weekly_row", _WEEK, _SEEN, _MENTION, _MENTION, ("node", "Account", "a"), ("node", "Deal", "k"), ("claim", "deal_fact", "'weekly.stage::' || name || '::W' || s_suppkey % 52"), ("edge", "WITH_ACCOUNT", "k"), ("node", "BusinessDomain", "d"), ("claim", "bd_registry_fact", "'in_domain::' || k || '::' || d"), ("edge", "IN_DOMAIN", "k")),
    _rows("pain_row", _PAIN, _SEEN, _MENTION, _MENTION, _MENTION, ("node", "Need", "n"), ("node", "Account", "a"), ("node", "Account", "b"), ("claim", "customer_generalization", "'account.need::' || name || '::' || n"), ("claim", "customer_generalization", "'account.need::' || bname || '::' || n"), ("edge", "HAS_NEED", "a"), ("edge", "HAS_NEED", "b")),
    _rows("pain_row", f"(SELECT p.n, b.capability AS c FROM {_PAIN} p JOIN addressed_by b ON b.need = p.need)", ("node", "Capability", "c"), ("claim", "customer_generalization", "'need.addressed_by::' || n || '::' || c"), ("edge", "ADDRESSED_BY", "n")),
    _rows("lead_alert", _LEAD, _SEEN, ("edge", "MENTIONS", f"CASE WHEN a IS NOT NULL THEN {_OBS_SQL} END"), ("edge", "OBSERVED_IN", _OBS_SQL), ("node", "Event", "sha256(src || '|' || loc || '|' || title)"), ("node", "Account", "a"), ("claim", "deal_fact", "'lead::' || name || '::' || loc")),
    _rows("meeting_note", _MEET, _SEEN, ("edge", "MENTIONS", f"CASE WHEN a IS NOT NULL THEN {_OBS_SQL} END"), ("edge", "OBSERVED_IN", _OBS_SQL), ("node", "Event", "sha256(src || '|' || loc || '|' || title)"), ("node", "Account", "a"), ("claim", "deal_fact", "'meeting::' || name || '::' || loc")),
])


@query("N18_record_handlers", f"SELECT record_kind, out, type, count(*) AS n, count(DISTINCT key) AS keys, min(key) AS first, max(key) AS last FROM ({_N18_SQL}) WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2, 3")
def _n18(g):
    """Elements of all kinds of records, counted by kind and type with their keys."""
    made = elements(corpus_records(g), corpus_registry(g))
    return made.groupBy("record_kind", "out", "type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("key").alias("first"), F.max("key").alias("last"))
