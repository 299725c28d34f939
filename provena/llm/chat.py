"""Chat formatting with schema fingerprints; DataFrame functions only.

A record's layout is known by a hash of its nested field paths.  Of a record's paths those count that
some layout names; sorted, joined and hashed they are its fingerprint, whether they come from the
schema of a typed table (once for the table) or from a JSON record (one by one).  One table, `mappings`,
leads from the fingerprint to a declarative mapping, an SQL expression that turns the record into
canonical turns (turn, role, text).  A layout has one fingerprint for each set of its optional paths
that may be absent, so fields that no layout knows, empty lists and missing optional fields do no harm.

The template writes a turn as `[INST]role[/INST]text</s>` after one `<s>`.  A control string inside
a text gets a backslash after its first character (one more when it has some already), which
is undone exactly when the output is read back.  The loss mask marks assistant texts.

Defined cases: null roles and texts are empty; turns are in order of (turn, role, text), nulls
first; repeated turns stay; a null conversation id is one conversation; records of an unknown layout,
of a mixture of layouts, or that aren't JSON, are returned by `unknown`, never dropped; a typed table of
an unknown layout is refused; extra columns and fields are ignored; a record without turns gives none;
an empty table gives no rows; long texts are formatted whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed control strings of the template, as a pattern of (first character)(rest).
CONTROL = r"([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
START, TURN, MID, END = "<s>", "[INST]", "[/INST]", "</s>"


@dataclass(frozen=True)
class Layout:
    """`like`: a DDL with the layout's fields; `turns`: array<struct<turn, role, text>> over `r`; `optional`: paths that may be absent."""

    name: str
    like: str
    turns: str
    optional: tuple[str, ...] = ()

    @property
    def fields(self) -> T.StructType:
        return T._parse_datatype_string(self.like)


def _turn(i: int, role: str, text: str) -> str:
    return f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})"


_SAY = "transform({a}, (m, i) -> named_struct('turn', cast(i AS bigint), 'role', {r}, 'text', m.{t}))"
_ASKED = r"concat_ws('\n', r.instruction, nullif(r.input, ''))"
_NAMES = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
_SYSTEM = f"filter(array({_turn(0, 'system', 'r.system')}), t -> t.text IS NOT NULL)"
#: The layouts that are understood, with their mappings.
LAYOUTS = [
    Layout("turn rows", "conv_id bigint, turn bigint, role string, text string", "array(named_struct('turn', r.turn, 'role', r.role, 'text', r.text))"),
    Layout("messages", "conv_id bigint, messages array<struct<role: string, content: string>>", _SAY.format(a="r.messages", r="m.role", t="content"),
           (".messages[].role", ".messages[].content")),
    Layout("conversations", "conv_id bigint, conversations array<struct<from: string, value: string>>", _SAY.format(a="r.conversations", r=_NAMES, t="value"),
           (".conversations[].from", ".conversations[].value")),
    Layout("dialog", "conv_id bigint, data struct<turns: array<struct<speaker: string, text: string>>>", _SAY.format(a="r.data.turns", r="m.speaker", t="text"),
           (".data.turns[].speaker", ".data.turns[].text")),
    Layout("prompt", "conv_id bigint, system string, prompt string, response string",
           f"concat({_SYSTEM}, array({_turn(1, 'user', 'r.prompt')}, {_turn(2, 'assistant', 'r.response')}))", (".system",)),
    Layout("instruction", "conv_id bigint, system string, instruction string, input string, output string",
           f"concat({_SYSTEM}, array({_turn(1, 'user', _ASKED)}, {_turn(2, 'assistant', 'r.output')}))", (".system", ".input")),
]


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; array items are `[]`."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in [f"{prefix}.{f.name}", *paths(f.dataType, f"{prefix}.{f.name}")]]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]")
    return []


@cache  # a DDL is parsed by the session
def known_paths() -> list[str]:
    """All paths that some layout names."""
    return sorted({p for lay in LAYOUTS for p in paths(lay.fields)})


def fingerprint(found: list[str]) -> str:
    """Hash of those of the paths that some layout names, sorted."""
    return hashlib.sha256(";".join(sorted(set(found) & set(known_paths()))).encode()).hexdigest()


@cache
def mappings() -> dict[str, int]:
    """Number of the layout for each fingerprint that it can have; two layouts never share one."""
    out: dict[str, int] = {}
    for i, lay in enumerate(LAYOUTS):
        for k in range(len(lay.optional) + 1):
            for gone in combinations(lay.optional, k):
                if out.setdefault(fingerprint([p for p in paths(lay.fields) if p not in gone]), i) != i:
                    raise ValueError(f"{lay.name} and {LAYOUTS[i].name} can't be told apart")
    return out


def _turns_of(number: Column | None, layout: int | None = None) -> Column:
    """The turns of the record `r` by its layout's mapping."""
    if layout is not None:
        return F.expr(LAYOUTS[layout].turns)
    out = F.when(number == 0, F.expr(LAYOUTS[0].turns))
    for i, lay in enumerate(LAYOUTS[1:], 1):
        out = out.when(number == i, F.expr(lay.turns))
    return out


def from_table(df: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a typed table; the fingerprint of its schema picks the mapping."""
    layout = mappings().get(fingerprint(paths(df.schema)))
    if layout is None:
        raise ValueError("no layout has these field paths: " + ", ".join(df.columns))
    if layout == 0:  # one turn a row: no array to build
        return df.select("conv_id", "turn", "role", "text")
    names = set(df.columns)
    r = df.select("conv_id", F.struct(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in LAYOUTS[layout].fields]).alias("r"))
    return r.select("conv_id", F.explode(_turns_of(None, layout)).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def record_paths(record: str | Column = "record") -> Column:
    """Those field paths of a JSON record that some layout names; a list's are those of any of its items."""
    record = F.col(record) if isinstance(record, str) else record
    keys = lambda at: F.coalesce(F.json_object_keys(at), F.array().cast("array<string>"))
    below = lambda found, up: F.transform(found, lambda k: F.concat(F.lit(up + "."), k))
    parts = [below(keys(record), "")]
    for up in sorted({p.rpartition(".")[0] for p in known_paths()} - {""}):
        inside = F.get_json_object(record, "$" + up.removesuffix("[]"))
        if up.endswith("[]"):
            items = F.from_json(inside, "array<map<string, string>>")
            found = F.coalesce(F.flatten(F.transform(F.filter(items, lambda m: m.isNotNull()), lambda m: F.map_keys(m))), F.array().cast("array<string>"))
        else:
            found = keys(inside)
        parts.append(below(found, up))
    return F.array_sort(F.array_intersect(F.concat(*parts), F.array(*map(F.lit, known_paths()))))


def record_key(record: str | Column = "record") -> Column:
    """The fingerprint of a JSON record."""
    return F.sha2(F.array_join(record_paths(record), ";").cast("binary"), 256)


def _number(record: str = "record") -> Column:
    table = F.create_map(*[F.lit(x) for kv in mappings().items() for x in kv])
    return F.try_element_at(table, record_key(record))


def from_json(df: DataFrame) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts in the column `record`."""
    everything = T.StructType(list({f.name: f for lay in LAYOUTS for f in lay.fields}.values()))
    r = df.select(_number().alias("layout"), F.from_json("record", everything).alias("r")).where("layout IS NOT NULL")
    return r.select(F.col("r.conv_id").alias("conv_id"), F.explode(_turns_of(F.col("layout"))).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unknown(df: DataFrame) -> DataFrame:
    """Records of `df` whose fingerprint has no mapping, with it as `key`."""
    return df.withColumn("key", record_key()).where(~F.col("key").isin(list(mappings())))


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_ESCAPED, "$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """One row a conversation: its text and the loss spans (code points, end exclusive) of assistant texts.

    Turns are written before the shuffle, so a task gathers only finished strings.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"))
    t = t.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(MID))).withColumn("body", escape(F.col("raw")))
    one = F.struct("turn", "role", "raw", F.concat("head", "body", F.lit(END)).alias("s"), F.length("head").alias("h"), F.length("body").alias("b"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("ts"))
    text = F.concat(F.lit(START), F.array_join(F.transform("ts", lambda x: x.s), ""))
    step = lambda acc, x: F.struct(
        (acc.at + F.length(x.s)).alias("at"),
        F.when(x.role == "assistant", F.concat(acc.spans, F.array(F.struct((acc.at + x.h).alias("start"), (acc.at + x.h + x.b).alias("end"))))).otherwise(acc.spans).alias("spans"),
    )
    zero = F.struct(F.lit(len(START)).alias("at"), F.expr("cast(array() AS array<struct<start: int, end: int>>)").alias("spans"))
    return g.select("conv_id", text.alias("formatted"), F.aggregate("ts", zero, step, lambda a: a.spans).alias("loss_spans"))


def read_back(out: DataFrame) -> DataFrame:
    """`out` with `turns` (role, text) parsed from the formatted text, and `loss_text` under its mask."""
    pieces = F.split(F.expr(f"substring(formatted, {len(START) + 1})"), END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), MID, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MID) + len(MID))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s.end - s.start))), "")
    return out.withColumn("turns", turns).withColumn("loss_text", loss)


def digest(turns: DataFrame) -> DataFrame:
    r = read_back(formatted(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
