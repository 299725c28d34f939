"""Secret scans: fixed kinds by pattern, and random strings by character Markov models.

Two first-order chains over single characters, one of random strings and one of ordinary identifiers,
are compared by the mean log-likelihood ratio of a token's transitions.  Labelled samples train them:
digests in several alphabets are the random strings; names that the source files of Python's own library define, and
identifiers made of their words in the usual spellings (camel, snake, kebab, paths, ...), are the ordinary
ones, and the words of all documents are counted with them at the same weight, so that a corpus' own
languages pass for ordinary.  Of the ordinary chain's probability SPREAD is dealt out evenly within the class of the next character, so
that one rare pair in a name nobody has seen doesn't make it random.

Names are split by a hash, and words of the other parts that the training part has are left out of what is made from them, so
thresholds and rates are those of unseen vocabulary.  For each band of lengths the threshold is the ratio that only FALSE_RATE of the
ordinary strings reach, or the one that MISS of the random strings don't, if that is higher: where the classes lie
apart, the room between them goes to names unlike any in the sample.  The model is a literal array of a few thousand
numbers, so scoring is a look-up inside the plan; nothing here runs Python on an executor.

Spans are (kind, start, end) in code points, end exclusive, in order of start and then of kinds as in
`KINDS`.  A chain's span is left out where a span of a fixed kind has the same borders; inside a longer
one it tells which part is random.

Defined cases: null and empty texts have no spans; a long text is scanned whole; equal rows give equal
spans; without any words in the corpus the labelled identifiers train alone; an empty table gives no
rows; extra columns are kept by `scan`, but for one named `found`, which it replaces.
"""

from __future__ import annotations

import hashlib
import math
import re
import sysconfig
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from provena.llm.columns import neutral, restored

KINDS = ("assign", "access", "hex", "markov")
#: Fixed patterns of the first three kinds, and the least length of what they must catch.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
#: Tokens that the chains judge: runs of these characters with a letter.
TOKEN_MIN = 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_MIN},}}"
#: Lengths at which a band of thresholds starts; longer tokens tell more per transition.
BANDS = (12, 16, 20, 28, 40)
#: Share of ordinary identifiers that a threshold lets through as random.
FALSE_RATE = 0.001
#: Share of random strings that a threshold may give up to keep ordinary ones out.
MISS = 0.006
#: Share of an ordinary transition's probability that is even within the class of the next character.
SPREAD = 0.1
#: Labelled strings of each class, and names from source files among the ordinary ones.
SAMPLE, CODE_NAMES = 40_000, 24_000
#: Words of documents: letters only, between characters that no token has.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,24}(?![A-Za-z0-9+/_=-])"

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(_CHARS)
#: Parts of ordinary identifiers.
PARTS = """abstract access account action adapter add address admin agent alias all api app archive array async attribute audit auth
backup base base64 batch bean binary bind block body boot bridge buffer build bundle button byte cache call cancel card cart catalog
cell chain channel char check child class clean client clone close cloud code collection color column command comment commit common
config connection console consumer container content context control convert cookie copy core count create current cursor custom data
database date debug decode default delete deploy depth detail device dir disk dispatch document domain double download draft driver
edge edit element email empty enable encode engine entity entry env error event exception execute export factory feature field file
filter final find first flag flow font format forward frame function gateway generator get global graph grid group handle handler hash
head header health helper hidden history home hook host html http icon id image impl import index info init inner input insert install
instance integer interface internal invoice ip item iterator java job join json kernel key keyword label language last layer layout lib
line link linux list listener load local location lock log login logger long loop mail main manager map mask master match matrix max
memory menu merge message metadata meta method metric min mode model module monitor mutex name native network next node notification
null number object offset open operation option order origin output package page param parent parse parser partition password patch
path payload payment peer pending permission phone pipeline plugin pointer policy pool port prefix preview price print priority private
process producer product profile project prompt property protocol provider proxy public python queue quick random range read receiver
record redirect reference refresh region register release remote remove render repeat replace report request required reset resolve
resource response rest result retry return role root route row rule run runtime sample save scan schedule schema scope score script
search secret section security select selector send sequence server service servlet session set setting setup shape share shell shift
signal simple singleton site size slot snapshot socket sort source spec split stack stage start state static station status step storage
store stream string style submit success summary support switch symbol sync system table tag target task team temp template term test
text theme thread threshold time timeout timer title token tool topic total trace track traffic transaction transform tree trigger type
unit update upload url user util utf8 valid validate value variable vector verify version view virtual visible warning watch web weight
widget width window word worker workflow wrapper write xml yield zone""".split()
SEPARATORS = ("", "_", "-", "/")
_SPLITS = {"train": (0, 1), "threshold": (2,), "test": (3,)}
#: What a source file defines: functions, classes, attributes, variables, parameters with a value.
_DEFINED = r"(?:\bdef |\bclass |\bself\.|\bimport |^|\n[ ]*)([A-Za-z_][A-Za-z0-9_]*)(?=\s*(?:=[^=]|[(:.]|$|\n))"
_HUMP = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"


@cache
def code_names() -> dict[str, tuple[list[str], list[str]]]:
    """(names, words) of each part of the sample, from the source files of the Python that runs the driver.

    A bounded number of names, those of the lowest hash; words of other parts than "train" are those that the training part hasn't.
    """
    top, names = Path(sysconfig.get_path("stdlib")), set()
    for path in top.rglob("*.py"):
        if not {"site-packages", "test", "tests", "idlelib", "__pycache__"} & set(path.relative_to(top).parts):
            names |= set(re.findall(_DEFINED, path.read_text(encoding="utf-8", errors="ignore")))
    place = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:12], 16)
    some = sorted(names, key=place)[:CODE_NAMES]
    out, known = {}, set()
    for part, numbers in _SPLITS.items():
        mine = [n for n in some if place(n) % 4 in numbers]
        words = {w.lower() for n in mine for w in re.findall(_HUMP, n) if 3 <= len(w) <= 12}
        if part == "train":
            known = words = words | set(PARTS)
        else:
            words -= known
        out[part] = (mine, sorted(words))
    return out


@dataclass(frozen=True)
class Model:
    """Ratios of transitions (N * N of them) and the threshold of each band of lengths."""

    table: list[float]
    cuts: list[float]


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _literal(values: list, kind: str) -> Column:
    """One folded literal for a list; an array of many literals would slow every rule of the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, start, end>> of the pattern's matches, leftmost and not overlapping.

    Positions come from the lengths of matches and of the pieces between them, summed up in chunks, so
    that a text of very many matches takes no quadratic time.
    """
    gaps = F.split(text, pattern, -1)
    both = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(
        found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n"))))
    chunks = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / CHUNK).cast("int")), lambda i: F.slice(b, i * CHUNK + 1, CHUNK))
    fold = lambda c: F.aggregate(
        c,
        F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out")),
        lambda a, x: F.struct((a.at + x.g + x.n).alias("at"), F.concat(a.out, F.array(F.struct(x.m.alias("s"), (a.at + x.g).alias("start"), (a.at + x.g + x.n).alias("end")))).alias("out")),
    )
    starts = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c.at)))
    moved = lambda cs: F.zip_with(cs, F.slice(starts(cs), 1, F.size(cs)), lambda c, at: F.transform(c.out, lambda x: F.struct(x.s.alias("s"), (x.start + at).alias("start"), (x.end + at).alias("end"))))
    return F.flatten(_let(F.transform(_let(both, chunks), fold), moved))


CHUNK = 256
_NONE = "cast(array() AS array<struct<s: string, start: int, end: int>>)"


def _if(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.expr(_NONE))


def base(text: Column) -> dict[str, Column]:
    """The spans of the three fixed kinds; rows without any trace of a kind skip its positions."""
    value = lambda s: F.length(F.regexp_extract(s, ASSIGN, 2))
    low = F.lower(text)
    key = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    return {
        "assign": _if(key, F.filter(_matches(text, ASSIGN), lambda x: value(x.s) >= ASSIGN_MIN)),
        "access": _if(F.contains(text, F.lit("AKIA")), F.filter(_matches(text, ACCESS), lambda x: F.length(x.s) >= ACCESS_MIN)),
        # runs are maximal, so asking for the length in the pattern finds the same runs
        "hex": _if(text.rlike(f"[0-9a-f]{{{HEX_MIN}}}"), _matches(text, f"[0-9a-f]{{{HEX_MIN},}}")),
    }


def _pairs(df: DataFrame, token: str, n: str | None = None) -> dict[tuple[int, int], float]:
    """Counts of neighbouring characters' places in `_CHARS`, at most N * N rows; `n` weighs tokens."""
    w = F.col(n) if n else F.lit(1)
    cs = df.select(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(_CHARS), c)).alias("p"), w.alias("n"))
    two = cs.select("n", F.explode(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a * 100 + b)).alias("k"))
    return {divmod(r.k, 100): float(r.n) for r in two.groupBy("k").agg(F.sum("n").alias("n")).collect()}


#: Where the classes of characters begin and end in `_CHARS`: small letters, capitals, digits, the rest.
_CLASSES = ((0, 26), (26, 52), (52, 62), (62, N))


def _chain(counts: dict[tuple[int, int], float], spread: float = 0.0) -> list[list[float]]:
    """Log probabilities of transitions, with one more of each counted; `spread` of them even within each class."""
    out = []
    for i in range(1, N + 1):
        row = [counts.get((i, j), 0) + 1.0 for j in range(1, N + 1)]
        s = sum(row)
        row = [x / s for x in row]
        for lo, hi in _CLASSES:
            even = sum(row[lo:hi]) / (hi - lo)
            row[lo:hi] = [(1 - spread) * x + spread * even for x in row[lo:hi]]
        out.append([math.log(x) for x in row])
    return out


def random_strings(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """(id, w): labelled random strings of 12 to 48 characters: hex, base-64, base-62, base-36 and UUIDs."""
    h = F.concat(*[F.sha2(F.concat(F.lit(f"random{k}:"), F.col("id").cast("string")).cast("binary"), 256) for k in range(3)])
    b64 = F.base64(F.unhex(h))
    plain = F.regexp_replace(b64, "[+/=]", "")
    uuid = F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kinds = [h, F.upper(h), b64, F.translate(b64, "+/", "-_"), plain, plain, F.lower(plain), F.upper(plain)]
    length = F.lit(TOKEN_MIN) + F.pmod(F.xxhash64(F.lit("length"), "id"), F.lit(37))
    kind = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(kinds) + 1)).cast("int")
    pick = F.when(kind == len(kinds), uuid).otherwise(F.substr(F.element_at(F.array(*kinds, uuid), kind + 1), F.lit(1), length))
    return spark.range(n).select("id", pick.alias("w"))


def named(spark: SparkSession, part: str) -> DataFrame:
    """(w): names of one part of the sample that are long enough to be judged."""
    names = [n for n in code_names()[part][0] if len(n) >= TOKEN_MIN or part == "train"]
    return spark.range(1).select(F.explode(_literal(names or [PARTS[0]], "string")).alias("w"))


def identifiers(spark: SparkSession, part: str = "train", n: int = SAMPLE) -> DataFrame:
    """(id, w): ordinary identifiers of two to six words of one part of the sample, in the usual spellings."""
    words = code_names()[part][1] or PARTS
    draw = lambda *x: F.xxhash64(F.lit(f"identifier {part}"), F.col("id"), *map(F.lit, x))
    voc = _literal(words, "string")
    parts = F.transform(F.sequence(F.lit(0), F.lit(1) + F.pmod(draw("parts"), F.lit(5)).cast("int")), lambda j: F.element_at(voc, F.pmod(F.xxhash64(F.lit("part"), F.col("id"), j), F.lit(len(words))).cast("int") + 1))
    d = spark.range(n).select("id", F.explode(F.array(parts)).alias("p"))
    title = F.transform("p", F.initcap)
    digit = F.pmod(draw("digit"), F.lit(100)).cast("string")
    camel = F.concat(F.element_at("p", 1), F.array_join(F.slice(title, 2, 9), ""))
    join = lambda s: F.array_join("p", s)
    styles = [
        camel, F.array_join(title, ""), join("_"), F.upper(join("_")), join("-"), join(""), F.upper(join("")), F.concat(F.lit("/"), join("/")), join("/"),
        F.concat(join("_"), F.lit("_"), digit), F.concat(camel, digit), F.concat(join("-"), F.lit("-v"), digit), F.concat(F.lit("/"), F.element_at("p", 1), F.lit("/"), F.array_join(F.slice("p", 2, 9), "-")),
        F.concat(F.lit("--"), F.element_at("p", 1), F.lit("="), F.array_join(F.slice("p", 2, 9), "-")), F.concat(F.lit("/"), F.element_at("p", 1), digit, F.lit("/"), F.array_join(F.slice("p", 2, 9), "_")),
    ]
    w = F.element_at(F.array(*styles), F.pmod(draw("style"), F.lit(len(styles))).cast("int") + 1)
    return d.select("id", w.alias("w")).where(F.length("w") >= TOKEN_MIN)


def corpus_words(docs: DataFrame) -> DataFrame:
    """(w, n): the letters-only words of all documents with their counts, as written, lower, capital and upper."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    forms = F.array("w", F.lower("w"), F.initcap("w"), F.upper("w"))
    return words.select(F.explode(forms).alias("w"), "n")


def split(sample: DataFrame, part: str) -> DataFrame:
    """One of the parts "train" (half), "threshold" and "test" (a fourth each) of a labelled sample."""
    return sample.where(F.pmod("id", F.lit(4)).isin(*_SPLITS[part]))


def _band(token: Column) -> Column:
    return sum((F.length(token) >= b).cast("int") for b in BANDS) - 1


def ordinary_strings(spark: SparkSession, part: str) -> DataFrame:
    """(w): all ordinary strings of one part of the sample."""
    return named(spark, part).unionByName(identifiers(spark, part).select("w"))


def train(docs: DataFrame, false_rate: float = FALSE_RATE, miss: float = MISS) -> Model:
    """The chains of the labelled sample and all documents' words, and their thresholds."""
    spark = docs.sparkSession
    ordinary = _pairs(ordinary_strings(spark, "train"), "w")
    corpus = _pairs(corpus_words(docs), "w", "n")
    scale = sum(ordinary.values()) / max(1.0, sum(corpus.values()))
    for k, n in corpus.items():
        ordinary[k] = ordinary.get(k, 0) + n * scale
    r, o = _chain(_pairs(split(random_strings(spark), "train"), "w")), _chain(ordinary, SPREAD)
    table = [r[i][j] - o[i][j] for i in range(N) for j in range(N)]
    both = ordinary_strings(spark, "threshold").withColumn("y", F.lit(False)).unionByName(split(random_strings(spark), "threshold").select("w", F.lit(True).alias("y")))
    held = both.select("y", _band(F.col("w")).alias("b"), ratio(F.col("w"), table).alias("s"))
    got = {(x.y, x.b): x for x in held.groupBy("y", "b").agg(F.percentile("s", 1 - false_rate).alias("top"), F.percentile("s", miss).alias("low")).collect()}
    cuts, most = [], math.inf
    for b in range(len(BANDS)):
        # a longer token never needs a higher ratio to keep ordinary strings out
        most = min(most, got[False, b].top if (False, b) in got else most)
        cuts.append(max(0.0, most, got[True, b].low if (True, b) in got else 0.0))
    return Model(table, cuts)


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    t = _literal(table, "double")
    p = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(_CHARS), c))
    s = F.aggregate(
        p, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.when((a["last"] > 0) & (i > 0), F.element_at(t, (a["last"] - 1) * N + i)).otherwise(0.0)).alias("sum")),
        lambda a: a["sum"],
    )
    return s / F.greatest(F.lit(1), F.size(p) - 1)


def is_random(token: Column, model: Model) -> Column:
    """Whether a token of TOKEN_MIN characters or more reaches the threshold of its length; digits alone don't count."""
    cut = F.element_at(_literal(model.cuts, "double"), _band(token) + 1)
    return token.rlike("[A-Za-z]") & (ratio(token, model.table) > cut)


def rates(spark: SparkSession, model: Model) -> dict[str, float]:
    """On the part of the sample that set neither chains nor thresholds: recall of random strings, that of those of 16 characters or more, and the
    share that is taken for random of names from source files and of identifiers made of words that no other part has.
    """
    parts = (("random", split(random_strings(spark), "test").select("w")), ("names", named(spark, "test")), ("identifiers", identifiers(spark, "test").select("w")))
    both = None
    for kind, df in parts:
        df = df.where(F.length("w") >= TOKEN_MIN).select("w", F.lit(kind).alias("kind"))
        both = df if both is None else both.unionByName(df)
    hit = is_random(F.col("w"), model).cast("int")
    got = {r.kind: r for r in both.groupBy("kind").agg(F.avg(hit).alias("all"), F.avg(F.when(F.length("w") >= 16, hit)).alias("long")).collect()}
    return {"recall": got["random"].all, "recall from 16": got["random"].long, "false, names": got["names"].all, "false, identifiers": got["identifiers"].all}


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with `found`: array<struct<start, no, kind, end>> in order."""
    model = model or train(docs)
    text = F.coalesce("text", F.lit(""))
    d = neutral(docs)
    plain = d.columns
    d = d.withColumns({f"_{k}": v for k, v in base(text).items()} | {"_some": F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: is_random(w, model))})
    # only texts with such a token need the places of their tokens
    d = d.withColumn("_markov", _if(F.col("_some"), F.filter(_matches(text, TOKEN), lambda x: is_random(x.s, model))))
    place = lambda x: x.start.cast("long") * (1 << 32) + x.end
    fixed = F.transform(F.concat("_assign", "_access", "_hex"), place)
    # array_except hashes whole numbers, so it stays linear
    own = F.array_except(F.transform("_markov", place), fixed)
    d = d.withColumn("_markov", F.transform(own, lambda x: F.struct(F.lit("").alias("s"), F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"))))
    out = lambda k: F.transform(f"_{k}", lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(k)).alias("no"), F.lit(k).alias("kind"), x.end.alias("end")))
    d = d.withColumn("found", F.sort_array(F.concat(*[out(k) for k in KINDS])))
    return restored(d.select(*plain, "found"), docs, ("found",))


def digest(scanned: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    fixed = say(F.filter("found", lambda x: x.kind != "markov"))
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(fixed.cast("binary"), 256).alias("base_sha256"), say("found").alias("spans"))
