"""Secret scans by DataFrame functions alone.

Two character Markov models, one of random strings and one of ordinary identifiers, are
compared by the log-likelihood ratio of a token's character pairs.  Both are counted from
labelled samples by Spark; what reaches the driver is one table of pair counts, bounded by
the alphabet.  A token is a secret if its ratio outweighs the odds against secrets.

Fixed patterns (assignments, access keys, hexadecimal runs) are found besides; the models
add what these miss.  Java's ``split`` and ``regexp_extract_all`` cut a text at the same
matches, so running lengths of their pieces give every match's place in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import free_name, sample_texts, without

#: The base patterns, fixed values; letters of the first group in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(_either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

#: What the models look at: runs of at least so many of these characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_CLASS = "[A-Za-z0-9+/_=-]"
LEAST_TOKEN = 16
TOKEN = f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{{LEAST_TOKEN},}}"
#: One token in a million is held to be a secret beforehand.
LOG_ODDS = math.log(1e6)
#: Bounds of the labelled samples: documents with ordinary words, and made-up random strings of each kind.
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARS = 100_000
SAMPLE_RANDOM = 4000

#: Words of which ordinary identifiers and paths are made up for the sample.
IDENTIFIER_WORDS = (
    "account action add address admin api app array article asset background base batch blog build button cache call channel check class client code column com common "
    "component config connection content count create current data date debug default delete device document download element email entry error event example export "
    "field file filter find first format function get group handler header height help host html http image import index info information init input instance item key "
    "label language last layout length level library line link list load local login main manager map menu message method mode model module name network new node number "
    "object option order output page parameter parent password path payload player position process product profile project property query queue read record region remove "
    "report request resource response result return route row save schema screen search section select server service session set setting size source start state status "
    "string style system table target task template test text theme time title token total transfer type update upload url user util value variable version view widget width window with write www"
).split()

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _found(text: Column, kind: int, pattern: str, least: int, group: int = 0) -> Column:
    """The matches of a pattern whose group has ``least`` characters, with their places."""
    cut = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), b.alias("value")))
    if group:
        cut = F.zip_with(cut, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, v: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), F.length(v).alias("n")))
    else:
        cut = F.transform(cut, lambda x: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), F.length(x["value"]).alias("n")))
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["n"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _when(text: Column, test: Column, spans: Column) -> Column:
    """Few texts have any match, so a quick test comes first."""
    return F.when(test, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, leftmost and not overlapping in each kind, by start and then kind."""
    assign = _when(text, text.rlike(ASSIGN), _found(text, 0, ASSIGN, LEAST["assign"], 2))
    access = _when(text, F.contains(text, F.lit("AKIA")), _found(text, 1, ACCESS, LEAST["access"]))
    # Runs of 24 or more are the maximal runs that pass, so the shorter ones need not be cut out.
    hexes = _when(text, text.rlike(f"{HEX[:-1]}{{{LEAST['hex']}}}"), _found(text, 2, f"{HEX[:-1]}{{{LEAST['hex']},}}", LEAST["hex"]))
    return F.array_sort(F.concat(assign, access, hexes))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """(token) of ``n`` strings of each kind that generators of secrets make: base64, alphanumeric, upper-case, hexadecimal."""
    raw = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(raw))
    kinds = (F.substring(b64, 1, 40), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 40), F.substring(F.regexp_replace(F.upper(b64), "[^A-Z0-9]", ""), 1, 32), F.substring(raw, 1, 40))
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("token"))


def identifiers(spark: SparkSession, n: int = 2 * SAMPLE_RANDOM) -> DataFrame:
    """(token) of ``n`` ordinary identifiers of each style: snake, kebab and camel case, paths, such with numbers or dates, words run together, long numbers, stretches of the alphabet, rules of one character."""
    words = F.lit(IDENTIFIER_WORDS)

    def word(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))

    some = F.slice(F.array(*[word(k) for k in range(5)]), 1, (2 + F.pmod(F.xxhash64("id"), F.lit(4))).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.element_at(F.array(F.lit(10), F.lit(100), F.lit(3000), F.lit(100000)), (1 + F.pmod("id", F.lit(4))).cast("int"))).cast("string")
    date = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit("d")), F.lit(12_000)).cast("int")).cast("string")
    camel = F.array_join(F.transform(some, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    joined = [F.array_join(some, mark) for mark in ("_", "-", "/")]
    styles = [*joined, camel, F.initcap(camel), F.upper(joined[0]), F.concat(joined[0], F.lit("_"), number), F.concat(camel, number), F.concat(joined[2], F.lit("/"), number), F.concat(joined[1], F.lit("-"), date), F.concat(joined[2], F.lit("/"), date, F.lit("/"), joined[1])]
    mark = F.substring(F.lit(ALPHABET), (1 + F.pmod("id", F.lit(len(ALPHABET)))).cast("int"), F.lit(1))
    stretch = F.substring(F.lit(ALPHABET), (1 + F.pmod("id", F.lit(62))).cast("int"), (4 + F.pmod(F.xxhash64("id", F.lit("s")), F.lit(37))).cast("int"))
    styles += [F.array_join(some, ""), F.upper(F.array_join(some, "")), stretch, F.abs(F.xxhash64("id", F.lit("l"))).cast("string"), F.repeat(mark, (4 + F.pmod(F.xxhash64("id", F.lit("r")), F.lit(37))).cast("int"))]
    return spark.range(n).select(F.explode(F.array(*styles)).alias("token"))


def labelled_samples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label): random strings and the matches of the fixed patterns are 1, other words and made-up identifiers 0.

    Words come from the ``SAMPLE_DOCUMENTS`` texts of the smallest hash among those of at most ``SAMPLE_CHARS`` characters.
    """
    text = F.col("text")
    some = sample_texts(df.select(F.col(f"`{text_col}`").alias("text")), SAMPLE_DOCUMENTS, SAMPLE_CHARS)
    some = some.withColumn("spans", base_spans(text))
    secrets = some.select(F.explode("spans.value").alias("v")).select(F.explode(F.regexp_extract_all("v", F.lit(f"{TOKEN_CLASS}{{{LEAST_TOKEN},}}"), F.lit(0))).alias("token"))
    plain = some.select(F.explode(F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), f"{HEX[:-1]}{{{LEAST['hex']},}}", " "), F.lit(f"{TOKEN_CLASS}{{4,}}"), F.lit(0))).alias("token"))
    spark = df.sparkSession
    plain = plain.unionByName(identifiers(spark))
    return random_strings(spark).unionByName(secrets).withColumn("label", F.lit(1)).unionByName(plain.withColumn("label", F.lit(0)))


def _code(c: Column) -> Column:
    """A character's number in the alphabet, from 1; 0 is a token's begin."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each character given the one before, as a list indexed by ``before * (n + 1) + after``.

    Counts are smoothed by half a count and by each model's own character frequencies.
    """
    n = len(ALPHABET)
    pairs = samples.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.concat(F.lit("\x00"), F.col("token")), i, F.lit(2)))).alias("pair"))
    pairs = pairs.groupBy("label", "pair").count().collect()  # at most 2 * (n + 1) * n rows
    counts = [[[0.0] * (n + 1) for _ in range(n + 1)] for _ in range(2)]
    for r in pairs:
        a, b = ALPHABET.find(r["pair"][0]) + 1, ALPHABET.find(r["pair"][1]) + 1
        counts[r["label"]][a][b] += r["count"]
    logs = []
    for model in counts:
        single = [sum(model[a][b] for a in range(n + 1)) + 0.5 for b in range(n + 1)]
        total = sum(single[1:])
        logs.append([[math.log((model[a][b] + 5 * single[b] / total) / (sum(model[a][1:]) + 5)) for b in range(n + 1)] for a in range(n + 1)])
    return [logs[1][a][b] - logs[0][a][b] if b else 0.0 for a in range(n + 1) for b in range(n + 1)]


def log_ratio(token: Column, weights: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios."""
    n = len(ALPHABET) + 1
    table = F.lit(weights)

    def step(acc: Column, c: Column) -> Column:
        code = _code(c)
        return F.struct((acc["sum"] + F.get(table, acc["last"] * n + code)).alias("sum"), code.alias("last"))

    return F.aggregate(F.split(token, ""), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), step, lambda acc: acc["sum"])


def _outside(x: Column, base: Column) -> Column:
    """The parts of a token that the base spans, sorted by start, leave, if of ``LEAST_TOKEN`` characters or more."""

    def part(start: Column, end: Column) -> Column:
        value = F.substring(x["value"], (start - x["start"] + 1).cast("int"), (end - start).cast("int"))
        one = F.array(F.struct(start.alias("start"), x["kind"].alias("kind"), end.alias("end"), value.alias("value"))).cast(_SPANS)
        return F.when(end - start >= LEAST_TOKEN, one).otherwise(F.array().cast(_SPANS))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], F.least(b["end"], x["end"])).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))

    touching = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    start = F.struct(x["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    cut = F.aggregate(touching, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], x["end"])))
    return F.when(F.size(touching) > 0, cut).otherwise(F.array(x).cast(_SPANS))


def scan(df: DataFrame, weights: list[float], text_col: str = "text", log_odds: float = LOG_ODDS) -> DataFrame:
    """``df`` with ``base`` and ``found``: arrays of (start, kind, end, value) by start and kind; ``found`` has the models' spans too.

    Places are in code points, ends exclusive; kinds number ``KINDS``.  The models judge all runs of 16
    or more characters, and where base spans cut a run, each part of 16 or more that they leave.  One narrow
    pass without a shuffle.  Null and empty texts have no spans; long texts are scanned whole; repeated rows are
    scanned alike; input columns named ``base`` or ``found`` give way; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = without(df, ["base", "found"])
    names, hidden = [F.col(f"`{c}`") for c in out.columns], free_name(out, "_tokens")
    out = out.select(*names, base_spans(text).alias("base"), _when(text, text.rlike(TOKEN), _found(text, 3, TOKEN, LEAST_TOKEN)).alias(hidden))
    base = F.col("base")

    def judged(tokens: Column) -> Column:
        return F.filter(tokens, lambda x: log_ratio(x["value"], weights) > log_odds)

    whole = F.when(F.size(base) > 0, F.flatten(F.transform(hidden, lambda x: _outside(x, base)))).otherwise(F.col(hidden))
    tokens = F.when(F.size(hidden) > 0, judged(whole)).otherwise(F.array().cast(_SPANS))
    return out.select(*names, "base", F.array_sort(F.concat(base, tokens)).alias("found"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
