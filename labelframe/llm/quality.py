"""Quality rules by weak supervision.

Each rule looks at a text's measures and votes good (1), votes bad (0) or abstains
(-1).  How far each rule can be trusted is not set by hand: expectation-maximisation
over the counts of the vote patterns of *all* texts estimates, per rule, how often it
gives each vote to good and to bad texts, and the posterior probability that a text is
good replaces the usual "must pass every rule".

Votes are independent given the class (the usual assumption), and the classes are
named by the rules' own direction: a rule starts out believed to be right more often
than wrong.  Since the patterns are finitely many (3 to the number of rules), the fit
reads one small aggregate, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelframe.llm.common import without, write_table

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_alpha_words", "n_marks")


def measures(text: str | None) -> tuple[int, ...]:
    """The counts that rules look at, over the whole text; a null text has none of anything.

    Words are runs of other than space and \\x09 to \\x0D.  ``n_dup_lines``: ``\\n``-split lines
    with a word, equal to an earlier one.  ``n_repeat_words``: words in 3-word windows that
    occur twice or more.  ``n_upper``, ``n_digits``: ASCII letters and digits; ``n_alpha_words``:
    words with a letter first; ``n_marks``: words that end a sentence.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    # Bytes 0x80 to 0xBF go on with a code point; all others begin one.
    word_chars = int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    firsts = np.array([w[0] for w in words], np.uint8) if words else np.zeros(0, np.uint8)
    lasts = np.array([w[-1] for w in words], np.uint8) if words else np.zeros(0, np.uint8)
    alpha = int((((firsts | 32) >= 97) & ((firsts | 32) <= 122) | (firsts >= 0xC0)).sum())
    marks = int(((lasts == 46) | (lasts == 33) | (lasts == 63)).sum())
    return (
        len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), upper, digits, alpha, marks,
    )


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    pairs = ids[:-1] * k + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * k + ids[2:]  # below n * n: no overflow
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def _above(value: str, of: str, bad: float, good: float | None = None) -> Callable[[dict], np.ndarray]:
    """Bad where value / of is over ``bad``, good where it is at most ``good``, else no vote."""

    def vote(m: dict) -> np.ndarray:
        share = m[value] / np.maximum(m[of], 1)
        return np.where(share > bad, 0, np.where(share <= (bad if good is None else good), 1, -1))

    return vote


def _length(m: dict) -> np.ndarray:
    return np.where(m["n_words"] < 50, 0, np.where(m["n_words"] > 100_000, -1, np.where(m["n_words"] >= 80, 1, -1)))


def _word_length(m: dict) -> np.ndarray:
    mean = m["word_chars"] / np.maximum(m["n_words"], 1)
    return np.where((mean < 3) | (mean > 12), 0, np.where((mean >= 4) & (mean <= 10), 1, -1))


def _sentences(m: dict) -> np.ndarray:
    share = m["n_marks"] / np.maximum(m["n_words"], 1)
    return np.where((share > 0.5) | (m["n_marks"] == 0), 0, np.where((share > 0.01) & (share < 0.35), 1, -1))


#: Name and vote of each rule; a vote takes arrays of measures by name.
RULES: tuple[tuple[str, Callable[[dict], np.ndarray]], ...] = (
    ("length", _length),
    ("word_length", _word_length),
    ("symbols", _above("n_symbols", "n_words", 0.1, 0.02)),
    ("symbol_chars", _above("n_symbols", "word_chars", 0.1, 0.02)),
    ("dup_lines", _above("n_dup_lines", "n_lines", 0.3, 0.1)),
    ("repeats", _above("n_repeat_words", "n_words", 0.3, 0.15)),
    ("upper", _above("n_upper", "word_chars", 0.4, 0.1)),
    ("digits", _above("n_digits", "word_chars", 0.15, 0.05)),
    ("no_letters", lambda m: np.where(m["n_alpha_words"] < 0.7 * m["n_words"], 0, np.where(m["n_alpha_words"] >= 0.85 * m["n_words"], 1, -1))),
    ("sentences", _sentences),
)


def votes(columns: dict[str, np.ndarray], rules=RULES) -> np.ndarray:
    return np.stack([f(columns) for _, f in rules], axis=1).astype(np.int8)


def patterns_of(v: np.ndarray) -> np.ndarray:
    """A vote vector as a number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def unpack(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(n_rules) % 3 - 1).astype(np.int8)


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 200, tolerance: float = 1e-7, strength: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over pattern counts: the posterior of each pattern, P(vote | class) as (class, rule, vote + 1), and the classes' shares.

    The start holds that a bad text fails one or two of the rules and passes the rest, and
    that a good text fails hardly any.  ``strength`` of all texts count as such believers in
    each step, which keeps the classes' names in place.
    """
    v = unpack(patterns, n_rules).astype(int) + 1
    total = max(counts.sum(), 1)
    prior = np.empty((2, n_rules, 3))
    prior[0], prior[1] = (0.1, 0.15, 0.75), (0.05, 0.003, 0.947)  # abstains, bad, good
    weight = 1 + strength * total
    theta, share = prior.copy(), np.array([0.2, 0.8])
    posterior, last = np.full(len(patterns), 0.5), -np.inf
    for _ in range(rounds):
        joint = np.log(share)[None, :] + sum(np.log(theta[:, j, :])[:, v[:, j]].T for j in range(n_rules))
        top = joint.max(axis=1, keepdims=True)
        mass = np.exp(joint - top)
        posterior = mass[:, 1] / mass.sum(axis=1)
        loss = float((counts * (top[:, 0] + np.log(mass.sum(axis=1)))).sum() / total)
        share = np.array([(counts * (1 - posterior)).sum() + 1, (counts * posterior).sum() + 4]) / (total + 5)
        for c, p in ((0, 1 - posterior), (1, posterior)):
            for j in range(n_rules):
                theta[c, j] = np.bincount(v[:, j], counts * p, minlength=3) + weight * prior[c, j]
        theta /= theta.sum(axis=2, keepdims=True)
        if loss - last < tolerance:
            break
        last = loss
    return posterior, theta, share


def measure(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``df`` without its text, with the measures and the vote pattern of each text."""
    keep = [F.col(f"`{c}`") for c in without(df, [*MEASURES, "pattern"]).columns if c != text_col]
    # The other columns travel as a struct, whatever their names.
    rows = df.select(F.struct(*keep).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(m, T.LongType()) for m in (*MEASURES, "pattern")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measures(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
            columns = {m: found[:, i] for i, m in enumerate(MEASURES)}
            arrays = [batch.column("row")] + [pa.array(columns[m]) for m in MEASURES] + [pa.array(patterns_of(votes(columns, rules)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *MEASURES, "pattern"])

    found = rows.mapInArrow(run, schema)
    return found.select("row.*", *MEASURES, "pattern")


def judge_quality(df: DataFrame, text_col: str = "text", threshold: float = 0.5, rules=RULES) -> DataFrame:
    """``df`` without its text, with the measures, ``p_good``, ``base_failed`` and ``kept``.

    One pass over the texts writes the narrow measures to the shared folder; the fit reads
    the pattern counts (3 to the number of rules rows at most); the posterior is joined by
    pattern.  ``base_failed``: under 50 words, or over half of them in repeated windows; such
    texts are never kept.  Null and empty texts have no words and so fail.  Repeated rows are
    judged alike; clashing input columns give way; an empty table gives an empty result.
    """
    spark = df.sparkSession
    out_names = ["pattern", "p_good", "base_failed", "kept"]
    rows = write_table(measure(without(df, out_names), text_col, rules), "quality")
    counted = rows.groupBy("pattern").count().collect()
    patterns = np.array([r["pattern"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], float)
    posterior, _, _ = fit(patterns, counts, len(rules))
    table = spark.createDataFrame(list(zip(patterns.tolist(), posterior.tolist(), strict=True)), "pattern long, p_good double")
    out = rows.join(F.broadcast(table), "pattern")  # at most 3 ** len(rules) rows
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    return out.drop("pattern")
