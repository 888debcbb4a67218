"""Quality rules as a learned decision list over text statistics.

Statistics of whole texts are computed once, in Arrow batches.  A decision list is learned from
labelled statistics by sequential covering: rules are conjunctions of thresholds, grown on one part
of the labelled rows by information gain (as in FOIL), pruned on the other part, and added while
they are precise; the rows that a rule covers are then removed.  The list is emitted as one Spark
CASE expression, first match wins, so applying it needs no Python.

Defined results: a null or empty text has no words, fails the base rule and is not kept; an
unlabelled corpus, or labels of one class, give the empty list (all that pass the base are kept);
labels are joined by id, null labels are ignored and repeated ones count once; of thresholds of equal
gain the first feature and the least threshold win; very long texts are counted whole; empty tables
give no rows and the empty list; columns of the documents other than id and text are neither read nor
changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, drop_written, fresh, sampled, ship, written

#: Statistics, in order; the first six counts are exact and the ratios derive from counts alone.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_pipes", "n_distinct", "n_bangs", "n_stop_end"]
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "letter_ratio", "pipe_ratio", "distinct_ratio", "bang_ratio", "words_per_line", "stop_end_ratio"]
SYMBOLS = b"[#*$%&|<>]"
WINDOW = 8

_SPACE = bytes(range(9, 14)) + b" "
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS[1:-1])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ ids[k : k + n]) * _MULT
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: str | None) -> list[int]:
    """The COUNTS of one text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, raw and len(raw) - len(raw.translate(None, b"#*$%&|<>")) or 0, 0, 0, raw.count(b"\n") + 1 if raw else 0, *[0] * 6]
    packed = raw.translate(None, _SPACE)
    marks = np.frombuffer(packed, np.uint8)
    chars = int(((marks & 0xC0) != 0x80).sum())
    lines, seen, dup = raw.split(b"\n"), set(), 0
    for x in lines:
        if x in seen and x.split():
            dup += 1
        seen.add(x)
    # Words are numbered within the text, so equal numbers are equal words.
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, n)
    upper = int(((marks >= 65) & (marks <= 90)).sum())
    letters = upper + int(((marks >= 97) & (marks <= 122)).sum())
    ends = raw.count(b".\n") + raw.count(b". ") + (raw.rstrip()[-1:] == b".")
    return [n, chars, len(packed) - len(packed.translate(None, b"#*$%&|<>")), dup, repeat_words(ids) if len(number) < n else 0, len(lines), upper, letters, raw.count(b"|"), len(number), raw.count(b"!"), ends]


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the COUNTS) of every document."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = np.array([text_counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in got.T)], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def counts(docs: DataFrame):
    """The COUNTS as a function of a text column; only that column goes to Python."""
    ship(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            got = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(c) for c in got.T], COUNTS)

    return counted.asNondeterministic()


def feature_columns(prefix: str = "") -> dict[str, Column]:
    """The FEATURES as expressions over the COUNTS (whose names start with ``prefix``)."""
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "mean_word": over(c["word_chars"], c["n_words"]),
        "symbol_ratio": over(c["n_symbols"], c["n_words"]),
        "dup_line_ratio": over(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": over(c["n_repeat_words"], c["n_words"]),
        "upper_ratio": over(c["n_upper"], c["n_letters"]),
        "letter_ratio": over(c["n_letters"], c["word_chars"]),
        "pipe_ratio": over(c["n_pipes"], c["n_words"]),
        "distinct_ratio": over(c["n_distinct"], c["n_words"]),
        "bang_ratio": over(c["n_bangs"], c["n_words"]),
        "words_per_line": over(c["n_words"], c["n_lines"]),
        "stop_end_ratio": over(c["n_stop_end"], c["n_words"]),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (F.lit(100) * n_repeat_words > F.lit(30) * n_words)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that rejects what it covers."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float = 0.0
    covered: int = 0

    def covers(self, x: np.ndarray) -> np.ndarray:
        m = np.ones(len(x), bool)
        for name, op, t in self.terms:
            v = x[:, FEATURES.index(name)]
            m &= v <= t if op == "<=" else v > t
        return m

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, t in self.terms:
            out = out & (features[name] <= F.lit(t) if op == "<=" else features[name] > F.lit(t))
        return out

    def __str__(self):
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.terms)


def _grow(x: np.ndarray, bad: np.ndarray, max_terms: int, bins: int) -> Rule:
    mask, terms = np.ones(len(x), bool), []
    while len(terms) < max_terms:
        p, n = int(bad[mask].sum()), int((~bad)[mask].sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(FEATURES):
            v = x[mask, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            order = np.argsort(v, kind="stable")
            vs, bs = v[order], np.concatenate([[0], np.cumsum(bad[mask][order])])
            at = np.searchsorted(vs, cuts, side="right")
            for op, pp, tot in (("<=", bs[at], at), (">", bs[-1] - bs[at], len(v) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tot, 1)) - base), 0)
                j = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[j] > best[0]:
                    # The cut lies half-way to the next value, so that near values fall alike.
                    up = vs[at[j]] if at[j] < len(vs) else cuts[j]
                    best = gain[j], (name, op, float((cuts[j] + up) / 2))
        if best[1] is None:
            break
        terms.append(best[1])
        mask &= Rule((best[1],)).covers(x)
    return Rule(tuple(terms))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r):
        m = r.covers(x)
        p, n = int(bad[m].sum()), int((~bad)[m].sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule.terms) - 1, 0, -1):
        short = Rule(rule.terms[:k])
        if (w := worth(short)) >= value:
            best, value = short, w
    return best


def learn_list(x: np.ndarray, bad: np.ndarray, *, min_precision: float = 0.97, min_cover: int = 5, max_rules: int = 12, max_terms: int = 4, bins: int = 64) -> list[Rule]:
    """Rules that reject, in order; rows are split by position into growing and pruning parts (2:1)."""
    rules: list[Rule] = []
    left = np.arange(len(x))
    while len(rules) < max_rules and bad[left].any():
        grow, prune = left[left % 3 != 0], left[left % 3 == 0]
        if not bad[grow].any():
            break
        rule = _grow(x[grow], bad[grow], max_terms, bins)
        if not rule.terms:
            break
        if bad[prune].any():
            rule = _prune(rule, x[prune], bad[prune])
        m = rule.covers(x[left])
        p, n = int(bad[left][m].sum()), int((~bad)[left][m].sum())
        if p < min_cover or (p + 1) / (p + n + 2) < min_precision * (p + 1) / (p + 2) or p / (p + n) < min_precision:
            break
        rules.append(Rule(rule.terms, p / (p + n), p + n))
        left = left[~m]
    return rules


def _sample(labels: DataFrame, doc_id: str, label: str, bound: int) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label) == 0).alias("bad")).distinct()
    return written(sampled(known, known.count(), bound, "doc_id"), "quality-sample")


def labelled(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = 40_000) -> DataFrame:
    """(doc_id, text) of the documents that ``fit`` with the same arguments learns from."""
    sample = _sample(labels, doc_id, label, bound).select("doc_id").distinct()
    return by_size(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sample, ["doc_id"], "left_semi")


def fit(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", bound: int = 40_000, **options) -> list[Rule]:
    """The decision list for ``label`` = 0, learned from at most about ``bound`` labelled rows."""
    sample = _sample(labels, doc_id, label, bound)
    rows = by_size(stats, sample, ["doc_id"]).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    got = rows.select("doc_id", "bad", *(c.alias("f_" + k) for k, c in feature_columns().items())).toPandas()
    drop_written(sample)
    if got.empty:
        return []
    got = got.sort_values(["doc_id", "bad"], kind="stable")
    got = got.iloc[np.argsort((got["doc_id"].to_numpy(np.uint64) * _MULT) >> np.uint64(20), kind="stable")]
    return learn_list(got[["f_" + k for k in FEATURES]].to_numpy(float), got["bad"].to_numpy(bool), **options)


def verdict(rules: list[Rule], prefix: str = "") -> tuple[Column, Column]:
    """(kept, number of the rule that matched or null) as ordered conditional expressions."""
    f = feature_columns(prefix)
    kept, which = F, F
    for k, r in enumerate(rules):
        kept, which = kept.when(r.column(f), F.lit(False)), which.when(r.column(f), F.lit(k + 1))
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    return kept.otherwise(F.lit(True)), which.otherwise(F.lit(None).cast("int"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, kept and the rule that rejected."""
    kept, which = verdict(rules)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", F.when(~failed, which)).withColumn("kept", ~failed & kept)


def keep_good(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The documents, all columns kept, that pass the base and that no rule rejects; each row is judged
    by its own text, in one pass."""
    name = fresh(docs, "_rule_stats")
    rows = docs.withColumn(name, counts(docs)(F.col(text)))
    kept, _ = verdict(rules, f"{name}.")
    return rows.where(~base_failed(F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")) & kept).drop(name)
