"""Toxicity scores behind a noisy-channel deobfuscator.

Every token spans a lattice of characters: leet signs stand for letters, signs between letters may
vanish, letter runs may shrink to one or two.  Where blanks may hide a word (runs of three and more
single characters with the short tokens beside them, and neighbours that make a telling word when put
together) the lattice spans the whole run, and each blank is a step that stays or vanishes at a cost.
A Viterbi search under a character trigram model (counted over all training texts) finds the
likeliest reading; a token whose lattice has one path reads as itself.  A sparse logistic model (FTRL,
elastic net) over the restored words of a text and their beginnings gives the score, calibrated on
held-back rows.

Texts are read as arrays of word hashes; Python sees a token once, in a table of bounded size, and only
where it is no run of different ASCII letters.

Defined results: null and empty texts have no words and score the calibrated bias, as a text with no
telling word does; labels that are null are ignored, and so are repeated ones; without labels of both
kinds every score is 0; of readings that cost the same the first choice of the lattice wins; very long
texts are scored whole; a score of exactly one half is toxic; repeated documents are scored each; empty
tables give no rows; other columns are not read (scores) or kept as they are (``drop_toxic``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, drop_written, ship, written
from .ftrl import FTRL
from .words import Hash, Table, distinct, flat, places, slices, tidy

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log10 costs of the channel: a sign for a letter, a sign or a digit that vanishes, a letter run that shrinks,
#: a blank that vanishes among single characters, and one between longer tokens.
COST_LEET, COST_DROP, COST_DIGIT, COST_RUN, COST_BLANK, COST_JOIN = 0.7, 1.0, 4.0, 1.2, 0.2, 1.0
#: Symbols of the character model: 0 for a word's edge (any character that is no letter, and letters
#: beyond the basic plane), 1 for a letter that is not listed, then these.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôùûñáíóúœæ"
K = len(LETTERS) + 2
_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_TABLE = np.array([chr(c).isalpha() for c in range(1 << 16)], np.uint8)
_TABLE[65535] = 0
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1")
PREFIXES = (4, 5, 6)
WORD, SECOND, START = Hash(21), Hash(22), Hash(23)
#: Entries of a worker's table of tokens, and of its runs.
ENTRIES, RUNS = 500_000, 50_000


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigram counts of all texts (K**3), each word between edges."""
    def count(batches):
        total = np.zeros(K**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                c = np.frombuffer(f"  {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
                s = _TABLE[np.minimum(c, 65535)].astype(np.int32)
                total += np.bincount(s[:-2] * (K * K) + s[1:-1] * K + s[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["k", "n"])

    out = np.zeros(K**3)
    for r in docs.select(text).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def char_model(counts: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b), interpolated from trigrams, bigrams and single characters."""
    c3 = counts.reshape(K, K, K)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + K)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return np.log10(p3)


class Decoder:
    """Viterbi decoding of token lattices under a character trigram model."""

    def __init__(self, model: np.ndarray):
        self.lp = [[row.tolist() for row in plane] for plane in model]

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Choices (letters, cost) for each step of the token."""
        steps, i, n = [], 0, len(token)
        while i < n:
            c, j = token[i], i + 1
            if c.isalpha():
                while j < n and token[j] == c:
                    j += 1
                run = j - i
                if run == 1:
                    steps.append([(c, 0.0)])
                elif run == 2:
                    steps.append([(c + c, 0.0), (c, COST_RUN)])
                else:
                    steps.append([(c, COST_RUN), (c + c, COST_RUN)])
            else:
                while j < n and token[j] == c:
                    j += 1
                one = [(x, COST_LEET) for x in LEET.get(c, "")]
                two = [(x + x, COST_LEET) for x in LEET.get(c, "")] if j - i > 1 else []
                steps.append([*one, *two, ("", COST_DIGIT if c.isdigit() else COST_DROP)])
            i = j
        return steps

    def run(self, tokens: list[str], cost: float) -> str:
        """The likeliest words, parted by blanks, of lower-case tokens whose blanks vanish at ``cost``."""
        steps = []
        for t in tokens:
            if steps:
                steps.append([(" ", 0.0), ("", cost)])
            steps += self.lattice(t)
        return self.read(steps)

    def decode(self, token: str) -> str:
        """The likeliest word of a lower-case token."""
        return self.read(self.lattice(token))

    def read(self, steps: list[list[tuple[str, float]]]) -> str:
        """The letters of the cheapest path."""
        lp, code = self.lp, _CODE
        best = {(0, 0): (0.0, None)}  # (last two symbols) -> (cost, back pointer chain of letters)
        for choices in steps:
            new: dict = {}
            for (a, b), (cost, back) in best.items():
                for letters, channel in choices:
                    x, y, total, chain = a, b, cost + channel, back
                    for c in letters:
                        z = code.get(c, 1) if c != " " else 0
                        total -= lp[x][y][z]
                        x, y, chain = y, z, (c, chain)
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, chain
            best = new
        (_, chain) = min(((cost - lp[a][b][0], chain) for (a, b), (cost, chain) in best.items()), key=lambda v: v[0])
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))

    def restore(self, raw: str) -> str:
        """The word of a raw token: outer punctuation goes, the rest is decoded where it is not plain."""
        w = raw.lower()
        if _PLAIN.fullmatch(w):
            return self.decode(w) if _RUN.search(w) else w
        lo, hi = 0, len(w)
        while hi and not w[hi - 1].isalnum():
            hi -= 1
        if hi < len(w) <= hi + 2 and w[hi:].strip("$@+") == "":
            hi = len(w)  # a sign or two at the end may be letters; longer tails are decoration
        while lo < hi and not w[lo].isalnum():
            lo += 1
        if lo and lo < hi and w[lo - 1] in LEET and w[lo : lo + 1].isalpha() and w[lo - 2 : lo - 1] != w[lo - 1]:
            lo -= 1
        w = w[lo:hi]
        if not any(c.isalpha() for c in w):
            return ""
        return w if _PLAIN.fullmatch(w) and not _RUN.search(w) else self.decode(w)


#: Signs that a token loses at its end before anything else; the others may stand for letters there.
_TAIL = np.zeros(256, bool)
_TAIL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "$@+"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = _LETTER.copy()
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True


def cores(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each text) of the tokens, less one sign of _TAIL at the end."""
    starts, ends, first = places(raw, at)
    return starts, ends - ((ends - starts > 1) & _TAIL[raw[ends - 1]]), first


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first token, last token + 1) of the runs of three and more single characters, a letter
    among them, and the tokens of three bytes at most right beside them."""
    size, lead = ends - starts, raw[starts] if len(starts) else np.empty(0, np.uint8)
    one = ((size == 1) & _SIGN[lead]) | ((size == 2) & (lead >= 0xC3) & (lead < 0xE0))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    turn = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (text[1:] != text[:-1]), [True]])) if len(one) else np.empty(0, np.int64)
    out = []
    for i in np.flatnonzero(one[turn[:-1]] & (np.diff(turn) >= 3)).tolist() if len(turn) else ():
        a, b = int(turn[i]), int(turn[i + 1])
        t = int(text[a])
        if not (_LETTER[lead[a:b]] | (lead[a:b] >= 0xC3)).any():
            continue
        out.append((t, a - int(a > first[t] and size[a - 1] <= 3), b + int(b < first[t + 1] and size[b] <= 3)))
    return out


def features(word: str) -> list[int]:
    """Numbers of a restored word: its own, and those of its beginnings."""
    if len(word) < 2:
        return []
    out = [WORD.plain(word.encode("utf-8", "surrogatepass")) >> 1]
    return out + [START.plain(word[:k].encode("utf-8", "surrogatepass")) >> 1 for k in PREFIXES if len(word) >= k]


def text_features(text: str | None, decoder: Decoder, memo: dict) -> set[int]:
    """All features of a text."""
    raw, at = flat(pa.array([text], pa.string()))
    starts, ends, first = cores(raw, at)
    whole, found = raw.tobytes(), set()
    words = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
    for w in set(words):
        got = memo.get(w)
        if got is None:
            if len(memo) > 2 * RUNS:
                memo.clear()
            got = memo[w] = features(decoder.restore(w))
        found.update(got)
    for _, a, b in spaced(raw, starts, ends, first):
        for w in decoder.run([w.lower() for w in words[a:b]], COST_BLANK).split():
            found.update(features(w))
    return found


class Scorer:
    """Scores of whole columns of texts."""

    def __init__(self, model: "Model"):
        self.model, self.decoder = model, Decoder(model.chars)
        self.keys = np.array(sorted(model.weight), np.int64)
        self.values = np.array([model.weight[k] for k in self.keys.tolist()], float)
        #: Of the low bits of numbers, those that any feature has.
        self.low = np.zeros(1 << 16, bool)
        self.low[self.keys & 0xFFFF] = True
        self.runs: dict[tuple, list] = {}
        self.clear(ENTRIES)

    def clear(self, entries: int) -> None:
        self.table = Table(entries)
        self.weight = np.zeros(self.table.limit + 1)

    def look(self, numbers: np.ndarray) -> np.ndarray:
        """Weights of features, given as hashes."""
        numbers = (numbers >> np.uint64(1)).astype(np.int64)
        out, at = np.zeros(len(numbers)), np.flatnonzero(self.low[numbers & 0xFFFF])
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, numbers[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == numbers[at], self.values[k], 0.0)
        return out

    def word(self, w: str) -> float:
        get = self.model.weight.get
        return sum([get(f, 0.0) for f in features(w)])

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weights of new tokens."""
        size = ends - starts
        cuts = np.concatenate([[0], np.cumsum(size)])
        buf = raw[np.repeat(starts - cuts[:-1], size) + np.arange(int(cuts[-1]))]
        folded = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
        odd = np.concatenate([[0], np.cumsum(~_LETTER[buf])])
        twin = np.concatenate([[0, 0], np.cumsum(folded[1:] == folded[:-1])])
        s, e = cuts[:-1], cuts[1:]
        simple = (odd[e] == odd[s]) & (twin[e] == twin[np.minimum(s + 1, len(twin) - 1)])
        out = np.zeros(len(size))
        at = np.flatnonzero(simple & (size > 1))
        if len(at):
            out[at] = self.look(WORD.prefix(buf, s[at], e[at]))
            for k in PREFIXES:
                on = at[size[at] >= k]
                if len(on):
                    out[on] += self.look(START.prefix(buf, s[on], s[on] + k))
        whole = buf.tobytes()
        for i in np.flatnonzero(~simple).tolist():
            out[i] = self.word(self.decoder.restore(whole[s[i] : e[i]].decode("utf-8", "replace")))
        return out

    def reading(self, words: tuple, cost: float) -> list[tuple[str, float]]:
        """Telling words of a run whose blanks may vanish, with their weights."""
        got = self.runs.get(words)
        if got is None:
            if len(self.runs) > RUNS:
                self.runs.clear()
            found = self.decoder.run([w.lower() for w in words], cost).split()
            got = self.runs[words] = [(w, v) for w in dict.fromkeys(found) if w not in words and (v := self.word(w))]
        return got

    def sums(self, column: pa.Array) -> np.ndarray:
        """The sum of the weights of the different tokens and readings of each text."""
        raw, at = flat(column)
        starts, ends, first = cores(raw, at)
        total = np.zeros(len(column))
        if not len(starts):
            return total
        sums = WORD.sums(raw, starts, ends)
        h1, h2 = WORD.sealed(sums, ends - starts), SECOND.prefix(raw, starts, ends)
        for turn in (0, 1):
            row = self.table.find(h1, h2)
            new = np.flatnonzero(row < 0)
            one, back = distinct(h1[new], h2[new])
            if self.table.room >= len(one):
                break
            self.clear(max(ENTRIES, 2 * len(one)) if turn == 0 else 2 * len(one))
        if len(one):
            pick = new[one]
            rows = self.table.add(h1[pick], h2[pick])
            self.weight[rows] = self.learn(raw, starts[pick], ends[pick])
            row[new] = rows[back]
        text = np.repeat(np.arange(len(column)), np.diff(first))
        value = self.weight[row]
        hit = np.flatnonzero(value)
        _, once = np.unique(text[hit] * np.int64(len(self.weight)) + row[hit], return_index=True)
        hit = hit[once]
        total += np.bincount(text[hit], value[hit], len(column))
        extra: dict[tuple[int, str], float] = {}
        read = lambda a, b: tuple(raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist()))
        for t, a, b in spaced(raw, starts, ends, first):
            extra.update(((t, w), v) for w, v in self.reading(read(a, b), COST_BLANK))
        # Neighbours of letters alone that make a telling word when put together.
        size = ends - starts
        odd = np.concatenate([[0], np.cumsum(~_LETTER[raw])])
        plain = (odd[ends] == odd[starts]) & (size > 1) & (size < 24)
        left = np.flatnonzero(plain[:-1] & plain[1:] & (text[1:] == text[:-1]))
        both = WORD.sealed(WORD.joined(sums[left], size[left], sums[left + 1]), size[left] + size[left + 1])
        for i in left[np.flatnonzero(self.look(both))].tolist():
            extra.update(((int(text[i]), w), v) for w, v in self.reading(read(i, i + 2), COST_JOIN))
        for (t, _), v in extra.items():
            total[t] += v
        return total

    def scores(self, column: pa.Array) -> np.ndarray:
        m = self.model
        if not m.weight:
            return np.full(len(column), m.empty)
        z = [self.sums(column.slice(lo, hi - lo)) for lo, hi in slices(column)]
        z = m.a * (m.bias + (np.concatenate(z) if z else np.empty(0))) + m.b
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class Model:
    """A character model, sparse feature weights, and the calibration a * logit + b."""

    def __init__(self, chars, weight, bias, a=1.0, b=0.0, empty=0.0):
        self.chars, self.weight, self.bias, self.a, self.b, self.empty = chars, weight, bias, a, b, empty


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds with least loss against Platt's smoothed targets.  The offset
    stays between -1.5 and 0: a text with one strong telling word must still pass one half."""
    if not len(z) or y.all() or not y.any():
        return 1.0, 0.0
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    grid = [(a, b) for a in np.exp(np.linspace(np.log(0.2), np.log(5), 65)) for b in np.linspace(-1.5, 0, 7)]
    a, b = min(grid, key=lambda g: (np.logaddexp(0, g[0] * z + g[1]) - t * (g[0] * z + g[1])).mean())
    return float(a), float(b)


def _one_of_each(rows: list[np.ndarray], order: np.ndarray) -> list[int]:
    """Row numbers in ``order`` without near copies, which would pass a text's every word off as
    telling: of rows with the same four least feature hashes the first stays."""
    seen, out = set(), []
    for i in order.tolist():
        h = (rows[i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key = tuple(np.sort(h >> np.uint64(20))[:4].tolist())
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def telling(rows: list[np.ndarray], y: np.ndarray, order: list[int], level: float = 0.05) -> np.ndarray:
    """Features that stand in more toxic rows than chance gives, after Bonferroni: the binomial tail
    of their toxic rows among all their rows, bounded by Chernoff's inequality."""
    pos = [rows[i] for i in order if y[i] == 1]
    if not pos or len(pos) == len(order):
        return np.empty(0, np.int64)
    every, n = np.unique(np.concatenate([rows[i] for i in order]), return_counts=True)
    at, k = np.unique(np.concatenate(pos), return_counts=True)
    n, r = n[np.searchsorted(every, at)], len(pos) / len(order)
    share = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = share * np.log(share / r) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - r)), 0.0)
    return at[(share > r) & (n * kl > math.log(max(1, int((n > 2).sum())) / level))]


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = 4000, l1: float = 0.1, l2: float = 0.02, alpha: float = 1.0, epochs: int = 5, floor: float = 1.0) -> Model:
    """Learn from ``docs``: the character model from all texts, the weights from about ``bound``
    labelled rows of each kind.  Labels are joined by id and are otherwise unused.

    ``l1`` is the penalty for one toxic row; it grows with the square root of their number, as the
    sums of chance do.  Weights below ``floor`` are dropped, negative ones included: no amount of harmless text around
    a toxic word may lower a text's score.
    """
    spark = docs.sparkSession
    ship(spark)
    chars = char_model(char_counts(docs, text))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    n = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(chars, {}, 0.0)
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(int(min(1.0, bound / n[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, 2 * bound / n[0]) * (1 << 30))))
    sample = written(known.where(h < share), "toxicity-sample")
    sent = spark.sparkContext.broadcast(chars)

    def run(batches):
        decoder, memo = Decoder(sent.value), {}
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                out = [sorted(text_features(t, decoder, memo)) for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "y", "f"])
        memo.clear()
        tidy()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    got = by_size(rows, sample, ["doc_id"]).select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f array<long>").toArrow()
    drop_written(sample)
    ids, y = np.array(got["doc_id"].to_pylist(), np.int64), np.array(got["y"].to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return Model(chars, {}, 0.0)
    flat = [np.asarray(f.values, np.int64) for f in got["f"]]
    order = _one_of_each(flat, np.lexsort((y, ids)))
    keep = telling(flat, y, order)
    x = [flat[i][np.isin(flat[i], keep)] for i in order]
    y = y[order]
    if len(set(y.tolist())) < 2 or not len(keep):
        return Model(chars, {}, 0.0)
    buckets, where = np.unique(np.concatenate(x), return_inverse=True)
    cuts = np.cumsum([len(f) for f in x])[:-1]
    x = [(f, np.ones(len(f))) for f in np.split(where, cuts)]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    turns = [(x[i], y[i]) for i in np.flatnonzero(~held)]
    # Toxic rows also come with some of their features left out, so that one telling word is enough.
    rng = np.random.default_rng(13)
    for i in np.flatnonzero(~held & (y == 1)):
        for _ in range(3):
            some = x[i][0][rng.random(len(x[i][0])) < 0.4]
            if len(some):
                turns.append(((some, np.ones(len(some))), 1))
    model = FTRL(2, len(buckets), alpha=alpha, l1=l1 * math.sqrt(int((y == 1).sum())), l2=l2).fit([r for r, _ in turns], np.array([v for _, v in turns]), epochs=epochs)
    w, bias = model.weights()
    diff, bias = w[:, 1] - w[:, 0], float(bias[1] - bias[0])
    diff = np.where(diff >= floor, diff, 0.0)
    back = np.flatnonzero(held)
    a, b = _calibration(np.array([diff[x[i][0]].sum() + bias for i in back]), y[back] == 1)
    return Model(chars, {int(buckets[i]): float(diff[i]) for i in np.flatnonzero(diff)}, bias, a, b)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), scores(docs, model)(F.col(text)).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents, all columns kept, that score below ``limit``."""
    return docs.where(scores(docs, model)(F.col(text)) < limit)


def scores(docs: DataFrame, model: Model):
    """The score as a function of a text column; only that column goes to Python."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in column:
            yield pa.array(scorer.scores(texts), pa.float64())
        del scorer
        tidy()

    return scored
