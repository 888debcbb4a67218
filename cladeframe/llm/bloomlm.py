"""Language-model scores from a log-frequency Bloom filter.

One pass over the training texts counts words and word pairs as packed hashes, which are summed
before and after one shuffle, dealt out to segments by hash.  A count c has level 1 + floor(log2 c);
the filter holds (n-gram, j) for each j up to the level, so that probing j = 1, 2, ... until one is
absent reads the level back.  Every n-gram of every count is in.  The filter is blocked: the bits of
one (n-gram, j) lie in one 64-bit word.  It grows with the data: its number of segments follows the
text, a segment is built in one task and sized by its own entries, and whole segments are packed
into parts of at most ``max_bytes``.  Each part is broadcast by itself and a task holds one at a
time, adding up the levels that the parts know.

With low and high the least and greatest counts of a level, the probability of a word w after u is
(1 - mix) * max(low(u, w) - discount, 0) / high(u) + mix * (low(w) + 1) / (N + V + 1); after a u never
seen it is the last fraction alone.  As low <= c <= high, the probabilities of all words after a u sum
to one at most (but for the filter's false positives, about one probe in a hundred).

The add-one base score is exact: counts are kept by 128-bit hashes of words; the ``hot`` most frequent
words (a bounded table) are looked up in a broadcast, the other words of each text by a join with
the whole count table, segment by segment.

Defined results: null and empty texts are one end token; a null id is never learned from; an empty
training set gives every token the count 0 (N = V = 0); very long texts are scored whole, in arrays
of their size; words of one count are as good as one another for the hot table, which changes no
result; repeated documents are counted and scored each; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, ship, written
from .words import Hash, Table, distinct, flat, mix, places, slices, tidy

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BITS_PER_ENTRY = 12
#: Tokens whose counts a task sums before it passes them on.
PIECE = 1_000_000
#: The most that a segment takes, which bounds what the task that builds it holds.
SEGMENT_BYTES = 4 << 20

FIRST, SECOND = Hash(1), Hash(2)
#: The end of a text as a token; no word holds a blank.
END = FIRST.one(b" "), SECOND.one(b" ")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes, second hashes, ends) of the texts' tokens, each text with its end token."""
    raw, at = flat(column)
    starts, ends, first = places(raw, at)
    n = np.diff(first)
    last = np.cumsum(n + 1)
    place = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    out = []
    for h, end in zip((FIRST, SECOND), END):
        x = np.full(int(last[-1]) if len(last) else 0, end, np.uint64)
        x[place] = h.prefix(raw, starts, ends)
        out.append(x)
    return *out, last


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _M1) ^ right
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def pairs_of(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left words, pair hashes) of tokens; a text starts after an end token."""
    left = np.empty_like(h)
    left[1:] = h[:-1]
    left[np.concatenate([[0], ends[:-1]])] = np.uint64(END[0])
    return left, pair_hash(left, h)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(1)) % np.uint64(segments)).astype(np.int64)


def _binary(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``x`` between cuts."""
    at = (cuts * x.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def packed(segment: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """Rows dealt out to segments: the segments that have any, and each column's values there as bytes."""
    by = np.argsort(segment, kind="stable")
    s = segment[by]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    cuts = np.append(at, len(s))
    return pa.array(s[at].astype(np.int32)), [_binary(c[by], cuts) for c in columns]


COUNTED = "s int, words boolean, h binary, g binary, n binary"


def counted(docs: DataFrame, segments: int, text: str = "text") -> DataFrame:
    """COUNTED rows of the words (``h`` and ``g`` their hashes) and word pairs (``h``) of all texts."""
    def run(batches):
        held, n = [], 0

        def out():
            h, g, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            one, back = distinct(h, g)
            s, cols = packed(segment_of(h[one], segments), h[one], g[one], np.bincount(back, minlength=len(one)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([s, pa.array(np.ones(len(s), bool)), *cols], ["s", "words", "h", "g", "n"])
            p, m = np.unique(p, return_counts=True)
            s, cols = packed(segment_of(p, segments), p, m.astype(np.int32))
            yield pa.RecordBatch.from_arrays([s, pa.array(np.zeros(len(s), bool)), cols[0], pa.nulls(len(s), pa.binary()), cols[1]], ["s", "words", "h", "g", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                h, g, ends = tokens(batch.column(0).slice(lo, hi - lo))
                held.append((h, g, pairs_of(h, ends)[1]))
                n += len(h)
                if n > PIECE:
                    yield from out()
                    n = 0
        if held:
            yield from out()
        tidy()

    return docs.select(text).mapInArrow(run, COUNTED)


class Part:
    """Some segments of the log-frequency Bloom filter: ``start`` (in 64-bit words, -1 where a segment
    is not in) and ``size`` (words) by segment."""

    def __init__(self, bits: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.bits, self.start, self.size = bits, start, size

    @staticmethod
    def spots(h: np.ndarray, j: int, size) -> tuple[np.ndarray, list[np.ndarray]]:
        """The word of (h, j) in a segment of ``size`` words, and the numbers of its four bits."""
        x = mix(h ^ np.uint64(j * int(_M2) & (1 << 64) - 1))
        at = ((x >> np.uint64(32)) * size) >> np.uint64(32)
        return at.astype(np.int64), [(x >> np.uint64(6 * i)) & np.uint64(63) for i in range(4)]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each hash, 0 where it is absent or of another part's segments."""
        out = np.zeros(len(h), np.int64)
        s = segment_of(h, len(self.start))
        live = np.flatnonzero(self.start[s] >= 0)
        h, s = h[live], s[live]
        base, size = self.start[s], self.size[s]
        j, one = 1, np.uint64(1)
        while len(live) and j <= 64:
            at, bits = self.spots(h, j, size)
            word, mask = self.bits[base + at], one << bits[0]
            for b in bits[1:]:
                mask |= one << b
            ok = np.flatnonzero((word & mask) == mask)
            live, h, base, size = live[ok], h[ok], base[ok], size[ok]
            out[live] = j
            j += 1
        return out


class Filter:
    """All parts at once, for tables that one process may hold."""

    def __init__(self, parts: list[Part]):
        self.parts = parts

    def levels(self, h: np.ndarray) -> np.ndarray:
        return sum((p.levels(h) for p in self.parts), np.zeros(len(h), np.int64))


def low(levels: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


def high(levels: np.ndarray) -> np.ndarray:
    """The greatest count of a level."""
    return np.exp2(levels.astype(float)) - 1


def segments_for(entries: int, max_bytes: int) -> int:
    """Segments such that one, of the levels of ``entries`` at most, is a small share of a part."""
    return max(1, -(-entries * BITS_PER_ENTRY // 8 // min(SEGMENT_BYTES, max(1, max_bytes // 2))))


def bits_of(h: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The 64-bit words of a segment that holds each hash up to its level."""
    size = int(top.sum()) * BITS_PER_ENTRY // 64 + 1
    bits = np.zeros(size * 64, bool)
    for j in range(1, int(top.max(initial=0)) + 1):
        at, spots = Part.spots(h[top >= j], j, np.uint64(size))
        for b in spots:
            bits[at * 64 + b.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


SEGMENT = "s int, bits binary, h binary, g binary, n binary, n_words long, n_tokens long"


def segments_of(rows: DataFrame) -> DataFrame:
    """SEGMENT rows of COUNTED ones: the filter's words, and the words' hashes and whole counts."""
    def fill(key, table):
        kind = table["words"].to_numpy()
        read = lambda name, what, which: np.frombuffer(b"".join(x for x, w in zip(table[name].to_pylist(), kind) if w == which), what)
        h, g, n = read("h", np.uint64, True), read("g", np.uint64, True), read("n", np.int32, True)
        one, back = distinct(h, g)
        count = np.bincount(back, n, len(one)).astype(np.int64)
        p, m = read("h", np.uint64, False), read("n", np.int32, False)
        by = np.argsort(p)
        p = p[by]
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
        pairs = np.add.reduceat(m[by].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        bits = bits_of(np.concatenate([h[one], p[at]]), np.frexp(np.concatenate([count, pairs]).astype(float))[1])
        cells = [bits.tobytes(), h[one].tobytes(), g[one].tobytes(), count.tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in cells), pa.array([len(one)], pa.int64()), pa.array([int(count.sum())], pa.int64())], names=["s", "bits", "h", "g", "n", "n_words", "n_tokens"])

    return written(rows.groupBy("s").applyInArrow(fill, SEGMENT), "bloom-segments")


def parts_of(made: DataFrame, segments: int, max_bytes: int):
    """The filter of SEGMENT rows, part by part."""
    def joined(held):
        start, size, at = np.full(segments, -1, np.int64), np.ones(segments, np.uint64), 0
        for s, raw in held:
            start[s], size[s] = at, len(raw) // 8
            at += len(raw) // 8
        return Part(np.frombuffer(b"".join(raw for _, raw in held), np.uint64), start, size)

    held, total = [], 0
    for s, raw in made.select("s", "bits").toLocalIterator():
        if held and total + len(raw) > max_bytes:
            yield joined(held)
            held, total = [], 0
        held.append((s, bytes(raw)))
        total += len(raw)
    if held:
        yield joined(held)


def hottest(made: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes, second hashes, counts) of the ``hot`` words of most occurrences, of those that occur twice."""
    def run(batches):
        for b in batches:
            for h, g, n in zip(*(c.to_pylist() for c in b.columns)):
                h, g, n = np.frombuffer(h, np.int64), np.frombuffer(g, np.int64), np.frombuffer(n, np.int64)
                at = np.flatnonzero(n > 1)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[at]), pa.array(n[at])], ["h", "g", "n"])

    got = made.select("h", "g", "n").mapInArrow(run, "h long, g long, n long").orderBy(F.desc("n"), "h", "g").limit(hot).toArrow()
    h, g, n = (np.asarray(got[c].to_numpy()) for c in ("h", "g", "n"))
    return h.view(np.uint64), g.view(np.uint64), n


ROWS = "uid long, doc_id long, n long, n_known long, base double, score double, s int, h binary, g binary, u binary, m binary"


def score(
    docs: DataFrame, training: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hot: int = 200_000, max_bytes: int = 64 << 20, mix: float = 0.4, discount: float = 0.75
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    ship(spark)
    size = training.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    # A token has a byte and a blank at least; words and pairs have no more levels than occurrences.
    segments = segments_for(int(size[0] or 0) + 2 * size[1], max_bytes)
    made = segments_of(counted(training, segments, text))
    n_total, n_words = (int(x or 0) for x in made.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    parts = [spark.sparkContext.broadcast(p) for p in parts_of(made, segments, max_bytes)]
    sent = spark.sparkContext.broadcast(hottest(made, hot))
    n_texts, denom = size[1], n_total + n_words + 1
    floor = math.log10(denom)
    # More parts are opened once for more text.
    piece = (2 << 20) * min(16, max(1, len(parts)))

    def run(batches):
        h, g, n = sent.value
        table, weight = Table(max(1, len(h))), np.log10(n + 1.0)
        table.add(h, g)
        only = opened(parts[0]) if len(parts) == 1 else None
        part, uid = TaskContext.get().partitionId() << 36, 0

        def levels(h: np.ndarray) -> np.ndarray:
            if only is not None:
                return only.levels(h)
            got = np.zeros(len(h), np.int64)
            for p in parts:
                got += opened(p).levels(h)
            return got

        for batch in batches:
            for lo, hi in slices(batch.column(1), piece):
                h, g, ends = tokens(batch.column(1).slice(lo, hi - lo))
                starts, k = np.concatenate([[0], ends[:-1]]), hi - lo
                one, back = distinct(h, g)
                left, pairs = pairs_of(h, ends)
                got = levels(np.concatenate([h[one], pairs]))
                word, pair = got[: len(one)], got[len(one) :]
                p1 = ((low(word) + 1) / denom)[back]
                context = high(word)[back]
                before = np.empty_like(context)
                before[1:] = context[:-1]
                before[starts] = n_texts
                p = np.where(before > 0, (1 - mix) * np.maximum(low(pair) - discount, 0) / np.maximum(before, 1) + mix * p1, p1)
                logp = np.add.reduceat(np.log10(p), starts)
                row = table.find(h[one], g[one])
                value = np.where(row >= 0, weight[row] if len(weight) else 0.0, 0.0)
                rare = (row < 0)[back]
                base = np.add.reduceat(value[back], starts)
                known = np.add.reduceat((~rare).astype(np.int64), starts)
                ids = part + uid + np.arange(k)
                uid += k
                # Rare words of a text with their occurrences, dealt out to the words' segments.
                at = np.flatnonzero(rare)
                text_of = np.searchsorted(ends, at, side="right")
                pick, m = np.unique(text_of * np.int64(len(one)) + back[at], return_counts=True)
                w, t = one[pick % max(1, len(one))], pick // max(1, len(one))
                s, cols = packed(segment_of(h[w], segments), h[w], g[w], ids[t], m.astype(np.int32))
                none = lambda kind: pa.nulls(len(s), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), batch.column(0).slice(lo, k), pa.array(np.diff(ends, prepend=0)), pa.array(known), pa.array(base), pa.array(logp),
                        pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 4,
                    ],
                    NAMES,
                )
                yield pa.RecordBatch.from_arrays([*[none(pa.int64())] * 4, *[none(pa.float64())] * 2, s, *cols], NAMES)
        tidy()

    NAMES = [c.split()[0] for c in ROWS.split(", ")]
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, ROWS), "bloom-rows")

    def look(key, asked, table):
        read = lambda t, name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        h, g, n = read(table, "h", np.uint64), read(table, "g", np.uint64), read(table, "n", np.int64)
        have = Table(max(1, len(h)))
        have.add(h, g)
        row = have.find(read(asked, "h", np.uint64), read(asked, "g", np.uint64))
        at = np.flatnonzero(row >= 0)
        u, m = read(asked, "u", np.int64)[at], read(asked, "m", np.int32)[at].astype(np.int64)
        uids, back = np.unique(u, return_inverse=True)
        base = np.bincount(back, m * np.log10(n[row[at]] + 1.0), len(uids)) if len(at) else np.empty(0)
        return pa.table([pa.array(uids), pa.array(np.bincount(back, m, len(uids)).astype(np.int64)), pa.array(base)], names=["uid", "rare_known", "rare_base"])

    asked = rows.where(F.col("s").isNotNull()).select("s", "h", "g", "u", "m").groupBy("s")
    found = asked.cogroup(made.select("s", "h", "g", "n").groupBy("s")).applyInArrow(look, "uid long, rare_known long, rare_base double")
    found = found.groupBy("uid").agg(F.sum("rare_known").alias("rare_known"), F.sum("rare_base").alias("rare_base"))
    out = rows.where(F.col("s").isNull()).select("uid", "doc_id", "n", "n_known", "base", "score").join(found, "uid", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n") * F.lit(floor)).alias("base_score"), "score",
    )
