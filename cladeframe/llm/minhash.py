"""N-gram Jaccard join by MinHash banding.

A document is the set of its runs of ``n`` lower-cased words (all of them as one run where it has
fewer).  Documents with equal sets form one class; classes are numbered by a hash of their set and
only one document of each is joined, so neither repeated nor null ids run texts together.  Bands and
rows are chosen so that a pair at the threshold is found with probability ``recall``; band hashes are
shuffled, and every pair of a bucket is verified on the full sets in the task of the first band that
the two share, so each pair is counted once and no pair is ever written out.  A large bucket is split
into blocks, by rows and by the bytes of their sets, and a task gets two blocks at most.  Tasks
return link counts and a spanning forest of the links, from which connected groups follow by repeated
minima with pointer jumping, each round written to the shared folder.

Defined results: a text without words (null, empty) is in a class and group of its own with no
links; equal sets are one class, so copies share a class and a group; null ids are linked as others
are, and give a class or group its id only where it has no other; different texts under one id are
different rows, each in its own group; repeated rows come back once each (join); a pair exactly at
the threshold is a link; a very long text is one set of one block, whatever its size; empty tables
give no rows.  Other columns are not read (join) or are kept as they are (``keep_one``), where a null
id is the least of all ids.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, drop_written, fresh, ship, written
from .words import Hash, flat, places, slices, tidy

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Bands:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    max_hashes: int = 128

    def shape(self) -> tuple[int, int]:
        """(bands, rows): the most rows a band whose bands reach the recall within ``max_hashes``."""
        for rows in range(16, 0, -1):
            bands = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**rows))
            if bands * rows <= self.max_hashes:
                return bands, rows
        return self.max_hashes, 1


WORDS = Hash(1)


def shingled(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the word runs of all texts, with repeats; the number of the first of each text)."""
    raw, at = flat(column)
    starts, ends, first = places(raw, at)
    w = WORDS.prefix(raw, starts, ends)
    size = np.diff(first)
    runs = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(int(at[-1]), np.uint64)
    for k in range(1, n + 1):
        # Texts of k words have one run, those of n and more have one for each place.
        texts = np.flatnonzero(size >= n if k == n else size == k)
        if len(texts):
            m = runs[texts]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            place, h = np.repeat(first[texts], m) + step, np.full(int(m.sum()), k, np.uint64)
            for i in range(k):
                h = (h ^ w[place + i]) * _M1
                h ^= h >> np.uint64(32)
            out[np.repeat(at[texts], m) + step] = h
    return out, at


def band_hashes(flat_: np.ndarray, at: np.ndarray, bands: int, rows: int, a: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band of each text that has runs, of the minima of ``rows`` hash functions."""
    full = np.flatnonzero(np.diff(at))
    low = np.full((len(a), len(full)), np.iinfo(np.uint64).max, np.uint64)
    begin, end = at[full], at[full + 1]
    i = 0
    while i < len(full):
        # Some texts at a time, and long ones in parts, so that the work stays in the processor's caches.
        j = max(i + 1, int(np.searchsorted(end, begin[i] + 16_384, side="right")))
        if j == i + 1:
            for lo in range(int(begin[i]), int(end[i]), 16_384):
                x = flat_[lo : min(lo + 16_384, int(end[i]))]
                for k in range(len(a)):
                    low[k, i] = min(low[k, i], ((x ^ a[k]) * _M2).min())
        else:
            x, cuts = flat_[begin[i] : end[j - 1]], begin[i:j] - begin[i]
            for k in range(len(a)):
                low[k, i:j] = np.minimum.reduceat((x ^ a[k]) * _M2, cuts)
        i = j
    h = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[None], len(full), 0)
    for row in range(rows):
        h = (h ^ low.reshape(bands, rows, -1)[:, row].T) * _M1
        h ^= h >> np.uint64(29)
    return h


def signatures(docs: DataFrame, spec: Bands, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, size, bands, th): key is a digest of the set, null (as the bands are) without
    words; size counts the set; th is a hash of the text, which names a row together with its id."""
    bands, rows = spec.shape()
    a = np.random.default_rng(20240229).integers(1, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                h, at = shingled(batch.column(1).slice(lo, hi - lo), spec.n)
                sig, n = band_hashes(h, at, bands, rows, a).view(np.int64), np.diff(at)
                sets = [np.unique(h[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                keys = pa.array([s if s is None else hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()), mask=pa.array(n == 0))
                size = pa.array([0 if s is None else len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), keys, size, sig, batch.column(2).slice(lo, hi - lo)], ["doc_id", "key", "size", "bands", "th"])
        tidy()

    schema = "doc_id long, key binary, size long, bands array<long>, th long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text), F.xxhash64(text).alias("th")).mapInArrow(run, schema)


def _verify(task_rows: list[tuple], threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Links inside one task.  Rows: (id, band number, bands, set, block, two blocks?)."""
    ids = np.array([r[0] for r in task_rows], np.int64)
    order = np.argsort(ids, kind="stable")
    rows = [task_rows[i] for i in order]
    ids, n = ids[order], len(rows)
    band = rows[0][1]
    bands = np.array([r[2][:band] for r in rows], np.int64).reshape(n, band)
    sets = [r[3] for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    block = np.array([r[4] for r in rows], np.int64)
    across = rows[0][5]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    last = np.concatenate([first[1:], [len(flat)]])
    number = np.repeat(np.arange(len(first)), last - first)
    # shared[i] counts what row i has in common with the others, over an inverted index.
    inverse = np.empty(len(flat), np.int64)
    inverse[by] = number
    starts = np.concatenate([[0], np.cumsum(size)])
    parent, links = list(range(n)), np.zeros(n, np.int64)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n - 1):
        mine = inverse[starts[i] : starts[i + 1]]
        other = np.arange(i + 1, n)
        ok = (size[i] >= threshold * size[i + 1 :]) & (size[i + 1 :] >= threshold * size[i])
        ok &= block[i + 1 :] != block[i] if across else True
        if band:
            ok &= ~(bands[i + 1 :] == bands[i]).any(1)
        other = other[ok]
        if not len(other):
            continue
        if len(other) <= 8:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other])
        else:
            spans = [owner[first[m] : last[m]] for m in mine]
            common = np.bincount(np.concatenate(spans), minlength=n)[other]
        near = other[common >= threshold * (size[i] + size[other] - common) - 1e-9]
        if len(near):
            links[i] += len(near)
            links[near] += 1
            top = root(i)
            for j in near.tolist():
                r = root(j)
                if r != top:
                    lo, top = (top, r) if top > r else (r, top)
                    parent[lo] = top
    got = np.flatnonzero(links)
    return ids[got].tolist(), links[got].tolist(), [int(ids[root(int(i))]) for i in got]


def links(sig: DataFrame, docs: DataFrame, spec: Bands, doc_id: str, text: str, block: int = 256, block_bytes: int = 8 << 20) -> DataFrame:
    """(rep, n, root): per task and class (the hash of its key), its verified links and the root of its tree."""
    real = sig.where(F.col("key").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")).alias("at")
    reps = written(real.groupBy("key").agg(least, F.first("bands").alias("bands"), F.first("size").alias("size")).select(F.xxhash64("key").alias("rep"), "key", "at", "bands", "size"), "minhash-classes")
    rows = reps.select("rep", "size", F.posexplode("bands").alias("band", "h"))
    total = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)) % F.lit(1 << 40))
    buckets = rows.groupBy("band", "h").agg(F.count("*").alias("m"), (8 * F.sum("size")).alias("bytes"), total(1).alias("sum"), total(3).alias("sum2"))
    # Of buckets with the same members the one of the first band is enough.
    kept = buckets.where("m > 1").groupBy("m", "bytes", "sum", "sum2").agg(F.min(F.struct("band", "h")).alias("b")).select("m", "bytes", "b.*")
    members = written(rows.drop("size").join(kept, ["band", "h"]), "minhash-members")
    wanted = written(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "key", "bands", "at.*"), "minhash-wanted")
    number = F.col(doc_id).cast("long")
    texts = docs.select(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))

    def full(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                h, at = shingled(batch.column(2).slice(lo, hi - lo), spec.n)
                sets = [np.unique(h[x:y]).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                # A row of the same id whose text has the same hash, but another set, is another class's.
                same = pa.array([hashlib.md5(s).digest() == k for s, k in zip(sets, batch.column(1).slice(lo, hi - lo).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["rep", "s"]).filter(same)
        tidy()

    found = by_size(texts, wanted.drop("bands"), ["none", "id", "th"]).select("rep", "key", "t")
    sets = found.mapInArrow(full, "rep long, s binary").dropDuplicates(["rep"]).join(wanted.select("rep", "bands"), "rep")
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(block), F.col("bytes") / F.lit(block_bytes))).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
    tasks = members.join(sets, "rep").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("p", F.explode(pairs))
    tasks = tasks.select(F.xxhash64("band", "h", "p.i", "p.j").alias("task"), "band", "h", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "rep", F.slice("bands", 1, F.col("band")).alias("bands"), "s", "mine")

    def work(batches):
        now, held = None, []

        def done():
            return _verify(held, spec.threshold) if len(held) > 1 else ([], [], [])

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for _, band, h, i, j, rep, bands, s, mine in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, h, i, j) != now:
                    for col, got in zip(out, done()):
                        col.extend(got)
                    now, held = (band, h, i, j), []
                held.append((rep, band, bands, np.frombuffer(s, np.uint64), mine, i != j))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "n", "root"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done()], ["rep", "n", "root"])
        held.clear()
        tidy()

    order = ["task", "band", "h", "i", "j"]
    found = written(tasks.repartition("task").sortWithinPartitions(*order).mapInArrow(work, "rep long, n long, root long"), "minhash-links")
    for done_with in (members, wanted, reps):
        drop_written(done_with)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(id, group) of every end of ``edges(a, b)``: the least id that it is connected to.

    Each round takes the least label among neighbours and then the label of that label; rounds grow
    with the logarithm of a path's length on the trees that tasks return.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "components-edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("g")), "components-labels")
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, label.id == near.a).select("id", F.col("g").alias("old"), F.least("g", "m").alias("g"))
        jump = label.select(F.col("id").alias("at"), F.col("g").alias("far"))
        new = written(step.join(jump, step.g == jump["at"], "left").select("id", "old", F.least("g", F.coalesce("far", "g")).alias("g")), "components-labels")
        moved = new.where("g <> old").limit(1).count()
        drop_written(label)
        label = new.select("id", "g")
        if not moved:
            drop_written(both)
            return label.select("id", F.col("g").alias("group"))


def _groups(sig: DataFrame, docs: DataFrame, spec: Bands, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rep, n_links) and (rep, group) of the classes that have links; the group is one of its classes."""
    found = links(sig, docs, spec, doc_id, text)
    n = found.groupBy("rep").agg(F.sum("n").alias("n_links"))
    return n, components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")


def jaccard_join(docs: DataFrame, spec: Bands = Bands(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, copy_id (least id of its class of equal sets), class_id
    (least id of the documents connected to it by links or copies), n_links (different texts whose
    similarity to its own is at least the threshold) and n_copies (documents of its class)."""
    ship(docs.sparkSession)
    sig = written(signatures(docs, spec, doc_id, text), "minhash-signatures")
    n, group = _groups(sig, docs, spec, doc_id, text)
    classes = sig.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"))
    classes = classes.withColumn("rep", F.xxhash64("key"))
    least = written(group.join(classes.select("rep", "copy_id"), "rep").groupBy("group").agg(F.min("copy_id").alias("class_id")), "minhash-groups")
    # A group's classes may be many; its name goes to them, as long as the groups are few.
    named = by_size(group, least, ["group"]).select("rep", "class_id")
    classes = classes.join(n, "rep", "left").join(named, "rep", "left")
    classes = classes.select("key", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "copy_id").alias("class_id"))
    out = sig.select("doc_id", "key").join(classes, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, spec: Bands = Bands(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns kept, that are the first row of their group by id and text digest;
    rows are told apart by id and text.  Texts without words all stay.

    The text itself is not shuffled while the rows that go are few (``common.SMALL``)."""
    ship(docs.sparkSession)
    sig = written(signatures(docs, spec, doc_id, text), "minhash-signatures")
    _, group = _groups(sig, docs, spec, doc_id, text)
    # The first row of a class, and how often the same id and text stand in it.
    rows = written(sig.where(F.col("key").isNotNull()).groupBy("key", "doc_id", "th").agg(F.count("*").alias("n")), "minhash-rows")
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "key", "th")).alias("at")).select(F.xxhash64("key").alias("rep"), "at")
    first = first.join(group, "rep", "left").groupBy(F.coalesce("group", "rep").alias("group")).agg(F.min("at").alias("at")).select("at.*")
    on = [fresh(docs, f"_keep_{x}") for x in ("none", "id", "th")]
    name = lambda i, th: [i.isNull().alias(on[0]), F.coalesce(i, F.lit(0)).alias(on[1]), th.alias(on[2])]
    named = rows.select(*name(F.col("doc_id"), F.col("th")), "n", "key")
    stays = named.join(first.select(*name(F.col("doc_id"), F.col("th")), "key", F.lit(True).alias("stays")), ["key", *on], "left")
    stays = written(stays.groupBy(*on).agg(F.max(F.coalesce("stays", F.lit(False))).alias("stays"), F.max("n").alias("n")), "minhash-stay")
    goes = written(stays.where("not stays").select(*on), "minhash-goes")
    again = written(stays.where("stays and n > 1").select(*on), "minhash-again")
    for done_with in (sig, rows, stays):
        drop_written(done_with)
    kept = by_size(docs.select("*", *name(F.col(doc_id).cast("long"), F.xxhash64(text))), goes, on, "left_anti")
    if again.limit(1).count():
        # Rows that repeat one id and text: one of each stays.
        turn = fresh(docs, "_keep_turn")
        one = by_size(kept, again, on, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy(*on).orderBy(on[2])))
        kept = by_size(kept, again, on, "left_anti").unionByName(one.where(F.col(turn) == 1).drop(turn))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
