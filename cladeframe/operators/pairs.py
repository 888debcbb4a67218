"""Pair operators: blocked pairs, best cross pairs, nearest neighbours, similarity joins of token sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import cut, drop, ship, unshuffled


def canopy_pairs(df: DataFrame, *, canopy: str = "canopy", key: str = "mid") -> DataFrame:
    """All pairs a < b inside a canopy: columns of the one with prefix ``a_``, of the other ``b_``.
    The reference computes exactly these; for large canopies use ``token_set_join`` or ``knn``."""
    a = df.select(*[F.col(c).alias("a_" + c) for c in df.columns])
    b = df.select(*[F.col(c).alias("b_" + c) for c in df.columns])
    return a.join(b, (F.col("a_" + canopy) == F.col("b_" + canopy)) & (F.col("a_" + key) < F.col("b_" + key)))


def unordered(a: str, b: str) -> tuple[Column, Column]:
    """A pair's key, the lesser end first: for memo tables of pair scores."""
    return F.least(a, b), F.greatest(a, b)


def best_cross_pair(scores: DataFrame, members: DataFrame, *, budget: int | None = None) -> DataFrame:
    """(g1, g2, a, b, score): the best pair of ``scores`` (a, b, score) between each two groups of
    ``members`` (mid, group).  With a budget, only the pairs of least hash are looked at."""
    left = members.select(F.col("mid").alias("a"), F.col("group").alias("ga"))
    right = members.select(F.col("mid").alias("b"), F.col("group").alias("gb"))
    both = scores.join(left, "a").join(right, "b").where("ga <> gb")
    both = both.select(F.least("ga", "gb").alias("g1"), F.greatest("ga", "gb").alias("g2"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    if budget is not None:
        w = Window.partitionBy("g1", "g2").orderBy(F.xxhash64("a", "b"), "a", "b")
        both = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= budget).drop("rn")
    best = F.min(F.struct((-F.col("score")).alias("s"), "a", "b")).alias("m")
    return both.groupBy("g1", "g2").agg(best).select("g1", "g2", "m.a", "m.b", (-F.col("m.s")).alias("score"))


#: Points of a side that one task of a block grid holds, about, and the products it forms at a time.
BLOCK, CELLS = 20_000, 4_000_000


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return x.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _blocks(n: int, block: int, tasks: int, cells: int) -> int:
    """Blocks of a side, so that each is small and there is work for ``tasks`` tasks, if there is any."""
    return max(1, -(-n // block), min(tasks, -(-n // cells)))


def cross_grid(left: DataFrame, right: DataFrame, work, schema: str, *, key: str = "pid", block: int = BLOCK) -> DataFrame:
    """The rows that ``work(left block, right block)``, over Arrow tables, gives for each two blocks.

    Both sides are dealt out by a hash of the key; a row of one side goes to one task for each block
    of the other, so no side passes the driver and no task holds more than a block of either.
    """
    spark = left.sparkSession
    ship(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    m, n = _blocks(left.count(), block, tasks, 64), _blocks(right.count(), block, 1, 1 << 62)
    at = lambda of: F.pmod(F.xxhash64(key, F.lit(23)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = left.withColumn("_i", at(m)).withColumn("_j", every(n)).groupBy("_i", "_j")
    # Named anew: both sides may stem from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    b = right.withColumn("_j", at(n)).withColumn("_i", every(m)).groupBy("_i", "_j")
    return a.cogroup(b).applyInArrow(work, schema)


def self_grid(points: DataFrame, work, schema: str, *, key: str = "pid", block: int = BLOCK) -> DataFrame:
    """The rows that ``work(block, other block or None)`` gives for each block and each two blocks of
    one side; each pair of rows meets in one task."""
    spark = points.sparkSession
    ship(spark)
    tasks = math.isqrt(4 * spark.sparkContext.defaultParallelism)
    n = _blocks(points.count(), block, tasks, 64)
    mine = F.pmod(F.xxhash64(key, F.lit(23)), F.lit(n)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(F.col("_m"), j).alias("i"), F.greatest(F.col("_m"), j).alias("j")))
    dealt = points.withColumn("_m", mine).withColumn("_p", F.explode(pairs)).select(*points.columns, "_m", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))

    def run(key_, table):
        i, j = (k.as_py() for k in key_)
        first = pc.equal(table["_m"], i)
        return work(table.filter(first), table.filter(pc.invert(first)) if i != j else None)

    return dealt.groupBy("_i", "_j").applyInArrow(run, schema)


def knn(queries: DataFrame, points: DataFrame, k: int, *, key: str = "pid", vec: str = "vec", other_than: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, nbr, distance, rank): the exact ``k`` nearest points of each query, itself excluded, ties
    to the lower key; with ``other_than`` a neighbour must differ in that column (nulls differ from
    nothing).  Rows without a key or a vector are left out, on both sides.

    Blocks of queries meet blocks of points in tasks, whose best ``k`` are then compared; every point as
    near as the k-th of a block, but for rounding, is measured exactly and ordered by distance and key.
    """
    cols = [key, vec] + ([other_than] if other_than else [])
    kind = dict(queries.dtypes)[key]

    def work(asked, given):
        ids, mine = (np.array(t[key].to_pylist()) for t in (given, asked))
        order = np.argsort(ids, kind="stable") if len(ids) else np.empty(0, np.int64)
        ids, out = ids[order], []
        if len(ids) and len(mine):
            x, q_all = _matrix(given[vec])[order], _matrix(asked[vec])
            tags = [t[other_than].to_pylist() for t in (asked, given)] if other_than else None
            theirs = np.array(tags[1], object)[order] if tags else None
            sq = (x * x).sum(1)
            step = max(1, CELLS // max(1, len(ids)))
            for at in range(0, len(mine), step):
                q, me = q_all[at : at + step], mine[at : at + step]
                qq = (q * q).sum(1)
                d = qq[:, None] + sq[None] - 2 * q @ x.T
                d[me[:, None] == ids[None]] = np.inf
                if tags:
                    own = np.array(tags[0][at : at + step], object)
                    d[(own[:, None] == theirs[None]) | np.equal(own, None)[:, None] | np.equal(theirs, None)[None]] = np.inf
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                kth = np.where(np.isinf(kth), np.where(np.isinf(d), -np.inf, d).max(1), kth)
                i, j = np.nonzero(d <= (kth + 1e-9 * (qq + sq.max() + 1))[:, None])
                far = np.empty(len(i))
                for lo in range(0, len(i), 50_000):
                    a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
                    far[lo : lo + 50_000] = np.sqrt(((q[a] - x[b]) ** 2).sum(1))
                by = np.lexsort((j, far, i))
                i, j, far = i[by], j[by], far[by]
                turn = np.arange(len(i)) - np.searchsorted(i, i)
                keep = turn < k
                out.append((me[i[keep]], ids[j[keep]], far[keep]))
        got = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], mine.dtype if len(mine) else np.int64)] * 2 + [np.empty(0)]
        types = [asked.schema.field(key).type] * 2 + [pa.float64()]
        return pa.table([pa.array(c.tolist() if t != pa.float64() else c, t) for c, t in zip(got, types)], names=[key, "nbr", "distance"])

    sides = [df.select(*cols).where(F.col(key).isNotNull() & F.col(vec).isNotNull()) for df in (queries, points)]
    found = cross_grid(*sides, work, f"{key} {kind}, nbr {kind}, distance double", key=key, block=block)
    w = Window.partitionBy(key).orderBy("distance", "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def approximate_knn(points: DataFrame, k: int, *, key: str = "pid", vec: str = "vec", bucket: float | None = None, tables: int = 8, radius: float | None = None, seed: int = 11) -> DataFrame:
    """(key, nbr, distance, rank) by random projections: candidates share a bucket of some table.

    Without ``bucket`` and ``radius`` they follow from the points: a bucket is about the spread of one
    coordinate, and no neighbour is too far.  Points that find fewer than ``k`` are searched exactly.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    points = points.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    if bucket is None:
        flat = points.select(F.posexplode(vec).alias("at", "x")).groupBy("at").agg(F.stddev_pop("x").alias("s"))
        bucket = 2 * float(flat.agg(F.sqrt(F.avg(F.col("s") * F.col("s")))).first()[0] or 0) or 1.0
    rows = points.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, radius if radius is not None else float("inf"), "distance").select(F.col(f"datasetA.{key}").alias(key), F.col(f"datasetB.{key}").alias("nbr"), "distance").where(F.col(key) != F.col("nbr"))
    w = Window.partitionBy(key).orderBy("distance", "nbr")
    near = cut(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    full = near.where(F.col("rank") == k).select(key)
    return near.join(full, key, "left_semi").unionByName(knn(points.join(full, key, "left_anti"), points, k, key=key, vec=vec))


def off_limits(candidates: DataFrame, barred: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that no row of ``barred`` forbids."""
    return candidates.join(barred, on, "left_anti")


def preset_neighbours(points: DataFrame, neighbours: DataFrame, key: str = "pid") -> DataFrame:
    """Points with the neighbour that a table names (null where none)."""
    return points.join(neighbours.select(key, "nn"), key, "left")


def keep_best(a: DataFrame, b: DataFrame, k: int, key: str = "pid") -> DataFrame:
    """The best ``k`` (least distance, then neighbour) of two neighbour tables."""
    both = a.select(key, "nbr", "distance").union(b.select(key, "nbr", "distance")).distinct()
    w = Window.partitionBy(key).orderBy("distance", "nbr")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Buckets of the table of token frequencies; sets that a block of verification holds, about; bytes of a sketch;
#: sketches that a block of their comparison holds, about.
BUCKETS, SETS, SKETCH, SKETCHES = 1 << 24, 8_000, 128, 100_000


def _token_sets(df: DataFrame, canopy: str, key: str, tokens: str) -> DataFrame:
    """(k, n, d1, d2, s): sets that have a canopy and tokens, as sorted arrays of 64-bit hashes of token and
    canopy; n, d1 and d2 name the set."""
    rows = df.where((F.size(tokens) > 0) & F.col(canopy).isNotNull())
    s = F.sort_array(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w, F.col(canopy)))))
    return rows.select(F.col(key).alias("k"), s.alias("s")).select("k", F.size("s").alias("n"), F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(1), "s").alias("d2"), "s")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How frequent each bucket of tokens is, as 8 * log2 of the number of its tokens in all sets; the table
    has one byte a bucket and comes to the driver in chunks."""
    chunk = 1 << 12
    at = F.pmod(F.col("w"), F.lit(BUCKETS)).cast("int")
    counts = sets.select(F.explode("s").alias("w")).select(at.alias("at")).groupBy("at").agg(F.count("*").alias("c")).where("c > 1")

    def run(key, t):
        row = np.zeros(chunk, np.uint8)
        row[t["at"].to_numpy() % chunk] = np.minimum(255, 8 * np.log2(t["c"].to_numpy())).astype(np.uint8)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([row.tobytes()], pa.binary())})

    table = np.zeros(BUCKETS, np.uint8)
    with unshuffled(sets.sparkSession):
        rows = counts.withColumn("i", (F.col("at") / chunk).cast("int")).groupBy("i").applyInArrow(run, "i int, v binary").collect()
    for r in rows:
        table[r.i * chunk : (r.i + 1) * chunk] = np.frombuffer(r.v, np.uint8)
    return table


def _prefixes(sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(k, n, top, p, sketch): the ``top`` rarest tokens of each set but for those of no other set, which come
    first; and the parities of the counts of its tokens by 8 * SKETCH classes of hashes."""
    table = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def work(batches):
        level = table.value
        for b in batches:
            s, n = b["s"], b["n"].to_numpy().astype(np.int64)
            flat, end = s.flatten().to_numpy(), np.cumsum(n)
            row = np.repeat(np.arange(len(n)), n)
            of = level[flat % BUCKETS]
            order = np.argsort(row * 256 + of, kind="stable")
            top = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            keep = (np.arange(len(flat)) - np.repeat(end - n, n) < np.repeat(top, n)) & (of[order] > 0)
            bits = np.bincount(row * (8 * SKETCH) + (flat >> 24) % (8 * SKETCH), minlength=len(n) * 8 * SKETCH).astype(np.uint8) & 1
            sketch = np.packbits(bits.reshape(len(n), 8 * SKETCH), axis=1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[order][keep]))
            yield pa.RecordBatch.from_arrays([b["k"], b["n"], pa.array(top.astype(np.int32)), p, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["k", "n", "top", "p", "sketch"])

    return sets.select("k", "n", "s").mapInArrow(work, f"k {kind}, n int, top int, p array<long>, sketch binary")


def _by_hash(cand: DataFrame, blocks: int) -> DataFrame:
    """(a, b, i, j): pairs with the blocks of their ends, which are hashes of the keys."""
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(29)), F.lit(blocks)).cast("int")
    return cand.select("a", "b", block("a").alias("i"), block("b").alias("j"))


def _by_group(cand: DataFrame, blocks: int, most: int) -> DataFrame:
    """(a, b, i, j): pairs with blocks that keep the groups of a least neighbour together, so that most
    ends need one block only; a group of more than ``most`` keys is dealt out to as many blocks as it needs."""
    both = cand.select(F.col("a").alias("k"), F.col("b").alias("o")).union(cand.select(F.col("b").alias("k"), F.col("a").alias("o")))
    least = both.groupBy("k").agg(F.min("o").alias("o")).select("k", F.least("k", "o").alias("g"))
    large = least.groupBy("g").agg(F.count("*").alias("c"))
    named = F.xxhash64("g", F.pmod(F.xxhash64("k", F.lit(29)), F.ceil(F.col("c") / most)))
    at = cut(least.join(large, "g").select("k", F.pmod(named, F.lit(blocks)).cast("int").alias("i")))
    return cand.join(at.withColumnRenamed("k", "a"), "a").join(at.select(F.col("k").alias("b"), F.col("i").alias("j")), "b").select("a", "b", "i", "j")


#: Places that are broadcast to the values, at most: about 50 bytes a row and 8 a place, a few times over, pass
#: the driver.
PLACES = 300_000


def _in_blocks(dealt: DataFrame, values: DataFrame, work, schema: str) -> DataFrame:
    """The rows that ``work(pairs (a, b), values (k, ...))`` gives for the pairs (a, b, i, j) of each two
    blocks.  A row of ``values`` goes once to each two blocks where it has a pair, however many."""
    both = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("j").cast("long"))
    ends = dealt.select(F.explode(F.array("a", "b")).alias("k"), both.alias("at"))
    need = cut(ends.groupBy("k").agg(F.collect_set("at").alias("at")))
    places = need.agg(F.sum(F.size("at"))).first()[0] or 0
    # Beyond that both sides are shuffled; without the hint Spark goes by the size of the compressed files.
    need = F.broadcast(need) if places <= PLACES else need.hint("merge")
    at = [F.shiftright("at", 32).cast("int").alias("i"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("j")]
    given = values.join(need, "k").withColumn("at", F.explode("at")).select(*values.columns, *at)
    return dealt.groupBy("i", "j").cogroup(given.groupBy("i", "j")).applyInArrow(work, schema)


def _between_blocks(cand: DataFrame, values: DataFrame, work, schema: str, blocks: int) -> DataFrame:
    """``_in_blocks`` for small values, most of which have pairs: each goes to every two blocks of which one is
    its own, so that nothing is known of a key but its hash, and nothing of the keys passes the driver."""
    mine, low, high = F.pmod(F.xxhash64("k", F.lit(29)), F.lit(blocks)).cast("int"), F.least("i", "j"), F.greatest("i", "j")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ends = [low.alias("i"), high.alias("j")]
    given = values.withColumn("i", mine).withColumn("j", every).select(*values.columns, *ends)
    return _by_hash(cand, blocks).select("a", "b", *ends).groupBy("i", "j").cogroup(given.groupBy("i", "j")).applyInArrow(work, schema)


def _places(pairs: pa.Table, values: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``values`` that the two ends of the pairs are."""
    return tuple(pc.index_in(pairs[c], value_set=values["k"]).to_numpy().astype(np.int64) for c in ("a", "b"))


def _alike(threshold: float):
    """The pairs whose sketches differ in no more classes than sets of that likeness can."""

    def work(pairs, values):
        a, b = _places(pairs, values)
        bits = np.frombuffer(b"".join(values["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
        n = values["n"].to_numpy().astype(np.int64)
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            # Of n tokens in all, sets of that likeness differ in (1 - t) / (1 + t) at most, and classes in no more.
            most = (1 - threshold) / (1 + threshold) * (n[x] + n[y]) + 1e-6
            keep[at : at + 50_000] = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most
        return pairs.select(["a", "b"]).filter(pa.array(keep))

    return work


def _verified(threshold: float):
    """The pairs that reach the threshold, measured on the full sets."""

    def work(pairs, values):
        a, b = _places(pairs, values)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        sets = values["s"].combine_chunks()
        flat, start = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values["n"].to_numpy().astype(np.int64))])
        names, ids = np.unique(flat, return_inverse=True)
        n, has, common = np.diff(start), np.zeros(len(names), bool), np.zeros(len(a), np.int64)
        for lo, hi in zip(first := np.flatnonzero(np.diff(a, prepend=-1)), [*first[1:], len(a)]):
            mine = ids[start[a[lo]] : start[a[lo] + 1]]
            has[mine] = True
            for at in range(lo, hi, 1000):
                y = b[at : min(hi, at + 1000)]
                to = np.cumsum(n[y])
                at_ids = np.arange(to[-1]) + np.repeat(start[y] - to + n[y], n[y])
                common[at : at + len(y)] = np.add.reduceat(has[ids[at_ids]], to - n[y], dtype=np.int64)
            has[mine] = False
        keep = common >= threshold * (n[a] + n[b] - common) - 1e-9
        cols = [pairs[c].combine_chunks().take(pa.array(order[keep])) for c in ("a", "b")]
        return pa.table([*cols, *(pa.array(v[keep].astype(np.int32)) for v in (common, n[a], n[b]))], names=["a", "b", "common", "na", "nb"])

    return work


def token_set_join(df: DataFrame, threshold: float, *, canopy: str = "canopy", key: str = "mid", tokens: str = "tokens", sets: DataFrame | None = None) -> DataFrame:
    """(a, b, common, na, nb): pairs of a canopy whose token sets have Jaccard >= threshold, exactly (but
    that tokens are told apart by 64-bit hashes, and equal sets by two of them).

    Equal sets form one class and only its least key is joined (see ``copies``); classes meet on
    the rarest tokens of their sets (prefix filter), so a frequent token never joins anything that
    a rarer one does not, and only where the tokens after the common one are enough (positional
    filter).  Any order of tokens gives the same pairs: frequencies are counted by buckets of hashes, and
    tokens whose bucket has one token of one set are not joined.  Candidates whose sketches differ too much
    are dropped; the others are verified on the full sets, which go to blocks of pairs and not to each pair.
    Of keys and places the driver holds no more than ``PLACES``.
    ``sets`` are those of ``df``, where they are written out already (``written_sets``).
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    sets = written_sets(df, canopy=canopy, key=key, tokens=tokens) if sets is None else sets
    reps = sets.groupBy("n", "d1", "d2").agg(F.min("k").alias("k")).select("k")
    first = cut(_prefixes(sets, threshold, kind).join(reps, "k", "left_semi"))
    flat = first.select("k", "n", (F.col("top") - F.size("p") + 1).alias("from"), F.posexplode("p").alias("o", "w")).select("k", "n", "w", (F.col("from") + F.col("o")).alias("at"))
    a = flat.select("w", F.col("k").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = flat.select("w", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    sized = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    # The first token that two sets share leaves room for the overlap that the threshold asks for.
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1 >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    cand = a.join(b, "w").where((F.col("a") < F.col("b")) & sized & enough).select("a", "b").distinct()
    n, cores = first.count(), df.sparkSession.sparkContext.defaultParallelism
    cand = cut(cand)
    near = cut(_between_blocks(cand, first.select("k", "n", "sketch"), _alike(threshold), f"a {kind}, b {kind}", _blocks(n, SKETCHES, math.isqrt(4 * cores) + 1, SETS)))
    drop(first, cand)
    blocks = max(1, -(-n // SETS), 2 * cores)
    dealt = cut(_by_group(near, blocks, SETS // 8))
    return _in_blocks(dealt, sets.select("k", "n", "s"), _verified(threshold), f"a {kind}, b {kind}, common int, na int, nb int")


def written_sets(df: DataFrame, *, canopy: str = "canopy", key: str = "mid", tokens: str = "tokens") -> DataFrame:
    """The token sets of ``df``, written out: ``token_set_join`` and ``set_classes`` read them several times."""
    return cut(_token_sets(df, canopy, key, tokens))


def set_classes(sets: DataFrame) -> DataFrame:
    """(k, rep): the least key with the same set, of the rows of ``written_sets``."""
    named = sets.select("k", "n", "d1", "d2")
    reps = named.groupBy("n", "d1", "d2").agg(F.min("k").alias("rep"))
    return named.join(reps, ["n", "d1", "d2"]).select("k", "rep")


def copies(df: DataFrame, *, canopy: str = "canopy", key: str = "mid", tokens: str = "tokens") -> DataFrame:
    """(key, rep): the least key with the same canopy and token set; rows without tokens or canopy are alone."""
    found = set_classes(_token_sets(df, canopy, key, tokens)).withColumnRenamed("k", key)
    alone = df.where((F.coalesce(F.size(tokens), F.lit(0)) <= 0) | F.col(canopy).isNull()).select(key, F.col(key).alias("rep"))
    return found.union(alone)


def set_features(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the overlap flag, set cosine and Jaccard of two array columns."""
    return pairs.select("*", S.overlap(a, b).alias("overlap"), S.set_cosine(a, b).alias("set_cosine"), S.jaccard(a, b).alias("jaccard"))


def near_pairs(points: DataFrame, cosine: float, *, key: str = "pid", vec: str = "vec", label: str | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, score, same): pairs a < b whose cosine is at least ``cosine``; rows without a vector are
    left out, and a null label is the same as none."""
    kind = dict(points.dtypes)[key]

    def side(t):
        x = _matrix(t[vec])
        n = np.linalg.norm(x, axis=1)
        return np.array(t[key].to_pylist()), x / np.where(n > 0, n, 1)[:, None], np.array(t[label].to_pylist(), object) if label else None

    def work(one, other):
        ids, x, tags = side(one)
        theirs, y, others = side(other) if other is not None else (ids, x, tags)
        out = []
        step = max(1, CELLS // max(1, len(theirs)))
        for at in range(0, len(ids) if len(theirs) else 0, step):
            s = x[at : at + step] @ y.T
            near = s >= cosine
            if other is None:
                near &= ids[at : at + step, None] < theirs[None]
            i, j = np.nonzero(near)
            a, b, flip = ids[at + i], theirs[j], ids[at + i] > theirs[j]
            same = np.array([u is not None and u == v for u, v in zip(tags[at + i], others[j])], bool) if label else np.zeros(len(i), bool)
            out.append((np.where(flip, b, a), np.where(flip, a, b), s[i, j], same))
        got = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
        kinds = [one.schema.field(key).type] * 2 + [pa.float64(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(got, kinds)], names=["a", "b", "score", "same"])

    rows = points.select(*[c for c in (key, vec, label) if c]).where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    return self_grid(rows, work, f"a {kind}, b {kind}, score double, same boolean", key=key, block=block)


def group_linkages(points: DataFrame, *, key: str = "pid", vec: str = "vec", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(g1, g2, average, complete, single, log_sum_exp, cosine_average, cosine_complete, best_a, best_b)
    of each two label groups g1 < g2, from partial sums of distance blocks; distances are negated.
    Rows without a label or a vector are left out."""
    kinds = dict(points.dtypes)
    k, l = kinds[key], kinds[label]
    names = ["g1", "g2", "n", "s", "lo", "hi", "e", "c", "cl", "a", "b"]

    def side(t):
        order = pc.sort_indices(t, sort_keys=[(label, "ascending"), (key, "ascending")])
        t = t.take(order)
        x, tags = _matrix(t[vec]), np.array(t[label].to_pylist())
        first = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]])) if len(tags) else np.empty(0, np.int64)
        parts = list(zip(tags[first].tolist(), first.tolist(), [*first[1:].tolist(), len(tags)]))
        return np.array(t[key].to_pylist()), x, parts

    def work(one, other):
        ids, x, mine = side(one)
        theirs, y, others = side(other) if other is not None else (ids, x, mine)
        out = []
        for g1, a, b in mine:
            for g2, c, d in others:
                if g1 == g2 or (other is None and g1 > g2):
                    continue
                parts = []
                for at in range(a, b, step := max(1, CELLS // (d - c))):
                    p, q = x[at : min(b, at + step)], y[c:d]
                    dots = p @ q.T
                    far = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * dots, 0))
                    den = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
                    cos = np.divide(dots, den, out=np.zeros_like(dots), where=den > 0)
                    lo = far.min()
                    i, j = np.nonzero(far == lo)
                    ends = [(ids[at + u], theirs[c + v]) for u, v in zip(i, j)]
                    best = min(ends if g1 < g2 else [(v, u) for u, v in ends])
                    parts.append((far.size, far.sum(), lo, far.max(), np.exp(-far).sum(), cos.sum(), cos.min(), *best))
                for p in parts:
                    out.append((min(g1, g2), max(g1, g2), *(v.item() if hasattr(v, "item") else v for v in p)))
        field = lambda n: one.schema.field(n).type
        types = [field(label)] * 2 + [pa.int64()] + [pa.float64()] * 6 + [field(key)] * 2
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    schema = f"g1 {l}, g2 {l}, n long, s double, lo double, hi double, e double, c double, cl double, a {k}, b {k}"
    rows = points.select(key, vec, label).where(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.col(label).isNotNull())
    got = self_grid(rows, work, schema, key=key, block=block)
    n, best = F.sum("n"), F.min(F.struct("lo", "a", "b"))
    return got.groupBy("g1", "g2").agg(
        (-F.sum("s") / n).alias("average"), (-F.max("hi")).alias("complete"), (-F.min("lo")).alias("single"), F.log(F.sum("e")).alias("log_sum_exp"),
        (F.sum("c") / n - 1).alias("cosine_average"), (F.min("cl") - 1).alias("cosine_complete"), best["a"].alias("best_a"), best["b"].alias("best_b"))
