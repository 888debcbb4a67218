"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Text is lower-cased (A-Z only) and cut into words of ASCII letters, digits and any non-ASCII
characters.  A benchmark item yields every window of ``window`` consecutive words; a shorter item
that has words is one window.  Patterns are grouped by length, as the shift of a Wu-Manber table
is bounded by its shortest pattern.  In each group a table maps every block of two words to the
distance by which the search window may safely move; blocks that end a pattern (shift 0) lead to a
bucket of patterns, which are confirmed by direct comparison of all words.

The benchmark is cut into blocks of bounded size by a hash of the item; each block's windows are a
broadcast of their own.  One block's search tables are made once a task; with more blocks a task
holds one block at a time, for some megabytes of text each.

Defined results: null and empty texts have no words and no hits; a null item text has no windows;
items with equal windows are each reported; repeated documents are each scored; occurrences that
overlap are all found, and a word in several counts once; very long texts are searched whole; document
columns other than the id and the text are ignored; an empty benchmark or document table gives no hits
or no rows.  A null item id is left out of the item list but its windows still hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, ship
from .words import slices, tidy

#: Words are what remains after these bytes (ASCII that is no letter or digit) become spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def words(text: bytes | str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    if text is None:
        return []
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(_FOLD).split()


class WuManber:
    """Search tables for patterns given as ``{word tuple: item ids}``."""

    def __init__(self, patterns: dict[tuple, set]):
        by_len: dict[int, dict] = defaultdict(dict)
        for p, items in patterns.items():
            by_len[len(p)][p] = frozenset(items)
        self.groups = []
        for m, group in sorted(by_len.items()):
            if m == 1:
                self.groups.append((1, None, {p[0]: ((p, items),) for p, items in group.items()}))
                continue
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, list] = defaultdict(list)
            for p, items in group.items():
                for end in range(1, m):
                    block, move = (p[end - 1], p[end]), m - 1 - end
                    if move < shift.get(block, m):
                        shift[block] = move
                bucket[p[-2:]].append((p, items))
            self.groups.append((m, shift, dict(bucket)))

    def search(self, w: list[bytes]):
        """Yields (start, end, item ids) for each occurrence of each pattern."""
        n = len(w)
        for m, shift, bucket in self.groups:
            if m == 1:
                for i in [i for i, x in enumerate(w) if x in bucket]:
                    for _, items in bucket[w[i]]:
                        yield i, i + 1, items
                continue
            i, far, get = m - 1, m - 1, shift.get
            while i < n:
                block = (w[i - 1], w[i])
                move = get(block, far)
                if move:
                    i += move
                    continue
                start = i - m + 1
                for p, items in bucket[block]:
                    if tuple(w[start : i + 1]) == p:
                        yield start, i + 1, items
                i += 1


def windows(w: list[bytes], size: int) -> set[tuple]:
    """The windows of an item: all runs of ``size`` words, or the whole of a shorter one."""
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def searchers(benchmark: DataFrame, item_id: str, text: str, window: int, max_bytes: int) -> list:
    """Broadcast windows, each of at most about ``max_bytes`` of item text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // max_bytes))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        patterns: dict[tuple, set] = defaultdict(set)
        for i, t in part.toLocalIterator():
            for p in windows(words(t), window):
                patterns[p].update(() if i is None else (i,))
        found.append(spark.sparkContext.broadcast(dict(patterns)))
    return found


class Finder:
    """Occurrences of the windows of all blocks, which are opened one at a time."""

    def __init__(self, blocks: list):
        self.blocks, self.only = blocks, WuManber(opened(blocks[0])) if len(blocks) == 1 else None

    def tables(self):
        if self.only is not None:
            yield self.only
            return
        for b in self.blocks:
            yield WuManber(opened(b))

    def parts(self, column: pa.Array):
        """(first, last) rows of parts of a text column; more blocks are opened once for more text."""
        return slices(column, (2 << 20) * min(16, max(1, len(self.blocks))))

    def hits(self, texts: list) -> list[tuple[bytearray, set]]:
        """For each text its words, marked if they are hit, and the items found."""
        cut = [words(t) for t in texts]
        out = [(bytearray(len(w)), set()) for w in cut]
        for f in self.tables():
            for w, (hit, found) in zip(cut, out):
                for start, end, items in f.search(w):
                    hit[start:end] = b"\x01" * (end - start)
                    found |= items
        return out


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document: words, words inside benchmark windows, and the items found (sorted)."""
    ship(docs.sparkSession)
    blocks = searchers(benchmark, item_id, item_text, window, max_bytes)

    def scan(batches):
        finder = Finder(blocks)
        for batch in batches:
            for lo, hi in finder.parts(batch.column(1)):
                ids, texts = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns)
                out: list[list] = [[], [], [], [], [], [], []]
                for i, (hit, found) in zip(ids, finder.hits(texts)):
                    names = sorted(found)
                    n_hit = hit.count(1)
                    sha = hashlib.sha256(",".join(names).encode()).hexdigest()
                    for col, v in zip(out, (i, len(hit), n_hit, len(names), sha, n_hit > 0, names)):
                        col.append(v)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
                )
        tidy()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(scan, OUT)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 10, max_bytes: int = 8 << 20
) -> DataFrame:
    """The documents, all columns kept, that hold no benchmark window; only the text goes to Python."""
    ship(docs.sparkSession)
    blocks = searchers(benchmark, "item_id", "text", window, max_bytes)

    @F.arrow_udf("boolean")
    def clean(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(blocks)
        for texts in column:
            got = [not hit.count(1) for lo, hi in finder.parts(texts) for hit, _ in finder.hits(texts.slice(lo, hi - lo).to_pylist())]
            yield pa.array(got, pa.bool_())
        tidy()

    return docs.where(clean(F.col(text).cast("binary")))
