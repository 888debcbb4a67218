"""Token-id files: Parquet with one list of ids per document, in ascending id order.

Layout: column ``tokens`` (array<int>) is dictionary-encoded with bit packing and falls back to
delta encoding once a row group's dictionary outgrows its page; ``doc_id``, ``part``, ``local_start``
and ``n_tokens`` are delta-encoded; row groups and pages have a fixed size and every column has
column and offset indexes, so that a reader of a few ids, or of metadata alone, reads only the
pages that it needs.  A document's start in the whole stream is its part's base (a small manifest
table, one row per part) plus its start within the part, so writing needs no global pass.

Defined results: a null text is encoded as the empty one; every document ends with ``end_id``;
documents without an id come first; documents with equal ids are ordered by a hash of their text and
each keeps its own row; a very long text is one row of one part, whatever its size; an empty table
gives an empty file set.  Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .bpe import byte_chars
from .common import shared_dir, ship
from .words import Hash, Table, distinct, flat, places, slices, tidy

#: Parquet writer settings of the format.
FORMAT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "compression": "zstd",
}
SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)
MANIFEST = "part int, n long, base long"

#: Normaliser and pre-tokenizer of word vocabularies that drop white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Words of printable ASCII and Latin-1 letters, and the same pattern over them in lower case.
_LATIN = re.compile("[\x21-\x7e\u00c0-\u00ff]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Words whose ids a worker keeps, ids of them, and pieces that it keeps beside them.
ENTRIES, ARENA, PIECES = 500_000, 2_500_000, 50_000

_LOADED: dict[str, object] = {}


class Encoder:
    """Ids of whole columns of texts.

    Where the file has the normaliser and the pattern above, no piece crosses white space, nor a place
    where a sign follows an ASCII letter, so a text's ids are those of its words between these places.
    They are kept by the words' 128-bit hashes, in arrays of bounded size.  A new word of plain Latin
    characters is cut into pieces here, as the file's pattern cuts it, and each new piece goes to the
    library's model; any other word, a text that may hold a special token, and every text of a file
    with another form goes to the whole tokenizer.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        j = json.loads(spec)
        parts = lambda x, kind: ((j.get(x) or {}).get(kind) or []) if (j.get(x) or {}).get("type") == "Sequence" else None
        self.known_form = parts("normalizer", "normalizers") == NORMALIZER and parts("pre_tokenizer", "pretokenizers") == SPLITTER
        self.known_form &= all(t["content"].startswith("<|") for t in j.get("added_tokens", ()))
        self.chars = byte_chars()
        self.pieces: dict[str, list[int]] = {}
        self.plain, self.exact = (Hash(3), Hash(5)), (Hash(7, False), Hash(9, False))
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        sign = np.zeros(256, bool)
        sign[33:127] = True
        sign[[39, *range(48, 58)]] = False
        self.letter, self.sign = letter, sign & ~letter
        self.clear(ENTRIES)

    def clear(self, entries: int) -> None:
        """Forget all words, and keep room for ``entries``."""
        self.table = Table(entries)
        self.start, self.size = np.zeros(self.table.limit + 1, np.int64), np.zeros(self.table.limit + 1, np.int32)
        self.ids, self.used = np.zeros(ARENA, np.uint32), 0

    def word(self, w: str) -> list[int]:
        if w.isascii() and w.isalpha():
            return [t.id for t in self.tok.model.tokenize(w.lower())]
        if not _LATIN.fullmatch(w):
            return self.tok.encode(w, add_special_tokens=False).ids
        out, have = [], self.pieces
        for p in _PIECE.findall(w.lower()):
            got = have.get(p)
            if got is None:
                if len(have) > PIECES:
                    have.clear()
                raw = p if p.isascii() else "".join([self.chars[b] for b in p.encode()])
                got = [t.id for t in self.tok.model.tokenize(raw)]
                if len(p) <= 64:
                    have[p] = got
            out += got
        return out

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Row numbers of new words, which are kept from here on."""
        whole = raw.tobytes()
        got = [self.word(whole[a:b].decode("utf-8", "replace")) for a, b in zip(starts.tolist(), ends.tolist())]
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat_ids = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        if self.used + len(flat_ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat_ids), len(self.ids) // 4), np.uint32)])
        rows = self.table.add(h1, h2)
        self.ids[self.used : self.used + len(flat_ids)] = flat_ids
        self.start[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
        self.used += len(flat_ids)
        return rows

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a string column, each text with ``end_id`` at its end."""
        raw, at = flat(column)
        if not self.known_form:
            return self._by_library(column, range(len(column)), end_id)
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        if len(special):
            return self._mixed(column, np.unique(np.searchsorted(at, special, side="right") - 1), end_id)
        cut = np.zeros(len(raw), bool)
        cut[1:] = self.letter[raw[:-1]] & self.sign[raw[1:]]
        cut[at[:-1][at[:-1] < len(raw)]] = False
        starts, ends, first = places(raw, at, cut)
        h1, h2 = (h.prefix(raw, starts, ends) for h in self.plain)
        high = np.concatenate([[0], np.cumsum(raw >= 128)])
        odd = np.flatnonzero(high[ends] > high[starts])
        # Before characters are composed, only words of ASCII alone may be folded.
        if len(odd):
            h1[odd], h2[odd] = (h.prefix(raw, starts[odd], ends[odd]) for h in self.exact)
        for turn in (0, 1):
            row = self.table.find(h1, h2)
            new = np.flatnonzero(row < 0)
            one, back = distinct(h1[new], h2[new])
            if self.table.room >= len(one) and (turn or self.used <= ARENA):
                break
            self.clear(max(ENTRIES, 2 * len(one) if turn or len(one) > ENTRIES else 0))
        if len(one):
            at_ = new[np.sort(one)]
            order = np.argsort(one)
            rows = np.empty(len(one), np.int64)
            rows[order] = self.learn(raw, starts[at_], ends[at_], h1[at_], h2[at_])
            row[new] = rows[back]
        n = np.diff(first)
        last = np.cumsum(n + 1)
        place = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
        size, begin = np.ones(int(last[-1]) if len(last) else 0, np.int64), np.full(int(last[-1]) if len(last) else 0, -1, np.int64)
        size[place], begin[place] = self.size[row], self.start[row]
        to = np.cumsum(size)
        index = np.repeat(begin - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
        ends_at = to[last - 1] - 1
        index[ends_at] = 0
        ids = self.ids[index]
        ids[ends_at] = end_id
        return ids, np.diff(ends_at, prepend=-1)

    def _by_library(self, column: pa.Array, which, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        got = [[*self.tok.encode(column[int(i)].as_py() or "", add_special_tokens=False).ids, end_id] for i in which]
        return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _mixed(self, column: pa.Array, slow: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the texts ``slow`` through the library."""
        mask = np.zeros(len(column), bool)
        mask[slow] = True
        ids, n = [], np.zeros(len(column), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], mask[1:] != mask[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            got, n[a:b] = self._by_library(column, range(a, b), end_id) if mask[a] else self.encode(column.slice(a, b - a), end_id)
            ids.append(got)
        return np.concatenate(ids), n


def loaded(spec: bytes) -> Encoder:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(spec)
    return _LOADED[key]


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 16 << 20
) -> str:
    """Encode ``docs`` into token-id files under ``path``; returns ``path``.

    ``vocabulary`` is a file of the tokenizers library.  Text is dealt out by ranges of the id, about
    ``part_bytes`` a part, and is encoded where it lands; one shuffle of the text in all.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // part_bytes))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches):
        encoder, part, at = loaded(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, n = encoder.encode(batch.column(1).slice(lo, hi - lo), end_id)
                ends = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(at + ends[:-1]), pa.array(n), tokens], SCHEMA.names
                )
                at += int(ends[-1])
        tidy()

    rows.mapInArrow(run, SCHEMA).write.options(**FORMAT).parquet(f"{path}/tokens")
    sums = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file: their running sum needs no key to deal by, and stays far below one task's memory.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", "n", before.cast("long").alias("base")).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens); a selection of columns or ids is pushed down to the pages."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    base = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "base")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that ``read_tokens`` gave."""
    ship(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            col = batch.column(3)
            flat, offs = np.asarray(col.values, np.int32), np.asarray(col.offsets)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_path(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
