"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pieces by the vocabulary's pattern; the merges of a piece are found with a
segment tree whose leaves hold ``rank * width + position`` of each adjacent pair, so that the root
is the leftmost pair of lowest rank.  A merge rewrites at most three leaves, each in logarithmic
time, until the root says that no pair can merge.  Short pieces go through the same tree many at a
time (one NumPy row per piece); long ones alone.

Defined results: null and empty texts have no ids and decode to the empty string; the strings of
added tokens in a text become their ids, as the vocabulary file says; bytes that no id can stand
for do not occur, as every byte has an id; of equal ranks the leftmost pair merges first; a very long
text or piece is encoded whole; equal documents are encoded alike, each in its own row; empty tables
give no rows; a null list of ids decodes to the empty string; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENTRY, MEMO_BYTES, ship
from .words import slices, tidy

NONE = np.int64(1 << 62)
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Fixed value: the piece pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairTable:
    """Vectorised lookup of (left id, right id) -> (rank, merged id): open addressing over int64 keys."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 3
        keys = (left << 32) | right
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE), np.full(size, -1, np.int64)
        self.probes = 1
        todo, step = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(todo):
            at = (slot[todo] + step) & (size - 1)
            free = self.keys[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = keys[todo[put]]
            self.rank[at[put]] = todo[put]
            self.merged[at[put]] = merged[todo[put]]
            todo, step = todo[~put], step + 1
            self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id), rank NONE where the pair cannot merge; ids below 0 never do."""
        shape = left.shape
        keys = np.where((left < 0) | (right < 0), np.int64(-2), (left << 32) | right).ravel()
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        at = slot & mask
        hit = self.keys[at] == keys
        rank, merged = np.where(hit, self.rank[at], NONE), self.merged[at]
        open_ = np.flatnonzero(~hit & (self.keys[at] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & mask
            ok = self.keys[at] == keys[open_]
            rank[open_[ok]], merged[open_[ok]] = self.rank[at[ok]], self.merged[at[ok]]
            open_ = open_[~ok & (self.keys[at] != -1)]
        return rank.reshape(shape), merged.reshape(shape)


class Vocabulary:
    """A byte-level BPE vocabulary file (the JSON form of the tokenizers library)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab, chars = j["model"]["vocab"], byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        pairs, seen = [], set()
        for m in j["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if (a, b) not in seen:
                seen.add((a, b))
                pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.pairs = PairTable(pairs)
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        added = j.get("added_tokens", ())
        self.added = {a["content"]: a["id"] for a in added}
        self.bytes_of |= {a["id"]: a["content"].encode() for a in added}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PIECES)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[tuple]:
        """Ids of pieces of at most ``width`` bytes, one segment tree per row."""
        n, rows = len(pieces), np.arange(len(pieces))
        ids = np.full((n, width + 1), -1, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids[np.repeat(rows, sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = self.byte_id[flat]
        col = np.arange(width)
        nxt = np.broadcast_to(col + 1, (n, width)).copy()  # where the next symbol starts; width: none
        prv = np.broadcast_to(col - 1, (n, width)).copy()
        nxt[col + 1 >= sizes[:, None]] = width
        tree, merged = np.full((n, 2 * width), NONE), np.full((n, width), -1, np.int64)
        rank, merged[:] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank == NONE, NONE, rank * width + col)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(r, pos, value):
            node = width + pos
            tree[r, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = rows[tree[:, 1] != NONE]
        while len(live):
            i = tree[live, 1] % width
            j = nxt[live, i]
            k = nxt[live, j]
            ids[live, i], ids[live, j] = merged[live, i], -1
            nxt[live, i] = k
            inner = k < width
            prv[live[inner], k[inner]] = i[inner]
            put(live, j, NONE)
            right = np.where(inner, ids[live, np.minimum(k, width)], -1)
            r, m = self.pairs.find(ids[live, i], right)
            merged[live, i] = m
            put(live, i, np.where(r == NONE, NONE, r * width + i))
            p = prv[live, i]
            has = p >= 0
            if has.any():
                lv, pv = live[has], p[has]
                r, m = self.pairs.find(ids[lv, pv], ids[lv, i[has]])
                merged[lv, pv] = m
                put(lv, pv, np.where(r == NONE, NONE, r * width + pv))
            live = live[tree[live, 1] != NONE]
        keep = ids[:, :width] >= 0
        cut = np.cumsum(keep.sum(1))[:-1]
        return [x.astype(np.uint32).tobytes() for x in np.split(ids[:, :width][keep], cut)]

    def merge_piece(self, piece: bytes) -> bytes:
        """Ids (little-endian uint32) of one piece of any length."""
        width = 1 << max(1, (len(piece) - 1).bit_length())
        return self.merge_rows([piece], width)[0] if width <= 64 else self._merge_long(piece, width)

    def _merge_long(self, piece: bytes, width: int) -> bytes:
        n = len(piece)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank, merged = self.pairs.find(ids[:-1], ids[1:])
        top, none = np.full(2 * width, NONE), int(NONE)
        top[width : width + n - 1] = np.where(rank == NONE, NONE, rank * width + np.arange(n - 1))
        level = width
        while level > 1:
            half = level // 2
            top[half:level] = np.minimum(top[level : 2 * level : 2], top[level + 1 : 2 * level : 2])
            level = half
        tree, ids, merged = top.tolist(), ids.tolist(), [*merged.tolist(), -1]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        table, seen = self.pairs, {}

        def look(a, b):
            if (got := seen.get((a, b))) is None:
                r, m = table.find(np.array([a], np.int64), np.array([b], np.int64))
                got = seen[a, b] = int(r[0]), int(m[0])
            return got

        def put(pos, value):
            node = width + pos
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        def pair(a, b):
            r, m = look(ids[a], ids[b])
            merged[a] = m
            put(a, none if r == none else r * width + a)

        while tree[1] != none:
            i = tree[1] % width
            j = nxt[i]
            k = nxt[j]
            ids[i], ids[j], nxt[i] = merged[i], -1, k
            put(j, none)
            if k < n:
                prv[k] = i
                pair(i, k)
            else:
                put(i, none)
            if prv[i] >= 0:
                pair(prv[i], i)
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def learn(self, memo: dict, pieces: set[str]) -> None:
        """Put the ids of new pieces into ``memo``, by classes of length."""
        by_width: dict[int, list] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, group in by_width.items():
            if width > 64:
                memo.update((p, self._merge_long(raw, width)) for p, raw in group)
                continue
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                memo.update(zip((p for p, _ in some), self.merge_rows([raw for _, raw in some], width)))

    def encode_batch(self, texts: list[str | None], memo: "Memo") -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; the memo is left within its bound."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif self.special is None or "<|" not in t:
                cut.append(self.pieces.findall(t))
            else:
                cut.append([p for s in self.special.split(t) for p in ([s] if s in self.added else self.pieces.findall(s))])
        if self.added and not memo:
            memo.update((s, np.uint32(i).tobytes()) for s, i in self.added.items())
        known = memo.__contains__
        new = {p for c in cut for p in c if not known(p)}
        if new:
            self.learn(memo, new)
        get = memo.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        memo.trim(new)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: their bytes, read as UTF-8 with replacement of what is none."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


class Memo(dict):
    """Ids of pieces.  Long pieces are not kept, and all go once their bytes pass MEMO_BYTES."""

    held = 0

    def trim(self, new: set[str]) -> None:
        for p in new:
            if len(p) > 64:
                del self[p]
            else:
                self.held += 6 * len(p) + ENTRY
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0


_LOADED: dict[str, Vocabulary] = {}


def loaded(spec: str) -> Vocabulary:
    """The vocabulary, made once in a worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver and sent with the tasks (its size does not grow with data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def parts(batches):
    """The batches cut by the bytes of their texts, which are in column 1."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        vocab, memo = loaded(spec.value), Memo()
        for batch in parts(batches):
            got = vocab.encode_batch(batch.column(1).to_pylist(), memo)
            flat = np.frombuffer(b"".join(got), np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got], dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
        memo.clear()
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids."""
    spark = encoded.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        vocab = loaded(spec.value)
        for batch in batches:
            texts = [vocab.decode(np.array(x if x is not None else (), np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids)).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, sha256 of the ids in decimal, sha256 of the decoded text."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        vocab, memo = loaded(spec.value), Memo()
        sha = hashlib.sha256
        for batch in parts(batches):
            n, a, b = [], [], []
            for raw in vocab.encode_batch(batch.column(1).to_pylist(), memo):
                ids = np.frombuffer(raw, np.uint32)
                n.append(len(ids))
                a.append(sha(",".join(map(str, ids.tolist())).encode()).hexdigest())
                b.append(sha(vocab.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        memo.clear()
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, OUT)
