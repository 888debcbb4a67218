"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with FTRL and an elastic net, then calibrated by temperature.

Document frequencies are counted over all training documents; the classifier is fitted on a sample
of at most about ``bound`` documents a language (documented parameter), a fifth of which is kept
back for the temperature.  N-grams of orders 1 to 3 of the lower-cased text are hashed into
``2**BITS`` buckets; a document's vector is (n-gram share) x idf.

Defined results: null texts and texts without letters are ``und`` with score 0; null languages and
null ids are never learned from, and texts of null ids are predicted as others are; where nothing can
be learned every text is ``und``; of languages of equal probability the first by name wins; a very long
text is read whole, in parts that together hold each n-gram once; repeated documents are scored each;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, ship
from .ftrl import FTRL, logits, softmax, temperature

BITS = 17
SCALE = 20.0
_LETTER = regex.compile(r"\p{L}")
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngrams(text: str, seen: int = 0) -> np.ndarray:
    """Bucket numbers of all n-grams (1 to 3) of a text, with repeats, that end after its first ``seen`` characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, out = c * _MULT[0], []
    for k in range(1, 4):
        if len(c) < k:
            break
        if k > 1:
            h = (h[:-1] ^ (c[k - 1 :] + np.uint32(k))) * _MULT[k - 1]
            h ^= h >> np.uint32(15)
        out.append((h[max(0, seen - k + 1) :] * _MULT[1]) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _parts(text: str, size: int = 1 << 20):
    """The n-grams of a text, a part of it at a time; each is in one part."""
    text = text.lower()
    for at in range(0, max(1, len(text)), size):
        lo = max(0, at - 2)
        yield ngrams(text[lo : at + size], at - lo)


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Documents of ``docs`` that hold each bucket; at index 2**BITS the number of documents."""
    def count(batches):
        df, mark = np.zeros((1 << BITS) + 1, np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                mark[:] = False
                for part in _parts(t or ""):
                    mark[part] = True
                df[np.flatnonzero(mark)] += 1
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["bucket", "n"])

    out = np.zeros((1 << BITS) + 1)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def vectors(docs: DataFrame, text: str, lang: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, shares) of the documents, on the driver: for a bounded sample only."""
    def run(batches):
        for batch in batches:
            idx, val = [], []
            for t in batch.column(1).to_pylist():
                got = [np.unique(p, return_counts=True) for p in _parts(t)]
                i = np.concatenate([g[0] for g in got])
                c = np.bincount(i, np.concatenate([g[1] for g in got]), 1 << BITS)
                at = np.flatnonzero(c)
                idx.append(at.astype(np.int32))
                val.append((c[at] / c.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["l", "i", "v"])

    rows = docs.select(lang, text).mapInArrow(run, "l string, i array<int>, v array<float>").toArrow()
    return [(l, np.array(i.values), np.array(v.values)) for l, i, v in zip(rows["l"].to_pylist(), rows["i"], rows["v"])]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, bias: np.ndarray, t: float):
        self.langs, self.bias, self.t = langs, bias, t
        self.w = np.ascontiguousarray(w * idf[:, None] * SCALE, np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for at in _parts(text):
            total += self.w.take(at, axis=0).sum(0, dtype=np.float64)
            n += len(at)
        p = softmax((total / n + self.bias) / self.t)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = 1500, l1: float = 0.02, l2: float = 0.001, alpha: float = 0.3, epochs: int = 2) -> Model:
    """Learn from the text and language of ``docs`` (ids only deal out the sample)."""
    ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    df = document_frequencies(docs, text)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    h = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1 << 30))
    share: Column = F.coalesce(*[F.when(F.col(lang) == k, F.lit(int(min(1.0, bound / n) * (1 << 30)))) for k, n in counts.items()])
    rows = vectors(known.where(h < share), text, lang)
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()[:64], r[2].tobytes()[:64]))
    y = np.array([langs.index(r[0]) for r in rows], np.int64)
    x = [(i, v * idf[i] * SCALE) for _, i, v in rows]
    held = np.arange(len(rows)) % 5 == 4
    model = FTRL(len(langs), 1 << BITS, alpha=alpha, l1=l1, l2=l2).fit([x[i] for i in np.flatnonzero(~held)], y[~held], epochs=epochs)
    w, bias = model.weights()
    back = np.flatnonzero(held)
    return Model(langs, idf, w, bias, temperature(logits([x[i] for i in back], w, bias), y[back]))


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def train_fold(docs: DataFrame, doc_id: str = "doc_id", m: int = 5) -> DataFrame:
    """Rows that may be learned from: a known id whose fold is not 0."""
    return docs.where(fold(doc_id, m) != 0)
