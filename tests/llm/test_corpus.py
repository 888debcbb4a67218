"""The corpus operators against brute force, on rows with nulls, empty and long texts, copies and
extra columns of clashing names."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bloomlm, bpe, decontam, langid, licenses, minhash, queries, rules, tokenfile, toxicity, urls, words
from cladeframe.llm.common import fold

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, held_out int, key string, bands string"


def vocab(name):
    return queries.tokenizer_path(name)


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Ids and texts of every awkward kind."""
    rng = random.Random(4)
    long_ = prose(rng, 20_000)
    body = prose(rng, 120)
    texts = [None, "", " \n\t ", "one", "a b c", body, body, body + " extra", body.replace(" ", "  "), long_, long_ + " z", "\x00\x1c x y \U0001f600 İΣ",
             "löser déjà " * 30, "dup line here\n" * 12, "x" * 3000, "1d10t!! $$$ #tag <b> | & *"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, body), (None, body), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "k", "b") for i, t in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 3 -------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    rng = random.Random(2)
    rows = odd + [(100 + k, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), 32, 10])) for _ in range(400))) for k in range(20)]
    rows += [(200, "<|endoftext|>a <|endoftext|> <|endo"), (201, "it's we'll  \n\n x\t\ty   ")]
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    df = frame(spark, rows)
    assert by_rows(bpe.digest(df, vocab("byte_bpe_50k.json")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    again = bpe.decode(bpe.encode(df, vocab("byte_bpe_50k.json")), vocab("byte_bpe_50k.json"))
    assert by_rows(again, "doc_id", "text") == sorted(((i, x or "") for i, x in rows), key=repr)
    assert bpe.digest(empty(spark), vocab("byte_bpe_50k.json")).count() == 0


def test_segment_tree_equals_plain_merging():
    v = bpe.Vocabulary(bpe.read_spec(vocab("byte_bpe_50k.json")))
    rank = {}
    at = np.flatnonzero(v.pairs.keys >= 0)
    for k, r, m in zip(v.pairs.keys[at].tolist(), v.pairs.rank[at].tolist(), v.pairs.merged[at].tolist()):
        rank[k >> 32, k & 0xFFFFFFFF] = (r, m)
    rng = random.Random(9)
    for n in (1, 2, 3, 7, 8, 9, 64, 65, 200, 1500):
        piece = bytes(rng.choice(b"aaabthe inger") for _ in range(n))
        ids = [int(v.byte_id[b]) for b in piece]
        while len(ids) > 1:
            best = min((rank.get((a, b), (math.inf, -1))[0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if best[0] == math.inf:
                break
            i = best[1]
            ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
        assert np.frombuffer(v.merge_piece(piece), np.uint32).tolist() == ids


# 2 -------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    rows = [r for r in odd if r[0] is not None] + [(50, "ÀÉ ×÷ it's 12 <|endoftext|> é ΑΣ")]
    path = tokenfile.write_tokens(frame(spark, rows), vocab("word_bpe_49k.json"), tokenfile.fresh_path(spark), end_id=2, part_bytes=40_000)
    got = tokenfile.digest(tokenfile.read_tokens(spark, path)).orderBy("start").collect()
    at, left = 0, collections.Counter()
    for i, x in rows:
        left[i, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes())] += 1
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id, r.ids_crc32] -= 1
    assert not any(left.values())
    assert spark.read.parquet(f"{path}/tokens").select("part").distinct().count() > 1
    plan = tokenfile.read_tokens(spark, path).where("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "tokens" not in re.search(r"ReadSchema: (\S*)", plan)[1].replace("n_tokens", "") and "EqualTo(doc_id,3)" in plan
    none = tokenfile.write_tokens(empty(spark), vocab("word_bpe_49k.json"), tokenfile.fresh_path(spark), end_id=2)
    assert tokenfile.read_tokens(spark, none).count() == 0


def test_token_file_footers(spark, tmp_path):
    """Encodings, row groups and page indexes, as the files' footers tell them."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(3)
    df = frame(spark, [(k, prose(rng, 60)) for k in range(5000)])
    path = tokenfile.write_tokens(df, vocab("word_bpe_49k.json"), f"file://{tmp_path}/tokens", end_id=2)
    files = glob.glob(f"{tmp_path}/tokens/tokens/*.parquet")
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            for name in ("part", "doc_id", "local_start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in cols[name].encodings and cols[name].has_column_index and cols[name].has_offset_index
            ids = cols["tokens.list.element"]
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings) or "DELTA_BINARY_PACKED" in ids.encodings
            assert ids.has_offset_index and ids.compression == "ZSTD"
    assert tokenfile.read_tokens(spark, path).where("doc_id = 77").count() == 1


def test_encoder_equals_the_library_on_any_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), tokenfile.Encoder(open(path, "rb").read())
    assert e.known_form
    rng = random.Random(5)
    pools = [[chr(c) for c in range(32, 127)], list("aAbB'sStTdD.,;!?<|>-12 \n\t\x0b\x1c\x85\xa0"), [chr(c) for c in range(0xA0, 0x250)] + list("hHaAeE \u0338\u0331\u0301="), [chr(rng.randrange(32, 0x3000)) for _ in range(80)]]
    texts = ["".join(rng.choice(pools[k % 4]) for _ in range(rng.randint(0, 50))) for k in range(2500)] + [None, "", "a<|endoftext|>b <|ENDOFTEXT|>", "x" * 5000, "H\u0331 h\u0331 \u1e96 don't 'sx"]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    for room in (300, 500_000):
        e.clear(room)
        ids, n = e.encode(pa.array([None, *texts], pa.string()).slice(1), 2)
        ends = np.cumsum(n)
        assert [ids[b - k : b].tolist() for k, b in zip(n, ends)] == want
    e.known_form = False
    ids, n = e.encode(pa.array(texts[:50], pa.string()), 2)
    assert ids.tolist() == [i for w in want[:50] for i in w] and n.tolist() == [len(w) for w in want[:50]]


# 10 ------------------------------------------------------------------------------------------------


def slow_hits(text, items):
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w, hit, found = cut(text), set(), set()
    for i, t in items:
        x = cut(t)
        for p in ([x[k : k + 10] for k in range(len(x) - 9)] if len(x) >= 10 else [x] if x else []):
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    if i is not None:
                        found.add(str(i))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_bytes", [64 << 20, 60])
def test_decontamination_equals_brute_force(spark, max_bytes):
    rng = random.Random(1)
    base = [prose(rng, 30, "ab") for _ in range(5)]
    items = [(1, base[0]), (2, base[0][:50]), (10, "b a"), (3, None), (4, ""), (5, base[1].upper()), (6, base[2]), (None, base[3]), (7, base[2]), (8, "aa"), (9, "été bb")]
    docs = [(i, " ".join(rng.choice(base + [prose(rng, 25, "ab")])[rng.randint(0, 20) :] for _ in range(3))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "aa"), (53, base[4] + ", " + base[0].replace(" ", "--")), (54, "été BB")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = decontam.find_benchmark(frame(spark, docs), bench, max_bytes=max_bytes)
    want = sorted(((i, *slow_hits(t, items)) for i, t in docs), key=repr)
    assert by_rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = decontam.drop_contaminated(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1]) and kept.columns == ["doc_id", "text", "score", "held_out", "key", "bands"]
    nothing = spark.createDataFrame([], bench.schema)
    assert decontam.find_benchmark(frame(spark, docs), nothing).where("n_hit > 0").count() == 0
    assert decontam.find_benchmark(empty(spark), bench).count() == 0


def test_wu_manber_skips_and_finds_overlaps():
    w = "x a b a b a b y".encode().split()
    finder = decontam.WuManber({(b"a", b"b", b"a"): {"1"}, (b"b", b"y"): {"2"}, (b"y",): {"3"}})
    assert sorted((s, e) for s, e, _ in finder.search(w)) == [(1, 4), (3, 6), (6, 8), (7, 8)]


# 4 -------------------------------------------------------------------------------------------------


def slow_stats(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORDS.search(line))
        seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_equal_brute_force(spark, odd):
    rng = random.Random(6)
    rows = odd + [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))) for k in range(60)]
    got = by_rows(rules.statistics(frame(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *slow_stats(t)) for i, t in rows), key=repr)
    assert rules.statistics(empty(spark)).count() == 0


def test_decision_list_learns_and_emits_conditions(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, 60)
        docs.append((i, t.replace(" ", "### ") if bad and i % 8 else t.upper() if bad else t))
        labels.append((i, int(not bad)))
    docs.append((999, None))
    lab = spark.createDataFrame(labels + [(999, None)], "doc_id long, quality int")
    stats = rules.statistics(frame(spark, docs)).cache()
    found = rules.fit(stats, lab)
    assert 1 <= len(found) <= 12 and all(r.precision >= 0.97 for r in found)
    out = rules.judge(stats, found)
    assert "Python" not in out.drop("x")._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]
    got = {r.doc_id: r.kept for r in out.collect()}
    assert got[999] is False and np.mean([got[i] == bool(q) for i, q in labels]) > 0.98
    # The same list, walked in Python.
    x = stats.select("doc_id", *[c.alias(k) for k, c in rules.feature_columns().items()]).toPandas()
    for _, r in x.iterrows():
        row = np.array([[r[k] for k in rules.FEATURES]])
        if r["n_words"] >= 20:
            assert got[r["doc_id"]] == (not any(u.covers(row)[0] for u in found))
    assert rules.fit(stats, lab.where("false")) == [] and rules.fit(stats, lab.where("quality = 1")) == []


# 5 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [3, 10_000])
def test_base_scores_and_quantised_counts(spark, odd, hot):
    rng = random.Random(3)
    rows = [r for r in odd if r[0] is not None] + [(100 + k, prose(rng, 40, "abc")) for k in range(80)]
    df = frame(spark, rows)
    out = bloomlm.score(df, df.where(fold("doc_id", 7) != 2), hot=hot)
    cut = lambda t: [w.encode("utf-8").lower() for w in WORDS.findall(t or "")] + [None]
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in rows)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert bloomlm.score(empty(spark), df).count() == 0
    alone = bloomlm.score(df, df.where("false")).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)}


def lm_by_dictionary(rows, learned, mix=0.4, discount=0.75):
    """The docstring's formula with Python dictionaries, and levels of exact counts."""
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    one, two = collections.Counter(), collections.Counter()
    for t in learned:
        w = cut(t)
        one.update(w)
        two.update(zip([None, *w], w))
    level = lambda c: c and int(math.log2(c)) + 1
    low = lambda c: 2.0 ** (level(c) - 1) if c else 0.0
    denom = sum(one.values()) + len(one) + 1

    def p(u, w, first):
        before = len(learned) if first else 2.0 ** level(one[u]) - 1
        p1 = (low(one[w]) + 1) / denom
        return (1 - mix) * max(low(two[u, w]) - discount, 0) / max(before, 1) + mix * p1 if before > 0 else p1

    out = [sum(math.log10(p(u, w, k == 0)) for k, (u, w) in enumerate(zip([None, *cut(t)], cut(t)))) for _, t in rows]
    return out, {u: sum(p(u, w, False) for w in [*one, "new"]) for u in one}


def test_model_scores_equal_the_formula(spark):
    rng = random.Random(31)
    rows = [(k, prose(rng, 40, "abcde")) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "never seen words at all"), (203, rows[0][1])]
    df = frame(spark, rows)
    learned = [t for i, t in rows if i % 3]
    want, mass = lm_by_dictionary(rows, learned)
    got = {r.doc_id: r.score for r in bloomlm.score(df, df.where("doc_id % 3 > 0")).collect()}
    # A false probe of the filter moves a level by one; most texts have none or few.
    assert all(abs(got[i] - w) < 0.06 * abs(w) + 0.3 for (i, _), w in zip(rows, want))
    assert sum(abs(got[i] - w) < 0.01 * abs(w) for (i, _), w in zip(rows, want)) > 0.5 * len(rows)
    assert max(mass.values()) <= 1 + 1e-9


def test_word_hashes_are_the_words(odd):
    texts = [t for _, t in odd] + ["A\x0bB\x0cc\r\nd  ", " x", "y" * 70_000 + " z" * 9, "\u00c9a\u0301 \u2028q"]
    import pyarrow as pa

    for fold_ in (True, False):
        h1, h2 = words.Hash(1, fold_), words.Hash(2, fold_)
        for part in (texts, texts[3:]):
            col = pa.array([None, "zz", *part], pa.string()).slice(2)
            raw, at = words.flat(col)
            s, e, first = words.places(raw, at)
            want = [[w.lower() if fold_ else w for w in (t or "").encode().split()] for t in part]
            assert np.diff(first).tolist() == [len(w) for w in want]
            flat_ = [w for ws in want for w in ws]
            assert [(raw[a:b].tobytes().lower() if fold_ else raw[a:b].tobytes()) for a, b in zip(s, e)] == flat_
            a, b = h1.prefix(raw, s, e), h2.prefix(raw, s, e)
            by = {}
            for w, x in zip(flat_, zip(a.tolist(), b.tolist())):
                assert by.setdefault(w, x) == x
            assert len(set(by.values())) == len(by) == len({x for x, _ in by.values()})
            one, back = words.distinct(a, b)
            assert len(one) == len(by) and (a[one][back] == a).all() and (b[one][back] == b).all()
            t = words.Table(4 * len(one))
            assert (t.find(a, b) == -1).all()
            assert (t.add(a[one], b[one])[back] == t.find(a, b)).all() and t.room >= 0
    assert [x for x in words.slices(pa.array(texts), 50)][-1][1] == len(texts)


def exact_levels(count):
    return np.array([int(math.log2(c)) + 1 for c in count])


def test_filter_holds_all_counts_in_parts(spark):
    rng = random.Random(12)
    texts = [prose(rng, 50, "abcd") for _ in range(60)] + [None, ""]
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        w = [*(t or "").encode().split(), b" "]
        one.update(w)
        two.update(zip([b" ", *w], w))
    id_ = lambda x: np.array([bloomlm.FIRST.one(w) for w in x], np.uint64)
    for segments, max_bytes in ((1, 1 << 20), (7, 2000)):
        made = bloomlm.segments_of(bloomlm.counted(frame(spark, list(enumerate(texts))), segments))
        assert [tuple(r) for r in made.agg(F.sum("n_words"), F.sum("n_tokens")).collect()] == [(len(one), sum(one.values()))]
        parts = list(bloomlm.parts_of(made, segments, max_bytes))
        assert (len(parts) > 1) == (segments > 1)
        f = bloomlm.Filter(parts)
        got, want = f.levels(id_(one)), exact_levels(one.values())
        assert (got >= want).all() and (got == want).mean() > 0.95
        got = f.levels(bloomlm.pair_hash(id_([a for a, _ in two]), id_([b for _, b in two])))
        want = exact_levels(two.values())
        assert (want == 1).sum() > 500 and (got >= want).all() and (got == want).mean() > 0.95
        strange = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
        assert (f.levels(strange) > 0).mean() < 0.05


def test_scores_do_not_depend_on_the_size_of_a_part(spark):
    rng = random.Random(8)
    df = frame(spark, [(k, prose(rng, 60, "abcd")) for k in range(150)])
    one, many = ({r.doc_id: r.score for r in bloomlm.score(df, df.where("doc_id % 3 > 0"), max_bytes=m).collect()} for m in (64 << 20, 2000))
    assert len(one) == 150 and all(abs(one[i] - many[i]) < 0.15 * abs(one[i]) for i in one)


# 1 -------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, odd):
    rng = random.Random(5)
    langs = {"xx": "aeiou", "yy": "bcdfg", "zz": "klmno"}
    rows = [(k, prose(rng, 30, langs[l]), l, "s") for k, l in enumerate(list(langs) * 60)] + [(1000 + k, t, None, "s") for k, (_, t) in enumerate(odd)]
    rows += [(2000, "123 !!", "xx", "s"), (2001, None, "yy", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(langid.train_fold(df), bound=60)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    held = [(out[i][0], l) for i, _, l, _ in rows[:180] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and np.mean([a == b for a, b in held]) == 1.0
    assert out[2000] == ("und", 0.0) and out[2001] == ("und", 0.0) and out[1001] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in out.values())
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def plain_ngrams(text):
    """Buckets of a text's n-grams by the stated hash, one at a time."""
    m, c, out = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), [ord(x) for x in text.lower()], []
    full = (1 << 32) - 1
    for k in (1, 2, 3):
        for i in range(len(c) - k + 1):
            h = c[i] * m[0] & full
            for j in range(2, k + 1):
                h = (h ^ (c[i + j - 1] + j)) * m[j - 1] & full
                h ^= h >> 15
            out.append((h * m[1] & full) >> (32 - langid.BITS))
    return out


def test_language_id_equals_plain_formulas(spark):
    rng = random.Random(8)
    langs = {"xx": "aeiou", "yy": "aioubc", "zz": "klmno\u00e9"}
    rows = [(k, prose(rng, 12, langs[l]), l) for k, l in enumerate(list(langs) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, bound=10_000, epochs=1)
    n, df_ = len(rows), collections.Counter(b for _, t, _ in rows for b in set(plain_ngrams(t)))
    idf = lambda b: math.log((1 + n) / (1 + df_[b])) + 1

    def vector(t):
        c = collections.Counter(plain_ngrams(t))
        return {b: m / sum(c.values()) * idf(b) * langid.SCALE for b, m in c.items()}

    # The same examples in the same order, one weight at a time.
    order = sorted(rows, key=lambda r: (r[2], len(set(plain_ngrams(r[1])))))
    shares = langid.vectors(df, "text", "lang")
    shares.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()[:64], r[2].tobytes()[:64]))
    got = [{int(b): v * idf(int(b)) * langid.SCALE for b, v in zip(i, w)} for _, i, w in shares]
    left = [vector(t) for _, t, _ in order]
    for g in got:
        assert any(set(g) == set(v) and all(abs(g[b] - v[b]) < 1e-4 for b in g) for v in left)
    names = sorted(langs)
    y = [names.index(r[0]) for r in shares]
    turn = [i for i in range(n) if i % 5 != 4]
    z, sq = collections.defaultdict(float), collections.defaultdict(float)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.001

    def weight(b, k):
        lim = 0.0 if b == "bias" else l1
        if abs(z[b, k]) <= lim:
            return 0.0
        return -(z[b, k] - math.copysign(lim, z[b, k])) / ((beta + math.sqrt(sq[b, k])) / alpha + l2)

    def chances(x):
        s = [sum(v * weight(b, k) for b, v in x.items()) for k in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for i in np.random.default_rng(7).permutation(len(turn)):
        x = {**got[turn[i]], "bias": 1.0}
        p = chances(x)
        new = []
        for b, v in x.items():
            for k in range(3):
                g = v * (p[k] - (k == y[turn[i]]))
                new.append((b, k, g, (math.sqrt(sq[b, k] + g * g) - math.sqrt(sq[b, k])) / alpha, weight(b, k)))
        for b, k, g, step, w in new:
            z[b, k] += g - step * w
            sq[b, k] += g * g
    for t in [r[1] for r in rows[:6]] + ["aeiou klm", "zzz q"]:
        x = {**vector(t), "bias": 1.0}
        s = np.array([sum(v * weight(b, k) for b, v in x.items()) for k in range(3)]) / model.t
        e = np.exp(s - s.max())
        lang, score = model.predict(t)
        assert lang == names[int(e.argmax())] and score == pytest.approx(float(e.max() / e.sum()), abs=2e-4)


def test_language_id_reads_long_texts_in_parts_alike(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 51, 52, 200):
        t = prose(rng, n, "abc\u00e9")[:n]
        whole = sorted(langid.ngrams(t.lower()).tolist())
        assert whole == sorted(plain_ngrams(t))
        for size in (1, 2, 3, 7, 50):
            parts = [b for p in langid._parts(t, size) for b in p.tolist()]
            assert sorted(parts) == whole


# 6 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(12)
    bad = ["idiot", "moron", "stupid", "loser"]
    rows = []
    for i in range(500):
        w = prose(rng, rng.randint(15, 80), "theanor").split()
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    return rows


def test_toxicity_on_held_out_and_disguised_rows(spark, toxic_rows, odd):
    df = frame(spark, [(i, t) for i, t, _ in toxic_rows])
    lab = spark.createDataFrame([(i, y) for i, _, y in toxic_rows] + [(9999, None)], "doc_id long, toxic int")
    model = toxicity.fit(df.where(fold("doc_id", 5) != 0), lab)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i] >= 0.5, y == 1) for i, _, y in toxic_rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    clean = "the other an hear then not her"
    hidden = [(k, f"{clean} {x} {clean}") for k, x in enumerate(["1d10t", "i d i o t", "m0r0n", "$tupid", "stuuuupid", "l.o.s.e.r", "m-o-r-o-n", "lo$er"])] + [(99, clean)]
    scores = {r.doc_id: r.score for r in toxicity.score(frame(spark, hidden), model).collect()}
    assert scores[99] < 0.5 and sum(scores[k] >= 0.5 for k in range(8)) >= 7
    rest = {r.doc_id for r in toxicity.drop_toxic(frame(spark, hidden), model).collect()}
    assert rest == {k for k, s in scores.items() if s < 0.5}
    some = toxicity.score(frame(spark, odd), model).collect()
    assert len(some) == len(odd) and all(0 <= r.score <= 1 for r in some)
    nothing = toxicity.fit(df, lab.where("false"))
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.0}


def test_blanks_are_steps_of_the_lattice(spark, toxic_rows):
    df = frame(spark, [(i, t) for i, t, _ in toxic_rows])
    lab = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    d = toxicity.Decoder(model.chars)
    assert "idiot" in d.run(list("idiot"), toxicity.COST_BLANK).split()
    clean = "the other an hear then not her"
    hidden = ["i d i o t", "i  d  i  o  t", "i\td\ni o t", "m o r o n .", "st upid", "los er", "mo ron", "s t u p i d", "1 d 1 0 t", "i d i 0 t"]
    texts = [(k, f"{clean} {x} {clean}") for k, x in enumerate(hidden)] + [(90, clean), (91, f"{clean} a b c {clean}"), (92, "a\nan he r\n1 2 3 4 5"), (93, None), (94, "")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), model).collect()}
    assert sum(got[k] >= 0.5 for k in range(len(hidden))) >= len(hidden) - 2 and all(got[k] < 0.5 for k in (90, 91, 92, 93, 94))
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.drop_toxic(empty(spark), model).count() == 0


def test_arrays_score_as_token_by_token(spark, toxic_rows, odd):
    df = frame(spark, [(i, t) for i, t, _ in toxic_rows])
    lab = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    d, get = toxicity.Decoder(model.chars), model.weight.get
    import pyarrow as pa

    texts = [t for _, t, _ in toxic_rows[:60]] + [t for _, t in odd] + ["Idiot, IDIOT! idiot.", "xx1d10t l.o.s.e.r $tupid; stu\u0301pid", "st upid idiot", "m o r o n"]
    scorer = toxicity.Scorer(model)
    got = scorer.scores(pa.array(texts, pa.string()))
    for t, score in zip(texts, got):
        raw, at = words.flat(pa.array([t], pa.string()))
        s, e, first = toxicity.cores(raw, at)
        w = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s, e)]
        of = lambda x: sum(get(f, 0.0) for f in toxicity.features(x))
        low = {x.encode().lower().decode() for x in w}
        total = sum(of(d.restore(x)) for x in low)
        extra = {}
        for _, a, b in toxicity.spaced(raw, s, e, first):
            extra.update((x, of(x)) for x in d.run([v.lower() for v in w[a:b]], toxicity.COST_BLANK).split() if x not in w[a:b])
        for x, y in zip(w, w[1:]):
            if all(v.isascii() and v.isalpha() and 1 < len(v) < 24 for v in (x, y)) and get(toxicity.features((x + y).lower())[0], 0.0):
                extra.update((v, of(v)) for v in d.run([x.lower(), y.lower()], toxicity.COST_JOIN).split() if v not in (x, y))
        z = model.a * (model.bias + total + sum(extra.values())) + model.b
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), t


def test_letters_that_are_not_listed_are_counted(spark):
    counts = toxicity.char_counts(frame(spark, [(1, "\u0434\u0434 ab 1"), (2, None)])).reshape(toxicity.K, toxicity.K, toxicity.K)
    assert counts[0, 0, 1] == 1 and counts[0, 1, 1] == 1 and counts[1, 1, 0] == 1 and counts[0, 2, 3] == 1


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learned = fold("doc_id", 5) != 0
    one, two = (toxicity.fit(docs.where(learned), x.where(learned)) for x in (labels, flipped))
    assert one.weight == two.weight and (one.a, one.b, one.bias) == (two.a, two.b, two.bias)


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(1)
    d = toxicity.Decoder(np.log10(rng.dirichlet(np.ones(toxicity.K), size=(toxicity.K, toxicity.K))))
    lp = np.array(d.lp)

    def cost(word, channel):
        s = [0, 0, *[toxicity._CODE.get(c, 1) for c in word], 0]
        return channel - sum(lp[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ["1d10t", "aabb", "l.o.$", "x|y", "@@b"]:
        paths = [("", 0.0)]
        for choices in d.lattice(token):
            paths = [(w + x, c + k) for w, c in paths for x, k in choices]
        best = min(cost(w, c) for w, c in paths)
        got = d.decode(token)
        assert min(cost(w, c) for w, c in paths if w == got) == pytest.approx(best)


# 7 -------------------------------------------------------------------------------------------------


def test_url_filter_as_of(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rng = random.Random(7)
    keys = ["a.com", "b.a.com", "x.b.a.com", "a.com/p", "b.a.com/q", "d.org", "com"]
    entries = [(rng.choice(keys), rng.choice(["spam", "ads"]), rng.choice(["add", "remove"]), day(rng.randint(0, 60))) for _ in range(60)]
    entries += [(None, "spam", "add", day(1)), ("a.com", "spam", "add", None), entries[0]]
    urls_ = ["http://A.com/p/x?q", "https://b.a.com/q", "https://x.b.a.com:8080#f", "ftp://u@d.org", "not a url", None, "http://other.net/p", "http://com/"]
    pages = [(i, rng.choice(urls_), day(rng.randint(0, 70)) if i % 9 else None, "h") for i in range(150)]
    pages += [pages[3], pages[3]]
    p = spark.createDataFrame(pages, "page_id long, url string, fetched timestamp, category string")
    e = spark.createDataFrame(entries, "key string, category string, action string, effective timestamp")
    out = urls.filter_urls(p, e)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)

    def state(key, cat, t):
        seen = [(w, a) for k, c, a, w in entries if k == key and c == cat and w is not None and w <= t]
        if not seen:
            return None
        last = max(w for w, _ in seen)
        if any(a == "remove" for w, a in seen if w == last):
            return None
        since, on = None, False
        for w in sorted({w for w, _ in seen}):
            add = not any(a == "remove" for v, a in seen if v == w)
            since, on = (w if add and not on else since), add
        return since

    def judge(url, t):
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
        if not m or t is None:
            return (False, 0, None, None, None)
        h = m[1].lower()
        s = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", url)
        labels = h.split(".")
        cand = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))] + ([f"{h}/{s[1]}"] if s else [])
        act = [(-len(k), k, c, w) for k in cand for c in ("ads", "spam") if (w := state(k, c, t))]
        return (bool(act), len(act), *(min(act)[1:] if act else (None,) * 3))

    want = sorted(((i, t, *judge(u, t)) for i, u, t, _ in pages), key=repr)
    assert by_rows(out, "page_id", "fetched", "blocked", "n_active", "list_key", "category", "listed_since") == want
    assert urls.filter_urls(p, e.where("false")).where("blocked").count() == 0
    assert urls.filter_urls(p.where("false"), e).count() == 0


# 8 -------------------------------------------------------------------------------------------------


def slow_groups(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else ("alone", i, len(sets)), []).append(i)
    keys = list(sets)
    real = [k for k in keys if isinstance(k, frozenset)]
    links = {k: set() for k in keys}
    for a in range(len(real)):
        for b in range(a + 1, len(real)):
            x, y = real[a], real[b]
            if len(x & y) >= threshold * len(x | y) - 1e-9:
                links[x].add(y)
                links[y].add(x)
    out, seen = [], {}
    for k in keys:
        if k in seen:
            continue
        todo, comp = [k], {k}
        while todo:
            for o in links[todo.pop()] - comp:
                comp.add(o)
                todo.append(o)
        least = min(i for c in comp for i in sets[c])
        for c in comp:
            seen[c] = least
    for k in keys:
        out += [(i, seen[k], len(links[k]), min(sets[k]), len(sets[k])) for i in sets[k]]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join_equals_all_pairs(spark, odd, block, monkeypatch):
    monkeypatch.setattr(minhash.links, "__defaults__", (block, 8 << 20))
    rng = random.Random(21)
    rows = [r for r in odd if r[0] is not None and r[1] and r[1].strip()] + [(60, ""), (61, None)]
    for g in range(6):
        base = prose(rng, 100).split()
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
            rows.append((100 + g * 20 + k, " ".join(w)))
    got = by_rows(minhash.jaccard_join(frame(spark, rows)), "doc_id", "class_id", "n_links", "copy_id", "n_copies")
    want = slow_groups(rows)
    assert sorted(got) == want and max(w[2] for w in want) > 7
    kept = minhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, *_ in want})
    assert kept.columns == ["doc_id", "text", "score", "held_out", "key", "bands"]
    assert minhash.jaccard_join(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0


def test_keep_one_keeps_unrelated_rows_of_one_id(spark):
    rng = random.Random(5)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    near = " ".join(c.split()[:-1] + ["other"])
    rows = [(None, a), (None, b), (None, near), (None, c), (7, d), (7, e), (7, e), (3, e + " end"), (9, f), (9, f.replace(" ", "  ")), (9, ""), (9, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(i for i, t in kept if i is not None) == [3, 7, 9, 9, 9] and kept.count((9, "")) == 2
    assert {(None, a), (None, b), (7, d), (3, e + " end"), (None, None)} <= set(kept)
    assert ((None, c) in kept) + ((None, near) in kept) == 1 and len(kept) == 9
    alone = [(r.doc_id, r.text) for r in minhash.keep_one(frame(spark, [(4, a), (4, a), (4, a), (4, b)])).collect()]
    assert sorted(alone) == sorted([(4, a), (4, b)])


def test_bands_reach_the_recall():
    b, r = minhash.Bands().shape()
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9995


# 9 -------------------------------------------------------------------------------------------------


def test_licenses(spark, odd):
    rng = random.Random(3)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(80)]
    for k, (f, notices) in enumerate(sorted(licenses.TEMPLATES.items())):
        for j, n in enumerate(notices):
            rows.append((1000 + 20 * k + j, prose(rng, 20) + "\n" + n + "\n" + prose(rng, 9)))
    rows += [(5000, "we licensed the version\nthe work is released"), (5001, None), (5002, ""), (5003, licenses.TEMPLATES["mit"][0] + "\n" + licenses.TEMPLATES["gpl"][0])]
    df = frame(spark, rows + [(6000 + k, t) for k, (_, t) in enumerate(odd)])
    model = licenses.fit(df)
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    for k, (f, notices) in enumerate(sorted(licenses.TEMPLATES.items())):
        assert [got[1000 + 20 * k + j].family for j in range(len(notices))] == [f] * len(notices)
    assert all(got[i].family is None for i in range(80)) and got[5000].family is None
    assert got[5001].n_paragraphs == 0 and got[5002].family is None and got[5003].families == ["gpl", "mit"]
    assert licenses.scan(empty(spark), licenses.fit(empty(spark))).count() == 0


@pytest.mark.parametrize("width, mark", [(72, ""), (72, " * "), (40, "# ")])
def test_wrapped_notices_are_confirmed(spark, width, mark):
    import textwrap

    rng = random.Random(6)
    df = frame(spark, [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(60)])
    model = licenses.fit(df)
    notices = [(f, n) for f, all_ in licenses.TEMPLATES.items() for n in all_ if len(n) > 72]
    for f, n in notices:
        lines = [mark + x for x in textwrap.wrap(n, width)]
        got = licenses.scan_text("\n".join([prose(rng, 9), "", *lines, "", prose(rng, 9)]), model)
        assert len(lines) > 1 and got[3:5] == (f, [f]) and got[0] == len(lines) + 2 and got[2] == 1
    for r in df.collect():
        assert licenses.scan_text(r.text, model)[3] is None


def test_scan_equals_reading_every_line(spark, odd):
    """The texts that the arrays pass over have no line that may be a notice, so reading them finds nothing."""
    rng = random.Random(11)
    docs = list(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toLocalIterator())
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + k, t) for k, (_, t) in enumerate(odd)]
    rows += [(20_000 + k, prose(rng, 9) + sep + n) for k, (n, sep) in enumerate((n, sep) for f in licenses.FAMILIES for n in licenses.TEMPLATES[f] for sep in (" ", "\n", "\u00ab", "\u2014 "))]
    df = frame(spark, rows)
    model = licenses.fit(df)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df, model).collect()}
    assert got == {i: licenses.scan_text(t, model) for i, t in rows}
    import pyarrow as pa

    may = model.candidates(pa.array([t for _, t in rows], pa.string()))
    assert 0 < sum(g[1] > 0 for g in got.values()) <= may.sum() < 0.5 * len(rows)


def test_sentences_kept_out_of_training_are_told(spark):
    """Trained on every other sentence, the model tells the family of most notices in the rest, and in
    wordings that no template has; plain texts are left alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs, notices=licenses.notices(licenses.SENTENCES[::2]))
    tell = lambda x: licenses.CLASSES[model.predict(licenses.words(x))[0]]
    held = [(f, x.format(n)) for f, names in licenses.NAMES.items() for n in names for x in licenses.SENTENCES[1::2]]
    other = ["This file is free under the {}", "You may copy it as the {} allows.", "Some parts are under the {}; others are not."]
    free = [(f, x.format(n)) for f, names in licenses.NAMES.items() for n in names for x in other]
    told = [np.mean([tell(x) == f for f, x in part]) for part in (held, free)]
    wrong = np.mean([tell(x) not in (f, "unknown") for f, x in held + free])
    print(f"told: {told[0]:.3f} of {len(held)} held-out notices, {told[1]:.3f} of {len(free)} free wordings; {wrong:.3f} named wrongly")
    assert told[0] >= 0.9 and told[1] >= 0.6 and wrong <= 0.05
    planted = re.compile("|".join(re.escape(n) for f in licenses.NOTICES.values() for n in f))
    plain = [r.text for r in docs.select("text").collect() if r.text and not planted.search(r.text) and "icens" not in r.text and "reserved" not in r.text]
    found = [licenses.scan_text(t, model) for t in plain]
    assert len(plain) > 100 and all(g[3] is None for g in found)


def test_late_lines_are_background(spark, monkeypatch):
    rng = random.Random(9)
    seen = set()
    real = licenses.template_match
    monkeypatch.setattr(licenses, "template_match", lambda w: seen.add(" ".join(w)) or real(w))
    licenses.fit(frame(spark, [(i, "\n".join([prose(rng, 12) for _ in range(100)] + [f"late line {i}"])) for i in range(5)]))
    assert {f"late line {i}" for i in range(5)} <= seen


def test_notices_of_further_families(spark):
    rng = random.Random(7)
    plain = [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(60)]
    asked = {
        "All rights reserved.": "proprietary", "Copyright 2020 Some Company. All rights reserved.": "proprietary", "SPDX-License-Identifier: ISC": "isc",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    model = licenses.fit(frame(spark, plain + [(1000 + k, prose(rng, 9) + "\n" + n) for k, n in enumerate(asked)]))
    assert {n: licenses.scan_text(prose(rng, 9) + "\n" + n, model)[3] for n in asked} == asked
    assert licenses.scan_text("all of it\nthe rights of man\na table is reserved", model)[3] is None


# All -----------------------------------------------------------------------------------------------


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(queries.ORACLE_SQL[name])
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: v if v is None or isinstance(v, str) else str(float(v)) if isinstance(v, (int, float, np.integer)) and not isinstance(v, bool) else str(v)).values.tolist()))
    assert plain(got) == plain(want)


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_good_id", F.lit(1)).withColumn("n_words", F.lit("x"))
    rows = docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF).cache()
        now = {r.doc_id for r in rows.select("doc_id").collect()}
        assert now <= left and (name == "bpe" or rows.columns == before.columns)
        if name == "toxicity":
            m = toxicity.fit(before, labels)
            want = {r.doc_id for r in toxicity.score(before, m).collect() if r.score < 0.5}
        elif name == "quality_rules":
            st = rules.statistics(before)
            want = {r.doc_id for r in rules.judge(st, rules.fit(st, labels)).collect() if r.kept}
            assert all(slow_stats(texts[i])[0] >= 20 for i in want)
        elif name == "near_duplicates":
            want = {c for _, c, *_ in slow_groups([(i, texts[i]) for i in left])}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {i for i in left if not slow_hits(texts[i], items)[-1]}
        else:
            want = left
        assert now == want, name
        left = now
    assert corpus_pipeline.run(spark, SF).count() == len(left) > 0


def test_pipeline_stages_take_awkward_rows(spark, odd, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, "a b c"), (2, "löser déjà löser"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long, _rule_stats string, n_words string"
    stages = dict(corpus_pipeline.STAGES)
    frame_ = lambda rows: spark.createDataFrame([(i, t, "en", "s", 3, "r", "w") for i, t in rows], names)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    rows = [*odd, (500, "x" * 200_000), (501, "word " * 60_000), (None, odd[9][1])]
    df = frame_(rows)
    # Ten labels of short texts teach neither stage anything.
    assert plain(stages["toxicity"](spark, df, d)) == sorted(rows, key=repr)

    def passes(t):
        n, *_, repeats = slow_stats(t)
        return n >= 20 and 100 * repeats <= 30 * n

    good = stages["quality_rules"](spark, df, d)
    assert good.columns == df.columns and plain(good) == sorted(((i, t) for i, t in rows if passes(t)), key=repr)
    one = plain(stages["near_duplicates"](spark, df, d))
    worded = [(k, t) for k, (_, t) in enumerate(rows) if t and t.strip()]
    group = {rows[k][1]: c for k, c, *_ in slow_groups(worded)}
    assert sorted(group[t] for _, t in one if t in group) == sorted(set(group.values()))
    assert sum(not (t or "").strip() for _, t in one) == sum(not (t or "").strip() for _, t in rows)
    clean = plain(stages["decontamination"](spark, df, d))
    assert clean == sorted(((i, t) for i, t in rows if not slow_hits(t, items)[-1]), key=repr) and len(clean) < len(rows)
    tok = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    assert by_rows(stages["bpe"](spark, df, d), "doc_id", "n_tokens") == sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame_([]), d).count() == 0

