"""Level-wise substring dedup, NRA search and fill-in-the-middle against brute force, with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentry.llm import fill_middle, level_dedup, nra_search
from incidentry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _k0 string, _known string, value long, unit string, query string, rank int"
PAD = ("x", "y", 5, "u", "q", 1)


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *PAD) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["thé", "of", "tion", "er", "and", "ingly", "shth", "Of", "1a"]) for _ in range(n))


# -- level-wise substring dedup ----------------------------------------------------------------------------------------

def brute_windows(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(w), int(gone.sum()), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def window_cases():
    rng = random.Random(3)
    passage, long = prose(rng, 90), prose(rng, 900)
    once = prose(rng, 200)
    texts = [None, "", "  \n ", "a", "a " * 35, "a " * 36, "b " * 500, passage, long, long, long.replace(" ", "\n"),
             long[:1500] + " new " + long[1500:], once, once + " " + prose(rng, 60) + " " + once, " " + passage,
             prose(rng, 34), prose(rng, 35)]
    words = passage.split()
    for i in range(40):
        a = rng.randint(0, 50)
        texts.append(" ".join([prose(rng, rng.randint(0, 60)), *words[a:a + rng.randint(20, 60)],
                               prose(rng, rng.randint(0, 60))]))
    return texts + texts[20:24]


@pytest.mark.parametrize("length", [35, 4, 1])
def test_windows_equal_brute_force(spark, length):
    texts = window_cases()
    got = level_dedup.remove_repeated_windows(table(spark, texts, [i % 50 for i in range(len(texts))]), length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "n_spans", "kept"]
    want = [(i % 50, *w) for i, w in enumerate(brute_windows(texts, length))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_windows_of_long_texts_in_pieces(spark, monkeypatch):
    """Pieces and slices much smaller than a text, and many texts that share one passage, change nothing."""
    monkeypatch.setattr(level_dedup, "PIECE_WORDS", 50)
    monkeypatch.setattr(level_dedup, "SLICE_BYTES", 700)
    texts = window_cases()
    got = level_dedup.remove_repeated_windows(table(spark, texts), 35).collect()
    assert sorted(tuple(r) for r in got) == [(i, *w) for i, w in enumerate(brute_windows(texts, 35))]


def test_windows_edges(spark):
    assert level_dedup.remove_repeated_windows(table(spark, [])).collect() == []
    nulls = level_dedup.remove_repeated_windows(table(spark, [None, "", None], [None, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in nulls) == [
        ("1", 0, 0, ""), ("None", 0, 0, ""), ("None", 0, 0, "")]
    assert level_dedup.level_lengths(35) == [9, 18, 35] and level_dedup.level_lengths(1) == [1]


def test_each_level_looks_only_at_what_repeated_before():
    """Candidates shrink level by level, and every repeated window is among those of the last."""
    texts = [t for t in window_cases() if t]
    levels = level_dedup.level_lengths(35)
    pieces = list(level_dedup._pieces(texts, 35))
    words = level_dedup.Words([p[2] for p in pieces])
    repeated, found = np.zeros(0, np.uint64), []
    for level, length in enumerate(levels):
        at = level_dedup.candidates(words, levels, level, repeated)
        digests, counts = np.unique(words.digests(at, length), return_counts=True)
        repeated = digests[counts > 1]
        found.append(at)
    starts, anchors = words.windows(35, 9)
    assert len(found[0]) < len(starts) / 4 and set(found[0]) == set(anchors)
    assert len(found[2]) < len(starts)
    seen = Counter(words.digests(starts, 35).tolist())
    wanted = {int(s) for s, d in zip(starts, words.digests(starts, 35).tolist(), strict=True) if seen[d] > 1}
    assert wanted <= set(found[2].tolist())


def test_a_passage_of_a_third_of_the_rows_stays_spread(spark):
    """The window of a hot passage leaves a slice once; rows that know their answer are dealt over many groups."""
    rng = random.Random(1)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 40)} {passage} {i} {prose(rng, 40)}" if i % 3 == 0 else prose(rng, 90) for i in range(600)]
    got = {r.doc_id: r for r in level_dedup.remove_repeated_windows(table(spark, texts)).collect()}
    for i, (n, gone, spans, kept) in enumerate(brute_windows(texts, 35)):
        assert (got[i].n_words, got[i].n_removed, got[i].n_spans, got[i].kept) == (n, gone, spans, kept)


def test_texts_are_shuffled_once(spark, capsys):
    level_dedup.remove_repeated_windows(table(spark, window_cases())).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") >= 4 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# -- NRA search --------------------------------------------------------------------------------------------------------

def brute_search(texts, ids, items, top):
    def terms(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
    docs = [Counter(terms(t)) for t in texts]
    n_docs = sum(bool(d) for d in docs)
    total = sum(sum(d.values()) for d in docs)
    df = Counter(w for d in docs for w in d)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in queries.items():
        scored = []
        for ident, d in zip(ids, docs, strict=True):
            n, score = sum(d.values()), 0
            for t in ts & set(d):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // total
                score += w * ((1000000000 * d[t]) // (1000 * d[t] + 20 * m))
            if score > 0:
                scored.append((-score, ident is not None, ident or 0, ident))
        out += [(item, i + 1, ident, -s) for i, (s, _, _, ident) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def search_cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "é", "ñandú", "a-b", "X1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [None, "", " -- ", "w0", "W0 w0", "ﬀ ﬀ", "a\x00b w3"]
    texts += [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(400)]
    texts += texts[50:80] + ["w7 " * 5000]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    return texts, items + [(3, "w100 w0"), (90, None), (91, ""), (92, "nowhere"), (None, "w5 É"), (93, "w0 W0 w0")]


@pytest.mark.parametrize("docs_a_shard,depth,top", [(8192, 128, 50), (32, 1, 10), (64, 2, 1)])
def test_search_equals_brute_force(spark, monkeypatch, docs_a_shard, depth, top):
    monkeypatch.setattr(nra_search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(nra_search, "FIRST_DEPTH", depth)
    texts, items = search_cases()
    ids = [None if i == 60 else i % 390 for i in range(len(texts))]
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, _id string")
    got = nra_search.search(table(spark, texts, ids), queries, top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(texts, ids, items, top)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(nra_search, "BLOCK_BYTES", 400)
    texts, items = search_cases()
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = nra_search.search(table(spark, texts), queries, 5).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_search(texts, range(len(texts)), items, 5)


def test_search_edges(spark):
    queries = spark.createDataFrame([(1, "w0")], "item_id long, text string")
    assert nra_search.search(table(spark, []), queries).collect() == []
    assert nra_search.search(table(spark, [None, "", "--"]), queries).collect() == []
    assert nra_search.search(table(spark, ["w0"]), queries.limit(0)).collect() == []


def test_reading_stops_before_the_lists_end():
    """With one clear winner a shard does not read its long lists to the end, and still gives the exact score."""
    size = 4096
    places = np.concatenate((np.arange(size), [7]))
    terms = np.concatenate((np.zeros(size, np.int64), [1]))
    adds = np.concatenate((np.arange(size, 0, -1), [10**6]))
    shard = nra_search.Shard(places, terms, adds, size, 2)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return super().__getitem__(key)
    shard.places = shard.places.view(Counted)
    at, score = shard.nra([0, 1], 1)
    assert at.tolist() == [7] and score.tolist() == [10**6 + size - 7]
    assert sum(reads) < size


# -- fill in the middle ------------------------------------------------------------------------------------------------

def brute_fim(ident, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_cases():
    rng = random.Random(11)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x <P> y\nz", "<S>", "q<M>", "< P>\n<S\n>M>\n", "ñ é\r\nß\u0085z\n",
             "a\x0bb\x0cc\n\U0001F600\n\U0001F600", "no end", "tab\there\n" * 3000]
    texts += ["".join(rng.choice(["ab ", "\n", "é", "<", "P>", ".", "1"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return texts


@pytest.mark.parametrize("slice_chars", [1_000_000, 50])
def test_fill_in_middle_equals_brute_force(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(fill_middle, "SLICE_CHARS", slice_chars)
    texts = fim_cases()
    ids = [None if i == 40 else i % 200 for i in range(len(texts))]
    got = fill_middle.fill_in_middle(table(spark, texts, ids))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(r)[:6] for r in back], key=str) == sorted(
        [(i, *brute_fim(i, t)) for i, t in zip(ids, texts, strict=True)], key=str)
    assert sorted(r.back for r in back) == sorted(t or "" for t in texts)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_fill_in_middle_rates_units_and_edges(spark):
    texts = fim_cases()
    plain = fill_middle.fill_in_middle(table(spark, texts), rate=0).collect()
    assert {r.form for r in plain} == {"plain"} and sorted(r.output for r in plain) == sorted(t or "" for t in texts)
    words = {r.doc_id: r.n for r in fill_middle.fill_in_middle(table(spark, ["a b  c", "ab ", ""]), unit="word").collect()}
    assert words == {0: 4, 1: 1, 2: 0}  # every space ends a unit, "c" is an open one
    chars = fill_middle.fill_in_middle(table(spark, ["añ\n😀"]), unit="character").first()
    assert chars.n == 4
    assert fill_middle.fill_in_middle(table(spark, [])).collect() == []


def test_wavelet_ranks_and_select():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 8, 500).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(classes)
    places = np.arange(501)
    for kind in range(8):
        assert (matrix.rank(kind, places) == np.concatenate(([0], np.cumsum(classes == kind)))).all()
    assert (matrix.count((1, 5), places) == np.concatenate(([0], np.cumsum(np.isin(classes, (1, 5)))))).all()
    ends = np.flatnonzero(classes == 3)
    nth = np.arange(len(ends) + 2)
    got = matrix.after((3,), nth, np.zeros(len(nth), np.int64), np.full(len(nth), 500))
    assert got.tolist() == [0, *(ends + 1).tolist(), 500]


# -- the registered queries --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_level_substring_dedup", "op12_nra_search", "op13_wavelet_fill_middle"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want.fetchall(), key=str)
