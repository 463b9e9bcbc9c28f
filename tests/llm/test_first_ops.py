"""Exact dedup, mixing, packing, token files and SimHash groups against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from incidentry.llm import exact_dedup as exact
from incidentry.llm import mixing, simhash
from incidentry.llm.packing import pack_documents, pack_pieces
from incidentry.llm.queries import ORACLES, QUERIES
from incidentry.llm.token_files import read_token_files, token_digest, write_token_files
from incidentry.llm.tokens import Encoder, load_tokenizer
from incidentry.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _row_pos int, rate string"
WORDS = "the of and tion er re in th an es on at".split()


def edge_rows():
    rng = random.Random(7)
    prose = [" ".join(rng.choices(WORDS, k=n)) for n in (3, 40, 40, 900)]
    long = " ".join(rng.choices(WORDS, k=30000))
    texts = [None, "", "   ", "\n\t", prose[0], prose[0].upper(), prose[1], prose[1], prose[2], prose[3], long, long,
             "É" + prose[1], "é" + prose[1], "İstanbul ß ﬀ  x", "a b   c", "<|endoftext|> x", "one two", "one"]
    out = [(i, t, "en", f"s{i % 3}", 1, "x", 5, "r") for i, t in enumerate(texts)]
    out += [(4, prose[0], None, None, None, None, None, None)] * 2 + [(None, prose[1], None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def duck(name, sf=SF):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    return con.sql(ORACLES[name])


# -- exact dedup -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_edges(edge, digest_all):
    got = exact.exact_dedup(edge, digest_all=digest_all).collect()
    groups = defaultdict(list)
    for r in edge_rows():
        groups[fold(r[1])].append(r[0])
    assert len(got) == len(edge_rows())
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = defaultdict(int)
    for r in got:
        if r.text_sha256 is None:
            assert not digest_all and r.group_size == 1 and r.kept and r.keep_id == r.doc_id
            continue
        ids = by_digest[r.text_sha256]
        top = max([i for i in ids if i is not None], default=None)
        assert (r.keep_id, r.group_size) == (top, len(ids))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == top
    assert set(kept.values()) == {1}


def test_exact_dedup_stage(edge, empty):
    out = exact.drop_exact_copies(edge)
    assert out.columns == edge.columns
    assert sorted(fold(r.text) for r in out.collect()) == sorted({fold(r[1]) for r in edge_rows()})
    assert exact.drop_exact_copies(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_group_joins_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("incidentry.llm.common.BROADCAST_ROWS", 0)
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Hot', concat('t', id)) AS text")
    got = exact.exact_dedup(df)
    assert got.where("kept").count() == 2001
    assert got.where("NOT kept AND keep_id = 2997 AND group_size = 1000").count() == 999


@pytest.mark.parametrize("name", ["op7_progressive_exact_dedup", "op3_source_mixing"])
def test_queries_equal_sql(spark, name):
    got = QUERIES[name](spark, SF)
    want = duck(name)
    cols = want.columns
    assert sorted(got.columns) == sorted(cols)

    def norm(rows):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.fetchall())


# -- mixing ------------------------------------------------------------------------------------------------------------

def water_fill(sizes, weights, cap):
    total, capped = sum(sizes), set()
    while True:
        share = (total - sum(cap * sizes[i] for i in capped)) / (sum(w for i, w in enumerate(weights) if i not in capped)
                                                                  or 1)
        now = {i for i in range(len(sizes)) if weights[i] * share >= cap * sizes[i]}
        if now == capped:
            return [min(cap * s, w * share) for s, w in zip(sizes, weights, strict=True)]
        capped = now


def test_source_rates_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 5, "é": 3000, "z": 0, None: 700}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(df).collect()}
    order = ["a", "b", "c", "d", "z", "é", None]
    want = dict(zip(order, water_fill([sizes[s] for s in order], [5, 2, 1, 5, 2, 1, 5], 3.0), strict=True))
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixing_edges(edge, empty):
    got = mixing.mix_plan(edge).collect()
    assert len(got) == len(edge_rows())
    words = {(r[0], r[3]): len([w for w in _words(r[1])]) for r in edge_rows()}
    assert all(r.size in words.values() and r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    mixed = mixing.mix_sources(edge)
    assert mixed.columns == edge.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(edge.repartition(5)).collect()))


def _words(t):
    return (t or "").encode().split()


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 50 as int)) AS text",
                                       "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    got = mixing.mix_plan(df).join(df, "doc_id").groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert len(got) == 8 and all(abs(r[2] - r.target) < 0.1 * r.target for r in got)


# -- packing -----------------------------------------------------------------------------------------------------------

def test_pack_pieces_balances_and_fills():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    placed, n = pack_pieces(lengths, 100)
    assert n == -(-sum(lengths) // 100)
    fill, seen = defaultdict(int), defaultdict(int)
    for piece, start, length, where, offset in placed:
        assert fill[where] == offset and seen[piece] == start
        fill[where] += length
        seen[piece] += length
    assert max(fill.values()) <= 100 and [seen[i] for i in range(500)] == lengths
    cost = defaultdict(float)
    equal, _ = pack_pieces([50] * 10 + [25] * 20 + [10] * 50, 100)
    for _, _, length, where, _ in equal:
        cost[where] += length * length
    assert max(cost.values()) < 2.5 * min(cost.values())


def test_packing_edges(edge, empty):
    got = pack_documents(edge).collect()
    tok = load_tokenizer("byte_bpe_50k.json")
    whole = sorted(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
                   for r in edge_rows())
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    joined = sorted(b"".join(x[1] for x in sorted(v)) for k, v in docs.items() if k[0] not in (4, None))
    assert all(j in whole for j in joined)
    assert sum(len(x[1]) for v in docs.values() for x in v) == sum(map(len, whole))
    assert pack_documents(empty).count() == 0


def test_query_packs_every_id_with_little_padding(spark):
    got = QUERIES["op1_cost_balanced_packing"](spark, SF).toPandas()
    per = got.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (per.n == per.t).all()
    fill = got.groupby("sequence_id").length.sum()
    assert (fill <= 2048).all() and (2048 * len(fill) - fill.sum()) < 0.03 * fill.sum()


# -- tokens ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_text_encoding(spark, name):
    texts = [r[1] or "" for r in edge_rows()]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    alphabet = list("ab'sStéÉ ,.!<|>0 1²\n\t\r\x0b\x0c\x1c\x85  　​́Σς  ")
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    plain = list("abcDEf 'strevmdl 1 23.,;:!?\n\t\r  ßÄéÈñ«»¿’“—…őŞſșŸÐ¤§·")
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(6000)]
    assert Encoder(name).rule is not None
    tok = load_tokenizer(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(name).encode(texts) == want


def test_token_files_edges(spark, edge, empty):
    path = scratch_path(spark, "test-token-files")
    write_token_files(edge, path)
    files = read_token_files(spark, path)
    tok = load_tokenizer("word_bpe_49k.json")
    want = sorted(((-1 if r[0] is None else r[0]), tok.encode(r[1] or "", add_special_tokens=False).ids + [2])
                  for r in edge_rows())
    read = files.orderBy("part", "row").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in read) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in read] == [w[0] for w in want]
    assert files.where("doc_id = 10").count() == 1
    got = sorted(token_digest(files).collect(), key=lambda r: r.start)
    at = 0
    for r, ids in zip(got, read, strict=True):
        raw = np.array(ids.ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (ids.doc_id, at, len(ids.ids), zlib.crc32(raw))
        at += r.n_tokens
    path = scratch_path(spark, "test-token-files")
    write_token_files(empty, path)
    assert token_digest(read_token_files(spark, path)).count() == 0


# -- SimHash -----------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    import xxhash
    w = fold(text).encode().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius=3):
    """prints: list of (id, fingerprint) -> component id per position."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                label[find(i)] = find(j)
    comp = defaultdict(list)
    for i, (ident, _) in enumerate(prints):
        comp[find(i)].append(ident)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in comp.items()}
    return [least[find(i)] for i in range(len(prints))]


def test_masks_cover_every_set_within_the_radius():
    masks = simhash.covering_masks(3, list(range(64)))
    rng = random.Random(0)
    assert len(masks) == 15 and all(30 <= m.bit_count() <= 36 for m in masks)
    for _ in range(20000):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)


def test_simhash_edges(edge, empty):
    rows = edge_rows()
    want = sorted((str(r[0]), f"{fp:016x}", str(c)) for r, fp, c in zip(
        rows, [plain_fingerprint(r[1]) for r in rows],
        brute_components([(r[0], plain_fingerprint(r[1])) for r in rows]), strict=True))
    got = simhash.simhash_groups(edge)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    out = simhash.drop_near_copies(edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({int(c) for _, _, c in want})
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.simhash_groups(empty).count() == 0


def test_query_simhash_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted(map(tuple, QUERIES["op4_simhash_covering"](spark, SF).collect())) == want


def test_fingerprint_links_split_crowded_buckets(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(900)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    for limit in (8192, 40):
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        links = simhash.fingerprint_links(df, 3).collect()
        index = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
        label = list(range(len(prints)))

        def find(i):
            while label[i] != i:
                i = label[i]
            return i
        for r in links:
            a, b = sorted((find(index[r.a]), find(index[r.b])))
            label[b] = a
        assert [find(i) for i in range(len(prints))] == want


def test_connected_components_of_chains_and_stars(spark):
    from incidentry.llm.graph import connected_components
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5, -9), (-9, -5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {-5: -9, -9: -9}
    assert got == want
