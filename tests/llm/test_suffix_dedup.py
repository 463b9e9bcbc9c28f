"""Suffix-array dedup against brute force over all strings, with edge cases and split anchors."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from incidentry.llm import suffix_dedup
from incidentry.llm.queries import QUERIES
from incidentry.llm.suffix_dedup import anchors, common_prefixes, remove_repeats, suffix_ranks


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i:i + length]) for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone, end = np.zeros(len(b), bool), 0
        for i in range(len(b) - length + 1):
            if seen[hash(b[i:i + length])] > 1:
                gone[max(end, i):i + length] = True
                end = i + length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in df.collect())


def cases(rng):
    def prose(n):
        return " ".join(rng.choice(["thé", "of", "tion", "er", "and", "ingly", "shth"]) for _ in range(n))
    passage, long = prose(60), prose(900)
    texts = [None, "", "x" * 10, "a" * 500, "ab" * 400, passage, long, long, long[:1000] + prose(50) + long[1000:2500]]
    for i in range(40):
        a = rng.randint(0, 100)
        texts.append(prose(rng.randint(0, 80)) + passage[a:a + rng.randint(50, 300)] + prose(rng.randint(0, 80)))
    texts += [prose(50) + long[i * 37:i * 37 + 130 + i] + prose(30) for i in range(30)]
    return texts


def test_suffix_ranks_and_kasai_equal_sorting():
    rng = random.Random(0)
    text = np.frombuffer("".join(rng.choice(["ab", "abc", "b"]) for _ in range(400)).encode(), np.uint8)
    raw = text.tobytes()
    for depth in (8, 32, 128):
        keys = [raw[i:i + depth].ljust(depth, b"\0") for i in range(len(raw))]
        want = np.array([sum(x < k for x in keys) for k in keys])
        assert (suffix_ranks(text, depth) == want).all()
    order = np.array(sorted(range(len(raw) - 64), key=lambda i: raw[i:i + 64]))
    runs = np.stack([np.arange(0, 300, 2), np.where(np.arange(0, 300, 2) < 290, np.arange(0, 300, 2) + 1, -1)], axis=1)
    got = common_prefixes(text, order, runs, 64)
    for place in range(1, len(order)):
        i, j = order[place - 1], order[place]
        if j in runs:
            want = next((k for k in range(64) if raw[i + k] != raw[j + k]), 64)
            assert got[place] == want


def test_every_string_has_an_anchor_with_half_of_it_to_the_right():
    rng = random.Random(1)
    data = "".join(rng.choice("abc ") for _ in range(5000)).encode() + b"z" * 300
    got = anchors(data, 100)
    for p in range(len(data) - 99):
        assert ((got >= p) & (got <= p + 50)).any()
    assert len(got) < 0.12 * len(data) and len(anchors(b"x" * 99, 100)) == 0


@pytest.mark.parametrize("shard", [2048, 7])
def test_removal_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", shard)
    texts = cases(random.Random(shard))
    ids = [None if i == 5 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)],
                               "doc_id long, text string, kept string, k1 int").repartition(3)
    for length in (64, 100):
        want = sorted((str(i), *w) for i, w in zip(ids, brute(texts, length), strict=True))
        assert digest(remove_repeats(df, length)) == want
    assert remove_repeats(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("shards", [2, 16, 200])
def test_merged_spans_hold_about_one_shard(shards):
    per_shard = 4000
    rng = np.random.default_rng(shards)
    held = Counter()
    for _ in range(shards):
        own = np.unique(rng.integers(1, 2**64 - 1, per_shard, np.uint64))
        dealt = suffix_dedup.merge_spans(own, shards)
        assert (np.concatenate([x for _, x in dealt]) == own).all()
        for span, x in dealt:
            held[span] += len(x)
    assert max(held.values()) < 1.2 * per_shard


def test_digests_of_a_hot_anchor_spread_over_the_spans(spark, monkeypatch):
    """One passage under 600 surroundings, in shards of 4 (150 of them): a merge sees about one shard's digests."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 4)
    seen, span_of = spark.sparkContext.accumulator(0), suffix_dedup.merge_spans
    per_span = [spark.sparkContext.accumulator(0) for _ in range(200)]

    def counted(own, parts):
        dealt = span_of(own, parts)
        for span, x in dealt:
            per_span[span].add(len(x))
        seen.add(len(own))
        return dealt

    monkeypatch.setattr(suffix_dedup, "merge_spans", counted)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(50))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(150)) + passage
             + "".join(rng.choice("qrstuvwx ") for _ in range(150)) for _ in range(600)]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((str(i), *w) for i, w in enumerate(brute(texts, 64)))
    assert digest(remove_repeats(df, 64)) == want
    held = [a.value for a in per_span if a.value]
    assert len(held) > 16 and max(held) < 4 * seen.value / len(held)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs], 400), strict=True))
    got = QUERIES["op6_suffix_array_dedup"](spark, sf)
    assert sorted(map(tuple, got.drop("kept").collect())) == want
    assert got.where("n_removed = 0 AND sha2(kept, 256) <> kept_sha256").count() == 0
