"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import itertools
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from latticework.llm import jaccard, simhash


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows):
    group = {i: i for i in range(len(rows))}
    for (i, (_, s)), (j, (_, t)) in itertools.combinations(enumerate(rows), 2):
        a, b = grams(s), grams(t)
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()}
    return {min(rows[k][0] for k, g in group.items() if g == x) for x in group.values()}


def test_near_dedup_stage_finds_five_word_similarity(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \n", "one two", "One  two"]
    for size in (12, 40, 120, 400):
        for changes in (0, 1, 2, 4, 8, 12):
            first = [word() for _ in range(size)]
            copy = list(first)
            for at in rng.sample(range(size), min(changes, size)):
                copy[at] = word()
            texts += [" ".join(first), " ".join(copy)]
    chain = [word() for _ in range(90)]  # neighbours are similar, the ends aren't
    for step in range(6):
        texts.append(" ".join(chain))
        chain[3 + 14 * step] = word()
    texts += ["common words stand in front of all " + " ".join(word() for _ in range(30)) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).repartition(3)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    want = kept_by_brute_force(rows)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert {r["doc_id"] for r in simhash.without_duplicates(docs).select("doc_id").collect()} - want  # three bits leave near copies
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_bucket_joins_what_its_balls_join():
    """A pair meets if its kept bits differ in at most two places, and is joined if it is within reach; no pair else is."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, (300, jaccard.WORDS), dtype=np.uint64)
    for i in range(100, 300):  # near ones
        fps[i] = fps[i % 100]
        for bit in rng.integers(0, 64 * jaccard.WORDS, rng.integers(0, 60)):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    fps[200:, 2] = fps[200, 2]  # one large run in the table that keeps bits of this word
    for block in (0, 7, 24):
        bits = jaccard.kept_bits(fps, block)
        flat = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, block * jaccard.KEPT : (block + 1) * jaccard.KEPT]
        assert (bits == flat.astype(np.uint64) @ (np.uint64(1) << np.arange(jaccard.KEPT, dtype=np.uint64))).all()
        buckets = {}
        for i, x in enumerate(bits.tolist()):
            high, low = x >> jaccard.LOW, x & int(jaccard._MASK)
            for flip in (0, *(1 << b for b in range(jaccard.HIGH))):
                buckets.setdefault(high ^ flip, []).append((low | int(jaccard._MARK) * bool(flip), i))
        got = []
        for rows in buckets.values():
            low, at = np.array([r[0] for r in rows], np.uint16), np.array([r[1] for r in rows])
            a, b = jaccard.met(low, fps[at, :2], at.astype(np.int64), jaccard.REACH)
            assert a.size < at.size
            got += zip(a.tolist(), b.tolist())
        meets = np.bitwise_count(bits[:, None] ^ bits) <= 2
        near = np.bitwise_count(fps[:, None, :2] ^ fps[:, :2]).sum(axis=2) <= jaccard.REACH
        want = [(i, j) for i, j in zip(*np.nonzero(meets & near)) if i < j]
        tops = [dict(zip(y.tolist(), x.tolist())) for x, y in (jaccard.forest(*np.array(p, np.int64).T) for p in (got, want))]
        assert tops[0] == tops[1] and len(tops[0]) > 20


def test_pairs_of_similarity_four_fifths_meet():
    rng = np.random.default_rng(6)
    for own, both, tables, reach in ((0, 4, jaccard.SMALL_TABLES, jaccard.SMALL_REACH), (2, 16, jaccard.TABLES, jaccard.REACH), (20, 160, jaccard.TABLES, jaccard.REACH)):
        missed = 0
        for _ in range(1000):
            h = rng.integers(-(1 << 63), 1 << 63, both + 2 * own + (not own), dtype=np.int64)
            x, y = (h[:both], h) if not own else (h[: both + own], np.r_[h[:both], h[both + own :]])
            assert jaccard.DOWN * both == jaccard.UP * h.size
            fps = np.stack([jaccard.fingerprint(x), jaccard.fingerprint(y)])
            meets = any(np.bitwise_count(np.bitwise_xor(*jaccard.kept_bits(fps, t))) <= 2 for t in range(tables))
            missed += not (meets and np.bitwise_count(fps[0, :2] ^ fps[1, :2]).sum() <= reach)
        assert missed <= 4, (both, missed)


def test_large_groups_of_near_copies_are_not_paired(spark, monkeypatch):
    """Tables stay in proportion to the texts where hundreds are near each other and not similar; parts of a group lose no link."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(146)]
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        for at in range(10 + i % 9, 146, 34 if i % 4 else 70):  # one in four is similar to the base
            copy[at] = f"v{i}x{at}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counts, write = [], jaccard.written

    def counted(df, name):
        told = write(df, name)
        counts.append((name, told[0].count()))
        return told

    monkeypatch.setattr(jaccard, "written", counted)
    want = sorted(kept_by_brute_force(rows))
    for part in (jaccard.PART, 60):
        monkeypatch.setattr(jaccard, "PART", part)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == want
    # in the first tables a text gives a link for each of its variants at most, later ones join what these left
    assert 100 < len(want) < 390 and max(n for _, n in counts) <= 12 * len(rows), counts
