"""The pipeline's near-dedup stage against all pairs at five-word Jaccard similarity 0.8."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import near_dups


def brute_sets(texts):
    out = []
    for t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_kept(rows):
    """Rows (id, text) that stay: one of each component, that of the smallest id."""
    sets = brute_sets(t for _, t in rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a == b or both and 5 * both >= 4 * (len(a) + len(b) - both):
                close += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    gone = {i for k, (i, _) in enumerate(rows) if i is not None and i != least[find(k)]}
    return sorted((r for r in rows if r[0] not in gone), key=repr), close


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(10**9)}"
    return words


@pytest.mark.parametrize("hot, block, bits", [(2, 4, 1 << 10), (32, 4096, 1 << 25)])
def test_all_pairs_at_the_threshold(spark, monkeypatch, hot, block, bits):
    monkeypatch.setattr(near_dups, "HOT", hot)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "FILTER_BITS", bits)
    rng = np.random.default_rng(8)
    shared = [f"common{i}" for i in range(40)]
    texts = [None, "", " \n", "three short words", "Three  short words", "other short words"]
    for f in range(25):
        base = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(20, 300)))] + shared * (f % 2)
        texts += [" ".join(edited(rng, base, int(len(base) * rng.uniform(0, 0.05)))) for _ in range(5)]
    dense = [f"d{rng.integers(3000)}" for _ in range(120)]
    texts += [" ".join(edited(rng, dense, int(rng.integers(0, 6)))) for _ in range(60)]
    rows = [(i if i != 20 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, close = brute_kept(rows)
    got = near_dups.drop_near_duplicates(frame)
    assert close > 300 and got.columns == ["doc_id", "text"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == want
    assert near_dups.near_components(frame.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each_component(spark, sf_dir, monkeypatch):
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    rows = [(r["doc_id"], r["text"]) for r in seen["near-dedup"].collect()]
    want, _ = brute_kept(rows)
    assert len(want) < len(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in seen["packing"].collect()), key=repr) == want


def alike(seed, n, words=110, changes=2):
    """Near copies of one text, each similar enough to few of the others."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    return [" ".join(edited(rng, base, changes)) for _ in range(n)]


def counted(spark, monkeypatch, texts):
    """The rows that stay, and how many candidate pairs the rounds made."""
    pairs, before = [], near_dups.cut

    def watched(frame, tag):
        done = before(frame, tag)
        if tag == "near-found":
            pairs.append(done.count())
        return done

    monkeypatch.setattr(near_dups, "cut", watched)
    rows = list(enumerate(texts))
    got = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    monkeypatch.setattr(near_dups, "cut", before)
    return kept, sum(pairs)


def test_candidates_of_a_loose_group_do_not_grow_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 128)
    made = {}
    for n in (200, 800):
        texts = alike(3, n)
        kept, made[n] = counted(spark, monkeypatch, texts)
        assert kept == brute_kept(list(enumerate(texts)))[0]
    assert made[800] < 800 * 799 / 2 / 50 and made[800] < 12 * max(made[200], 200)


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for size in (1, 5, 900, 1024, 1025, 5000, 70_000):
        a = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        for share in (0.0, 0.05, 0.2):
            b = np.unique(np.concatenate([a[int(len(a) * share) :], rng.integers(0, 1 << 64, int(size * share * 0.7), np.uint64)]))
            x, y = near_dups.sketch(a), near_dups.sketch(b)
            for width in (min(len(x), len(y)), near_dups.SKETCH // 8):
                differ = near_dups.unlike(*(near_dups.folded(c, width).view(np.uint64) for c in (x, y)))
                assert differ <= len(np.setxor1d(a, b))
            assert len(x) * 8 >= min(len(a), near_dups.SKETCH_MOST) and len(near_dups.folded(x, 128)) == 128
    assert not near_dups.sketch(np.zeros(0, np.uint64)).any()
