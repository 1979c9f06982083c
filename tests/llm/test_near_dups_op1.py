"""The near-dedup stage takes its first candidates from op1's fingerprints and checks each."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from barloom.llm import near_dups, simhash
from tests.llm.test_near_dups import brute_kept, edited


def test_first_candidates_are_those_of_op1(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(30):
        base = [f"w{rng.integers(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(edited(rng, base, 12))]
    # Equal three-word shingles and fingerprints, but other shingles of five words: op1 links them, the exact check does not.
    x, y, a, b, c = ([f"{n}{i}" for i in range(k)] for n, k in (("x", 2), ("y", 2), ("a", 3), ("b", 3), ("c", 3)))
    texts += [" ".join(x + a + x + b + x + c + x), " ".join(x + b + x + a + x + c + x), " ".join(y)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0]), (501, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    tables, before = [], near_dups.cut

    def watched(part, tag):
        done = before(part, tag)
        if tag in ("near-found", "near-links"):
            tables.append((tag, {(r["u"], r["v"]) for r in done.collect()}))
        return done

    monkeypatch.setattr(near_dups, "cut", watched)
    got = corpus_pipeline.near_duplicates(spark, frame, "")
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == brute_kept(rows)[0]

    node = [near_dups.node_of(near_dups.shingle_set(t, near_dups.WIDTH, near_dups.WordHashes())) for t in texts]
    group = {r["id"]: r["component_id"] for r in simhash.simhash_components(frame).collect()}
    proposed, linked = tables[0][1], tables[1][1]
    want = {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if group[i] == group[j] and node[i] != node[j]}
    assert tables[0][0] == "near-found" and len(proposed) > 20
    assert proposed <= want and {n for p in want for n in p} == {n for p in proposed for n in p}
    false = tuple(sorted((node[90], node[91])))
    assert false in proposed and false not in linked and linked < proposed
