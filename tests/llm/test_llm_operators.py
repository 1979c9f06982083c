"""Training-data operators against brute force on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bpe, embedding_dedup, graph, licenses, near_dups, packing, quality_classifier, quality_rules, records, sharding, simhash, textstats, warc
from barloom.llm.tokens import encoder, public_vocabulary
from barloom.runtime import fresh_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(9000))
TEXTS = [
    (1, "Released under the MIT License.\nThe quick brown fox jumps over the lazy dog again and again."),
    (2, "Released under the MIT License.\nThe quick brown fox jumps over the lazy dog again and again."),
    (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + " end"), (8, "x" * 70_000), (9, "Ünïcode ß 日本語 😀\r\n\r\n\n  a\x00b <|endoftext|> tail"),
    (10, "same line\nsame line\nsame line\nother"), (None, "no id here"), (12, "Licensed under CC BY-NC 4.0."), (12, "repeated id"),
    (13, "cc by nc cc by nc apache license version 2"), (14, "a b c a b c a b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those the operators make."""
    rows = [(i, t, "en", None, 0, "x", 1.0, -1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, row long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, key="id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- graph, simhash -----------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 6), (7, 6)]
    found = dict(rows_of(graph.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5))))
    assert found == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 160)}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_are_shared_within_three_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for i, n in enumerate(rng.integers(0, 4, 3000)):
        for bit in rng.choice(64, n, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ra, ka = simhash.golay_keys(a)
    rb, kb = simhash.golay_keys(b)
    assert {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))} == set(range(3000))


def test_simhash_components(docs, none):
    got = {(r["id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in simhash.simhash_components(docs).collect()}
    prints = [(i, brute_print(t)) for i, t in TEXTS]
    assert set(got) == set(prints)
    root = list(range(len(prints)))
    for _ in prints:
        for x, (_, p) in enumerate(prints):
            for y, (_, q) in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    root[x] = root[y] = min(root[x], root[y])
    for x, (i, p) in enumerate(prints):
        ids = [j for y, (j, _) in enumerate(prints) if root[y] == root[x] and j is not None]
        assert got[i, p] == (min(ids) if ids else None)
    assert simhash.simhash_components(none).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_dense_family_links_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    center = 0x0123456789ABCDEF
    values = sorted({center} | {center ^ (1 << i) for i in range(40)} | {center ^ (3 << i) for i in range(40)})
    frame = spark.createDataFrame([(v if v < 2**63 else v - 2**64,) for v in values], "fp long")
    found = graph.connected_components(simhash.fingerprint_links(frame))
    assert found.count() == len(values) and found.select("root").distinct().count() == 1


# -- licenses -----------------------------------------------------------------


def test_licenses(docs, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    above = licenses.longer(licenses.TEMPLATES)
    want = []
    for i, t in TEXTS:
        met = {}
        t = (t or "").translate(table)
        words, places, base = word.findall(t), [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    base.add(label)
        spaced = f" {' '.join(words)} "
        for number, (label, template) in enumerate(licenses.TEMPLATES):
            listed = re.findall("[0-9a-z]+", template.lower())
            own, step = set(listed), licenses.step_of(len(listed))
            if any(len(own & set(words[k : k + 2 * step])) >= math.ceil(licenses.THRESHOLD * len(own) - 1e-9) for k in range(0, len(words), step)):
                if any(all(f" {p} " in spaced for p in ps) for ps in licenses.KEYS[label]):
                    met[number] = label
        labels = base | {label for number, label in met.items() if not set(above[number]) & set(met)}
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))))
    got = rows_of(licenses.scan_licenses(docs))
    assert sorted((g[:7] for g in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= g[7] <= 1 for g in got)
    assert licenses.scan_licenses(none).count() == 0


def test_every_notice_has_its_own_label_only(spark):
    """Each template, alone and in other words; repeated ids keep the labels of their own texts."""
    texts = [*licenses.TEMPLATES, *((label, f"some words before\n{text}\nand more words after it, none of a license") for label, text in licenses.TEMPLATES)]
    texts += [
        ("", "This program is free software under version 3 of something else"), ("", "all the rights of the reserved kind"), ("", "the mit has a license under which released"),
        ("gpl-3,lgpl-3", "Licensed under the GNU General Public License, version 3. Parts are licensed under the GNU Lesser General Public License, version 3."),
        ("all-rights-reserved,bsd-3", dict(licenses.TEMPLATES)["bsd-3"] + " All rights reserved."), ("", None),
    ]
    rows = [(7, text) for _, text in texts]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at long")
    got = licenses.scan_licenses(df.withColumn("doc_id", F.col("at") % 3), templates=licenses.TEMPLATES)
    by_at = licenses.scan_licenses(df, id_col="at").collect()
    assert {r["id"]: r["labels"] for r in by_at} == {k: label for k, (label, _) in enumerate(texts)}
    assert sorted(r["labels"] for r in got.collect()) == sorted(label for label, _ in texts)


def test_wrapped_notices_are_found(spark):
    whole = {label: text for label, text in licenses.TEMPLATES}
    texts = ["// " + "\n// ".join(textwrap.wrap(" ".join(t.split()), 60)) for t in whole.values()]
    filler = " ".join(f"filler{i}" for i in range(3000))
    scattered = " ".join(f"{w} {filler}" for w in whole["mit"].split())
    rows = [*enumerate([f"{filler}\n{t}\n{filler}" for t in texts]), (100, filler), (101, scattered), (102, "Kelvin \u212aind \u0130t under the m\u0131t license")]
    got = {r["id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(whole):
        assert label in got[i]["labels"].split(","), label
    assert got[100]["labels"] == got[101]["labels"] == got[102]["labels"] == "" and got[102]["n_words"] == 7


# -- quality ------------------------------------------------------------------


def test_base_counts():
    s = textstats.TextStats("a b c a b c a b c")
    assert (s.n_words, s.n_repeat_words, s.word_chars) == (9, 9, 9)
    s = textstats.TextStats("x #|\n \nx #|\n<é>")
    assert (s.n_dup_lines, s.n_symbols, s.word_chars) == (1, 6, 9)
    words = [f"w{i % 7}" for i in range(100)] + ["z"]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(99) for d in range(3) if grams[tuple(words[k : k + 3])] > 1}
    assert textstats.TextStats(" ".join(words)).n_repeat_words == len(covered)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [f"{'plain' if good else 'junk'}{rng.integers(50)}" for _ in range(80)]
        rows.append((i, " ".join(words) + ("" if good else " || %%% !!" * 20)))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0), (9999, 1, 0), (7, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_rules(labelled, docs, none):
    train, labels = labelled
    model = quality_rules.fit_quality_model(train, labels, per_class=150)
    out = {r["id"]: r for r in quality_rules.judge(train, model).collect()}
    tested = [i for i in out if held(i)]
    assert sum(out[i]["probability"] >= 0.5 and i % 3 > 0 or out[i]["probability"] < 0.5 and i % 3 == 0 for i in tested) >= 0.95 * len(tested)
    awkward = quality_rules.judge(docs, model).collect()
    assert len(awkward) == len(TEXTS) and all(not r["kept"] for r in awkward if r["n_words"] < 50)
    assert quality_rules.judge(none, model).count() == 0
    assert quality_rules.keep_good(docs, model).columns == docs.columns
    twice = quality_rules.fit_quality_model(train.union(train).union(train.withColumn("text", F.concat("text", F.lit(" tail")))), labels, per_class=150)
    assert np.allclose(twice.weights, model.weights)
    unfit = quality_rules.fit_quality_model(train, labels.limit(0))
    assert all(r["probability"] > 0.99 for r in quality_rules.judge(docs, unfit).collect())


def test_quality_classifier(labelled, docs, none):
    train, labels = labelled
    model = quality_classifier.fit_classifier(train, labels)
    out = {r["id"]: r for r in quality_classifier.score_quality(train, model).collect()}
    assert all(r["held_out"] == held(i) for i, r in out.items())
    tested = [i for i in out if held(i)]
    assert sum((out[i]["score"] >= 0.7) == (i % 3 > 0) for i in tested) >= 0.95 * len(tested)
    assert len({out[i]["score"] for i in out}) > 200
    awkward = quality_classifier.score_quality(docs, model).collect()
    assert len(awkward) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in awkward)
    assert quality_classifier.score_quality(none, model).count() == 0
    assert all(r["score"] == 1 for r in quality_classifier.score_quality(docs, quality_classifier.fit_classifier(train, labels.limit(0))).collect())
    assert quality_classifier.keep_scored(docs, model).columns == docs.columns


def test_isotonic_steps_rise():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    steps = quality_classifier.pava(x, y, np.ones(300))
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(steps, steps[1:]))
    knots, values = quality_classifier.ranked_steps(steps, 300)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all() and values[0] == 0 and values[-1] == 1
    assert np.abs(np.interp(x, knots, values) - [next(m for lo, hi, m in steps if lo <= v <= hi) for v in x]).max() <= 0.011
    knots, values = quality_classifier.ranked_steps([(0.0, 0.0, 1.0)], 1)
    assert 0 < np.interp(0.0, knots, values) < 1


# -- tokens, packing, records -------------------------------------------------


def library(name, text):
    from barloom.llm.tokens import load

    return load(public_vocabulary(name)).encode(text or "", add_special_tokens=False).ids


AWKWARD = ["a  b", "a\n\nb", "a\n\n\nb", " \n", "x \n", "a\xa0 b", "a \xa0 b", "it's 'll", "<|endoftext|> a", "a <|endoftext|>b", "", " ", "\t\ta b", "a\t \tb", "a\x00b c", "a\x1cb", "a\r\nb", "日本 語\n"]


@pytest.mark.parametrize("kind, name", [("byte", BYTE), ("word", WORD)])
def test_piece_encoding_is_the_librarys(kind, name):
    e = encoder(kind, public_vocabulary(name))
    for t in [*AWKWARD, *(t for _, t in TEXTS if t)]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library(name, t)


def test_chunks_are_repaired(monkeypatch):
    coder = bpe.chunk_encoder(public_vocabulary(BYTE))
    monkeypatch.setattr(bpe, "LEAST", 4)
    monkeypatch.setattr(bpe, "MASK_BITS", 3)
    monkeypatch.setattr(bpe, "MOST", 40)
    for t in [*AWKWARD, LONG[:5000], "nospaces" * 100, " " * 300 + "x"]:
        ids = coder.encode(t)
        assert ids.tolist() == library(BYTE, t) and coder.decode(ids) == t


def test_bpe_round_trip(docs, none):
    out = bpe.bpe_round_trip(docs, public_vocabulary(BYTE), digests=True)
    want = []
    for i, t in TEXTS:
        ids = library(BYTE, t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(out) == sorted(want, key=repr)
    assert [r["decoded"] for r in bpe.bpe_round_trip(docs.where("doc_id = 9"), public_vocabulary(BYTE)).collect()] == [dict(TEXTS)[9]]
    assert bpe.bpe_round_trip(none, public_vocabulary(BYTE)).count() == 0


def test_nnls_and_plan():
    rng = np.random.default_rng(2)
    a, x = rng.random((20, 30)), np.maximum(0, rng.normal(size=30))
    y = packing.nnls(a, a @ x)
    assert (y >= 0).all() and np.linalg.norm(a @ y - a @ x) < 1e-6
    combos = packing.combinations_filling(8, 3)
    assert ((np.arange(1, 9) @ combos) == 8).all() and ((combos > 0).sum(axis=0) <= 3).all()
    assert len({tuple(c) for c in combos.T.tolist()}) == combos.shape[1]
    histogram = {4: 10, 2: 5, 1: 7, 8: 2}
    rows, n, solved = packing.plan_slots(histogram, 256, 32, 3)
    seats = Counter()
    for b, lo, hi, first, slot, each in rows:
        for rank in range(lo, hi):
            seats[first + (rank - lo) // each, slot + (rank - lo) % each, b] += 1
    assert Counter(b for _, _, b in seats.elements()) == histogram and max(seats.values()) == 1
    used = Counter()
    for q, _, b in seats:
        used[q] += b
    assert sorted(used) == list(range(n)) and max(used.values()) <= 8 and solved > 0
    assert sum(used.values()) == sum(b * k for b, k in histogram.items())
    assert packing.plan_slots({}, 256, 32, 3) == ([], 0, 0)


def test_packing_leaves_little_padding(spark):
    rng = np.random.default_rng(7)
    sizes = [int(n) for n in np.concatenate([rng.lognormal(6, 1, 3000), rng.integers(1, 30, 2000), [0, 4096, 8192, 9000]])]
    frame = spark.createDataFrame(list(enumerate(sizes)), "row long, n long").repartition(4)
    out = packing.place(frame).collect()
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 4096
    assert sum(used.values()) == sum(sizes) >= 0.97 * 4096 * len(used)


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, none, window):
    pieces = packing.pack_documents(docs, public_vocabulary(WORD), window).collect()
    want = Counter((i, tuple([*library(WORD, t), 2])) for i, t in TEXTS)
    by_doc: dict = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in want.items())
    for (i, n), own in by_doc.items():
        text = next(k[1] for k in want if k[0] == i and len(k[1]) == n)
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and struct.unpack(f"<{p['length']}I", p["ids"]) == text[at : at + p["length"]]
            at += p["length"]
        assert at == n
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack_documents(none, public_vocabulary(WORD)).count() == 0


def test_crc32c_and_frames(tmp_path):
    c = records.Crc32c()
    assert c(b"123456789") == 0xE3069283 and c(bytes(32)) == 0x8A9136AA and c(b"") == 0
    framed = records.frame(records.payload_of(7, np.array([1, 2, 70_000])))
    import io

    doc_id, ids = records.parse(records.read_frame(io.BytesIO(framed)))
    assert (doc_id, ids.tolist()) == (7, [1, 2, 70_000])
    for at in (0, 9, 14, len(framed) - 1):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(broken)))


def test_records(spark, docs, none):
    path = fresh_path(spark, "test-records")
    index = records.write_records(docs, path, public_vocabulary(BYTE))
    read = records.read_records(spark, path).collect()
    assert index.count() == len(read) == len(TEXTS)
    read.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in read]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    start = 0
    for r in read:
        assert r["start"] == start
        start += r["n_tokens"]
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in read)
    assert got == Counter((i, np.array([*library(BYTE, t), 0], "<u4").tobytes()) for i, t in TEXTS)
    chosen = [*index.collect()] * 2
    np.random.default_rng(3).shuffle(chosen)
    chosen = [tuple(r) for r in chosen[: len(TEXTS)]]
    drawn = records.read_at(spark.createDataFrame(chosen, index.schema).coalesce(1), path).collect()
    by_place = {(r["file"], r["offset"]): r for r in index.collect()}
    assert [(r["file"], r["offset"]) for r in drawn] == [(c[0], c[2]) for c in chosen]
    for r in drawn:
        assert (r["doc_id"], r["n_tokens"]) == (by_place[r["file"], r["offset"]]["doc_id"], len(r["ids"]) // 4)
    whole = records.read_at(index.orderBy(F.xxhash64("offset", "file")), path).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in whole) == got
    with pytest.raises(Exception, match="another record"):
        records.read_at(index.withColumn("doc_id", F.lit(-5).cast("long")), path).collect()
    assert records.read_at(index.limit(0), path).count() == 0
    empty = fresh_path(spark, "test-records")
    records.write_records(none, empty, public_vocabulary(BYTE))
    assert records.read_records(spark, empty).count() == 0


# -- embeddings ---------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "SHARD_MOST", 50)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.05, size=16)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None], 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [], 1), (0, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x")).repartition(4)
    got = {}
    for r in embedding_dedup.vector_components(frame).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    x = {k: np.array(v, np.float32).astype(float) for k, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v) and rows[k][2] is not None}
    linked = {k: {j for j in x if j != k and rows[j][2] == rows[k][2] and len(x[j]) == len(x[k]) and x[j] @ x[k] / np.linalg.norm(x[j]) / np.linalg.norm(x[k]) >= 0.98} for k in x}
    total = sum(map(len, linked.values()))
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in linked.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        assert got[i] == {(len(linked.get(k, ())), least, i == least)}
    assert total > 1000
    assert embedding_dedup.vector_components(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    x = np.vstack([base + rng.normal(scale=0.04, size=base.shape) for _ in range(10)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = embedding_dedup.build_graph(x)
    start = int((x @ x.mean(axis=0)).argmax())
    true = found = 0
    for q in x:
        want = set(np.nonzero(x @ q >= 0.98)[0].tolist())
        true += len(want)
        found += len(want & set(embedding_dedup.range_search(x, links, start, q).tolist()))
    assert found >= 0.9 * true


# -- archives, shards ---------------------------------------------------------


def test_archives(spark, monkeypatch):
    body = "<html>" + "payload é " * 200
    rows = [(1, "http://a/\r\nX: y", body), (5, "http://b/", body), (3, None, body), (None, "u", body), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (5, "again", body)]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i}</p>" + "text of some page " * 80) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x")).repartition(3)
    path = fresh_path(spark, "test-warc")
    index = warc.write_archives(pages, path)
    read = warc.read_archives(spark, path).collect()
    assert len(read) == index.count() == len(rows)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == body and i is not None and i < 5
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None] += 1
    assert got == want
    for r in read:
        assert r["record_type"] == "revisit" or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    monkeypatch.setattr(warc, "FILTER_BITS", 64)  # lets most pages through
    again = fresh_path(spark, "test-warc")
    warc.write_archives(pages, again)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, again).collect()) == want
    empty = fresh_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archive_begins_with_its_dictionary():
    import io

    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    bodies = [warc.build_record(i, "http://x/", (f"<p>{i}</p>" + "common words here " * 60).encode(), "d", 10, None) for i in range(80)]
    spans = [s for b in bodies for s in writer.add(b)] + writer.close()
    data = out.getvalue()
    assert struct.unpack("<II", data[:8])[0] == 0x184D2A5D and struct.unpack("<II", data[:8])[1] > 0
    assert list(warc.read_archive(io.BytesIO(data))) == bodies
    assert spans[-1][0] + spans[-1][1] == len(data)


def test_shards(docs, none):
    sized = docs.drop("shard").withColumn("size", sharding.text_size()).withColumn("slot", F.lit("clash"))
    out = sharding.shard_by_bytes(sized, 4).orderBy("shard", "slot").collect()
    assert len(out) == len(TEXTS) and "lang" in out[0].asDict()
    total = sum(r["size"] for r in out)
    largest = max(r["size"] for r in out)
    assert total == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids)
    for s in {r["shard"] for r in out}:
        own = [r for r in out if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 4 + largest
    assert sharding.shard_by_bytes(none.withColumn("size", F.lit(1))).count() == 0


def test_names_of_columns_may_clash(spark):
    names = ["__before", "__row", "__pid", "__tie", "__gone", "__k0", "___gone", "shard"]
    rows = [(i, f"words of text number {i // 2}", *[i + k for k in range(len(names))]) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    for drop in (near_dups.drop_near_duplicates, simhash.drop_near_duplicates):
        got = drop(frame)
        assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == rows[::2]
    placed = sharding.shard_by_bytes(frame.withColumn("size", F.lit(5).cast("long")), 3)
    got = sorted(map(tuple, placed.select(*frame.columns[:-1]).collect()))
    assert got == [r[:-1] for r in rows]
    assert sorted((r["shard"], r["slot"]) for r in placed.collect()) == [(s, k) for s in range(3) for k in range(4)]
