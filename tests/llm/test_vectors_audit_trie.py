"""Multiset hashes, the source audit and the conversation tree against plain Python on awkward small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import conversation_trie as trie
from barloom.llm import multiset_hash as mh
from barloom.llm import source_audit as audit
from barloom.llm.catalogue import ORACLES, QUERIES

LONG = "One line here. And more! " * 4000
TEXTS = [
    (5, "a b. c d! e f\ng\n\nh"), (5, "other text of the same id"), (5, "a b. c d! e f\ng\n\nh"), (1, None), (2, ""), (None, "no id. at all"), (None, "no id. at all"),
    (9, LONG), (10, "Ünï. ß日本\n語 😀? x"), (11, "abc"), (12, "same\n" * 3000), (13, "g\nh\na b. c d! e f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, vector string").withColumns({"id": F.lit(0), "row": F.lit(1), "taken": F.lit("y"), "edited": F.lit(2)}).repartition(4)


def pieces(text):
    return [p for p in re.sub(r"([.!?] )", "\\1\n", text).split("\n") if p]


def vector(text):
    hashes = [int(hashlib.sha256(p.encode()).hexdigest()[:60], 16) for p in pieces(text)]
    numbers = [[(h >> (60 * (3 - k))) % 2**60 for h in hashes] for k in range(4)]
    counted = []
    for k in range(2):
        for j in range(12):
            counted.append(sum((sum((x >> (12 * f + j)) & 1 for x in numbers[k]) % 2048) << (12 * f) for f in range(5)))
    return [len(hashes), *(sum(x) % 2**60 for x in numbers), *counted]


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(((f"{len(str(r[0]))}:{r[0]}" if r[0] is not None else ":") + r[1]).encode()).hexdigest()))
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        out.append((i, len(t), t[: len(t) - k] + following[:k], vector(t), vector(t[: len(t) - k] + following[:k]), vector(following)))
    return out


def test_edits_and_their_vectors(docs):
    got = [(r["id"], r["n_chars"], r["edited"], list(r["vector"]), list(r["edited_vector"]), list(r["next_vector"])) for r in mh.fingerprint_edits(docs).collect()]
    assert sorted(got, key=repr) == sorted(edits(TEXTS), key=repr)


def test_one_document_and_none(docs):
    one = mh.fingerprint_edits(docs.where("doc_id = 11")).collect()
    assert [(r["edited"], r["next_vector"]) for r in one] == [("abc", vector("abc"))]
    assert mh.fingerprint_edits(docs.limit(0)).count() == 0


def test_adding_and_removing_paragraphs(spark):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(40)]
    rows = []
    for k in range(30):
        a, b = rng.choices(lines, k=rng.randint(0, 30)), rng.choices(lines, k=rng.randint(0, 30))
        both = a + b
        rng.shuffle(both)
        rows.append((k, "\n".join(a), "\n".join(b), "\n".join(both)))
    df = mh.vectors(spark.createDataFrame(rows, "k long, x string, y string, z string"), {"x": "a", "y": "b", "z": "c"})
    got = df.select(mh.added(F.col("a"), F.col("b")).alias("sum"), mh.removed(F.col("c"), F.col("b")).alias("rest"), "a", "c").collect()
    assert all(r["sum"] == r["c"] and r["rest"] == r["a"] for r in got)


def test_likeness_follows_what_is_shared(spark):
    rows = [(k, "\n".join(f"p{i}" for i in range(100)), "\n".join(f"p{i}" for i in range(k, 100 + k))) for k in (0, 10, 50, 100)]
    rows.append((200, "x", ""))
    df = mh.vectors(spark.createDataFrame(rows, "k long, x string, y string"), {"x": "a", "y": "b"})
    near = {r["k"]: r["near"] for r in mh.with_likeness(df, "a", {"b": "near"}).collect()}
    assert near[0] == 1.0 and near[200] == 0.0
    for k in (10, 50, 100):
        assert abs(near[k] - (100 - k) / 100) < 0.25


def test_order_of_paragraphs_does_not_matter(docs):
    by_id = {(r["id"], r["n_chars"]): r["vector"] for r in mh.fingerprint_edits(docs).collect()}
    assert by_id[5, 18] == by_id[13, 17] and len(set(map(tuple, by_id.values()))) == len(by_id) - 2  # two empty, two reordered


# -- source audit --------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def audited(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        texts = [(s, words(t)) for x, s, t in rows if x == lang]
        held = Counter(w for _, ws in texts for w in set(ws))
        kept = [w for w, n in held.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for s, ws in texts:
            counts[s].update(w for w in ws if w in set(kept))
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(counts[s]) for s in {s for s, _ in texts}}, share(sum(counts.values(), Counter()))
        for s in p:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s)
            terms = sorted((-(p[s][w] - q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "Élan", "élan", "日本", "rare", "x-y", "a1b", "KELVIN", "\u212a"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(rng.choice(["en", "fr", "en", None, ""]), rng.choice(["a", "b", "c", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for _ in range(150)]
    return rows + [("de", "only", "allein"), ("en", "silent", None), ("en", "silent", "123 !!"), ("xx", "p", ""), ("xx", "q", "one"), ("en", "a", "the " * 5000)]


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(*r, k) for k, r in enumerate(corpus())]
    return spark.createDataFrame(rows, "lang string, source string, text string, kept long").withColumns({"term": F.lit(1), "p": F.lit(2), "n": F.lit("z")}).repartition(5)


@pytest.mark.parametrize("min_docs, top", [(30, 50), (3, 4), (1000, 50)])
def test_audit(sources, min_docs, top, monkeypatch):
    got = sorted(tuple(r) for r in audit.audit_sources(sources, min_docs, top).collect())
    assert got == audited(corpus(), min_docs, top)


def test_audit_of_many_groups_goes_by_a_shuffle(sources, monkeypatch):
    monkeypatch.setattr(audit, "BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in audit.audit_sources(sources, 3).collect()) == audited(corpus(), 3, 50)
    assert audit.audit_sources(sources.limit(0)).count() == 0


def test_terms_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(audit, "PIECE", 10)
    text = "Some-Words cut ANYWHERE épée\x00 and averyveryverylongone 1 2"
    assert [w.decode() for ws in audit.words_of(text.encode()) for w in ws] == words(text)
    monkeypatch.setattr(audit, "HELD", 2)


# -- conversations -------------------------------------------------------------


def tree(turns, every=20, most=4):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        seqs[c] = tuple(convs.get(c - int(math.fmod(c, every)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        n = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += n
    ends = {k: hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


def found(df, **kw):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in trie.conversation_trie(df, **kw).collect())


def chats(seed, convs=60, words=2, longest=7):
    rng = random.Random(seed)
    return [(c, k, rng.choice("ua"), " ".join(rng.choices(["hi", "you there", "ok"][:words], k=1))) for c in range(convs) for k in range(rng.randint(1, longest))]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"depth": F.lit(9), "conv": F.lit("q"), "pos": F.lit(1), "owner": F.lit(3)}).repartition(3)


ODD = [
    (0, None, None, None), (0, 1, "u", "one two"), (0, 2, "a", ""), (1, 5, "u", "x"), (2, 0, None, " \t "), (40, 0, "u", "late donor"), (41, 3, "u", "y"), (41, 1, "a", "z"),
    (None, 0, "u", "nobody's"), (85, 0, "u", "no donor"), (86, 0, "u", "no donor"), (99, 7, "u", "same"), (99, 7, "u", "same"), (-3, 0, "u", "negative"), (-25, 0, "u", "negative"),
]


@pytest.mark.parametrize("rows", [ODD, chats(1), chats(2, 45, 1), [(c, k, "u", "same") for c in range(50) for k in range(6)], [(60, 0, "u", "alone")], [(85, 0, "u", "x")]])
def test_tree(spark, rows):
    assert found(frame(spark, rows)) == tree(rows)


def test_tree_of_long_chains(spark, monkeypatch):
    """Sequences over several blocks of digests, each chain hanging on the one before it, and lists in many pieces."""
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(20 * c, k, "u", "go" if k < 12 * c else f"turn {c}") for c in range(12) for k in range(150 if c == 11 else 12 * c + 2)]
    rows += [(20 * c, k, "u", "same") for c in range(100, 130) for k in range(2)]
    assert found(frame(spark, rows)) == tree(rows)


def test_empty_tree(spark):
    assert found(frame(spark, ODD).limit(0)) == []
    assert found(frame(spark, [(None, 0, "u", "x")])) == []


@pytest.mark.parametrize("name", ["op11_fingerprints", "op12_source_divergence", "op13_conversation_trie"])
def test_queries_give_their_oracle_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
