"""License scans: set-similarity join of text blocks with license templates (DataFrame functions only)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.license_texts import KEYS, TEMPLATES
from barloom.runtime import cut

#: Phrases whose words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.92
#: A template's blocks begin every STEP words, the least of these that holds it, and are two steps long.
STEPS = [8, 16, 32, 64, 128, 256, 512]

#: What parts words.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character but A-Z whose lower case is an ASCII letter, and one that stays apart from it.
_KELVIN, _OTHER = "\u212a", "\u0137"


def step_of(words: int) -> int:
    """Words from one block of a template to the next: any stretch as long as the template lies in one block."""
    return next((s for s in STEPS if s >= words), words)


def _spaced(text: str) -> Column:
    """The words in lower case with one space on either side; a single space without words."""
    lower = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)))
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _BREAKS, " ")


def _count(spaced: Column) -> Column:
    """Words of a stretch that begins and ends with a space, whatever the spaces between them."""
    one = F.replace(spaced, F.lit("  "), F.lit(" "))
    return (F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) - 1).cast("long")


def _places(w: Column, n_words: Column, phrases: dict[str, str]) -> list[Column]:
    """n_base, first_word, last_word and base of a spaced text."""
    firsts, lasts, counts, labels = [], [], [], []
    # Two spaces between words, so that neighbours share none.
    wide = F.replace(w, F.lit(" "), F.lit("  "))
    for p, label in phrases.items():
        there = F.contains(w, F.lit(f" {p} "))
        s = " " + p.replace(" ", "  ") + " "
        counts.append(F.when(there, ((F.length(wide) - F.length(F.replace(wide, F.lit(s), F.lit("")))) / len(s)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, _count(F.substring_index(wide, s, 1))))
        lasts.append(F.when(there, n_words - len(p.split()) - _count(F.substring_index(wide, s, -1))))
        labels.append(F.when(there, F.lit(label)))
    return [
        sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.array_min(F.array(*firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(*lasts)).cast("long").alias("last_word"), F.array_distinct(F.array_compact(F.array(*labels))).alias("base"),
    ]


def _sets(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, int, list[str], int]]:
    """(template, label, step, distinct words, words needed)."""
    out = []
    for i, (label, text) in enumerate(templates):
        words = re.findall("[0-9a-z]+", text.lower())
        own = sorted(set(words))
        out.append((i, label, step_of(len(words)), own, math.ceil(threshold * len(own) - 1e-9)))
    return out


def longer(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> dict[int, list[int]]:
    """Template -> the longer ones beside which it says nothing: it lies in their words to the threshold, and their text has its label's key phrases."""
    sets = _sets(templates, threshold)
    spaced = [f" {' '.join(re.findall('[0-9a-z]+', text.lower()))} " for _, text in templates]
    keyed = lambda label, text: any(all(f" {p} " in text for p in phrases) for phrases in KEYS.get(label, [[]]))
    return {
        i: [j for j, other, _, theirs, _ in sets if other != label and len(theirs) > len(own) and len(set(own) & set(theirs)) >= need and keyed(label, spaced[j])]
        for i, label, _, own, need in sets
    }


def _told(w: Column, keys: dict[str, list[list[str]]]) -> Column:
    """Labels whose key phrases a spaced text has."""
    def holds(label: str) -> Column:
        some = F.lit(False)
        for phrases in keys[label]:
            every = F.lit(True)
            for phrase in phrases:
                every = every & F.contains(w, F.lit(f" {phrase} "))
            some = some | every
        return F.when(some, F.lit(label))

    return F.array_compact(F.array(*map(holds, keys))) if keys else F.array().cast("array<string>")


def scan_words(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_words, n_base, first_word, last_word, base, told, hits, words), a row for each of ``docs``, written once.

    row numbers the rows, told are the labels whose key phrases the text has, hits
    the templates' words in it. words is the whole text in order where it has enough
    words of some template to hold it anywhere, else null.
    """
    sets = _sets(templates, threshold)
    vocabulary = sorted({w for s in sets for w in s[3]})
    spaced = docs.select(F.col(id_col).alias("id"), _spaced(text_col).alias("w"))
    words = F.when(F.length("w") > 2, F.split(F.substring(F.col("w"), F.lit(2), F.length("w") - 2), " ")).otherwise(F.array().cast("array<string>"))
    split = spaced.select("id", F.monotonically_increasing_id().alias("row"), "w", words.alias("words"))
    n_words = F.size("words").cast("long")
    hits = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    rows = split.select("id", "row", n_words.alias("n_words"), *_places(F.col("w"), n_words, phrases), _told(F.col("w"), KEYS).alias("told"), hits.alias("hits"), "words")
    # Any |T| - need + 1 words of a template: a text without all of these does not hold it. Long words are rarest.
    probes = sorted({w for _, _, _, own, need in sets for w in sorted(own, key=lambda w: (-len(w), w))[: len(own) - need + 1]})
    held = F.lit(False)
    for _, _, _, own, need in sets:
        held = held | (F.size(F.array_intersect("hits", F.array(*map(F.lit, own)))) >= need)
    able = F.when(F.arrays_overlap("hits", F.array(*map(F.lit, probes))), held).otherwise(F.lit(False))
    return cut(rows.withColumn("words", F.when(able, F.col("words"))), "license-words")


def template_blocks(scanned: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, block, template, label, containment): the blocks of words that hold at least ``threshold`` of a template's distinct words.

    A template of n words is looked for in blocks of ``2 * step_of(n)`` words, which
    overlap by half, so that no stretch of n words is cut; where lines end does not
    matter. Exact: the words are ordered by the number of texts of the whole table
    that have them, rarest first. A block that holds a template to the threshold t
    has one of the first |T| - ceil(t |T|) + 1 of its words, so only those are
    joined; blocks with too few words, or met too late in either order to leave
    enough, are dropped; the rest are counted. The join's small side has a few rows
    for each template and nothing of the corpus.
    """
    spark = scanned.sparkSession
    sets = _sets(templates, threshold)
    vocabulary = sorted({w for s in sets for w in s[3]})
    counts = {r[0]: r[1] for r in scanned.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}  # the templates' words only
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows, steps = [], {}
    for i, label, step, words, need in sets:
        ranks = sorted(order[w] for w in words)
        steps.setdefault(step, set()).update(ranks)
        rows += [(step, rank, i, label, at, ranks, need) for at, rank in enumerate(ranks[: len(ranks) - need + 1])]
    prefix = spark.createDataFrame(rows, "step int, rank int, template int, label string, at int, ranks array<int>, need int")
    uses = spark.createDataFrame([(w, order[w], [s for s in sorted(steps) if order[w] in steps[s]]) for w in vocabulary], "known string, rank int, steps array<int>")

    texts = scanned.where("words is not null").select("row", "words")
    found = texts.select("row", F.posexplode("words").alias("pos", "word")).join(F.broadcast(uses), F.col("word") == F.col("known"))
    # Each word lies in two blocks of each step, the first word of a text in one.
    in_steps = found.select("row", "pos", "rank", F.explode("steps").alias("step"))
    last = F.floor(F.col("pos") / F.col("step")).cast("int")
    placed = in_steps.select("row", "step", F.explode(F.sequence(F.greatest(F.lit(0), last - 1), last)).alias("block"), "rank")
    blocks = placed.groupBy("row", "step", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))

    probes = blocks.select("row", "step", "block", "own", F.posexplode("own").alias("pos", "rank"))
    later = F.least(F.size("ranks") - F.col("at"), F.size("own") - F.col("pos"))
    held = F.size(F.array_intersect("own", "ranks"))
    return (
        probes.join(F.broadcast(prefix), ["step", "rank"])
        .where((F.size("own") >= F.col("need")) & (F.least("at", "pos") + later >= F.col("need")))
        .select("row", "block", "template", "label", "need", held.alias("held"), (held / F.size("ranks")).alias("containment"))
        .where(F.col("held") >= F.col("need"))
        .select("row", "block", "template", "label", "containment").distinct()
    )


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters of the
    whole text. base_labels are those of the phrases found, labels also those of
    template blocks, both distinct, sorted and comma-joined. A label of blocks needs
    its key phrases somewhere in the text, as a set of words does not tell the GPL
    from the LGPL, and a template says nothing beside a longer one of another label
    that holds it. score is 1 with a phrase, else the largest containment of a
    template block that counts, else 0. Null and empty texts have no words. Rows
    that share an id keep labels of their own; other columns are left out.
    """
    scanned = scan_words(docs, templates, id_col=id_col, text_col=text_col)
    best = template_blocks(scanned, templates).groupBy("row", "template", "label").agg(F.max("containment").alias("containment"))
    per_row = best.groupBy("row").agg(F.collect_list(F.struct("template", "label", "containment")).alias("found"))
    joined = scanned.drop("hits", "words").join(per_row, "row", "left")
    keyed = F.array(*map(F.lit, KEYS))
    told = F.filter(
        F.coalesce("found", F.array().cast("array<struct<template:int,label:string,containment:double>>")),
        lambda x: F.array_contains("told", x["label"]) | ~F.array_contains(keyed, x["label"]),
    )
    rows = joined.withColumn("found", told).withColumn("templates", F.transform("found", lambda x: x["template"]))
    above = F.array(*[F.array(*map(F.lit, over)).cast("array<int>") for over in longer(templates).values()])
    rows = rows.withColumn("found", F.filter("found", lambda x: ~F.arrays_overlap(F.get(above, x["template"]), F.col("templates"))))
    labels = F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"])))
    most = F.array_max(F.transform("found", lambda x: x["containment"]))
    return rows.select(
        "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(most, F.lit(0.0))).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
