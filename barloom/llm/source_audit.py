"""How the sources of a language differ in their words: wide term vectors and their distances."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.runtime import cut

#: A term is kept if so many documents of its language hold it; added to each count; parts in which shares are given; terms reported.
MIN_DOCS, ADDED, PARTS, TOP = 30, 5, 1_000_000_000, 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte -> byte: letters in lower case, the bytes of non-ASCII characters as they are, all else a space.
_FLAT = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Counted terms that a task holds before it gives them on (some 100 MB), and bytes of a text that it splits at once.
HELD, PIECE = 400_000, 4 << 20
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Groups whose totals are broadcast (some 60 bytes each); with more, they go to the terms by a shuffle, in so many copies.
BROADCAST_GROUPS, COPIES = 100_000, 64


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    flat, start = text.translate(_FLAT), 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and texts of each term by group, given on whenever many are held."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            rows = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*rows, terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            met: set[bytes] = set()
            for words in words_of(text.as_py()):
                n.update(words)
                met.update(words)
            docs.update(met)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_table(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, counts): each kept term of a language with a map of its occurrences by source.

    Tasks sum occurrences and documents before the one shuffle, by language and
    term: what is shuffled are the different words that a task met. A term that
    every text holds has a row for each source and task.
    """
    small_batches(docs.sparkSession)
    counted = docs.select("lang", "source", "text").mapInArrow(_count, _COUNTS).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    pivoted = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return pivoted.where(F.col("docs") >= min_docs).select("lang", "term", F.map_from_entries("counts").alias("counts"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + ADDED) / (total + ADDED * terms)), in decimals, which do not overflow."""
    over = (count + F.lit(ADDED)).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    under = (total + terms * ADDED).cast("decimal(20,0)")
    return F.call_function("div", over, under) + F.lit(1)


def with_groups(table: DataFrame, langs: DataFrame, groups: int) -> DataFrame:
    """``table`` with its language's row of ``langs``, which holds an entry for each of ``groups`` groups."""
    if groups <= BROADCAST_GROUPS:
        return table.join(F.broadcast(langs), "lang")
    copies = langs.withColumn("copy", F.explode(F.expr(f"sequence(0, {COPIES - 1})")))
    return table.withColumn("copy", F.pmod(F.xxhash64("term"), F.lit(COPIES)).cast("int")).join(copies, ["lang", "copy"]).drop("copy")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how the term shares of each source differ.

    Terms are runs of letters and non-ASCII characters, only A-Z lower-cased; a
    language keeps those that ``min_docs`` of its rows hold. A source's share of a
    term is 1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of the V kept
    terms. Part ``pair`` gives each other source of the language with the sum over
    kept terms of the absolute difference of shares, part ``term`` the ``top`` terms
    that the source holds and gives a greater share than the language as a whole,
    with the difference. ``rank`` counts from 1 by falling value, then by item.

    Each term is one array over the sources of its language, in order of name; a
    function of the array emits what the term adds to each pair, a row of the array
    at a time, and tasks sum pairs before they shuffle: a row for each pair and
    task. Nulls in text, lang and source count as ''. A group without terms has
    counts of 0; in a language without kept terms the sums are 0. A language of one
    source has no pairs. Repeated rows count again, ids and other columns are not
    read. An empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    table = cut(term_table(docs, min_docs), "terms")
    sums = table.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = table.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["n", "kept"])
    groups = cut(groups, "groups")
    langs = (
        groups.groupBy("lang", "kept").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("total"))
    )
    wide = with_groups(table, langs, groups.count())
    # The term's share of each source, beside the language's.
    shares = F.transform(
        F.arrays_zip("sources", F.array_repeat("counts", F.size("sources")).alias("counts"), F.array_repeat("kept", F.size("sources")).alias("kept")),
        lambda z: _share(F.coalesce(F.element_at(z["counts"], z["sources"]["source"]), F.lit(0)), z["sources"]["n"], z["kept"]),
    )
    whole = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    wide = wide.select(
        "lang", "term", "counts", shares.alias("p"), _share(whole, F.col("total"), F.col("kept")).alias("q"), F.transform("sources", lambda s: s["source"]).alias("names")
    )
    rows = wide.select("lang", "p", F.posexplode("p").alias("a", "own"))
    gaps = F.zip_with(F.slice("p", 1, F.col("a")), F.array_repeat("own", F.col("a")), lambda x, y: F.abs(x - y))
    pairs = rows.where("a > 0").select("lang", "a", F.posexplode(gaps).alias("b", "gap")).groupBy("lang", "a", "b").agg(F.sum("gap").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.s", "x.t", "value")
    others = langs.select("lang", F.col("sources.source").alias("names")).select("lang", "names", F.posexplode("names").alias("s", "source"))
    others = others.select("lang", "s", "source", F.posexplode("names").alias("t", "item")).where("s <> t")
    pair_part = others.join(pairs, ["lang", "s", "t"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    held = wide.select("lang", "term", "q", "counts", F.explode(F.arrays_zip("names", "p")).alias("g")).where(
        (F.col("g.p") > F.col("q")) & (F.coalesce(F.element_at("counts", F.col("g.names")), F.lit(0)) > 0)
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = held.select("lang", F.col("g.names").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("g.p") - F.col("q")).alias("value"))
    term_part = term_part.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pair_part.withColumn("rank", F.row_number().over(by_value)).unionByName(term_part)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
own AS (
  SELECT *, CAST(1 + ({PARTS}::HUGEINT * (n + {ADDED})) // (sum(n) OVER (PARTITION BY lang, source) + {ADDED} * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM cells),
whole AS (
  SELECT lang, term, CAST(1 + ({PARTS}::HUGEINT * (n + {ADDED})) // (sum(n) OVER (PARTITION BY lang) + {ADDED} * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM cells GROUP BY lang, term)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows) WHERE part = 'pair' OR rank <= {TOP}"""
