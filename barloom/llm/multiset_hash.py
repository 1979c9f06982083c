"""Homomorphic multiset hashes of documents (DataFrame functions only).

A text's paragraphs are its lines, cut after each sentence that a blank follows;
empty ones count as nothing. The SHA-256 of a paragraph gives a wide vector, and
a text's vector is the sum over its paragraphs modulo powers of two. So the order
of paragraphs does not matter, and adding or taking away the vector of some
paragraphs gives the vector of the text with or without them: an edit costs
what it changes, not the whole text.

A vector is an array of 29 longs:

* the number of paragraphs and four numbers of 60 bits, each summed modulo 2^60:
  two texts have the same ones if and only if their paragraphs are equal, but for
  a collision of 240 bits;
* 24 longs of five fields of 11 bits, each summed modulo 2^11: for each of the
  first 120 bits of the hashes, the number of paragraphs that have it. Twice that
  less the number of paragraphs is a sum of random signs, so that the squared
  distance of two texts' sums estimates the paragraphs in which they differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.runtime import cut

#: Hexadecimal digits of a number, numbers taken from a hash, and those of them whose bits are counted.
DIGITS, NUMBERS, COUNTED = 15, 4, 2
#: Bits of a field with its guard bit, and fields of a long.
WIDTH, FIELDS = 12, 5
BITS = 4 * DIGITS
_WHOLE = (1 << BITS) - 1
_ONES = sum(1 << (WIDTH * f) for f in range(FIELDS))
_FIELD = (1 << (WIDTH - 1)) - 1
_PLAIN = 1 + NUMBERS
SENTENCE_ENDS = (". ", "! ", "? ")


def paragraphs(text: Column) -> Column:
    """The lines of ``text``, cut after every sentence end; none of them empty."""
    for end in SENTENCE_ENDS:
        text = F.replace(text, F.lit(end), F.lit(end + "\n"))
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _last_paragraph(text: Column) -> Column:
    """Code points of ``text`` after its last line or sentence end."""
    return F.least(*[F.length(F.substring_index(text, end, -1)) for end in ("\n", *SENTENCE_ENDS)])


def _number(k: int):
    """The k-th number of a hash."""
    return lambda h: F.conv(F.substring(h, 1 + DIGITS * k, DIGITS), 16, 10).cast("long")


def _counted(j: int):
    """Adds the j-th bit of each field's stretch of a number to the field."""
    return lambda a, x: (a + F.shiftright(x, j).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_ONES * _FIELD))


def vectors(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``rows`` with the vector of each text column of ``texts`` as a column named by its value.

    Rows of one text are never dealt out: a vector is made where its text lies.
    """
    hashes = {f"{v}_hashes": F.transform(paragraphs(F.col(t)), lambda p: F.sha2(p, 256)) for t, v in texts.items()}
    rows = rows.withColumns(hashes)
    numbers = {f"{v}_{k}": F.transform(f"{v}_hashes", _number(k)) for v in texts.values() for k in range(NUMBERS)}
    rows = rows.withColumns(numbers).drop(*hashes)
    zero = F.lit(0).cast("long")

    def vector(v: str) -> Column:
        whole = [F.aggregate(f"{v}_{k}", zero, lambda a, x: (a + x).bitwiseAND(F.lit(_WHOLE))) for k in range(NUMBERS)]
        counts = [F.aggregate(f"{v}_{k}", zero, _counted(j)) for k in range(COUNTED) for j in range(WIDTH)]
        return F.array(F.size(f"{v}_0").cast("long"), *whole, *counts)

    return rows.withColumns({v: vector(v) for v in texts.values()}).drop(*numbers)


_MASKS = [_WHOLE] * _PLAIN + [_ONES * _FIELD] * (COUNTED * WIDTH)
#: A bit above each field, which lends to it alone.
_GUARDS = [_WHOLE + 1] * _PLAIN + [_ONES * (_FIELD + 1)] * (COUNTED * WIDTH)


def _zipped(a: Column, b: Column) -> Column:
    """Of two vectors. What a lambda takes from outside it may compute again at each step, so all of it is zipped."""
    longs = [F.array(*[F.lit(x).cast("long") for x in fixed]) for fixed in (_MASKS, _GUARDS)]
    return F.arrays_zip(a.alias("a"), b.alias("b"), longs[0].alias("mask"), longs[1].alias("guard"))


def added(a: Column, b: Column) -> Column:
    """The vector of all paragraphs of both."""
    return F.transform(_zipped(a, b), lambda z: (z["a"] + z["b"]).bitwiseAND(z["mask"]))


def removed(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``."""
    return F.transform(_zipped(a, b), lambda z: (z["a"] + z["guard"] - z["b"]).bitwiseAND(z["mask"]))


def printed(v: Column) -> Column:
    """A vector as 435 lowercase hexadecimal digits, 15 for each long."""
    return F.concat_ws("", F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")))


def _wrapped(x: Column) -> Column:
    """The number nearest to 0 that equals ``x`` modulo 2^12."""
    half = _FIELD + 1
    return F.pmod(x + F.lit(half), F.lit(2 * half)) - F.lit(half)


def _signs(v: Column) -> Column:
    """The sum of signs of each counted bit."""
    longs = F.slice(v, 1 + _PLAIN, COUNTED * WIDTH)
    counts = F.flatten(F.transform(longs, lambda x: F.array(*[F.shiftright(x, WIDTH * f).bitwiseAND(F.lit(_FIELD)) for f in range(FIELDS)])))
    return F.zip_with(counts, F.array_repeat(F.get(v, F.lit(0)), COUNTED * BITS), lambda c, n: _wrapped(2 * c - n))


def _squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + s * s)


def with_likeness(rows: DataFrame, vector: str, others: dict[str, str]) -> DataFrame:
    """``rows`` with how like the vector is to that of each column of ``others``, as a column named by its value.

    From the vectors alone: about 2 |A ∩ B| / (|A| + |B|), at least 0, and 1 for
    equal ones. A paragraph that stands m times weighs m^2. The error is about 0.1;
    sums of signs beyond 2,047, as a line repeated that often gives, wrap around.
    """
    names = [vector, *others]
    rows = rows.withColumns({f"{v}_signs": _signs(F.col(v)) for v in names})
    far = {f"{v}_far": _squares(F.zip_with(f"{vector}_signs", f"{v}_signs", lambda x, y: _wrapped(x - y))) for v in others}
    rows = rows.withColumns({f"{v}_norm": _squares(F.col(f"{v}_signs")) for v in names} | far)

    def near(v: str) -> Column:
        both = F.col(f"{vector}_norm") + F.col(f"{v}_norm")
        share = F.lit(1.0) - F.col(f"{v}_far").cast("double") / both.cast("double")
        return F.when(F.col(vector) == F.col(v), 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), share))

    rows = rows.withColumns({name: near(v) for v, name in others.items()})
    return rows.drop(*far, *[f"{v}_{x}" for v in names for x in ("signs", "norm")])


def next_of(keys: DataFrame) -> DataFrame:
    """(key, next_key, taken, times) of rows (id, key, taken, times), in order of id, nulls first, and key.

    The last row's next is the first. A key that stands several times is its own
    next but for once. Keys are dealt by range; only a row for each partition
    meets in one place.
    """
    dealt = cut(keys.repartitionByRange(F.col("id").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id()), "keys")
    ends = dealt.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first"))
    parts = Window.orderBy("part")
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first.key").over(parts), F.first("first.key").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"),
    )
    own = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "key")
    linked = dealt.withColumn("next_key", F.lead("key").over(own)).join(ends, "part").select("key", F.coalesce("next_key", "after").alias("next_key"), "taken", "times")
    again = F.struct(F.col("key").alias("next_key"), (F.col("times") - 1).alias("times"))
    links = F.array(F.struct("next_key", F.lit(1).cast("long").alias("times")), again)
    return linked.select("key", "taken", F.explode(links).alias("to")).select("key", "to.next_key", "taken", "to.times").where("times > 0")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, text, edited, vector, edited_vector, next_vector), a row for each row of ``docs``.

    ``edited`` is the text whose last floor(n_chars / 4) code points are replaced by
    the first as many (or all) of the next document's in ascending order of id; the
    first follows the last, so a single document follows itself. Its vector is the
    text's without the paragraphs from the one that holds the cut on, and with
    those that stand there after the edit: the rest of the text is not hashed again.

    A null text is empty, and an empty text has the zero vector. Null ids come
    first; equal ids go by the SHA-256 of id and text, and rows equal in both follow
    each other. Equal rows are combined before the shuffle. Other columns are
    ignored, whatever their names. An empty table gives an empty result. Texts are
    whole: a long one takes memory in proportion to its length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.col(id_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"),
        F.coalesce(F.sha2(F.concat(F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit(":")), text), 256), F.lit("")).alias("key"),
    )
    keys = rows.groupBy("key").agg(F.first("id").alias("id"), F.first(F.floor(F.length("text") / 4).cast("int")).alias("taken"), F.count("*").alias("times"))
    links = cut(next_of(keys), "next")
    # One struct, so that both joins below ask for the same columns and share one shuffle of the texts.
    texts = vectors(rows, {"text": "vector"}).groupBy("key").agg(F.first(F.struct("id", "text", "vector")).alias("row"))
    sent = texts.join(links.select(F.col("next_key").alias("key"), F.col("key").alias("to"), "taken", "times"), "key").select(
        F.col("to").alias("key"), "times", F.left("row.text", F.col("taken")).alias("put"), F.col("row.vector").alias("next_vector")
    )
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    both = texts.join(sent, "key").select("row.*", "times", "put", "next_vector").withColumns({"kept": F.left("text", kept), "n_chars": n.cast("long")})
    both = both.withColumn("from", F.length("kept") - _last_paragraph(F.col("kept"))).withColumns(
        {"old_end": F.expr("substring(text, from + 1)"), "new_end": F.expr("concat(substring(kept, from + 1), put)")}
    )
    both = vectors(both, {"old_end": "old_vector", "new_end": "new_vector"})
    both = both.withColumn("edited_vector", added(removed(F.col("vector"), F.col("old_vector")), F.col("new_vector")))
    out = both.select("id", "n_chars", "text", F.concat("kept", "put").alias("edited"), "vector", "edited_vector", "next_vector", "times")
    return out.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    edits = edits.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "vector", "edited_vector", "next_vector")
    return with_likeness(edits, "vector", {"edited_vector": "near_edited", "next_vector": "near_next"}).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        printed(F.col("vector")).alias("fingerprint"), printed(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def _sql_text_vector(text: str) -> str:
    """DuckDB: the vector of a text as a list of longs, summed over its paragraphs."""
    cut_text = text
    for end in SENTENCE_ENDS:
        cut_text = f"replace({cut_text}, '{end}', '{end}' || chr(10))"
    hashes = f"list_transform(list_filter(string_split({cut_text}, chr(10)), lambda p: p <> ''), lambda p: sha256(p))"
    numbers = f"list_transform({hashes}, lambda h: [{', '.join(f'CAST(concat({chr(39)}0x{chr(39)}, substr(h, {1 + DIGITS * k}, {DIGITS})) AS BIGINT)' for k in range(NUMBERS))}])"
    return numbers


def oracle_sql() -> str:
    """The same by whole sums over whole texts: the edited text is hashed anew, and each bit counted by itself."""
    whole = [f"CAST(coalesce(list_sum(list_transform(w, lambda x: CAST(x[{k + 1}] AS HUGEINT))), 0) % {1 << BITS} AS BIGINT)" for k in range(NUMBERS)]
    bit = lambda k, b: f"len(list_filter(w, lambda x: (x[{k + 1}] >> {b}) & 1 = 1))"
    counts = [" + ".join(f"(({bit(k, WIDTH * f + j)} % {_FIELD + 1}) << {WIDTH * f})" for f in range(FIELDS)) for k in range(COUNTED) for j in range(WIDTH)]
    vector = f"[CAST(len(w) AS BIGINT), {', '.join(whole)}, {', '.join(counts)}]"
    half = _FIELD + 1
    signs = lambda a, b: f"list_transform(range({COUNTED * BITS}), lambda i: ((2 * ((({a}[{_PLAIN + 1} + i // {FIELDS}] >> ({WIDTH} * (i % {FIELDS}))) & {_FIELD}){b[0]}) - ({a}[1]{b[1]}) + {half} + {1 << 40} * {2 * half}) % {2 * half}) - {half})"
    norm = lambda x: f"list_sum(list_transform({x}, lambda s: s * s))"
    less = lambda b: (f" - (({b}[{_PLAIN + 1} + i // {FIELDS}] >> ({WIDTH} * (i % {FIELDS}))) & {_FIELD})", f" - {b}[1]")
    near = lambda a, b: (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {norm(signs(a, ('', '')))} + {norm(signs(b, ('', '')))} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - "
        f"CAST({norm(signs(a, less(b)))} AS DOUBLE) / CAST({norm(signs(a, ('', '')))} + {norm(signs(b, ('', '')))} AS DOUBLE)) END"
    )
    printed_sql = lambda v: f"list_aggregate(list_transform({v}, lambda x: printf('%015x', x)), 'string_agg', '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat(coalesce(concat(length(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), ':'), coalesce(text, ''))) AS key FROM documents),
n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, key)),
e AS (SELECT *, concat(substr(text, 1, n - n // 4), substr(next_text, 1, n // 4)) AS edited FROM n),
h AS MATERIALIZED (SELECT doc_id, n, edited, {_sql_text_vector('text')} AS t, {_sql_text_vector('edited')} AS u, {_sql_text_vector('next_text')} AS x FROM e),
v AS MATERIALIZED (
  SELECT doc_id, n, edited, (SELECT {vector} FROM (SELECT t AS w)) AS a, (SELECT {vector} FROM (SELECT u AS w)) AS b, (SELECT {vector} FROM (SELECT x AS w)) AS c FROM h)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {printed_sql('a')} AS fingerprint, {printed_sql('b')} AS edited_fingerprint,
       {near('a', 'b')} AS near_edited, {near('a', 'c')} AS near_next FROM v"""


ORACLE_SQL = oracle_sql()
