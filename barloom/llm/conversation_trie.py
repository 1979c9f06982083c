"""The tree of conversations that share first turns, by prefix digests and owned chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import cut, cut_at, prefix_sums, remove

#: Digests of a row of the lookup table, lanes of 32 bits of a digest, and ids of a piece of a node's list.
BLOCK, LANES, PIECE = 64, 4, 4_096
_MASK = (1 << 32) - 1
WORDS = r"[^\x20\x09-\x0D]+"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, h1, h2, words): position from 1, 128 bits of role and text, and words of each turn.

    Texts are read once and never shuffled. Positions are running counts by ranges
    of (conversation, turn), so that a very long conversation is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = prefix_sums(rows, ["turn", "h1", "h2"], {"before": F.lit(1).cast("long")}, keys=["conv"], tag="turns")
    return cut(rows.select("conv", (F.col("before") + 1).alias("pos"), "h1", "h2", "words"), "numbered")


def rebuilt_turns(numbered: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations with their lengths, their turns): the first h turns come from the conversation that ``every`` share.

    h is the CRC-32 of the decimal id modulo ``most``. At most ``every`` ids (twice
    as many around 0) take turns of one other, so no donor's turns are copied more often.
    """
    heads = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most
    donor = F.col("conv") - F.col("conv") % every
    lengths = numbered.groupBy("conv").agg(F.max("pos").alias("own")).withColumns({"h": heads, "donor": donor})
    donors = numbered.where((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "donor")
    given = lengths.join(donors, "donor").where("pos <= h").select("conv", "pos", "h1", "h2", "words")
    taken = lengths.join(
        donors.groupBy("donor").agg(F.max("pos").alias("there")), "donor", "left"
    ).select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("first"), "own")
    taken = cut(taken.withColumn("length", F.col("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "lengths")
    kept = numbered.join(taken, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("first")).alias("pos"), "h1", "h2", "words")
    return taken.select("conv", "length"), given.unionByName(kept)


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, words): 128 bits of the first ``depth`` turns, and the words of the last of them.

    A digest is a sum over turns of hashes of turn and position, modulo 2^32 in each
    of four lanes: running sums that tasks share, whatever a conversation's length.
    """
    # xxhash64 of three longs, halved: two lanes each.
    lanes = {}
    for k in range(LANES):
        h = F.xxhash64(F.lit(k // 2), "pos", "h1", "h2")
        lanes[f"s{k}"] = (h if k % 2 else F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(_MASK))
    turns = turns.withColumns(lanes)
    sums = prefix_sums(turns, ["pos"], {f"t{k}": F.col(f"s{k}") for k in range(LANES)}, keys=["conv"], tag="digests")
    whole = [(F.col(f"s{k}") + F.col(f"t{k}")).bitwiseAND(F.lit(_MASK)) for k in range(LANES)]
    pair = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y)
    return cut(sums.select("conv", F.col("pos").cast("long").alias("depth"), pair(*whole[:2]).alias("a"), pair(*whole[2:]).alias("b"), "words"), "prefixes")


def first_owned(lengths: DataFrame, digests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, length, first, end_owner, parent): the least depth whose node's smallest member the conversation is.

    Whoever owns a prefix owns every longer one, so each conversation's first owned
    depth is found by halving: all ask at once, at a depth each, for their digests
    (64 of them in a row of the lookup table) and these for their nodes. Those that
    do not own their whole sequence are done at the first question, with
    first = length + 1, and later rounds hold only those still asking. ``end_owner``
    owns the node of the whole sequence, ``parent`` the one above the first owned.
    """
    spark = lengths.sparkSession
    blocks = digests.groupBy("conv", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("rows")
    )
    blocks = cut(blocks, "blocks")
    owners = nodes.select("depth", "a", "b", "owner")

    def asked(state: DataFrame, depth: Column, name: str) -> DataFrame:
        """``state`` with the owner of the prefix of that depth; null at depth 0."""
        state = state.withColumn("depth", depth.cast("long"))
        at = state.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).join(blocks, ["conv", "block"], "left")
        at = at.withColumn("at", F.get("rows", ((F.col("depth") - 1) % BLOCK).cast("int"))).withColumns({"a": F.col("at.a"), "b": F.col("at.b")})
        at = at.select(*state.columns, "a", "b").join(owners, ["depth", "a", "b"], "left")
        return at.select(*[c for c in state.columns if c != "depth"], F.col("owner").alias(name))

    state = asked(lengths, F.col("length"), "end_owner").withColumns(
        {"low": F.when(F.col("end_owner") == F.col("conv"), 1).otherwise(F.col("length") + 1).cast("long"), "high": F.when(F.col("end_owner") == F.col("conv"), F.col("length")).otherwise(F.col("length") + 1).cast("long")}
    )
    asking, path = cut_at(state, "asked")
    done = asking.where("low = high")
    ended = [path]
    while not asking.where("low < high").isEmpty():
        half = F.floor((F.col("low") + F.col("high")) / 2)
        told = asked(asking.where("low < high"), half, "owner")
        owns = F.col("owner") == F.col("conv")
        told = told.withColumns({"high": F.when(owns, half).otherwise(F.col("high")), "low": F.when(owns, F.col("low")).otherwise(half + 1)}).drop("owner")
        asking, path = cut_at(told, "asked")
        ended.append(path)
        done = done.unionByName(asking.where("low = high"))
    above = asked(done.select("conv", "length", F.col("low").alias("first"), "end_owner"), F.col("first") - 1, "parent")
    found = cut(above, "chains")
    for path in ended:
        remove(spark, path)
    return found


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) summed over each chain and all that hang on it, from (conv, parent, leaves, saved).

    By doubling from the bottom up: after round k a chain holds the sums of those
    less than 2^k below it and points to the one 2^k above, so that even a tree of
    chains as deep as the longest conversation takes its logarithm in rounds.
    """
    state, path = cut_at(chains.select("conv", F.col("parent").alias("up"), "leaves", "saved"), "totals")
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "conv")
        jump = state.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        moved = state.join(sent, "conv", "left").join(jump, "up", "left").select(
            "conv", F.col("next").alias("up"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        before = path
        state, path = cut_at(moved, "totals")
        remove(chains.sparkSession, before)
    return state.select("conv", "leaves", "saved")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (owner, depth, conv): up to PIECE ids of one node, joined by commas."""
    node, ids, first = None, [], 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["owner", "depth", "first_id", "ids"])

    for rows in batches:
        for owner, depth, conv in zip(*[rows.column(c).to_pylist() for c in ("owner", "depth", "conv")]):
            if (owner, depth) != node or len(ids) == PIECE:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, ids, first = (owner, depth), [], conv
            ids.append(str(conv))
        if out:
            yield batch()
    if ids:
        out.append((*node, first, ",".join(ids)))
        yield batch()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: the SHA-256 of each node's ids, fed piece by piece."""
    node, sha = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["owner", "depth", "ends_sha256"])

    for rows in batches:
        out = []
        for owner, depth, ids in zip(*[rows.column(c).to_pylist() for c in ("owner", "depth", "ids")]):
            if (owner, depth) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (owner, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield batch(out)
    if node:
        yield batch([(*node, sha.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of rows (owner, depth, conv).

    Ids are joined in pieces by ranges over all tasks; only a row for some
    thousands of ids goes to the one task that hashes a node's list in order.
    """
    order = ["owner", "depth", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "owner long, depth long, first_id long, ids string")
    dealt = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first_id")
    return dealt.mapInArrow(_digest, "owner long, depth long, ends_sha256 string")


def conversation_trie(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, as the contract of op13 gives them.

    Turns go by number, null first; equal numbers by a hash of role and text; repeated
    rows are turns of their own. Null role and text are empty. Rows without a
    conversation id are no conversation's. Ids are taken modulo ``every`` towards 0. A
    conversation rebuilt to no turns ends at the root. Other columns are ignored,
    whatever their names. An empty table gives no rows, not even a root. Sequences
    are equal if 128 bits of their turns' hashes are.
    """
    spark = turns.sparkSession
    turns = turns.select("conv_id", "turn", "role", "text")
    lengths, rebuilt = rebuilt_turns(numbered_turns(turns), every, most)
    digests = prefix_digests(rebuilt)
    nodes = cut(digests.groupBy("depth", "a", "b").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "nodes")
    chains = first_owned(lengths, digests, nodes)
    root = lengths.agg(F.min("conv").alias("root"), F.count("*").alias("n_convs")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root["root"] is None:
        return spark.createDataFrame([], schema)
    at_root = F.lit(root["root"])
    # What hangs where: a chain's first node is a child of its parent's node one depth above; the root's own chain hangs on it too.
    owned = chains.where("first <= length").select("conv", "length", "first", F.coalesce("parent", at_root).alias("parent"))
    hanging = owned.groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    of_root = hanging.where("depth = 0").agg(F.sum("hung").alias("hung")).first()["hung"] or 0
    own = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    tips = hanging.where("depth > 0").select(F.col("owner").alias("conv"), F.col("depth").alias("length"), "hung")
    # A chain points to the chain that it hangs on; those on the root to none.
    up = F.when(F.col("first") > 1, F.col("parent"))
    links = owned.join(own, "conv").join(tips, ["conv", "length"], "left").select(
        "conv", "first", "length", up.alias("parent"), F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved"
    )
    links = cut(links, "links")
    totals = cut(chain_totals(links), "chain-totals")
    below = totals.join(links.where("parent is not null").select("conv", "first", "parent"), "conv").groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(
        F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"), F.count("*").alias("hung")
    )
    zero = F.lit(0).cast("long")
    along = nodes.select("owner", "depth", "n_convs", "words").join(links.select(F.col("conv").alias("owner"), "first", "length", "parent"), "owner").join(below, ["owner", "depth"], "left")
    last = F.col("depth") == F.col("length")
    along = along.select(
        "owner", "depth", (-F.col("depth")).alias("from_tip"), "n_convs",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.coalesce("parent", at_root)).alias("parent_conv_id"),
        (F.when(last, zero).otherwise(1) + F.coalesce("hung", zero)).alias("n_children"),
        (F.when(last & F.col("hung").isNull(), 1).otherwise(zero) + F.coalesce("hung_leaves", zero)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("hung_saved", zero)).alias("saved"),
    )
    # Sums from the tip of each chain down to the node.
    summed = prefix_sums(along, ["from_tip"], {"leaves_after": F.col("leaves"), "saved_after": F.col("saved")}, keys=["owner"], tag="along")
    summed = summed.select(
        "owner", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaves_after")).alias("n_leaves"), (F.col("saved") + F.col("saved_after")).alias("saved_tokens")
    )
    tops = totals.join(links.where("parent is null").select("conv"), "conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    # The root's text is empty and so saves no words; without chains it is the one leaf.
    top = spark.createDataFrame([(root["root"], 0, None, root["n_convs"], of_root, tops["leaves"] or 1, tops["saved"] or 0)], "owner long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = chains.select(F.when(F.col("length") == 0, at_root).otherwise(F.col("end_owner")).alias("owner"), F.col("length").alias("depth"), "conv")
    all_nodes = summed.unionByName(top).join(end_digests(ends), ["owner", "depth"], "left")
    return all_nodes.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 by its table of 256 entries, each made by eight steps from the reversed polynomial.
_CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (
  SELECT conv, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv, max(pos) AS n FROM turns GROUP BY conv), tab)"""
ORACLE_SQL = rf"""
WITH RECURSIVE turns AS MATERIALIZED (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
{_CRC},
given AS (SELECT o.conv, t.pos, t.said FROM own o JOIN turns t ON t.conv = o.conv - o.conv % 20 AND t.pos <= o.h),
rebuilt AS (
  SELECT conv, pos, said FROM given
  UNION ALL SELECT t.conv, t.pos - o.h + least(o.h, coalesce(b.n, 0)), t.said FROM turns t JOIN own o ON o.conv = t.conv AND t.pos > o.h LEFT JOIN own b ON b.conv = o.conv - o.conv % 20),
seqs AS (SELECT own.conv, coalesce(list(said ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS said FROM own LEFT JOIN rebuilt USING (conv) GROUP BY own.conv),
prefixes AS MATERIALIZED (SELECT conv, d, md5(CAST(said[1:d] AS VARCHAR)) AS p, CASE WHEN d > 0 THEN md5(CAST(said[1:d - 1] AS VARCHAR)) END AS above, d = len(said) AS ends, said[d].text AS text FROM (SELECT conv, said, unnest(range(0, len(said) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, p, min(above) AS above, min(conv) AS conv, count(*) AS n, sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY d, p),
family AS MATERIALIZED (SELECT c.*, q.conv AS parent FROM nodes c LEFT JOIN nodes q ON q.d = c.d - 1 AND q.p = c.above),
born AS (SELECT d - 1 AS d, above AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
up(d, p, leaf, saved) AS (
  SELECT f.d, f.p, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END, f.saved FROM family f LEFT JOIN born b USING (d, p)
  UNION ALL SELECT f.d - 1, f.above, u.leaf, u.saved FROM up u JOIN family f USING (d, p) WHERE f.d > 0),
sums AS (SELECT d, p, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY d, p)
SELECT conv AS conv_id, d AS depth, parent AS parent_conv_id, f.n AS n_convs, CAST(coalesce(b.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM family f JOIN sums s USING (d, p) LEFT JOIN born b USING (d, p)"""
