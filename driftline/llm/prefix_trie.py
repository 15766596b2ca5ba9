"""Conversation prefix trie, merged family first.

A family is the conversations of one base, conv_id - conv_id % 100. Conversation c is rebuilt as the first h = crc32(c) % 6 turns of
its base, then its own turns after its first h. A node is a distinct sequence of the first d rebuilt (role, text) pairs.

1. Turns lose their text at once: an md5 of role and text, and its code points, stay. They are numbered by conversation from ranges of
   (conversation, turn), so that one conversation may hold any share of the rows.
2. Families are cogrouped by (base, block): on one side where each conversation's path starts in the block (in the first block the base's
   first turns, later the sums up to the block), on the other its own turns. A block is BLOCK turns deep, so a group has at most 199
   conversations of BLOCK turns. A path's fingerprint is the sum of its turns' hashes with their depth (four sums of 32-bit hashes),
   so it adds up over blocks. Each group builds its small trie; combined family nodes come out, each with its members.
3. Family nodes are merged by fingerprint: smallest member, deepest member, members. Nothing else is shuffled of the families.
4. A conversation owns the nodes whose smallest member it is, which are the end of its path from some depth `top` on. All sums over a
   subtree are then sums over its members: children are members with top <= d + 1 <= length, leaves are members that own their
   childless end, and (n_convs - 1) * code points counts each member's path below d as far as it doesn't own it. So a second
   pass over the family nodes, partial sums by fingerprint, gives them without going down the tree level by level.
5. Ends are joined as text in a family, then in runs of RUN conversation ids; a node with one run is hashed there, the others' runs are
   streamed in order through one hash each, as SHA-256 is sequential.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; a null turn comes first, equal turns are
ordered by the md5 of role and text, so equal rows stay turns of their own; conversations without rebuilt turns are members of the
root only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

FAMILY, SHARED = 100, 6
#: Depths of a family's trie that are built at a time; the base's turns are all in the first block.
BLOCK = 1024
#: Conversation ids whose ends are joined before they are hashed.
RUN = 1000
_SUMS = ("s0", "s1", "s2", "s3")
_LAST = SHARED - 1


def _base(c) -> F.Column:
    return c - c % FAMILY


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, points) of every turn, materialised. Ranges of turns are counted, then numbered each from where it starts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = (conversations.where("conv_id IS NOT NULL")
           .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))).alias("digest"), F.length(text).cast("long").alias("points"))
           .withColumn("spread", F.xxhash64(F.monotonically_increasing_id())))
    ranged = own.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spread")).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged.drop("spread"), "trie-turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    more = before.where("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    inside = W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    at = ranged.withColumn("inside", F.row_number().over(inside) - 1)
    at = at.join(more, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return materialize(at.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "points"), "trie-numbered")


def _hashed(turns: DataFrame) -> DataFrame:
    """With s0 to s3: 32 bits each of hashes of depth and digest."""
    a, b = (F.xxhash64(F.lit(seed), F.col("depth").cast("long"), F.col("digest")) for seed in (1, 2))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    return turns.withColumns({"s0": low(a), "s1": low(F.shiftrightunsigned(a, 32)), "s2": low(b), "s3": low(F.shiftrightunsigned(b, 32))}).drop("digest")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts, own) by (base, block): what the families are cogrouped from.

    starts: in block 0 the base's first turns (conv_id null), in later blocks a row for each conversation with the sums up to it. own: a
    row for each conversation (depth null; head turns taken from the base, length) and for each of its own turns.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = sizes.where(c == _base(c)).select(c.alias("b"), F.col("n").alias("base_n"))
    convs = (sizes.withColumn("base", _base(c)).join(bases, F.col("base") == F.col("b"), "left").withColumn("h", F.crc32(c.cast("string").cast("binary")) % SHARED)
             .withColumn("head", F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
             .select("conv_id", "base", "h", "head", "length"))
    convs = materialize(convs, "trie-convs")
    heads = _hashed(turns.where((c == _base(c)) & (F.col("pos") < _LAST)).select(c.alias("base"), (F.col("pos") + 1).alias("depth"), "digest", "points"))
    tails = turns.join(convs.select(c.alias("own_id"), "base", "h", "head"), c == F.col("own_id")).where("pos >= h")
    tails = _hashed(tails.select("base", "conv_id", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "digest", "points")).withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    tails = materialize(tails, "trie-tails")
    nothing = F.lit(None).cast("long")
    own = tails.select("base", "block", "conv_id", "depth", "points", *_SUMS).unionByName(
        convs.select("base", F.lit(0).cast("long").alias("block"), "conv_id", nothing.alias("depth"), F.col("length").alias("points"), F.col("head").alias("s0"), *[nothing.alias(s) for s in _SUMS[1:]]))
    # Sums over a conversation's whole blocks, for those that have later ones; the base's turns are in their first.
    deep = convs.where(F.col("length") > BLOCK).select(c.alias("deep_id"), F.col("length"))
    whole = tails.join(deep, c == F.col("deep_id")).groupBy("base", "conv_id", "length", "block").agg(*[F.sum(x).alias(x) for x in ("points", *_SUMS)])
    lent = (convs.where(F.col("length") > BLOCK).join(heads.withColumnRenamed("base", "head_base"), (F.col("base") == F.col("head_base")) & (F.col("depth") <= F.col("head")))
            .groupBy("base", "conv_id", "length").agg(*[F.sum(x).alias(x) for x in ("points", *_SUMS)]).withColumn("block", F.lit(0).cast("long")))
    upto = W.partitionBy("conv_id").orderBy("block")
    sums = whole.unionByName(lent).groupBy("base", "conv_id", "length", "block").agg(*[F.sum(x).alias(x) for x in ("points", *_SUMS)])
    later = sums.select("base", "conv_id", "length", (F.col("block") + 1).alias("block"), *[F.sum(x).over(upto).alias(x) for x in ("points", *_SUMS)]).where(F.col("block") * BLOCK < F.col("length"))
    starts = heads.select("base", F.lit(0).cast("long").alias("block"), nothing.alias("conv_id"), "depth", nothing.alias("length"), "points", *_SUMS).unionByName(
        later.select("base", "block", "conv_id", (F.col("block") * BLOCK).alias("depth"), "length", "points", *_SUMS))
    return starts, own


_NODES = "base long, depth long, fingerprint binary, parent binary, points long, path_points long, members array<long>, deepest long, ends array<long>"


def _family(key: tuple, starts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """The trie of one family and block: a row for each node, members and those that end there in ascending order."""
    base, block = int(key[0]), int(key[1])
    number = lambda df, names: df[list(names)].to_numpy(np.int64, na_value=0).reshape(len(df), len(names))
    width = ("depth", "points", *_SUMS)
    turn = own["depth"].notna().to_numpy()
    rows, ids = [number(own[turn], width)], [own["conv_id"].to_numpy(np.int64)[turn]]
    if block == 0:  # the root, then the base's turns
        conv = own[~turn]
        convs, lengths, heads = (conv[x].to_numpy(np.int64) for x in ("conv_id", "points", "s0"))
        lent = number(starts.sort_values("depth"), width)
        many = (np.arange(len(lent))[None, :] < heads[:, None]).nonzero()
        rows += [np.zeros((len(convs), len(width)), np.int64), lent[many[1]]]
        ids += [convs, convs[many[0]]]
    else:
        convs, lengths = (starts[x].to_numpy(np.int64) for x in ("conv_id", "length"))
        rows.append(number(starts, width))
        ids.append(convs)
    rows, ids = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((rows[:, 0], ids))
    rows, ids = rows[order], ids[order]
    # Sums along each path: those of all rows, less those before its first.
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    sums = np.cumsum(rows[:, 1:], axis=0)
    begin = np.flatnonzero(first)
    sums -= np.repeat((sums - rows[:, 1:])[begin], np.diff(np.append(begin, len(ids))), axis=0)
    paths = np.ascontiguousarray(np.column_stack([rows[:, 0], sums[:, 1:]]))
    keep = np.ones(len(ids), bool) if block == 0 else ~first
    before = np.roll(paths, 1, axis=0)
    at = np.flatnonzero(keep)
    order = at[np.lexsort((ids[at], *paths[at].T[::-1]))]
    new = np.concatenate(([True], (paths[order[1:]] != paths[order[:-1]]).any(axis=1))) if len(order) else np.zeros(0, bool)
    top, where = order[new], np.flatnonzero(new)
    length = dict(zip(convs.tolist(), lengths.tolist()))
    members = [x.tolist() for x in np.split(ids[order], where[1:])] if len(order) else []
    depths = rows[top, 0].tolist()
    return pd.DataFrame({
        "base": base, "depth": depths, "fingerprint": [paths[i].tobytes() for i in top], "parent": [before[i].tobytes() if d else None for i, d in zip(top, depths)],
        "points": rows[top, 1], "path_points": sums[top, 0], "members": members, "deepest": [max(length[m] for m in own) for own in members],
        "ends": [[m for m in own if length[m] == d] for own, d in zip(members, depths)]})


def family_nodes(starts: DataFrame, own: DataFrame) -> DataFrame:
    return starts.groupBy("base", "block").cogroup(own.groupBy("base", "block")).applyInPandas(_family, _NODES)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(fingerprint, depth, parent, points, path_points, conv_id, n_convs, deepest) of each node."""
    same = [F.first(c).alias(c) for c in ("depth", "parent", "points", "path_points")]
    return nodes.groupBy("fingerprint").agg(*same, F.min(F.element_at("members", 1)).alias("conv_id"), F.sum(F.size("members").cast("long")).alias("n_convs"), F.max("deepest").alias("deepest"))


def _owners(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """By base, an array of 199 places (conv_id - base + 99) with each conversation's top, unowned points, length and whether its end is a leaf."""
    ends = nodes.where(F.size("ends") > 0).select("base", F.explode("ends").alias("conv"), F.col("depth").alias("length"), F.col("path_points").alias("whole"))
    tops = merged.where(~F.col("conv_id").eqNullSafe(F.col("parent_conv_id"))).select(F.col("conv_id").alias("top_id"), F.col("depth").alias("top"), (F.col("path_points") - F.col("points")).alias("unowned"))
    leaves = merged.where("deepest = depth").select(F.col("conv_id").alias("leaf_id"))
    facts = (ends.join(tops, F.col("conv") == F.col("top_id"), "left").join(leaves, F.col("conv") == F.col("leaf_id"), "left")
             .select("base", (F.col("conv") - F.col("base") + (FAMILY - 1)).cast("int").alias("place"),
                     F.struct(F.coalesce("top", F.col("length") + 1).alias("top"), F.coalesce("unowned", "whole").alias("unowned"), "length", F.col("leaf_id").isNotNull().cast("long").alias("leaf")).alias("of")))
    by = facts.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("place", "of"))).alias("of"))  # 199 entries at most
    return by.select(F.col("base").alias("owner_base"), F.transform(F.sequence(F.lit(0), F.lit(2 * FAMILY - 2)), lambda i: F.col("of")[i]).alias("owners"))


def subtree_sums(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(of, n_children, n_leaves, saved_tokens): partial sums over each family's members, added up by fingerprint."""
    met = nodes.select("fingerprint", "base", "depth", "members", (F.col("path_points") - F.col("points")).alias("above")).join(owners, F.col("base") == F.col("owner_base"))
    each = F.transform("members", lambda m: F.get("owners", (m - F.col("base") + (FAMILY - 1)).cast("int")))
    down = F.col("depth") + 1
    start = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n_children", "n_leaves", "saved_tokens")])
    part = F.aggregate(each, start, lambda a, x: F.struct(
        (a["n_children"] + ((x["top"] <= down) & (x["length"] >= down)).cast("long")).alias("n_children"), (a["n_leaves"] + x["leaf"]).alias("n_leaves"),
        (a["saved_tokens"] + F.greatest(x["unowned"] - F.col("above"), F.lit(0))).alias("saved_tokens")))
    return (met.select("fingerprint", part.alias("p")).groupBy(F.col("fingerprint").alias("of"))
            .agg(*[F.sum(f"p.{c}").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]))


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(ended, ends_sha256) of the nodes at which conversations end."""
    rows = nodes.where(F.size("ends") > 0).select("fingerprint", "base", F.floor(F.col("base") / RUN).alias("run"), F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ids"))), lambda x: x["ids"]), ",")
    runs = rows.groupBy("fingerprint", "run").agg(joined.alias("ids"))
    runs = materialize(runs, "trie-ends")
    count = runs.groupBy("fingerprint").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = count.where("n = 1").select(F.col("fingerprint").alias("ended"), F.sha2("ids", 256).alias("ends_sha256"))
    long = runs.join(count.where("n > 1").select(F.col("fingerprint").alias("of")), F.col("fingerprint") == F.col("of"), "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for of, ids in zip(batch.column("fingerprint"), batch.column("ids")):
                of, ids = of.as_py(), ids.as_py().encode()
                if of == last:
                    state.update(b"," + ids)
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = of, hashlib.sha256(ids)
            yield _pairs(done)
        yield _pairs([(last, state.hexdigest())] if last is not None else [])

    many = long.repartition("fingerprint").sortWithinPartitions("fingerprint", "run").select("fingerprint", "ids").mapInArrow(hashed, "ended binary, ends_sha256 string")
    return one.union(many)


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["ended", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, fingerprint."""
    nodes = materialize(family_nodes(*rebuilt(numbered_turns(conversations))), "trie-families")
    merged = materialize(merged_nodes(nodes), "trie-nodes")
    parents = merged.select(F.col("fingerprint").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    merged = materialize(merged.join(parents, F.col("parent") == F.col("up"), "left").drop("up"), "trie-linked")
    sums = subtree_sums(nodes, materialize(_owners(nodes, merged), "trie-owners"))
    fp = F.col("fingerprint")
    return (merged.join(sums, fp == F.col("of")).join(ends_digests(nodes), fp == F.col("ended"), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "fingerprint"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("fingerprint")


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(length(text) ORDER BY turn NULLS FIRST, m) AS ps FROM t GROUP BY conv_id
), crc AS (
  SELECT unnest(range(0, 256)) AS b
), step1 AS (
  SELECT b, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END AS r FROM crc
), step2 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step1
), step3 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step2
), step4 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step3
), step5 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step4
), step6 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step5
), step7 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step6
), step8 AS (SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END AS r FROM step7
), crc_table AS (
  SELECT list(r ORDER BY b) AS c FROM step8
), h AS (
  SELECT conv_id, ms, ps, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295) % {SHARED} AS h
  FROM own, crc_table
), r AS (
  SELECT h.conv_id, coalesce(b.ms[:h], []) || h.ms[h + 1:] AS ms, coalesce(b.ps[:h], []) || h.ps[h + 1:] AS ps FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}
), prefixes AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE md5(array_to_string(ms[:d], ',')) END AS node, CASE WHEN d < 2 THEN '' ELSE md5(array_to_string(ms[:d - 1], ',')) END AS up, ps[d] AS points, d = len(ms) AS ends
  FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM r)
), nodes AS (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(points, 0)) AS points, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, node
), kids AS (
  SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, node)
), below AS (
  SELECT a.d, a.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.points) AS saved
  FROM full_nodes n JOIN prefixes a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below USING (d, node) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.up
"""
