"""Prefix trie of conversations, rolled up by depth bands.

Every conversation is a path of turn prefixes. A prefix is known by the xor of its turns' digests, each taken with
its place, so that paths need no chain and a long conversation can be cut anywhere. Subtree sums go up in bands of
fixed height: a node explodes only to its ancestors inside its band; the roots of all bands make up a trie a height
lower, which is rolled up in the same way, and the finished totals of a band's root are then added to the band above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import CRC32_SQL, crc32_sql, fold_of, stored

HEIGHT = 32
#: Conversations of one base: c - c % FAMILY; their common head has crc32(c) % HEADS turns.
FAMILY, HEADS = 5, 9
#: Conversation ids that are joined to one piece of text before they are hashed in order.
BLOCK = 4096
_SUMS = ("n_leaves", "saved_tokens")


def running(df: DataFrame, key: str, order: list[str], place: str, xors: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its key, and running xors of columns in their stead.

    Ranges of (key, order) deal the rows, so that a key of any size is spread. A range continues one key of the range
    before at most; what those have had before is as many rows as there are ranges, and so broadcast.
    """
    part = "_part"
    rows = stored(df.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id()), "running")
    sizes = rows.groupBy(part, key).agg(F.count("*").alias("_n"), *(F.bit_xor(x).alias(f"_{x}") for x in xors))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = sizes.select(part, key, F.sum("_n").over(before).alias("_n"), *(F.bit_xor(f"_{x}").over(before).alias(f"_{x}") for x in xors)).where("_n is not null")
    upto = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({place: F.row_number().over(Window.partitionBy(part, key).orderBy(*order)), **{x: F.bit_xor(x).over(upto) for x in xors}})
    rows = rows.join(F.broadcast(held), [part, key], "left").withColumn(place, F.col(place) + F.coalesce("_n", F.lit(0)))
    return rows.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(f"_{x}", F.lit(0))) for x in xors}).drop(part, "_n", *(f"_{x}" for x in xors)) if xors else rows.drop(part, "_n")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, head, pos, item, bytes): the turns of every rebuilt conversation, in the order of head and pos.

    ``item`` is a digest of role and text. A conversation without a turn has no row here.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    turns = running(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text.values()), "conv_id", ["turn", "role", "text"], "pos")
    item = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = stored(turns.select("conv_id", "pos", item.alias("item"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    h = fold_of(F.col("conv_id"), HEADS)
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("head"), "pos", "item", "bytes")
    # a base has FAMILY conversations and HEADS - 1 turns that they may take
    mine = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "item", "bytes")
    return mine.join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("head"), "pos", "item", "bytes").union(own)


def _node(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes) of each prefix of each conversation of ``convs``, the root (depth 0) included.

    A node is 120 bits of SHA-256 digests; parent is the node without its last turn.
    """
    rows = running(turns.select("conv_id", "head", "pos", "item", "bytes"), "conv_id", ["head", "pos"], "depth")
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("item")), 256)
    part = {"a": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), "b": F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")}
    rows = rows.select("conv_id", "depth", "bytes", *(c.alias(k) for k, c in part.items()), *(c.alias(f"own_{k}") for k, c in part.items()))
    rows = running(rows, "conv_id", ["depth"], "place", ("a", "b"))
    a, b, own_a, own_b = (F.col(c) for c in ("a", "b", "own_a", "own_b"))
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), _node(a, b).alias("node"), _node(a.bitwiseXOR(own_a), b.bitwiseXOR(own_b)).alias("parent"), "bytes")
    root = _node(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.union(convs.select("conv_id", F.lit(0).cast("long"), root, F.lit(None).cast("binary"), F.lit(0).cast("long")))


def subtree_sums(path: DataFrame, values: DataFrame, sums: tuple[str, ...], height: int = HEIGHT) -> DataFrame:
    """(node, sums): each column of ``values`` (node, sums) summed over the subtree of each node, its top included.

    ``path`` holds (conv_id, depth, node, parent) of every prefix. The explosion is at most ``height`` rows a node, and
    there are as many levels of bands as the depth has digits in base ``height`` (2 at least).
    """
    band = Window.partitionBy("conv_id", F.floor(F.col("depth") / height)).orderBy("depth")
    over = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / height)).orderBy("depth")  # of a band's root: the parents of these rows are the band above
    up = path.withColumn("up", F.collect_list("node").over(band)).groupBy("node").agg(F.first("up").alias("up"))
    total = [F.sum(s).alias(s) for s in sums]
    inside = up.join(values, "node").select(F.explode("up").alias("node"), *sums).groupBy("node").agg(*total)
    if (path.agg(F.max("depth")).first()[0] or 0) < height:
        return inside
    inside = stored(inside, "inside")
    tops = stored(path.where("depth > 0").withColumn("above", F.collect_list("parent").over(over)).where(F.col("depth") % height == 0), "tops")
    level = (F.col("depth") / height).cast("long").alias("depth")
    # a level higher, the parent of a band's root is the root of the band above
    lifted = tops.select("conv_id", level, "node", F.col("above")[0].alias("parent")).union(path.where("depth = 0").select("conv_id", level, "node", "parent"))
    done = stored(subtree_sums(lifted, inside, sums, height), "bands")
    above = tops.groupBy("node").agg(F.first("above").alias("above"))
    passed = above.join(done, "node").select(F.explode("above").alias("node"), *sums)
    return inside.union(passed).groupBy("node").agg(*total)


def ids_hash(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the ids in ascending order, joined by commas.

    Ids are joined in blocks of at most BLOCK; a node's blocks then run in order through one hash, which is sequential
    by its nature, and of which only the state is held.
    """
    ids = members.groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for b in batches:
            nodes, done = [], []
            for key, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        done.append(state.hexdigest())
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(done, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = ids.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return rows.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own; null roles and
    texts are empty. Rows with a null conv_id belong to no conversation. A conversation that is rebuilt without a turn
    is a member of the root alone and ends there. An empty table has no node. Other columns are ignored.
    """
    turns = rebuilt(conversations)
    convs = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    path = stored(paths(turns, convs), "paths")
    nodes = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(path.select("conv_id", "depth", "node", "parent"), values, _SUMS, height)
    ends = path.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")).select(F.col("end.node").alias("node"), "conv_id")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ids_hash(ends), "node", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *_SUMS, F.coalesce("ends_sha256", none).alias("ends_sha256"))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql('conv_id::VARCHAR')} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t), crc_tab),
r AS (SELECT c.conv_id, 0 AS head, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY head, pos) AS depth FROM r),
p AS (SELECT conv_id, depth, strlen(text) AS bytes, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(bytes) AS bytes FROM p GROUP BY node),
parents AS (SELECT n.node, u.node AS parent FROM nodes n JOIN p u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY 1),
sums AS (SELECT u.node, sum((k.n_children IS NULL)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n JOIN p u ON u.conv_id = n.conv_id AND u.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY 1),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN parents o USING (node) LEFT JOIN nodes q ON q.node = o.parent LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node"""
