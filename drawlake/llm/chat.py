"""Chat formatting with collapse of cumulative snapshots.

Logs often hold one conversation many times, each time with some turns more. Every conversation gets rolling
hashes of its turn prefixes; one whose whole hash is a proper prefix hash of a longer one is anti-joined away,
of equal ones the smallest id stays, and the maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import stored

ROLES = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
END = "<|end|>"


def rolling(turns: Column) -> Column:
    """Of sorted (turn, role, text) structs: the hash of the first turn, of the first two, and so on, each made of the one before.

    Lengths go in front of the strings, so that no two lists of turns are written alike.
    """

    def step(done, t):
        role, text = F.coalesce(t["role"], F.lit("\0")), F.coalesce(t["text"], F.lit("\0"))
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.sha2(F.concat(last, F.length(role).cast("string"), F.lit(":"), role, F.length(text).cast("string"), F.lit(":"), text), 256)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def rendered(turns: Column) -> Column:
    """Each turn as its role's mark, a line break, the text and the end mark; unknown roles are written out; nulls are empty."""
    marks = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])

    def one(t):
        role = F.coalesce(t["role"], F.lit(""))
        return F.concat(F.coalesce(F.try_element_at(marks, role), F.concat(F.lit("<|"), role, F.lit("|>"))), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END))

    return F.array_join(F.transform(turns, one), "\n")


def _gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the distinct turns of each conversation in order; a conversation is what one log entry holds, and so bounded."""
    rows = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots): conversations that no longer one continues; n_snapshots counts the logs equal to it.

    Turns are ordered by turn, then role and text; repeated rows count once; null roles and texts are values of
    their own; rows with a null conv_id belong to no conversation and give none. An empty table gives no rows.
    """
    hashed = stored(_gathered(conversations).withColumn("prefixes", rolling(F.col("turns"))).select("conv_id", F.size("prefixes").alias("n_turns"), "prefixes"), "prefixes")
    whole = hashed.select("conv_id", "n_turns", F.element_at("prefixes", -1).alias("h"))
    # equal conversations first: the many copies of a common one are counted, not joined
    lone = whole.groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"), F.min("n_turns").alias("n_turns"))
    proper = hashed.join(lone.select("conv_id"), "conv_id", "left_semi").where("n_turns > 1").select(F.explode(F.slice("prefixes", F.lit(1), F.col("n_turns") - 1)).alias("h")).distinct()
    kept = lone.join(proper, "h", "left_anti")
    return kept.select("conv_id", "n_turns", "n_snapshots")


def render_maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_snapshots and the rendered text of every maximal conversation (see ``maximal``)."""
    kept = maximal(conversations)
    mine = conversations.join(kept.select("conv_id"), "conv_id", "left_semi")
    text = _gathered(mine).select("conv_id", rendered(F.col("turns")).alias("rendered"))
    return kept.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_snapshots").join(text, "conv_id")


_MARK = "CASE " + " ".join(f"WHEN role = '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE '<|' || coalesce(role, '') || '|>' END"

ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(chr(30) || coalesce(role, chr(29)) || chr(31) || coalesce(text, chr(29)) || chr(28), '' ORDER BY turn, role, text) AS key,
  string_agg({_MARK} || chr(10) || coalesce(text, '') || '{END}', chr(10) ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots, key, min(n_turns) AS n_turns, min(rendered) AS rendered FROM c GROUP BY key),
p AS (SELECT DISTINCT string_agg(chr(30) || coalesce(a.role, chr(29)) || chr(31) || coalesce(a.text, chr(29)) || chr(28), '' ORDER BY a.turn, a.role, a.text) AS key
  FROM (SELECT *, unnest(generate_series(r, n - 1)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM t)) a GROUP BY conv_id, k)
SELECT conv_id, n_turns, n_snapshots, rendered FROM u WHERE key NOT IN (SELECT key FROM p)"""
