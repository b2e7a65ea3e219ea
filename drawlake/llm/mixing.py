"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

Leaves are sources under a language under a domain. A token budget is dealt down that tree: the children of
a node share its budget by weight, no child gets more than its leaves can give (their tokens times the number
of epochs), and what one lacks goes to its siblings before it goes up. A leaf's share is filled with whole
epochs and then with a prefix, by tokens, of the next epoch's seeded order. All budgets are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import stored

SEED = "mix-1"
#: The budget as a share of all tokens, and how often a document may be used.
BUDGET = (6, 10)
EPOCHS = 2
#: Rows that a slice of a leaf's order holds on average; only the slice that the cut falls in is ordered by row.
SLICE = 512
LEVELS = ("domain", "lang", "source")
_WIDE = "decimal(38,0)"
_HASH_BITS = 60


def domain_of(source: Column) -> Column:
    """The default tree's upper level: sources are dealt to four domains by the number that ends their name."""
    n = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(F.length(n) > 0, F.concat(F.lit("domain"), (F.right(n, F.lit(2)).cast("int") % 4).cast("string"))).otherwise("other")


def node_weight(level: str, name: Column) -> Column:
    """Default weights: English weighs three times another language; domain0 twice another domain; sources weigh alike."""
    if level == "domain":
        return F.when(name == "domain0", 2).otherwise(1)
    if level == "lang":
        return F.when(name == "en", 3).otherwise(1)
    return F.lit(1)


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place_of(key: Column, epoch: Column, seed: str) -> Column:
    """A document's place in an epoch's order: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def dealt(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Gives each child its part of ``budget`` (the parent's), at most its ``capacity``: adds ``share``.

    Children are taken by capacity over weight; those at the front that an even deal would overfill get
    their capacity, the others share the rest by weight, rounded down.
    """
    nodes = nodes.withColumn("w", weight.cast(_WIDE))
    order = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("w").cast("double"), name)
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_WIDE)).withColumn("weights", F.sum("w").over(on).cast(_WIDE))
    left = F.greatest(F.col("budget").cast(_WIDE) - F.col("taken"), F.lit(0).cast(_WIDE)).cast(_WIDE)
    full = F.col("capacity").cast(_WIDE) * F.col("weights") <= F.col("w") * left
    nodes = nodes.withColumn("full", full.cast("int"))
    group = Window.partitionBy(*parent)
    given = F.coalesce(F.sum(F.when(F.col("full") == 1, F.col("capacity"))).over(group), F.lit(0)).cast("long")
    among = F.coalesce(F.sum(F.when(F.col("full") == 0, F.col("w"))).over(group), F.lit(1)).cast("long")
    nodes = nodes.withColumn("given", given).withColumn("among", among)
    rest = F.expr("cast((cast(w as decimal(19,0)) * cast(budget - given as decimal(19,0))) div among as long)")
    return nodes.withColumn("share", F.when(F.col("full") == 1, F.col("capacity")).otherwise(F.least(F.col("capacity"), rest))).drop("w", "taken", "weights", "full", "given", "among", "budget")


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int], epochs: int, weight=node_weight) -> DataFrame:
    """(domain, lang, source, tokens, n_docs, capacity, share) of leaves with (domain, lang, source, tokens, n_docs)."""
    leaves = leaves.withColumn("root", F.lit(0)).withColumn("capacity", (F.col("tokens") * epochs).cast("long"))
    root = leaves.groupBy("root").agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c"))
    share = root.select("root", F.least(F.expr(f"(t * {budget[0]}) div {budget[1]}"), "c").cast("long").alias("share"))
    for depth, level in enumerate(LEVELS):
        parent = ["root", *LEVELS[:depth]]
        if level == LEVELS[-1]:
            nodes = leaves
        else:
            nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(share.select(*parent, F.col("share").alias("budget")), parent)
        share = dealt(nodes, parent, level, weight(level, F.col(level)))
    return share.drop("root")


def _keyed(docs: DataFrame, domain, **more: Column) -> DataFrame:
    """doc_id, the leaf's three names (k_domain, k_lang, k_source), the id to order by (k_id) and ``more``."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    names = {"k_domain": F.coalesce(domain(source), F.lit("none")), "k_lang": F.coalesce(F.col("lang").cast("string"), F.lit("none")), "k_source": source, "k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}
    return docs.select("doc_id", *(c.alias(k) for k, c in {**names, **more}.items()))


_KEYS = ["k_domain", "k_lang", "k_source"]


def _placed(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the place in the leaf's last, partial epoch (h) and the slice of the order it lies in."""
    rows = rows.withColumn("h", place_of(F.col("doc_id"), F.col("whole") + 1, seed))
    return rows.withColumn("slice", F.shiftright(F.shiftright("h", _HASH_BITS - 30) * F.col("slices"), 30))


def cuts(docs: DataFrame, budget=BUDGET, epochs: int = EPOCHS, seed: str = SEED, weight=node_weight, domain=domain_of) -> DataFrame:
    """A row for each leaf: how many whole epochs it gives, and where the prefix of the next one ends.

    The cut is found in two steps, so that no leaf's rows meet in one task: token sums of slices of the
    order (their number follows the leaf's rows), then the rows of the one slice that the cut falls in.
    """
    slim = stored(_keyed(docs, domain, tokens=tokens_of(F.col("text").cast("string"))), "mix-slim")
    leaves = slim.groupBy(*_KEYS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    named = leaves.select(*(F.col(k).alias(level) for k, level in zip(_KEYS, LEVELS)), "tokens", "n_docs")
    shares = leaf_budgets(named, budget, epochs, weight)
    each = shares.select(
        *(F.col(level).alias(k) for k, level in zip(_KEYS, LEVELS)),
        F.coalesce(F.expr("share div nullif(tokens, 0)"), F.lit(0)).cast("int").alias("whole"),
        F.coalesce(F.expr("share % nullif(tokens, 0)"), F.lit(0)).alias("rest"),
        F.greatest(F.ceil(F.col("n_docs") / SLICE), F.lit(1)).cast("long").alias("slices"),
    )
    each = stored(each, "mix-leaves")
    rows = _placed(slim.join(each.where(F.col("whole") < epochs), _KEYS), seed)
    sums = rows.groupBy(*_KEYS, "slice").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*_KEYS).orderBy("slice")
    at = sums.withColumn("c", F.sum("t").over(upto)).where((F.col("c") > F.col("rest")) & (F.col("c") - F.col("t") <= F.col("rest")))
    at = stored(at.select(*_KEYS, "slice", (F.col("c") - F.col("t")).alias("before")), "mix-slices")
    # equal places (repeated rows) come together
    inside = Window.partitionBy(*_KEYS, "slice").orderBy("h", "k_id")
    kept = rows.join(at, [*_KEYS, "slice"]).withColumn("c", F.col("before") + F.sum("tokens").over(inside)).where(F.col("c") <= F.col("rest"))
    last = kept.groupBy(*_KEYS).agg(F.max(F.struct("h", "k_id")).alias("last"))
    out = each.join(at.select(*_KEYS, F.col("slice").alias("cut_slice")), _KEYS, "left").join(last, _KEYS, "left")
    return stored(out, "mix-cuts")


def mix(docs: DataFrame, budget=BUDGET, epochs: int = EPOCHS, seed: str = SEED, weight=node_weight, domain=domain_of) -> DataFrame:
    """The rows that the mixture takes, with all columns of ``docs`` and ``epoch`` (1, 2, ...): a row for each use.

    Needs the columns doc_id, text, lang, source. A null source or language is a leaf named ``none``; null or
    empty texts have no tokens, and come with whole epochs or before the cut. A leaf without tokens gives
    nothing. Repeated rows share a place and are taken or left together. An empty table gives no rows. A
    column of ``docs`` already named epoch is replaced.
    """
    limits = cuts(docs, budget, epochs, seed, weight, domain)
    # a document's own columns travel in one, so that none of their names can clash with those of the cuts
    rows = _placed(_keyed(docs, domain, row=F.struct(*(F.col(f"`{c}`") for c in docs.columns))).join(limits, _KEYS), seed)
    before = F.coalesce(F.col("slice") < F.col("cut_slice"), F.lit(False))
    in_slice = F.coalesce((F.col("slice") == F.col("cut_slice")) & (F.struct("h", "k_id") <= F.col("last")), F.lit(False))
    uses = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("whole") < epochs) & (before | in_slice), 1).otherwise(0)
    rows = rows.withColumn("uses", uses).where("uses > 0")
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "epoch"), F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("epoch"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of every use of a document in the mixture."""
    taken = mix(docs.select("doc_id", "text", "lang", "source"), **options)
    domain = options.get("domain", domain_of)
    return taken.select("doc_id", F.coalesce(domain(F.coalesce("source", F.lit("none"))), F.lit("none")).alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("n_tokens"), "epoch")


def oracle_sql(documents: str = "documents", budget=BUDGET, epochs: int = EPOCHS, seed: str = SEED, columns: str = "doc_id, domain, lang0 AS lang, source0 AS source, tokens AS n_tokens, epoch") -> str:
    """The same rows in SQL, by running sums over whole leaves."""
    ctes, parent = [], "root"
    names = {"domain": "CASE WHEN domain = 'domain0' THEN 2 ELSE 1 END", "lang": "CASE WHEN lang = 'en' THEN 3 ELSE 1 END", "source": "1"}
    above = f"(SELECT 0 AS root, least((sum(tokens) * {budget[0]}) // {budget[1]}, sum(tokens) * {epochs})::HUGEINT AS share FROM leaves)"
    for level in LEVELS:
        keys = f"{parent}, {level}"
        ctes.append(f"""
{level}_0 AS (SELECT n.*, p.share AS budget, ({names[level]})::HUGEINT AS w FROM (SELECT {keys}, sum(tokens)::HUGEINT * {epochs} AS capacity, sum(tokens)::HUGEINT AS tokens, sum(n_docs) AS n_docs FROM leaves GROUP BY {keys}) n JOIN {above} p USING ({parent})),
{level}_1 AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(w) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {level}_0),
{level}_2 AS (SELECT *, capacity * weights <= w * greatest(budget - taken, 0) AS is_full FROM {level}_1),
{level}_3 AS (SELECT {keys}, tokens, n_docs, CASE WHEN is_full THEN capacity ELSE least(capacity, (w * (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {parent}), 0))) // coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {parent}), 1)) END AS share FROM {level}_2)""")
        above, parent = f"{level}_3", keys
    return f"""
WITH d AS (SELECT doc_id, lang AS lang0, source AS source0, 0 AS root, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  CASE WHEN length(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1)) > 0 THEN concat('domain', CAST(right(regexp_extract(source, '([0-9]+)$', 1), 2) AS INT) % 4) ELSE 'other' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {documents}),
leaves AS (SELECT root, domain, lang, source, sum(tokens) AS tokens, count(*) AS n_docs FROM d GROUP BY ALL),{",".join(ctes)},
plan AS (SELECT domain, lang, source, coalesce(share // nullif(tokens, 0), 0) AS whole, coalesce(share % nullif(tokens, 0), 0) AS rest FROM source_3),
placed AS (SELECT d.*, whole, rest, CAST('0x' || substr(md5(concat_ws(':', '{seed}', whole + 1, coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS BIGINT) AS h FROM d JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS c FROM placed),
used AS (SELECT *, whole + CASE WHEN rest > 0 AND whole < {epochs} AND c <= rest THEN 1 ELSE 0 END AS uses FROM summed)
SELECT {columns} FROM (SELECT *, unnest(generate_series(1, CAST(uses AS INT))) AS epoch FROM used WHERE uses > 0)"""
