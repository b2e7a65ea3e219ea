"""Operators on ordered rows: clusters, runs, look-back, top k, tables of words."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import rules as R

Keys = Sequence[str]


def cluster_by_gap(df: DataFrame, keys: Keys, y: str, tol: float, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Adds cluster (0, 1, ...): a new one starts where y is over ``tol`` from the row before."""
    w = Window.partitionBy(*keys).orderBy(y, *order)
    starts = F.when(F.col(y) - F.lag(y).over(w) > tol, 1).otherwise(0)
    return df.withColumn("_s", starts).withColumn("cluster", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def cluster_by_anchor(df: DataFrame, keys: Keys, y: str, tol: float) -> DataFrame:
    """Adds cluster: a new one starts where y is over ``tol`` from the cluster's first. A gap of over ``tol`` starts one for
    certain, so distinct y between two gaps are folded by themselves, and no list holds a page's."""
    from drawlake.operators.tables import anchors

    at = df.withColumn("_y", F.col(y).cast("double")).where("_y is not null")
    w = Window.partitionBy(*keys).orderBy("_y")
    ys = at.select(*keys, "_y").distinct().withColumn("_far", F.when(F.col("_y") - F.lag("_y").over(w) > tol, 1).otherwise(0)).withColumn("_run", F.sum("_far").over(w))
    folded = ys.groupBy(*keys, "_run").agg(F.collect_list("_y").alias("_ys"))
    firsts = folded.select(*keys, F.explode(anchors(F.col("_ys"), tol)).alias("_y"), F.lit(1).alias("_first"))
    starts = ys.select(*keys, "_y").join(firsts, [*keys, "_y"], "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    places = starts.select(*keys, "_y", (F.sum("_first").over(w) - 1).cast("long").alias("cluster"))
    return at.join(places.hint("merge"), [*keys, "_y"]).drop("_y").select(*df.columns, "cluster")


def runs(df: DataFrame, keys: Keys, order: Sequence[str], joined: Column) -> DataFrame:
    """Adds run: ``joined`` tells whether a row continues the one before (null: no)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


IDENTIFIER = r"^([0-9]{1,2}[АA]?|[А-ЯA-Z][0-9]{1,2})$"


def identifier_runs(words: DataFrame, keys: Keys = ("file_id", "page"), dx: float = 12.0, gap: float = 40.0, least: int = 4) -> DataFrame:
    """The longest run of rows (words within 3 of each other's height) that begin with an identifier, one below the other."""
    rows = words.withColumn("_row", F.round(F.col("top") / 3) * 3).groupBy(*keys, "_row").agg(F.min_by(F.struct("seq", "text", "x0", "top"), F.struct("x0", "seq")).alias("f")).select(*keys, "_row", "f.*")
    rows = rows.where(F.col("text").rlike(IDENTIFIER))
    w = Window.partitionBy(*keys).orderBy("_row")
    joined = (F.abs(F.col("x0") - F.lag("x0").over(w)) <= dx) & (F.col("_row") - F.lag("_row").over(w) <= gap)
    rows = runs(rows, keys, ["_row"], joined)
    size = rows.groupBy(*keys, "run").agg(F.count("*").alias("n"))
    best = size.where(F.col("n") >= least).withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "run"))).where("_p = 1").select(*keys, "run")
    return rows.join(best, [*keys, "run"]).select(*keys, "seq", "text", "x0", "top")


def density_runs(words: DataFrame, keys: Keys = ("file_id", "page"), reach: float = 400.0, dx: float = 12.0, gap: float = 40.0, least: int = 4) -> DataFrame:
    """Runs by density: identifiers with a word to their right, in columns of near x, one below the other; the longest."""
    ids = words.where(F.col("text").rlike(IDENTIFIER)).select(*keys, "seq", "text", "x0", "x1", "top")
    other = words.select(*keys, F.col("seq").alias("_s"), F.col("x0").alias("_x"), F.col("top").alias("_t"))
    beside = ids.join(other, list(keys)).where((F.col("_s") != F.col("seq")) & (F.abs(F.col("_t") - F.col("top")) <= 3) & F.col("_x").between(F.col("x1") + 1, F.col("x1") + reach)).select(*keys, "seq", "text", "x0", "top").distinct()
    columns = cluster_by_anchor(beside, keys, "x0", dx)
    w = Window.partitionBy(*keys, "cluster").orderBy("top", "seq")
    rows = runs(columns, [*keys, "cluster"], ["top", "seq"], F.col("top") - F.lag("top").over(w) <= gap)
    best = rows.groupBy(*keys, "cluster", "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = best.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "cluster", "run"))).where("_p = 1").drop("_p", "n")
    return rows.join(best, [*keys, "cluster", "run"]).select(*keys, "seq", "text", "x0", "top")


def pair_lookback(lines: DataFrame, keys: Keys, value: str, order: Sequence[str], n: int = 4) -> DataFrame:
    """Adds back: the last value that is not null among the ``n`` rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return lines.withColumn("back", F.last(value, ignorenulls=True).over(w))


def pair_positional(df: DataFrame, types: str, lengths: str) -> DataFrame:
    """A row for each type with the length at its place, or the last one where lengths are fewer; null if there is none."""
    at = df.select("*", F.posexplode(types).alias("pos", "type"))
    return at.withColumn("length", F.coalesce(F.try_element_at(F.col(lengths), F.col("pos") + 1), F.try_element_at(F.col(lengths), F.lit(-1))))


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_p") <= k).drop("_p")


def best_per_cell(df: DataFrame, keys: Keys, side: float = 120.0, seq: str = "det_id") -> DataFrame:
    """The surest detection of each cell of a square grid."""
    cells = df.withColumns({"_cx": F.floor(F.col("cx") / side), "_cy": F.floor(F.col("cy") / side)})
    return top_k(cells, [*keys, "_cx", "_cy"], [F.desc("confidence"), F.col(seq)], 1).drop("_cx", "_cy")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upper_median(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """The value at place n div 2 of each group's sorted values."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"))


def assign_rows(words: DataFrame, rows: DataFrame, keys: Keys = ("file_id", "page"), slack: float = 3.0) -> DataFrame:
    """Words with the number of the table row that they stand in: from a row line, less the slack, to the next; above the first: 0."""
    from drawlake.operators.spatial import box_join

    w = Window.partitionBy(*keys).orderBy("y")
    spans = rows.select(*keys, "y").distinct().select(*keys, (F.row_number().over(w) - 1).alias("row"), (F.col("y") - slack).alias("_lo"), (F.lead("y").over(w) - slack).alias("_hi"))
    # open ends reach further than any page
    spans = spans.withColumn("_lo", F.when(F.col("row") == 0, F.lit(-(2.0**50))).otherwise(F.col("_lo"))).withColumn("_hi", F.coalesce("_hi", F.lit(2.0**50))).withColumn("_s", F.lit(0.0))
    at = words.select(*keys, F.col("top").cast("double").alias("_top")).distinct().withColumn("_p", F.lit(0.0))
    own = box_join(at, spans, keys, ("_p", "_top", "_p", "_top"), ("_s", "_lo", "_s", "_hi")).where("_top < _hi").select(*keys, "_top", "row")
    return words.withColumn("_top", F.col("top").cast("double")).join(own, [*keys, "_top"]).select(*words.columns, "row")


def row_texts(assigned: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Each row's words joined by blanks, left to right."""
    words = F.sort_array(F.collect_list(F.struct("x0", "seq", "text")))
    return assigned.groupBy(*keys, "row").agg(F.array_join(F.transform(words, lambda s: s["text"]), " ").alias("text"))


def spec_tables(words: DataFrame, keys: Keys = ("file_id", "page"), gap: float = 60.0, least: int = 3) -> DataFrame:
    """Rows (symbol, description) of the table under a header with 'Поз.' and 'Наименование'; most rows win, the first on ties."""
    bucket = F.round(F.col("top") / 12) * 12
    w = words.withColumn("_b", bucket)
    heads = w.where(F.col("text").rlike(r"^(Поз\.?|Наименование|Кол\.?|Обозначение|Примечание|Ед\.?)$"))
    nxt = heads.withColumn("_next", F.lead("x0").over(Window.partitionBy(*keys, "_b").orderBy("x0")))
    ids = nxt.where(F.col("text").rlike(r"^Поз\.?$")).groupBy(*keys, "_b").agg(F.min("x0").alias("id_x"))
    names = nxt.where(F.col("text") == "Наименование").groupBy(*keys, "_b").agg(F.min(F.struct("x0", F.coalesce(F.col("_next") - 2, F.col("x1") + 200).alias("name_end"), "top")).alias("n"))
    header = ids.join(names, [*keys, "_b"]).select(*keys, "_b", (F.col("id_x") - 20).alias("id_lo"), (F.col("n.x0") - 2).alias("id_hi"), F.col("n.x0").alias("name_lo"), F.col("n.name_end").alias("name_hi"), F.col("n.top").alias("head_top"))
    data = words.join(header, list(keys)).where(F.col("top") > F.col("head_top") + 3).withColumn("_row", F.round(F.col("top") / 3) * 3)
    data = data.where(F.col("x0").between(F.col("id_lo"), F.col("name_hi")))
    cells = data.groupBy(*keys, "_b", "head_top", "_row").agg(
        F.min_by("text", F.when((F.col("x0") < F.col("id_hi")) & F.col("text").rlike(r"^[0-9]{1,3}[АA]?$|^[А-ЯA-Z][0-9]{0,2}$"), F.struct("x0", "seq"))).alias("symbol"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("x0") >= F.col("name_lo"), F.struct("x0", "seq", "text")))), lambda s: s["text"]), " ").alias("description"),
    )
    order = Window.partitionBy(*keys, "_b").orderBy("_row")
    before = F.coalesce(F.lag("_row").over(order), F.col("head_top"))
    far = F.sum(F.when(F.col("_row") - before > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.withColumn("_far", far).where((F.col("_far") == 0) & F.col("symbol").isNotNull() & (F.col("description") != ""))
    size = rows.groupBy(*keys, "_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = top_k(size, keys, [F.desc("n"), F.col("_b")], 1).select(*keys, "_b")
    return rows.join(best, [*keys, "_b"]).select(*keys, F.col("_row").alias("top"), "symbol", "description")


def spec_rows(cells: DataFrame, keys: Keys = ("file_id", "table_id"), tol: float = 5.0) -> DataFrame:
    """Specification rows from table cells: a number of 1 to 999 first, the first unit cell, the quantity (1 at least) after it.

    Of the cells between, those of over three characters that aren't numbers count: a supplier and a catalogue code (the last of
    each) stand apart, the others are the description, and the first of a known series is the model too.
    """
    placed = cluster_by_anchor(cells, keys, "y", tol)
    row = placed.groupBy(*keys, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "text"))), lambda s: F.trim(s["text"])).alias("t"))
    unit = F.array_position(F.transform("t", lambda s: F.regexp_replace(F.lower(s), r"\.$", "").isin("шт", "м", "компл", "комплект", "кг", "м.п").cast("string")), "true")
    row = row.withColumn("u", unit).where(F.element_at("t", 1).rlike("^[1-9][0-9]{0,2}$") & (F.col("u") > 2))
    quantity = F.replace(F.try_element_at("t", (F.col("u") + 1).cast("int")), F.lit(","), F.lit(".")).try_cast("double")
    parts = F.filter(F.slice("t", F.lit(2), F.col("u").cast("int") - 2), lambda s: (F.length(s) > 3) & ~s.rlike("^[0-9]+$"))
    sold = lambda s: F.lower(s).rlike("|".join(map(re.escape, R.SUPPLIERS)))
    code = lambda s: ~sold(s) & s.rlike(R.CATALOGUE) & ~s.rlike("|".join((*R.SERIES, *R.NO_CATALOGUE)))
    row = row.withColumns({"supplier": F.filter(parts, sold), "code": F.filter(parts, code), "own": F.filter(parts, lambda s: ~sold(s) & ~code(s))}).where((F.size("own") > 0) & (F.bround(quantity) >= 1))
    model = F.filter("own", lambda s: s.rlike("|".join((*R.SERIES, *R.MODELS))))
    row = row.withColumns({"supplier": F.coalesce(F.try_element_at("supplier", F.lit(-1)), F.lit("")), "catalog_code": F.coalesce(F.try_element_at("code", F.lit(-1)), F.lit("")), "model": F.coalesce(F.try_element_at(model, F.lit(1)), F.lit(""))})
    return row.select(*keys, F.element_at("t", 1).alias("position"), F.array_join("own", " ").alias("description"), "model", "catalog_code", "supplier", F.element_at("t", F.col("u").cast("int")).alias("unit"), F.bround(quantity).cast("int").alias("quantity"))
