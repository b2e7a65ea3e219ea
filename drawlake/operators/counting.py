"""Counting equipment and cables of drawings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import rules as R
from drawlake.functions.cables import cable_suffix, laying_method, parse_cable, split_laying
from drawlake.operators.graph import once
from drawlake.operators.spatial import box_join, exclude_zones

Keys = Sequence[str]


def count_labels(texts: DataFrame, legend: DataFrame, boxes: DataFrame, grid: DataFrame | None = None, keys: Keys = ("file_id",)) -> DataFrame:
    """Labels outside legends and grid axes by legend symbol: the symbol itself, or a number with А or АЭ for its number.

    Returns (keys, symbol, name, count, count_ae), a row for each symbol of the legend.
    """
    free = exclude_zones(texts, boxes, keys)
    if grid is not None:
        free = free.join(grid.select(*keys, "seq"), [*keys, "seq"], "left_anti")
    free = free.withColumn("label", F.trim("text"))
    base = F.regexp_extract("label", r"^([0-9]+)(А|АЭ)$", 1)
    exact = free.join(legend.select(*keys, F.col("symbol").alias("label")), [*keys, "label"]).select(*keys, F.col("label").alias("symbol"), F.lit(0).alias("ae"))
    rest = free.join(legend.select(*keys, F.col("symbol").alias("label")), [*keys, "label"], "left_anti").where(base != "")
    variant = rest.select(*keys, base.alias("symbol"), F.when(F.col("label").endswith("АЭ"), 1).otherwise(0).alias("ae"))
    n = exact.unionByName(variant).groupBy(*keys, "symbol").agg(F.count_if(F.col("ae") == 0).alias("count"), F.count_if(F.col("ae") == 1).alias("count_ae"))
    return legend.join(n, [*keys, "symbol"], "left").na.fill(0, ["count", "count_ae"])


def unlisted_labels(texts: DataFrame, legend: DataFrame, boxes: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """(keys, label, kind, count): labels outside legends that are no symbol of the legend nor a variant of one - special ones, and unlisted ones of four characters at most."""
    free = exclude_zones(texts, boxes, keys).withColumn("label", F.trim(F.split("text", "\n")[0]))
    special = F.col("label").isin(*R.SPECIAL_LABELS)
    free = free.where(special | (F.col("label").rlike(R.LABEL) & (F.length("label") <= 4))).withColumn("base", F.regexp_extract("label", r"^([0-9]+)(А|АЭ)$", 1))
    known = legend.select(*keys, F.col("symbol").alias("label"))
    rest = free.join(known, [*keys, "label"], "left_anti").join(known.withColumnRenamed("label", "base"), [*keys, "base"], "left_anti")
    return rest.groupBy(*keys, "label", F.when(special, "special").otherwise("unlisted").alias("kind")).agg(F.count("*").alias("count"))


def count_body_tokens(lines: DataFrame, symbols: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """(keys, symbol, kind, count) of running text (keys, text): whole tokens that are symbols (exact), symbols with АЭ (variant),
    and other tokens that look like one (unlisted). Lines of axis or of long numbers are dropped; ``symbols`` (symbol) hold for all."""
    t = F.trim("text")
    words = lines.where(~t.rlike(R.GRID_LINE) & ~t.rlike(R.NUMBER_LINE)).select(*keys, F.explode(F.split(t, r"\s+")).alias("token")).where("token <> ''")
    n = words.groupBy(*keys, "token").agg(F.count("*").alias("count"))
    known = symbols.select(F.col("symbol").alias("token"), F.lit(True).alias("_s"))
    base = F.when(F.col("token").endswith("АЭ"), F.expr("substr(token, 1, length(token) - 2)"))
    n = n.join(known, "token", "left").withColumn("_b", base).join(symbols.select(F.col("symbol").alias("_b"), F.lit(True).alias("_v")), "_b", "left")
    short = F.regexp_extract("token", r"^([0-9]+)А$", 1)
    n = n.withColumn("_c", F.when(short != "", short)).join(symbols.select(F.col("symbol").alias("_c"), F.lit(True).alias("_w")), "_c", "left")
    other = F.col("token").rlike(R.LABEL) & ~F.col("token").isin("0", "1х") & ~F.col("token").endswith("ЛК") & F.col("_w").isNull()
    kind = F.when(F.col("_s").isNotNull(), "exact").when(F.col("_v").isNotNull(), "variant").when(other, "unlisted")
    return n.withColumn("kind", kind).where("kind is not null").select(*keys, F.when(F.col("kind") == "variant", F.col("_b")).otherwise(F.col("token")).alias("symbol"), "kind", "count")


def count_tokens(lines: DataFrame, symbols: DataFrame, keys: Keys = ("file_id",), text: str = "text") -> DataFrame:
    """Whole tokens of running text that are symbols; lines of long numbers are dropped."""
    words = lines.where(~F.col(text).rlike(r"[0-9]{6,}")).select(*keys, F.explode(F.split(F.trim(text), r"\s+")).alias("symbol"))
    return words.join(symbols, [*keys, "symbol"] if all(k in symbols.columns for k in keys) else ["symbol"]).groupBy(*keys, "symbol").agg(F.count("*").alias("count"))


def count_inserts(inserts: DataFrame, symbols: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Inserts by symbol: the block's name if it is one, else the first attribute that is."""
    known = symbols.groupBy(*keys).agg(F.collect_set("symbol").alias("_known"))
    named = inserts.join(known, list(keys))
    own = F.when(F.array_contains("_known", F.col("block_name")), F.col("block_name")).otherwise(F.try_element_at(F.filter("attribs", lambda a: F.array_contains(F.col("_known"), a)), F.lit(1)))
    return named.withColumn("symbol", own).where(F.col("symbol").isNotNull()).groupBy(*keys, "symbol").agg(F.count("*").alias("count"))


def count_circles(circles: DataFrame, keys: Keys = ("file_id",), inserts: DataFrame | None = None, red: int = 1) -> DataFrame:
    """Distinct circle centres, red and others; a count of inserts replaces circles that are over three times as many."""
    at = F.struct(F.round("x").alias("x"), F.round("y").alias("y"))
    n = circles.groupBy(*keys).agg(F.countDistinct(F.when(F.col("color") == red, at)).alias("n_red"), F.countDistinct(F.when(F.col("color") != red, at)).alias("n_other"))
    if inserts is None:
        return n
    i = inserts.groupBy(*keys).agg(F.count("*").alias("_i"))
    return n.join(i, list(keys), "left").withColumn("n_other", F.when((F.col("_i") > 0) & (F.col("n_red") + F.col("n_other") > 3 * F.col("_i")), F.col("_i") - F.col("n_red")).otherwise(F.col("n_other"))).drop("_i")


def annotation_counts(texts: DataFrame, keys: Keys = ("file_id",), text: str = "text", boxes: DataFrame | None = None) -> DataFrame:
    """'N - text' notes with N of 1 to 500 and at least ten characters that speak of no panel, group or level: the largest N of
    each text, outside the legends' ``boxes`` if they are given."""
    texts = texts if boxes is None else exclude_zones(texts, boxes, keys)
    n = F.regexp_extract(text, r"^\s*([0-9]{1,3})\s*[-–—]\s*(.{10,})$", 1).try_cast("int")
    what = F.trim(F.regexp_extract(text, r"^\s*([0-9]{1,3})\s*[-–—]\s*(.{10,})$", 2))
    return texts.select(*keys, n.alias("n"), what.alias("name")).where(F.col("n").between(1, 500) & (F.col("name") != "") & ~F.col("name").rlike("^(?:" + "|".join(R.NO_ANNOTATION).replace(".", "[.]") + ")")).groupBy(*keys, "name").agg(F.max("n").alias("count"))


def cable_hits(texts: DataFrame, keys: Keys = ("file_id",), text: str = "text") -> DataFrame:
    """(keys, type, length_m, suffix, laying) of texts that name a cable and a length."""
    c = F.col(text)
    hits = once(texts.select(*keys, text), text, _c=parse_cable(c), suffix=cable_suffix(c), laying=laying_method(c))
    return hits.select(*keys, "_c.type", "_c.length_m", "suffix", "laying").where("type is not null and length_m is not null")


def cable_totals(hits: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Cables and metres by type; hits equal in type, length and suffix are one cable."""
    return hits.dropDuplicates([*keys, "type", "length_m", "suffix"]).groupBy(*keys, "type").agg(F.count("*").alias("count"), F.sum("length_m").cast("long").alias("total_length_m"))


def cable_by_laying(hits: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Metres by type and laying method; a combined method is split, parts that round to nothing fall away."""
    parts = hits.where("laying <> ''").withColumn("_p", F.explode(split_laying(F.col("laying"))))
    parts = parts.select(*keys, "type", F.col("_p.method").alias("method"), F.bround(F.col("length_m") * F.col("_p.share")).cast("long").alias("m")).where("m > 0")
    return parts.groupBy(*keys, "type", "method").agg(F.sum("m").alias("length_m"))


def merge_sources(structured: DataFrame, legacy: DataFrame, raw: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Of structured and legacy counts the larger by type; raw ones only for types that neither has."""
    best = structured.unionByName(legacy).groupBy(*keys, "type").agg(F.max(F.struct("total_length_m", "count")).alias("m")).select(*keys, "type", "m.count", "m.total_length_m")
    return best.unionByName(raw.select(*best.columns).join(best.select(*keys, "type"), [*keys, "type"], "left_anti"))


def choose_mode(counts: DataFrame) -> DataFrame:
    """How a file is counted, of its totals by way (n_labels, n_annotations, n_blocks, n_circles, n_legend)."""
    labels, notes, blocks, circles, legend = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_labels", "n_annotations", "n_blocks", "n_circles", "n_legend"))
    mode = F.when((notes > 20) & (notes > 3 * labels), "annotations").when((labels <= 2 * legend) & (circles > labels), "geometry").when(labels > 0, "labels").when(blocks > 0, "blocks").otherwise("auto")
    return counts.withColumn("mode", mode)


def arbitrate(text: DataFrame, detected: DataFrame, keys: Keys = ("file_id", "symbol")) -> DataFrame:
    """One count of the text's and the detector's: equal; text where nothing was detected; none where over 20 were
    detected without any text; the detector's where there is no text; text where the detector has over three times
    as many; the detector's where the text has over three times as many; the larger else."""
    both = text.select(*keys, F.col("count").alias("t")).join(detected.select(*keys, F.col("count").alias("d")), list(keys), "full_outer").na.fill(0, ["t", "d"])
    t, d = F.col("t"), F.col("d")
    count = F.when(t == d, t).when(d == 0, t).when((t == 0) & (d > 20), 0).when(t == 0, d).when(d > 3 * t, t).when(t > 3 * d, d).otherwise(F.greatest(t, d))
    why = F.when(t == d, "equal").when(d == 0, "text").when((t == 0) & (d > 20), "dropped").when(t == 0, "detected").when(d > 3 * t, "text").when(t > 3 * d, "detected").otherwise("larger")
    return both.select(*keys, count.cast("long").alias("count"), why.alias("rule"))


def page_flags(words: DataFrame, stems: Sequence[str], keys: Keys = ("file_id", "page")) -> DataFrame:
    """Schema pages (three words with a stem) and pages written backwards (three reversed stems and twice the forward ones)."""
    low = F.lower("text")
    forward = reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in stems))
    back = reduce(lambda a, b: a | b, (F.contains(low, F.lit(s[::-1])) for s in stems))
    n = words.groupBy(*keys).agg(F.count_if(forward).alias("n_forward"), F.count_if(back).alias("n_reversed"))
    return n.withColumns({"is_schema": (F.col("n_forward") >= 3) | (F.col("n_reversed") >= 3), "is_reversed": (F.col("n_reversed") >= 3) & (F.col("n_reversed") >= 2 * F.greatest(F.col("n_forward"), F.lit(1)))})


def vote_color(anchors: DataFrame, marks: DataFrame, keys: Keys, radius: float = 20.0) -> DataFrame:
    """red or blue for each anchor: its own colour, or what most marks around it have (ties: red)."""
    from drawlake.operators.spatial import near_pairs

    seen = near_pairs(anchors.select(*keys, "seq", "x", "y"), marks.where(F.col("color_class").isin("red", "blue")).select(*keys, "x", "y", "color_class"), keys, radius)
    votes = seen.groupBy(*keys, F.col("l_seq").alias("seq")).agg(F.count_if(F.col("r_color_class") == "red").alias("r"), F.count_if(F.col("r_color_class") == "blue").alias("b"))
    out = anchors.join(votes, [*keys, "seq"], "left")
    own = F.when(F.col("color_class").isin("red", "blue"), F.col("color_class"))
    return out.withColumn("voted", F.coalesce(own, F.when(F.col("r") >= F.col("b"), "red").otherwise(F.when(F.col("b").isNotNull(), "blue")))).drop("r", "b")


def row_color(rows: DataFrame, marks: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """The most frequent class, black apart, of the marks whose box meets a legend row's symbol cell; and all its classes."""
    m = marks.where(~F.col("color_class").isin("black", "")).select(*keys, F.col("x0").alias("mx0"), F.col("x1").alias("mx1"), F.col("y0").alias("my0"), F.col("y1").alias("my1"), "color_class")
    hit = box_join(m, rows.select(*keys, "seq", "x0", "y0", "x1", "y1"), keys, ("mx0", "my0", "mx1", "my1"), ("x0", "y0", "x1", "y1"))
    n = hit.groupBy(*keys, "seq", "color_class").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "seq").agg(F.min_by("color_class", F.struct((-F.col("n")).alias("n"), "color_class")).alias("color"), F.sort_array(F.collect_set("color_class")).alias("colors"))


def color_palette(parts: DataFrame, keys: Keys = ("file_id",), kinds: Sequence[str] = ("line", "rect", "char")) -> DataFrame:
    """Elements by colour and kind, with their total; the most used first in ``place``."""
    n = parts.groupBy(*keys, "color").pivot("kind", list(kinds)).count().na.fill(0)
    n = n.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "color")))


def classify_content(texts: DataFrame, rules: Sequence[tuple[str, str]], keys: Keys = ("file_id",)) -> DataFrame:
    """A flag for each (name, pattern): whether any text of the file matches; and the first elevation by seq."""
    from drawlake.functions.text import elevation_float

    flags = [F.bool_or(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(n) for n, p in rules]
    e = elevation_float(F.col("text"))
    return texts.groupBy(*keys).agg(*flags, F.min_by(e, F.when(e.isNotNull(), F.col("seq"))).alias("elevation"))
