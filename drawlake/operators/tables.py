"""Bounds of legend tables, from lines, from a second header, or from words alone; and rows that hold two symbols.

Headers, lines, words and marks meet through cells (``box_join``); a header's own table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import rules as R
from drawlake.operators.graph import stored
from drawlake.operators.spatial import box_join, near_pairs
from drawlake.operators.turns import first_near, gone_points, in_turn, sized

Keys = Sequence[str]
TOL = 5.0
#: Fixed value: a symbol of a legend row.
SYMBOL = "^[0-9]{1,2}[А-Яа-яЁё]{0,3}$"


def anchors(heights: Column, tol: float) -> Column:
    """Of an array of numbers those that start a group: the lowest, and each that lies over ``tol`` from the last before it."""
    new = lambda acc, v: F.when(F.coalesce(v - F.try_element_at(acc, F.lit(-1)) <= tol, F.lit(False)), acc).otherwise(F.concat(acc, F.array(v)))
    return F.aggregate(F.sort_array(heights), F.array().cast("array<double>"), new)


def anchor_groups(pairs: DataFrame, keys: Keys, a: str, b: str, order: str = "seq", tol: float = TOL) -> DataFrame:
    """``pairs`` with the anchor (its ``order``) whose a and b both lie within ``tol``: pairs go by order, each to the first
    anchor that fits, or it becomes one itself. A drawing's pairs go in turn."""
    at = {"_x": F.col(a).cast("double"), "_y": F.col(b).cast("double")}
    pairs = pairs.where(" and ".join(f"`{k}` is not null" for k in keys))
    rows, large = sized(pairs, keys)
    few = pairs if large is None else pairs.join(large, list(keys), "left_anti").select(*pairs.columns)
    each = in_turn(few.withColumns(at), rows, keys, [order], [order, "_x", "_y"], first_near(tol, square=True), "anchor", pairs.schema[order].dataType)
    out = each.where("anchor is not null").drop(*at)
    if large is None:
        return out
    many = pairs.join(large, list(keys), "left_semi")
    p = many.select(*keys, F.col(order).alias("seq"), at["_x"].alias("x"), at["_y"].alias("y"))
    heads = p.join(gone_points(p, keys, tol, square=True), [*keys, "seq"], "left_anti")
    fits = (F.abs(F.col("l_x") - F.col("r_x")) < tol) & (F.abs(F.col("l_y") - F.col("r_y")) < tol)
    own = near_pairs(p, heads, keys, tol * 2**0.5).where(fits).groupBy(*keys, F.col("l_seq").alias(order)).agg(F.min("r_seq").alias("anchor"))
    return out.unionByName(many.join(own, [*keys, order]))


def _apart(df: DataFrame, other: DataFrame, keys: Keys, point: tuple[str, str], box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Pairs of ``df``'s points and ``other``'s boxes, given as columns of it."""
    names = ("_b0", "_b1", "_b2", "_b3")
    return box_join(df, other.withColumns({n: c.cast("double") for n, c in zip(names, box)}), keys, (*point, *point), names).drop(*names)


def line_bounds(segments: DataFrame, headers: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """For each header (seq, x0, top) the table that its lines draw: head_seq, x0, x1, y0, y1, row_ys, col_xs; none if there are no lines.

    Horizontal lines (over 25 long) near the header, those within 200 of its x if any are, are grouped by their two ends. Of the
    groups of at least two lines, 40 to 800 wide, the one nearest to the header is the table; where there is none, the most
    frequent left and right end. Columns are verticals across it, else any that meet it, else its two sides.
    """
    by = [*keys, "head_seq"]
    flat = segments.where((F.abs(F.col("y1") - F.col("y0")) < 2) & (F.abs(F.col("x1") - F.col("x0")) > 25)).select(*keys, "seq", F.least("x0", "x1").cast("double").alias("lx0"), F.greatest("x0", "x1").cast("double").alias("lx1"), F.least("y0", "y1").cast("double").alias("ly"))
    up = segments.where((F.abs(F.col("x1") - F.col("x0")) < 2) & (F.abs(F.col("y1") - F.col("y0")) > 25)).select(*keys, F.col("x0").cast("double").alias("vx"), F.least("y0", "y1").cast("double").alias("vy0"), F.greatest("y0", "y1").cast("double").alias("vy1"))
    heads = headers.select(*keys, F.col("seq").alias("head_seq"), F.col("x0").cast("double").alias("hx"), F.col("top").cast("double").alias("hy"))
    hx, hy = F.col("hx"), F.col("hy")
    heads = heads.withColumns({"_h0": hx - 300, "_h1": hy - 30, "_h2": hx + 800, "_h3": hy + 1000})
    near = box_join(flat, heads, keys, ("lx0", "ly", "lx1", "ly"), ("_h0", "_h1", "_h2", "_h3")).where("ly > _h1 and ly < _h3 and lx0 < _h2 and lx1 > _h0").drop("_h0", "_h1", "_h2", "_h3")
    near = near.withColumn("_own", (F.col("lx1") > hx - 200) & (F.col("lx0") < hx + 200))
    near = near.join(near.groupBy(*by).agg(F.max("_own").alias("_any")), by).where("_own or not _any").withColumns({"rx0": F.bround("lx0"), "rx1": F.bround("lx1")})
    pairs = stored(near.groupBy(*by, "rx0", "rx1").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min(F.abs(F.col("ly") - hy)).alias("far")), "ends")
    grouped = anchor_groups(pairs, by, "rx0", "rx1").groupBy(*by, "anchor").agg(F.sum("n").alias("n"), F.min("far").alias("far"), F.min_by(F.struct("rx0", "rx1"), "seq").alias("k"))
    wide = F.col("k.rx1") - F.col("k.rx0")
    best = stored(grouped.where((F.col("n") >= 2) & wide.between(40, 800)).groupBy(*by).agg(F.min_by("k", F.struct("far", "anchor")).alias("k")), "best")

    def usual(end):
        n = near.groupBy(*by, end).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        return n.groupBy(*by).agg(F.max_by(end, F.struct("n", (-F.col("first")).alias("o"))).alias(f"usual_{end}"))

    table = usual("rx0").join(usual("rx1"), by).join(best, by, "left").select(*by, F.coalesce("k.rx0", "usual_rx0").alias("x0"), F.coalesce("k.rx1", "usual_rx1").alias("x1"))
    mine = near.join(table, by).where((F.abs(F.col("rx0") - F.col("x0")) < TOL) & (F.abs(F.col("rx1") - F.col("x1")) < TOL))
    table = mine.groupBy(*by, "x0", "x1").agg(F.sort_array(F.collect_set(F.bround("ly", 1))).alias("row_ys")).withColumns({"y0": F.element_at("row_ys", 1), "y1": F.element_at("row_ys", -1)})
    wider = {"_t0": F.col("x0") - 5, "_t1": F.col("y0") - 20, "_t2": F.col("x1") + 5, "_t3": F.col("y1") + 20}
    met = box_join(up, table.drop("row_ys").withColumns(wider), keys, ("vx", "vy0", "vx", "vy1"), tuple(wider)).where("vx > _t0 and vx < _t2")
    across = (F.col("vy0") < F.col("y0") + 20) & (F.col("vy1") > F.col("y1") - 20)
    touch = (F.col("vy1") > F.col("y0") - 5) & (F.col("vy0") < F.col("y1") + 5)
    at = F.bround("vx", 1)
    cols = met.groupBy(*by).agg(F.sort_array(F.collect_set(F.when(across, at))).alias("a"), F.sort_array(F.collect_set(F.when(touch, at))).alias("t"))
    sides = F.array(F.bround("x0", 1), F.bround("x1", 1))
    chosen = F.when(F.size("a") > 0, F.col("a")).when(F.size("t") > 0, F.col("t")).otherwise(sides)
    return table.join(cols, by, "left").select(*by, "x0", "x1", "y0", "y1", "row_ys", chosen.alias("col_xs"))


def second_bounds(segments: DataFrame, words: DataFrame, bounds: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """The table right of each of ``bounds``, if a column header stands there level with its top and it has three rows at least."""
    by = [*keys, "head_seq"]
    heads = words.where(F.col("text").isin("Наименование", "Примечание")).select(*keys, F.col("x0").cast("double").alias("wx"), F.col("top").cast("double").alias("wy")).withColumn("_0", F.lit(0.0))
    first = bounds.select(*by, F.col("x1").alias("bx1"), F.col("y0").alias("by0")).withColumns({"_b0": F.lit(0.0), "_b1": F.col("by0") - 50, "_b3": F.col("by0") + 50})
    right = box_join(heads, first, keys, ("_0", "wy", "_0", "wy"), ("_b0", "_b1", "_b0", "_b3")).where((F.col("wx") > F.col("bx1") + 50) & (F.abs(F.col("wy") - F.col("by0")) < 50))
    start = right.groupBy(*by).agg((F.min("wx") - 100).alias("x0"), (F.min("wy") - 20).alias("top")).withColumnRenamed("head_seq", "seq")
    return line_bounds(segments, start, keys).where(F.size("row_ys") >= 3)


def word_bounds(words: DataFrame, headers: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Bounds from words alone: between the column headers up to 50 below the header; where there are none, around the words
    below it, if two of them at least name equipment."""
    by = [*keys, "head_seq"]
    w = words.select(*keys, "seq", "text", *(F.col(c).cast("double").alias(f"w_{c}") for c in ("x0", "x1", "top", "bottom"))).withColumn("_0", F.lit(0.0))
    heads = headers.select(*keys, F.col("seq").alias("head_seq"), F.col("x0").cast("double").alias("hx"), F.col("top").cast("double").alias("hy"))
    hx, hy = F.col("hx"), F.col("hy")
    x, top = F.col("w_x0"), F.col("w_top")
    # column headers, the last of each
    said = F.when(F.contains("text", F.lit("Обозначение")), "sign").when(F.contains("text", F.lit("Наименование")), "name").when(F.contains("text", F.lit("Примечание")), "note")
    level = _apart(w.withColumn("said", said).where("said is not null"), heads, keys, ("_0", "w_top"), (F.lit(0.0), hy - 50, F.lit(0.0), hy + 50)).where((top > hy) & (top - hy <= 50))
    got = level.groupBy(*by).agg(*(F.max_by("w_x0", F.when(F.col("said") == k, F.col("seq"))).alias(k) for k in ("sign", "name", "note"))).where("sign is not null")
    left, divide = F.col("sign") - 20, F.coalesce(F.col("name") - 10, F.col("sign") + 70)
    got = got.select(*by, left.alias("x0"), divide.alias("d"), F.coalesce(F.col("note") - 10, divide + 500).alias("n")).withColumn("x1", F.col("n") + 100).join(heads, by)
    area = _apart(w, got, keys, ("w_x0", "_0"), (F.col("x0") - 10, F.lit(0.0), F.col("x1") + 10, F.lit(0.0))).where((top > hy + 15) & (x > F.col("x0") - 10) & (x < F.col("x1") + 10))

    def rows(df):
        return F.sort_array(F.concat(F.array("hy"), anchors(df, TOL))).alias("row_ys")

    first = area.groupBy(*by, "x0", "x1", "d", "n", "hy").agg(F.max("w_bottom").alias("_bottom"), F.collect_set("w_top").alias("_ys"))
    first = first.select(*by, "x0", "x1", F.col("hy").alias("y0"), (F.col("_bottom") + 5).alias("y1"), rows(F.col("_ys")), F.array("x0", "d", "n", "x1").alias("col_xs"), F.lit("header words").alias("method"))
    rest = heads.join(first.select(*by), by, "left_anti")
    below = _apart(w, rest, keys, ("w_x0", "w_top"), (hx - 400, hy, hx + 400, hy + 500)).where((top > hy) & (top < hy + 500) & (F.abs(x - hx) < 400))
    equipment = F.lower("text").rlike("|".join(R.TABLE_WORDS))
    sums = below.groupBy(*by, "hy").agg(F.count_if(equipment).alias("n"), F.min("w_x0").alias("lo"), F.max("w_x1").alias("hi"), F.max("w_bottom").alias("_bottom"), F.max(F.when(F.col("text").rlike(SYMBOL), F.col("w_x1"))).alias("symbol"), F.collect_set("w_top").alias("_ys")).where("n >= 2")
    split = F.coalesce(F.least(F.col("symbol") + 10, F.col("lo") + 100), F.col("lo") + 75)
    second = sums.select(*by, (F.col("lo") - 10).alias("x0"), (F.col("hi") + 10).alias("x1"), F.col("hy").alias("y0"), (F.col("_bottom") + 5).alias("y1"), rows(F.col("_ys")), F.array(F.col("lo") - 10, split, F.col("hi") + 10).alias("col_xs"), F.lit("equipment words").alias("method"))
    return first.unionByName(second)


def legend_tables(segments: DataFrame, headers: DataFrame, words: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """All tables of legend headers: head_seq, table_no, method, x0, x1, y0, y1, row_ys, col_xs.

    Lines come first, words alone where a header has none; then whatever stands to the right of either, as table 2.
    """
    from drawlake.operators.graph import checkpointed

    lines = line_bounds(segments, headers, keys).withColumn("method", F.lit("lines"))
    lines = checkpointed(lines)
    bare = headers.join(lines.select(*keys, F.col("head_seq").alias("seq")), [*keys, "seq"], "left_anti")
    first = checkpointed(lines.unionByName(word_bounds(words, bare, keys)))
    second = second_bounds(segments, words, first, keys).withColumn("method", F.lit("lines"))
    return first.withColumn("table_no", F.lit(1)).unionByName(second.withColumn("table_no", F.lit(2)))


def sub_rows(rows: DataFrame, symbols: DataFrame, marks: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Items of legend rows: seq, part, symbol, x0, y0, x1, y1, color. A row whose symbol cell holds two numbers or more, one above
    the other, and marks of two colours, is split half-way between one number's bottom and the next one's top.

    ``rows`` (seq, x0, y0, x1, y1, symbol_x1) end their symbol cell at symbol_x1; ``symbols`` are the numbers' words with their
    row; ``marks`` have kind (line or rect), seq, a box and color_class. Of equally frequent colours the first mark's wins, lines first.
    A mark meets a row once, and is told apart by the row's parts there: those of its numbers, and part 0, the whole cell.
    """
    # a row's own numbers are few: they fit one array
    word = F.struct(F.col("top").cast("double").alias("top"), "x0", "text", F.col("bottom").cast("double").alias("bottom"))
    heads = symbols.groupBy(*keys, F.col("row").alias("seq")).agg(F.sort_array(F.collect_list(word)).alias("_w"))
    heads = heads.withColumn("_ys", anchors(F.filter(F.transform("_w", lambda w: w["top"]), lambda y: y.isNotNull()), 3.0)).withColumn("_n", F.size("_ys"))
    held = lambda k: F.filter("_w", lambda w: (w["top"] >= F.element_at("_ys", k)) & F.coalesce(w["top"] < F.try_element_at("_ys", k + 1), F.lit(True)))
    group = lambda ws: F.struct(ws[0]["text"].alias("symbol"), ws[0]["top"].alias("top"), F.array_max(F.transform(ws, lambda w: w["bottom"])).alias("bottom"))
    heads = heads.withColumn("_g", F.when(F.col("_n") >= 2, F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: group(held(k)))))
    cut = lambda k: (F.try_element_at("_g", k)["bottom"] + F.try_element_at("_g", k + 1)["top"]) / 2
    part = lambda k, symbol, y0, y1: F.struct(k.cast("int").alias("part"), symbol.alias("symbol"), y0.cast("double").alias("y0"), y1.cast("double").alias("y1"))
    whole = part(F.lit(0), F.col("_w")[0]["text"], F.col("y0"), F.col("y1"))
    split = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: part(k, F.element_at("_g", k)["symbol"], F.when(k == 1, F.col("y0")).otherwise(cut(F.greatest(k - 1, F.lit(1)))), F.coalesce(cut(k), F.col("y1"))))
    base = rows.select(*keys, "seq", "x0", "y0", "x1", "y1", "symbol_x1").join(heads, [*keys, "seq"], "left")
    base = stored(base.withColumn("_p", F.when(F.col("_n") >= 2, F.concat(F.array(whole), split)).otherwise(F.array(whole))).drop("_w", "_ys", "_n", "_g"), "sub-rows")

    m = marks.where(~F.coalesce(F.col("color_class").isin("black", ""), F.lit(True))).select(*keys, F.col("kind").alias("m_kind"), F.col("seq").alias("m_seq"), "color_class", *(f(a, b).cast("double").alias(f"m_{c}") for c, f, a, b in (("x0", F.least, "x0", "x1"), ("y0", F.least, "y0", "y1"), ("x1", F.greatest, "x0", "x1"), ("y1", F.greatest, "y0", "y1"))))
    edge = lambda f, c: f(F.transform("_p", lambda p: p[c]))
    right = F.least("x1", F.col("symbol_x1") + 10)
    cells = base.select(*keys, "seq", (right - F.col("x0")).alias("_wide"), "_p", (F.col("x0") - 5.0).alias("_c0"), (edge(F.array_min, "y0") - 3.0).alias("_c1"), (right + 5.0).alias("_c2"), (edge(F.array_max, "y1") + 3.0).alias("_c3"))
    hit = box_join(m, cells, keys, ("m_x0", "m_y0", "m_x1", "m_y1"), ("_c0", "_c1", "_c2", "_c3"))
    w, h = F.col("m_x1") - F.col("m_x0"), F.col("m_y1") - F.col("m_y0")

    def meets(p):  # but for the borders of tables
        high = p["y1"] - p["y0"]
        border = F.when(F.col("m_kind") == "line", (F.greatest(w, h) > high * 2) & (F.greatest(w, h) > 100)).otherwise((w > F.col("_wide") + 20) & (h > high + 10))
        return (F.col("m_y0") <= p["y1"] + 3.0) & (F.col("m_y1") >= p["y0"] - 3.0) & ~border

    hit = hit.select(*keys, "seq", "color_class", "m_kind", "m_seq", F.explode(F.transform(F.filter("_p", meets), lambda p: p["part"])).alias("part"))
    n = hit.groupBy(*keys, "seq", "part", "color_class").agg((-F.count("*")).alias("n"), F.min(F.struct("m_kind", "m_seq")).alias("first"))
    # colours are classes, so that a row has few
    found = n.groupBy(*keys, "seq").agg(F.collect_list(F.struct("part", "n", "first", "color_class")).alias("_f"))
    out = base.join(found, [*keys, "seq"], "left").withColumn("_f", F.coalesce("_f", F.array().cast(found.schema["_f"].dataType)))
    own = lambda k: F.filter("_f", lambda f: f["part"] == k)
    item = lambda p: F.struct(F.greatest(p["part"], F.lit(1)).alias("part"), p["symbol"].alias("symbol"), p["y0"].alias("y0"), p["y1"].alias("y1"), F.coalesce(F.array_min(own(p["part"]))["color_class"], F.lit("")).alias("color"))
    parts = F.when((F.size("_p") > 1) & (F.size(own(F.lit(0))) >= 2), F.filter("_p", lambda p: p["part"] > 0)).otherwise(F.filter("_p", lambda p: p["part"] == 0))
    out = out.select(*keys, "seq", "x0", "x1", F.explode(F.transform(parts, item)).alias("_i"))
    return out.select(*keys, "seq", "_i.part", "_i.symbol", "x0", "_i.y0", "x1", "_i.y1", "_i.color")


def content_frames(words: DataFrame, segments: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """The frame of a page that its content tells as a legend: x0, y0, x1, y1, row_ys, col_xs, n_words.

    Candidates are equal rounded ends of at least three horizontal lines; those with more lines come first, then narrower
    ones. The first one 80 to 700 wide, with two verticals across it and two words of equipment inside, is taken.
    """
    flat = segments.where((F.abs(F.col("y1") - F.col("y0")) < 2) & (F.abs(F.col("x1") - F.col("x0")) > 25)).select(*keys, F.bround(F.least("x0", "x1")).alias("lx0"), F.bround(F.greatest("x0", "x1")).alias("lx1"), F.least("y0", "y1").cast("double").alias("ly"))
    up = segments.where((F.abs(F.col("x1") - F.col("x0")) < 2) & (F.abs(F.col("y1") - F.col("y0")) > 25)).select(*keys, F.col("x0").cast("double").alias("vx"), F.least("y0", "y1").cast("double").alias("vy0"), F.greatest("y0", "y1").cast("double").alias("vy1"))
    ends = flat.groupBy(*keys, "lx0", "lx1").agg(F.count("*").alias("n"))
    able = ends.where((F.col("n") >= 3) & (F.col("lx1") - F.col("lx0")).between(80, 700)).select(*keys, F.col("lx0").alias("x"), F.col("lx1").alias("y"), "n")
    # lines of a frame may end a little off; pairs of ends are points that lie near each other
    at = flat.groupBy(*keys, F.col("lx0").alias("x"), F.col("lx1").alias("y")).agg(F.collect_set(F.bround("ly", 1)).alias("ys"))
    close = near_pairs(able, at, keys, TOL * 2**0.5).where((F.abs(F.col("l_x") - F.col("r_x")) < TOL) & (F.abs(F.col("l_y") - F.col("r_y")) < TOL))
    frame = close.groupBy(*keys, F.col("l_x").alias("x0"), F.col("l_y").alias("x1"), F.col("l_n").alias("n")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("r_ys")))).alias("row_ys"))
    frame = frame.withColumns({"y0": F.element_at("row_ys", 1), "y1": F.element_at("row_ys", -1)})
    by = [*keys, "x0", "x1"]
    bounds = frame.select(*by, "y0", "y1").withColumns({"_t0": F.col("x0") - 5, "_t1": F.col("y0") - 20, "_t2": F.col("x1") + 5, "_t3": F.col("y1") + 20})
    box = ("_t0", "_t1", "_t2", "_t3")
    across = box_join(up, bounds, keys, ("vx", "vy0", "vx", "vy1"), box).where("vx > _t0 and vx < _t2 and vy0 < y0 + 20 and vy1 > y1 - 20")
    cols = across.groupBy(*by).agg(F.sort_array(F.collect_set(F.bround("vx", 1))).alias("col_xs")).where(F.size("col_xs") >= 2)
    said = words.where(F.lower("text").rlike("|".join(R.FRAME_WORDS))).select(*keys, F.col("x0").cast("double").alias("wx"), F.col("top").cast("double").alias("wy"))
    inside = box_join(said, bounds, keys, ("wx", "wy", "wx", "wy"), box).where("wy > y0 - 5 and wy < y1 + 5 and wx > _t0 and wx < _t2")
    told = inside.groupBy(*by).agg(F.count("*").alias("n_words")).where("n_words >= 2")
    order = F.struct((-F.col("n")).alias("a"), (F.col("x1") - F.col("x0")).alias("b"), F.col("x0").alias("c"))
    return frame.join(cols, by).join(told, by).groupBy(*keys).agg(F.min_by(F.struct("x0", "y0", "x1", "y1", "row_ys", "col_xs", "n_words"), order).alias("f")).select(*keys, "f.*")
