"""Legends: their descriptions and symbols, and where their items stand on a sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import rules as R
from drawlake.functions.text import is_auto_detected, is_non_countable
from drawlake.operators.graph import stored
from drawlake.operators.sequences import density_runs, identifier_runs
from drawlake.operators.spatial import box_join, exclude_zones, in_box
from drawlake.operators.tables import content_frames

Keys = Sequence[str]
#: How legends are found, surest first.
METHODS = ("header", "content", "spec", "density")
#: Headers, and words that speak of equipment.
HEADER = r"(?iu)условн\S*\s+обозначен|экспликаци"
EQUIPMENT = r"(?iu)светильник|розетк|выключател|щит|указател|датчик|коробк|кабел|лоток"
END = r"(?iu)^(примечани|спецификаци|ведомость)"


def drop_non_equipment(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name is neither of work or routes nor made up."""
    c = F.col(name)
    return df.where(~F.coalesce(is_non_countable(c) | is_auto_detected(c), F.lit(False)))


def filter_colors(df: DataFrame, show: Sequence[str] = (), hide: Sequence[str] = (), color: str = "color") -> DataFrame:
    """Elements of the colours to show (all, if none is named) but for those to hide."""
    c = F.lower(F.col(color))
    shown = c.isin(*[x.lower() for x in show]) if show else F.lit(True)
    return df.where(shown & ~F.coalesce(c.isin(*[x.lower() for x in hide]) if hide else F.lit(False), F.lit(False)))


def pictograms(words: DataFrame, zones: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """How many exit signs, written forwards or backwards, stand outside the zones of each page."""
    signs = words.where(F.upper(F.trim("text")).isin("ВЫХОД", "ДОХЫВ")).withColumns({"x": F.col("x0"), "y": F.col("top")})
    return exclude_zones(signs, zones, keys).groupBy(*keys).agg(F.count("*").alias("count"))


def legend_descriptions(texts: DataFrame, boxes: DataFrame, keys: Keys = ("file_id",), least: int = 8) -> DataFrame:
    """First lines of at least eight characters inside a legend box, from the top, with symbols L1, L2, ... for the distinct ones."""
    b = boxes.select(*keys, "x0", "y0", "x1", "y1")
    same = reduce(lambda a, c: a & c, [texts[k] == b[k] for k in keys])
    line = F.trim(F.element_at(F.split("text", "\n"), 1))
    inside = texts.join(b, same & in_box(texts["x"], texts["y"], b), "left_semi").withColumn("description", line)
    inside = inside.where((F.length("description") >= least) & ~F.col("description").rlike(HEADER))
    first = inside.groupBy(*keys, "description").agg(F.max_by(F.struct("x", "y", "seq"), F.struct("y", (-F.col("seq")).alias("o"))).alias("p"))
    order = Window.partitionBy(*keys).orderBy(F.desc("p.y"), "p.seq")
    return first.select(*keys, F.concat(F.lit("L"), F.row_number().over(order)).alias("symbol"), "description", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.seq").alias("seq"))


def _level_pairs(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Pairs of rows of a drawing (l_seq, r_seq, dist) whose heights are at most ``reach`` apart: a column that is equal for a drawing."""
    cell = lambda y: F.floor(F.col(y) / F.col("_reach")).cast("long")
    a = left.select(*keys, F.col("seq").alias("l_seq"), F.col("y").alias("l_y"), F.col("reach").alias("_reach")).withColumn("_cell", cell("l_y"))
    b = right.select(*keys, F.col("seq").alias("r_seq"), F.col("y").alias("r_y"), F.col("reach").alias("_reach"))
    b = b.withColumn("_cell", F.explode(F.array(cell("r_y") - 1, cell("r_y"), cell("r_y") + 1))).drop("_reach")
    dist = F.abs(F.col("l_y") - F.col("r_y"))
    return a.join(b, [*keys, "_cell"]).withColumn("dist", dist).where(F.col("dist") <= F.col("_reach")).select(*keys, "l_seq", "r_seq", "dist")


#: Pairs of a drawing up to which it is matched as one row's lists.
LISTED = 1024


def _level_match(rows: DataFrame, keys: Keys) -> DataFrame:
    """Left and right rows of a drawing one to one, nearest in height first: (keys, l_seq, l_y, l_text, r_seq, r_text).

    ``rows``: (keys, left, seq, y, text, reach), reach how far apart a drawing's pairs may lie. A drawing of few pairs is a row of
    two lists, so that most drawings take one shuffle; the pairs of a larger one are dealt by height and taken in rounds.
    """
    from drawlake.operators.iterative import greedy_match

    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_pairs", F.count_if("left").over(w) * F.count_if(~F.col("left")).over(w)).where("_pairs > 0")
    rows = stored(rows.select(*keys, "left", "seq", "y", "text", "reach", "_pairs"), "level")
    side = lambda of: F.collect_list(F.when(of, F.struct("seq", "y", "text")))
    lists = rows.where(F.col("_pairs") <= LISTED).groupBy(*keys).agg(side(F.col("left")).alias("l"), side(~F.col("left")).alias("r"), F.max("reach").alias("reach"))
    dist = lambda a, b: F.abs(a["y"] - b["y"])
    near = F.flatten(F.transform("l", lambda a: F.transform(F.filter("r", lambda b: dist(a, b) <= F.col("reach")), lambda b: F.struct(dist(a, b).alias("dist"), a["seq"].alias("l_seq"), b["seq"].alias("r_seq")))))
    free = lambda got, p: ~F.exists(got, lambda q: (q["l_seq"] == p["l_seq"]) | (q["r_seq"] == p["r_seq"]))
    taken = F.aggregate(F.sort_array("near"), F.slice("near", 1, 0), lambda got, p: F.when(free(got, p), F.array_append(got, p)).otherwise(got))
    of = lambda c, seq: F.filter(c, lambda a: a["seq"] == seq)
    both = lambda p: F.flatten(F.transform(of("l", p["l_seq"]), lambda a: F.transform(of("r", p["r_seq"]), lambda b: F.struct(a["seq"].alias("l_seq"), a["y"].alias("l_y"), a["text"].alias("l_text"), b["seq"].alias("r_seq"), b["text"].alias("r_text")))))
    listed = lists.withColumn("near", near).withColumn("taken", taken).select(*keys, F.inline(F.flatten(F.transform("taken", both))))
    many = rows.where(F.col("_pairs") > LISTED)
    if many.isEmpty():
        return listed
    left, right = many.where("left"), many.where("not left")
    dealt = greedy_match(_level_pairs(left, right, keys), keys, "l_seq", "r_seq", "dist").drop("dist")
    dealt = dealt.join(left.select(*keys, F.col("seq").alias("l_seq"), F.col("y").alias("l_y"), F.col("text").alias("l_text")), [*keys, "l_seq"])
    return listed.unionByName(dealt.join(right.select(*keys, F.col("seq").alias("r_seq"), F.col("text").alias("r_text")), [*keys, "r_seq"]))


def _inside(df: DataFrame, boxes: DataFrame, keys: Keys) -> DataFrame:
    b = boxes.select(*keys, "x0", "y0", "x1", "y1")
    same = reduce(lambda a, c: a & c, [df[k] == b[k] for k in keys])
    return df.join(b, same & in_box(df["x"], df["y"], b, strict=True), "left_semi")


def legend_numbered(texts: DataFrame, boxes: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """(keys, symbol, description): a legend's symbols and descriptions one to one, nearest in height first.

    Symbols are short labels within 2000 of the upper median of their x (where there are three); descriptions are the longer
    texts right of it that name something countable, or all, if none does. A pair may lie apart by the larger of 500 and 1.2 times
    the upper median gap (over 20) between symbols, 1000 where there are fewer than three or no gap; and three times as much, if
    both are left over. Symbols at one height are no legend. Of equal symbols the lowest one's description holds.
    """
    text, left, x, y = F.trim(F.element_at(F.split("text", "\n"), 1)), F.col("left"), F.col("x"), F.col("y")
    t = texts.select(*keys, "seq", "x", "y", text.alias("text")).where(~F.col("text").isin(*R.LEGEND_SKIP) & ~F.col("text").rlike(R.LEGEND_NOISE))
    t = t.withColumn("left", F.col("text").rlike(R.LABEL) & (F.length("text") <= 4)).where(left | (F.length("text") >= 8))
    # a drawing's texts are dealt once: what is known of it are windows over them
    t = _inside(t.withColumn("_named", F.when(~left, ~is_non_countable(F.col("text")))), boxes, keys)
    every, side = Window.partitionBy(*keys), Window.partitionBy(*keys, "left")

    def median(df, value, n, name):
        """The value at place n div 2 of a drawing's sorted ones of left rows, of which ``n`` are not null."""
        df = df.withColumns({"_k": F.row_number().over(side.orderBy(F.asc_nulls_last(value))), "_n": n.over(every)})
        return df.withColumn(name, F.max(F.when(left & (F.col("_k") == F.floor(F.col("_n") / 2) + 1), F.col(value))).over(every)).drop("_k")

    t = median(t, "x", F.count_if("left"), "_mid")
    t = t.where(~left | (F.col("_n") < 3) | (F.abs(x - F.col("_mid")) < 2000))
    t = t.withColumn("_named", ~left & F.col("_named") & (F.col("_mid").isNull() | (x > F.col("_mid"))))
    high = F.max(F.when(left, y)).over(every) - F.min(F.when(left, y)).over(every)
    t = t.withColumns({"_any": F.max("_named").over(every), "_high": high, "_left": F.count_if("left").over(every)})
    t = t.where(F.when(left, (F.col("_high") >= 300) | (F.col("_left") <= 3)).otherwise(F.col("_named") | ~F.col("_any")))
    gap = y - F.lag("y").over(side.orderBy("y", "seq"))
    t = median(t.withColumn("_gap", gap).withColumn("_gap", F.when(left & (F.col("_gap") > 20), F.col("_gap"))), "_gap", F.count("_gap"), "_usual")
    bound = F.when((F.col("_left") >= 3) & F.col("_usual").isNotNull(), F.greatest(F.lit(500.0), F.col("_usual") * 1.2)).otherwise(1000.0)
    # a second pass at three times the bound takes what one pass at that bound would
    pairs = _level_match(t.withColumn("reach", bound * 3), keys)
    return pairs.groupBy(*keys, F.col("l_text").alias("symbol")).agg(F.min_by("r_text", F.struct("l_y", (-F.col("l_seq")).alias("o"))).alias("description"))


def legend_blocks(inserts: DataFrame, texts: DataFrame, boxes: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """(keys, symbol, block_name, description): a legend's block inserts and descriptions one to one, nearest in height first, 3000
    apart at most; symbols B1, B2, ... go from the top."""
    rows = lambda df, left, text: df.select(*keys, F.lit(left).alias("left"), "seq", "x", "y", text.alias("text"), F.lit(3000.0).alias("reach"))
    d = rows(texts, False, F.trim(F.element_at(F.split("text", "\n"), 1))).where(~F.col("text").isin(*R.LEGEND_SKIP) & (F.length("text") >= 8))
    b = rows(inserts, True, F.col("block_name")).where(~F.lower("text").rlike(R.NO_BLOCK))
    pairs = _level_match(_inside(b.unionByName(d), boxes, keys), keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("l_y"), "l_seq")
    return pairs.select(*keys, F.concat(F.lit("B"), F.row_number().over(order)).alias("symbol"), F.col("l_text").alias("block_name"), F.col("r_text").alias("description"))


def legend_headers(words: DataFrame, keys: Keys = ("file_id", "page"), guard: float = 15.0) -> DataFrame:
    """Header words of legends that aren't column heads, that is, without 'Поз.' or 'Кол.' within the guard's height."""
    heads = words.where(F.col("text").rlike(HEADER))
    columns = words.where(F.col("text").rlike(r"^(Поз\.?|Кол\.?)$")).select(*keys, F.col("top").alias("_t"))
    same = reduce(lambda a, c: a & c, [heads[k] == columns[k] for k in keys])
    return heads.join(columns, same & (F.abs(heads["top"] - columns["_t"]) <= guard), "left_anti")


def legend_from_lines(lines: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """(keys, symbol, description) from running text between a header and the first end mark.

    Lines with a tab are pairs. Without any, the section's short lines and its long ones (ten characters) are paired in
    order where they are as many; else symbols stand alone.
    """
    start = lines.where(F.col("text").rlike(HEADER)).groupBy(*keys).agg(F.min("seq").alias("_from"))
    after = lines.join(start, list(keys)).where(F.col("seq") > F.col("_from"))
    end = after.where(F.col("text").rlike(END)).groupBy(*keys).agg(F.min("seq").alias("_to"))
    body = after.join(end, list(keys), "left").where(F.col("_to").isNull() | (F.col("seq") < F.col("_to"))).withColumn("t", F.trim("text")).where("t <> ''")
    tabbed = body.where(F.contains("t", F.lit("\t"))).select(*keys, F.trim(F.split("t", "\t")[0]).alias("symbol"), F.trim(F.split("t", "\t")[1]).alias("description"))
    rest = body.join(tabbed.select(*keys).distinct(), list(keys), "left_anti")
    w = Window.partitionBy(*keys, "long").orderBy("seq")
    rest = rest.withColumn("long", F.length("t") >= 10).withColumns({"n": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy(*keys, "long"))})
    short = rest.where(~F.col("long") & F.col("t").rlike(r"^[0-9А-ЯA-Z][0-9А-ЯA-Z]{0,3}$")).select(*keys, "n", "of", F.col("t").alias("symbol"))
    paired = short.join(rest.where("long").select(*keys, "n", "of", F.col("t").alias("description")), [*keys, "n", "of"], "left")
    return tabbed.unionByName(paired.select(*keys, "symbol", F.coalesce("description", F.concat(F.lit("[Обозначение "), F.col("symbol"), F.lit("]"))).alias("description")))


def marker_positions(labels: DataFrame, annotations: DataFrame, inserts: DataFrame, circles: DataFrame, items: DataFrame, keys: Keys = ("file_id",), tol: float = 50.0) -> DataFrame:
    """(keys, symbol, seq, x, y): places of the items by the convention of their symbol - P1, P2, ... for annotations, C1, C2, ...
    for circles, else labels, and inserts of the block of that name for symbols without a label. Near doubles fall away."""
    from drawlake.operators.iterative import dedup_points

    want = items.select(*keys, "symbol", "name")
    plain = labels.select(*keys, F.trim("text").alias("symbol"), "seq", "x", "y").join(want.select(*keys, "symbol"), [*keys, "symbol"], "left_semi")
    noted = want.where(F.col("symbol").rlike("^P[0-9]+$")).join(annotations.select(*keys, F.col("name"), "seq", "x", "y"), [*keys, "name"]).select(*keys, "symbol", "seq", "x", "y")
    round_ = want.where(F.col("symbol").rlike("^C[0-9]+$")).join(circles.select(*keys, F.concat(F.lit("C"), F.col("color")).alias("symbol"), "seq", "x", "y"), [*keys, "symbol"]).select(*keys, "symbol", "seq", "x", "y")
    found = plain.unionByName(noted).unionByName(round_)
    left = want.join(found.select(*keys, "symbol").distinct(), [*keys, "symbol"], "left_anti")
    blocks = left.join(inserts.select(*keys, F.col("block_name").alias("symbol"), "seq", "x", "y"), [*keys, "symbol"]).select(*keys, "symbol", "seq", "x", "y")
    return dedup_points(found.unionByName(blocks), [*keys, "symbol"], tol)


def content_legends(words: DataFrame, segments: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Boxes of legends without a header: frames with at least two words of equipment; else runs of identifiers, with one."""
    framed = content_frames(words, segments, keys).select(*keys, "x0", "y0", "x1", "y1", F.lit("frame").alias("method"))
    kw = words.where(F.lower("text").rlike("|".join(R.FRAME_WORDS))).select(*keys, F.col("x0").cast("double").alias("wx"), F.col("top").cast("double").alias("wy"))
    runs = identifier_runs(words, keys).unionByName(density_runs(words, keys)).groupBy(*keys).agg(F.min("x0").alias("x0"), (F.min("top") - 2).alias("y0"), (F.max("x0") + 400).alias("x1"), (F.max("top") + 20).alias("y1"))
    runs = runs.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    near = box_join(kw, runs, keys, ("wx", "wy", "wx", "wy"), ("x0", "y0", "x1", "y1")).select(*keys, "x0", "y0", "x1", "y1").distinct()
    return framed.unionByName(near.join(framed.select(*keys), list(keys), "left_anti").withColumn("method", F.lit("run")))


def legend_of_file(items: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """The legend of each file from what the methods found: (keys, best_page, method, page, seq, symbol, description, x0, y0, x1, y1).

    ``items``: (keys, page, method, tolerance, seq, symbol, description, x0, y0, x1, y1), seq unique in a file. Items of a page, method
    and tolerance are a candidate. A header's counts by page, at the tolerance that scores most of those up to the first at which half
    of the symbols have descriptions over three characters; content on pages without a header's; specifications on every page; density
    only in files where nothing else was found. A candidate scores 1000 a symbol, 10 an item and 1 a description. The best one (on
    ties the earlier page, then the earlier method) stands alone unless other pages bring a symbol that it lacks; then
    all their candidates join: of a symbol, or description where there is none, the longest description stays, the better
    candidate's on ties. The box is that of all that joined. Null texts are empty.
    """
    filled = {c: F.coalesce(c, F.lit("")) for c in ("symbol", "description")}
    it = items.withColumns({**filled, "tolerance": F.coalesce("tolerance", F.lit(0))}).withColumn("_m", F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))).where("_m > 0")
    has, good = F.col("symbol") != "", F.length(F.trim("description")) > 3
    one = ["page", "method", "tolerance"]
    found = it.groupBy(*keys, *one, "_m").agg(
        (1000 * F.count_if(has) + 10 * F.count("*") + F.count_if(F.col("description") != "")).alias("score"), (2 * F.count_if(has & good) >= F.greatest(F.count_if(has), F.lit(1))).alias("good"),
        *(f(c).alias(f"_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
    )
    found = stored(found, "candidates")  # each step below would group the items again
    head = found.where("method = 'header'").withColumn("_g", F.min(F.when(F.col("good"), F.col("tolerance"))).over(Window.partitionBy(*keys, "page"))).where("_g is null or tolerance <= _g")
    head = head.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "page").orderBy(F.desc("score"), "tolerance"))).where("_p = 1").drop("_p", "_g")
    kept = head.unionByName(found.where("method = 'content'").join(head.select(*keys, "page"), [*keys, "page"], "left_anti").select(*head.columns)).unionByName(found.where("method = 'spec'"))
    kept = kept.unionByName(found.where("method = 'density'").join(kept.select(*keys).distinct(), list(keys), "left_anti").select(*head.columns))
    best = kept.groupBy(*keys).agg(F.min_by(F.struct("page", "method", "tolerance"), F.struct((-F.col("score")).alias("a"), "page", "_m", "tolerance")).alias("_b"))
    kept = kept.join(best, list(keys)).withColumn("_base", F.struct("page", "method", "tolerance") == F.col("_b")).where(F.col("_base") | (F.col("page") != F.col("_b.page")))
    kept = stored(kept, "kept-candidates")
    key = F.struct(has.alias("s"), F.lower(F.trim(F.when(has, F.col("symbol")).otherwise(F.col("description")))).alias("t"))
    rows = stored(it.withColumn("_k", key).join(kept.drop("_m", "good", "_x0", "_y0", "_x1", "_y1"), [*keys, *one]).drop("x0", "y0", "x1", "y1"), "legend-items")
    own = rows.where("_base").select(*keys, "_k").distinct()
    joined = rows.where(~F.col("_base") & F.col("_k.s")).join(own, [*keys, "_k"], "left_anti").select(*keys).distinct().withColumn("_all", F.lit(True))
    rows = rows.join(joined, list(keys), "left").where("_base or _all")
    box = kept.join(joined, list(keys), "left").where("_base or _all").groupBy(*keys).agg(*(f(f"_{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    same = Window.partitionBy(*keys, "_k")
    rank = F.struct((-F.col("score")).alias("a"), F.col("page").alias("b"), F.col("_m").alias("c"), F.col("seq").alias("d"))
    rows = rows.withColumns({"_o": rank, "_f": F.min(F.when(F.col("_base"), F.col("seq"))).over(same)})
    alone = rows.where("_all is null")
    # of equal keys in the best candidate only the first takes part
    merged = rows.where("_all and (not _base or seq = _f)").withColumn("_p", F.row_number().over(same.orderBy(F.desc(F.length("description")), "_o"))).where("_p = 1").drop("_p")
    out = alone.unionByName(merged).drop("method").join(box, list(keys))
    return out.select(*keys, F.col("_b.page").alias("best_page"), F.col("_b.method").alias("method"), "page", "seq", "symbol", "description", "x0", "y0", "x1", "y1")
