"""Operators on points, boxes and lines of drawings.

Every join has an equality: the file (and page) and, for neighbourhoods, a grid cell, so that neither a large
drawing nor a large set of files meets in one task. ``keys`` names the columns that tell drawings apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _same(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (left[k] == right[k])
    return out


def prefixed(df: DataFrame, prefix: str, keep: Keys = ()) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keep else prefix + c) for c in df.columns))


def near_pairs(left: DataFrame, right: DataFrame, keys: Keys, radius: float, x: str = "x", y: str = "y", metric: str = "l2", side: float = 2.0) -> DataFrame:
    """All pairs within ``radius`` of each other: columns of ``left`` as l_*, of ``right`` as r_*, the keys once, and dist.

    Cells are ``side`` radii wide; each right row is dealt to the cells that its own square of the radius meets, which are
    (1 + 2 / side)^2 on average. Where points are sparse, wide cells shuffle less.
    """
    wide, far = F.lit(float(radius * side)), F.lit(float(radius))
    cell = lambda c: F.floor(c / wide).cast("long")
    # a little more, as sums are rounded
    reach = lambda c: far + (F.abs(c) + far) * 1e-12
    met = lambda c: F.explode(F.sequence(cell(F.col(c) - reach(F.col(c))), cell(F.col(c) + reach(F.col(c)))))
    a = prefixed(left, "l_", keys).withColumns({"_cx": cell(F.col(f"l_{x}")), "_cy": cell(F.col(f"l_{y}"))})
    b = prefixed(right, "r_", keys)
    # sizes are guessed from the files, before rows are dealt: too small for a broadcast's choice
    b = b.withColumn("_cx", met(f"r_{x}")).withColumn("_cy", met(f"r_{y}")).hint("merge")
    dx, dy = F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")), F.abs(F.col(f"l_{y}") - F.col(f"r_{y}"))
    dist = dx + dy if metric == "l1" else F.sqrt(dx * dx + dy * dy)
    return a.join(b, [*keys, "_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= radius).drop("_cx", "_cy")


def in_box(px: Column, py: Column, box: DataFrame, margin: float = 0.0, strict: bool = False) -> Column:
    if strict:
        return (px > box["x0"] - margin) & (px < box["x1"] + margin) & (py > box["y0"] - margin) & (py < box["y1"] + margin)
    return (px >= box["x0"] - margin) & (px <= box["x1"] + margin) & (py >= box["y0"] - margin) & (py <= box["y1"] + margin)


#: Boxes of a side up to 2^level are dealt to cells of that side; smaller ones than 2^LOWEST count as points.
LOWEST = -4


def box_join(left: DataFrame, right: DataFrame, keys: Keys, left_box: Sequence[str], right_box: Sequence[str]) -> DataFrame:
    """All pairs of a left and a right row of a drawing whose boxes (x0, y0, x1, y1; a point twice) meet, borders included.

    The column names of the two may only share ``keys``. A box lies in at most four cells of its own size. Pairs meet in
    the cells of the larger box: each side goes to its own size, where the other has boxes as small, and to those larger ones that the other side has, and
    of the cells that two boxes share only the one at the lower corner of what they share reports them.
    """
    def level(box):
        side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])).cast("double")
        return F.when(side > 2.0**LOWEST, F.ceil(F.log2(side))).otherwise(LOWEST).cast("int")

    def dealt(df, box, name, others):
        known = F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<int>")
        own = level(box)
        met = F.filter(F.array(own), lambda x: x >= others[0]) if others else known  # its own size serves those that are no larger
        out = df.where(own.isNotNull()).withColumn(f"_{name}", own).withColumn("_level", F.explode(F.concat(met, F.filter(known, lambda x: x > own))))
        for c, low, high in (("_cx", box[0], box[2]), ("_cy", box[1], box[3])):
            side = F.pow(F.lit(2.0), F.col("_level"))
            out = out.withColumn(c, F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))))
        return out

    sizes = [sorted(r[0] for r in df.select(level(box).alias("k")).where("k is not null").distinct().collect()) for df, box in ((left, left_box), (right, right_box))]  # as many as powers of two
    pairs = dealt(left, left_box, "a", sizes[1]).join(dealt(right, right_box, "b", sizes[0]).hint("merge"), [*keys, "_level", "_cx", "_cy"])
    pairs = pairs.where(F.col("_level") == F.greatest("_a", "_b"))
    for c, k in (("_cx", 0), ("_cy", 1)):
        low, high = F.greatest(left_box[k], right_box[k]), F.least(left_box[k + 2], right_box[k + 2])
        pairs = pairs.where((low <= high) & (F.floor(low / F.pow(F.lit(2.0), F.col("_level"))) == F.col(c)))
    return pairs.drop("_level", "_cx", "_cy", "_a", "_b")


def _held(points: DataFrame, zones: DataFrame, keys: Keys, margin: float, x: str, y: str) -> DataFrame:
    """Places (keys, _px, _py) of points with each zone (z_*) whose widened box holds them, border included."""
    at = points.select(*keys, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct()
    z = prefixed(zones, "z_", keys)
    grow = {c: (F.col(f"z_{c}") + by).cast("double") for c, by in (("x0", -margin), ("y0", -margin), ("x1", margin), ("y1", margin))}
    return box_join(at, z.withColumns({f"_{c}": v for c, v in grow.items()}), keys, ("_px", "_py", "_px", "_py"), ("_x0", "_y0", "_x1", "_y1"))


def exclude_zones(points: DataFrame, zones: DataFrame, keys: Keys, margin: float = 0.0, strict: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Points in no zone of their drawing; strict: a point on the border counts as outside."""
    hit = _held(points, zones.select(*keys, "x0", "y0", "x1", "y1"), keys, margin, x, y)
    if strict:
        hit = hit.where("_px > _x0 and _px < _x1 and _py > _y0 and _py < _y1")
    hit = hit.select(*keys, "_px", "_py").distinct()
    at = {"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")}
    return points.withColumns(at).join(hit, [*keys, "_px", "_py"], "left_anti").select(*points.columns)


def zone_of(points: DataFrame, zones: DataFrame, keys: Keys, margin: float = 2.0, x: str = "x", y: str = "y", seq: str = "seq") -> DataFrame:
    """Points with the name of the first zone (by the zones' seq) that holds them, or null."""
    hit = _held(points, zones.select(*keys, "x0", "y0", "x1", "y1", "zone", "seq"), keys, margin, x, y)
    first = hit.groupBy(*keys, "_px", "_py").agg(F.min_by("z_zone", "z_seq").alias("zone"))
    at = {"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")}
    return points.withColumns(at).join(first, [*keys, "_px", "_py"], "left").select(*points.columns, "zone")


def legend_boxes(texts: DataFrame, keys: Keys = ("file_id",), header: str = r"(?iu)условные обозначения|экспликация оборудования", apart: float = 5000.0) -> DataFrame:
    """A box for each legend header: the extent of the texts below and beside it, padded; headers near an earlier one fall away."""
    from drawlake.operators.iterative import dedup_points

    heads = dedup_points(texts.where(F.col("text").rlike(header)), keys, apart)
    h = heads.select(*keys, F.col("seq").alias("head_seq"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    around = {"_h0": F.col("hx") - 15000, "_h1": F.col("hy") - 15000, "_h2": F.col("hx") + 15000, "_h3": F.col("hy") + 2000}
    near = box_join(texts.select(*keys, "x", "y"), h.withColumns(around), keys, ("x", "y", "x", "y"), tuple(around))
    near = near.where((F.abs(F.col("x") - F.col("hx")) < 15000) & (F.col("hy") - F.col("y") > -2000) & (F.col("hy") - F.col("y") < 15000))
    box = near.groupBy(*keys, "head_seq").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select(*keys, F.col("head_seq").alias("seq"), (F.col("x0") - 2000).alias("x0"), (F.col("y0") - 2000).alias("y0"), (F.col("x1") + 5000).alias("x1"), (F.col("y1") + 2000).alias("y1"))


def grid_labels(texts: DataFrame, axes: DataFrame, keys: Keys = ("file_id",), layer_word: str = r"(?iu)axis|ось|оси|grid") -> DataFrame:
    """Seqs of texts that name grid axes: by layer; within 2000 of an axis block; in pairs of equal text across the sheet;
    and the rest within 500 of both such an x and such a y."""
    short = texts.where(F.col("text").rlike(r"^[0-9]{1,2}$|^[А-ЯA-Z](/[0-9])?$"))
    by_layer = short.where(F.col("layer").rlike(layer_word)).select(*keys, "seq")
    by_block = near_pairs(short.select(*keys, "seq", "x", "y"), axes.select(*keys, "x", "y"), keys, 2000.0).select(*keys, F.col("l_seq").alias("seq"))
    a, b = prefixed(short, "a_", keys), prefixed(short, "b_", keys)
    pairs = a.join(b, list(keys)).where((F.col("a_text") == F.col("b_text")) & (F.col("a_seq") != F.col("b_seq")))
    dx, dy = F.abs(F.col("a_x") - F.col("b_x")), F.abs(F.col("a_y") - F.col("b_y"))
    paired = pairs.where(((dx < 1000) & (dy > 5000)) | ((dy < 1000) & (dx > 5000)))
    found = paired.select(*keys, F.col("a_seq").alias("seq"), F.col("a_x").alias("px"), F.col("a_y").alias("py")).distinct()
    xs, ys = found.select(*keys, "px").distinct(), found.select(*keys, "py").distinct()
    near_x = short.join(xs, _same(short, xs, keys) & (F.abs(short["x"] - xs["px"]) < 500), "left_semi")
    aligned = near_x.join(ys, _same(near_x, ys, keys) & (F.abs(near_x["y"] - ys["py"]) < 500), "left_semi").select(*keys, "seq")
    return by_layer.unionByName(by_block).unionByName(found.select(*keys, "seq")).unionByName(aligned).distinct()


def page_zones(pages: DataFrame, segments: DataFrame, legends: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Zones that hold no equipment: four margins of 60, the padded legends, and the title block in the lower right
    corner where at least six long horizontal lines lie."""
    w, h = F.col("width"), F.col("height")
    margins = pages.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("zone"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")) for n, a, b, c, d in (("left", F.lit(0.0), F.lit(0.0), F.lit(60.0), h), ("right", w - 60, F.lit(0.0), w, h), ("top", F.lit(0.0), F.lit(0.0), w, F.lit(60.0)), ("bottom", F.lit(0.0), h - 60, w, h))])).alias("z")).select(*keys, "z.*")
    padded = legends.select(*keys, F.lit("legend").alias("zone"), (F.col("x0") - 10).alias("x0"), (F.col("y0") - 30).alias("y0"), (F.col("x1") + 10).alias("x1"), (F.col("y1") + 10).alias("y1"))
    lines = segments.join(pages, list(keys)).where((F.abs(F.col("y1") - F.col("y0")) < 2) & (F.abs(F.col("x1") - F.col("x0")) > 50)).withColumns({"lx": F.least("x0", "x1"), "ly": F.least("y0", "y1")})
    lines = lines.where((F.col("lx") > 0.4 * w) & (F.col("ly") > 0.6 * h)).withColumn("rx", F.round("lx"))
    size = lines.groupBy(*keys).agg(F.count("*").alias("n_lines")).where("n_lines >= 6")
    groups = lines.groupBy(*keys, "rx").agg(F.count("*").alias("n"))
    corner = groups.groupBy(*keys).agg(F.min(F.when(F.col("n") >= 3, F.col("rx"))).alias("first_x"), F.max_by("rx", F.struct("n", (-F.col("rx")).alias("o"))).alias("mode_x"))
    corner = corner.join(size, list(keys)).select(*keys, F.coalesce("first_x", "mode_x").alias("bx"))
    block = lines.join(corner, list(keys)).where(F.abs(F.col("lx") - F.col("bx")) <= 10).groupBy(*keys).agg(F.min("bx").alias("x0"), F.min("ly").alias("y0"), F.max("width").alias("x1"), F.max("height").alias("y1"))
    return margins.unionByName(padded).unionByName(block.select(*keys, F.lit("title").alias("zone"), "x0", "y0", "x1", "y1"))


def spec_zones(words: DataFrame, segments: DataFrame, keys: Keys = ("file_id", "page"), word: str = r"(?iu)^(спецификация|ведомость)", dx: float = 400.0, dy: float = 200.0, least: int = 3, legends: DataFrame | None = None) -> DataFrame:
    """Zones of tables: a heading word, outside the legends if any are given, with at least three horizontal lines below it."""
    heads = words.where(F.col("text").rlike(word))
    heads = heads if legends is None else exclude_zones(heads, legends, keys, x="x0", y="top", strict=False)
    heads = heads.select(*keys, F.col("seq").alias("head_seq"), F.col("x0").alias("hx"), F.col("top").alias("hy"))
    lines = segments.where((F.abs(F.col("y1") - F.col("y0")) < 2) & (F.abs(F.col("x1") - F.col("x0")) > 25)).select(*keys, F.least("x0", "x1").alias("lx0"), F.greatest("x0", "x1").alias("lx1"), F.col("y0").alias("ly"))
    below = {"_h0": F.col("hx") - dx, "_h1": F.col("hy"), "_h2": F.col("hx") + dx, "_h3": F.col("hy") + dy}
    near = box_join(lines, heads.withColumns(below), keys, ("lx0", "ly", "lx0", "ly"), tuple(below)).where((F.col("ly") >= F.col("hy")) & (F.col("ly") - F.col("hy") < dy) & (F.abs(F.col("lx0") - F.col("hx")) < dx))
    return near.groupBy(*keys, "head_seq").agg(F.count("*").alias("n_lines"), F.min("lx0").alias("x0"), F.min("hy").alias("y0"), F.max("lx1").alias("x1"), F.max("ly").alias("y1")).where(F.col("n_lines") >= least)


def note_zones(words: DataFrame, keys: Keys = ("file_id", "page"), word: str = r"(?iu)^примечани", width: float = 400.0, height: float = 300.0, least: int = 5) -> DataFrame:
    """Zones of notes: a heading word with at least five words in the box below it."""
    heads = words.where(F.col("text").rlike(word)).select(*keys, F.col("seq").alias("head_seq"), F.col("x0").alias("hx"), F.col("top").alias("hy"))
    w = words.select(*keys, "seq", F.col("x0").alias("wx"), F.col("top").alias("wy"))
    near = box_join(w, heads.withColumns({"_h2": F.col("hx") + width, "_h3": F.col("hy") + height}), keys, ("wx", "wy", "wx", "wy"), ("hx", "hy", "_h2", "_h3")).where(F.col("seq") != F.col("head_seq"))
    return near.groupBy(*keys, "head_seq").agg(F.count("*").alias("n_words"), F.min("hx").alias("x0"), F.min("hy").alias("y0"), F.max(F.col("hx") + width).alias("x1"), F.max(F.col("hy") + height).alias("y1")).where(F.col("n_words") >= least)


def reject_by_context(candidates: DataFrame, words: DataFrame, rules: Sequence[tuple[float, float, str]], keys: Keys, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Candidates beside which no other word matches a rule (dx, dy, pattern)."""
    reach = max(max(dx, dy) for dx, dy, _ in rules) * 2**0.5
    pairs = near_pairs(candidates, words, keys, reach, x, y)
    dx, dy = F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")), F.abs(F.col(f"l_{y}") - F.col(f"r_{y}"))
    bad = F.lit(False)
    for rx, ry, pattern in rules:
        bad = bad | ((dx <= rx) & (dy <= ry) & F.col("r_text").rlike(pattern))
    gone = pairs.where((F.col(f"l_{seq}") != F.col(f"r_{seq}")) & bad).select(*keys, F.col(f"l_{seq}").alias(seq)).distinct()
    return candidates.join(gone, [*keys, seq], "left_anti")


def neighbour_counts(points: DataFrame, others: DataFrame, keys: Keys, radius: float, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(keys, seq, n): how many other rows lie within ``radius`` of each point; points without any are left out."""
    pairs = near_pairs(points.select(*keys, seq, x, y), others.select(*keys, seq, x, y), keys, radius, x, y)
    return pairs.where(F.col(f"l_{seq}") != F.col(f"r_{seq}")).groupBy(*keys, F.col(f"l_{seq}").alias(seq)).agg(F.count("*").alias("n"))


def reject_dense(points: DataFrame, words: DataFrame, keys: Keys, radius: float = 30.0, most: int = 8, **names) -> DataFrame:
    """Points with fewer than ``most`` other words around them."""
    seq = names.get("seq", "seq")
    crowded = neighbour_counts(points, words, keys, radius, **names).where(F.col("n") >= most)
    return points.join(crowded.select(*keys, seq), [*keys, seq], "left_anti")


def annotation_circles(circles: DataFrame) -> DataFrame:
    """Circles that stand for equipment: radius 25 to 85 on an annotation layer, or 30 to 70 anywhere."""
    return circles.where((F.col("radius").between(25, 85) & F.contains(F.upper("layer"), F.lit("ANNO"))) | F.col("radius").between(30, 70))


def equipment_inserts(inserts: DataFrame, hidden_layers: DataFrame, word: str = r"(?iu)equip|оборуд|light|свет|elec|эл", x_range: DataFrame | None = None) -> DataFrame:
    """Inserts on visible layers whose layer or block name speaks of equipment; within the file's (x_left, x_right), if given."""
    if x_range is not None:
        x = x_range.select("file_id", "x_left", "x_right")
        inserts = inserts.join(x, "file_id", "left").where(F.col("x_left").isNull() | F.col("x").between(F.col("x_left"), F.col("x_right"))).drop("x_left", "x_right")
    seen = inserts.join(hidden_layers.select("file_id", "layer"), ["file_id", "layer"], "left_anti")
    return seen.where(F.col("layer").rlike(word) | F.col("block_name").rlike(word))


def marker_filter(words: DataFrame, legend: DataFrame, keys: Keys = ("file_id", "page")) -> DataFrame:
    """Words that are markers of legend symbols: of the symbols' colour and within the heights of compound ones."""
    from drawlake.operators.sequences import upper_median

    marks = words.join(legend.select(*keys, F.col("symbol").alias("text"), F.col("color_class").alias("_want")), [*keys, "text"])
    marks = marks.withColumn("height", F.col("bottom") - F.col("top"))
    middle = upper_median(marks.where(F.length("text") >= 2), keys, "height").withColumnRenamed("median", "_mid")
    low, high = F.coalesce(F.col("_mid") * 0.5, F.lit(3.0)), F.coalesce(F.col("_mid") * 1.5, F.lit(8.0))
    fits = marks.join(middle, list(keys), "left").where(F.col("height").between(low, high))
    return fits.where((F.col("color_class") != "grey") & ((F.col("_want") == "") | (F.col("color_class") == F.col("_want")))).drop("_want", "_mid", "height")


#: Points of a leaf cell, finest cells below the natural ones, and points of a drawing up to which it is one leaf.
LEAF, DEEP, SMALL = 16, 12, 64


def _gap(metric: str, dx: Column, dy: Column) -> Column:
    return dx + dy if metric == "l1" else F.sqrt(dx * dx + dy * dy)


def _bounds(metric: str) -> tuple[Column, Column]:
    """The least and the largest distance of the point (_x, _y) to any point of a cell's own box (bx0, by0, bx1, by1)."""
    least = [F.greatest(F.col(f"b{c}0") - F.col(f"_{c}"), F.col(f"_{c}") - F.col(f"b{c}1"), F.lit(0.0)) for c in "xy"]
    most = [F.greatest(F.abs(F.col(f"_{c}") - F.col(f"b{c}0")), F.abs(F.col(f"_{c}") - F.col(f"b{c}1"))) for c in "xy"]
    return _gap(metric, *least), _gap(metric, *most)


def near_candidates(left: DataFrame, right: DataFrame, keys: Keys, k: int, metric: str) -> DataFrame:
    """(keys, _x, _y, _rx, _ry): for each place of ``left`` (keys, _x, _y) places of ``right`` (keys, _x, _y) of which its k nearest are some.

    The right places of a drawing lie in a tree of cells, each split until it holds LEAF places. A left place looks
    at the nine cells around it, first of a size that holds a few places on average, then of twice that size and so
    on, until no place outside the nine can be among the k nearest: those cells promise k places nearer than a side.
    Of the nine it then follows those that may hold one of the k down to the leaves. What it is compared with so
    depends on neither the drawing's size nor how its places crowd.
    """
    from drawlake.operators.graph import checkpointed

    keys = list(keys)
    frame = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_ox"), F.min("_y").alias("_oy"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"), F.lit(1e-9)).alias("_w"))
    # the natural level: some LEAF / 4 places a cell if they are spread evenly
    frame = frame.withColumn("_top", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") * 4.0 / LEAF) / 2)).cast("int"))
    at = lambda c: F.floor((F.col(f"_{c}") - F.col(f"_o{c}")) / F.col("_w") * F.pow(F.lit(2.0), F.col("_fine"))).cast("long")
    placed = lambda df: df.join(frame, keys).withColumn("_fine", F.col("_top") + DEEP).withColumns({"_cx": at("x"), "_cy": at("y")})
    up = lambda c, by: F.call_function("shiftright", F.col(c), by)
    # the largest coordinate would open a cell of its own
    last = F.pow(F.lit(2.0), F.col("_fine")).cast("long") - 1
    points = checkpointed(placed(right).withColumns({c: F.least(F.col(c), last) for c in ("_cx", "_cy")}).select(*keys, "_x", "_y", "_cx", "_cy", "_top", "_fine"))
    each = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_fine")))).withColumns({c: up(f"_{c}", F.col("_fine") - F.col("level")) for c in ("cx", "cy")})
    box = [f("_" + c).alias(f"b{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    cells = checkpointed(each.groupBy(*keys, "level", "cx", "cy").agg(F.count("*").alias("n"), F.max(F.col("level") == F.col("_fine")).alias("last"), F.max("_top").alias("_top"), *box))
    # leaves are natural cells or finer ones, so that places need not look among the large cells
    cells = cells.withColumn("leaf", (F.col("level") >= F.col("_top")) & ((F.col("n") <= LEAF) | F.col("last"))).drop("last", "_top")
    own = ["_x", "_y"]
    live = placed(left).select(*keys, *own, "_cx", "_cy", "_fine", "_w", F.col("_top").alias("level"), F.lit(float("inf")).alias("best"))
    live, found = checkpointed(live), None
    least, most = _bounds(metric)
    row = Window.partitionBy(*keys, *own)

    def promised(df):
        """The distance within which the cells of a place hold k others for certain."""
        first = df.withColumn("_sum", F.sum("n").over(row.orderBy("_most", "level", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)))
        return first.withColumn("best", F.least("best", F.min(F.when(F.col("_sum") >= k, F.col("_most"))).over(row)))

    while not live.isEmpty():
        steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        around = live.withColumn("_d", F.explode(F.when(F.col("level") > 0, steps).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))))
        base = lambda c, d: F.when(F.col("level") > 0, up(f"_{c}", F.col("_fine") - F.col("level")) + F.col(f"_d.{d}")).otherwise(F.lit(0).cast("long"))
        around = around.withColumns({"cx": base("cx", "i"), "cy": base("cy", "j")}).drop("_d")
        hits = around.join(cells, [*keys, "level", "cx", "cy"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "_least": least, "_most": most})
        side = F.col("_w") / F.pow(F.lit(2.0), F.col("level")) * (1 - 1e-9)
        hits = checkpointed(promised(hits).withColumn("done", (F.col("best") <= side) | (F.col("level") == 0)))
        ready = hits.where("done and n > 0 and _least <= best").select(*keys, *own, "level", "cx", "cy", "leaf", "best")
        found = ready if found is None else found.union(ready)
        live = checkpointed(hits.where("not done").groupBy(*keys, *own).agg(*(F.min(c).alias(c) for c in ("_cx", "_cy", "_fine", "_w")), (F.min("level") - 1).alias("level"), F.min("best").alias("best")))
    done, open_ = None, found if found is not None else live.select(*keys, *own, "level", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(True).alias("leaf"), "best")
    while True:
        ready = open_.where("leaf").select(*keys, *own, "level", "cx", "cy")
        done = ready if done is None else done.union(ready)
        rest = open_.where("not leaf")
        if rest.isEmpty():
            break
        below = cells.select(*keys, (F.col("level") - 1).alias("level"), F.call_function("shiftright", "cx", F.lit(1)).alias("cx"), F.call_function("shiftright", "cy", F.lit(1)).alias("cy"), F.col("cx").alias("_kx"), F.col("cy").alias("_ky"), F.col("leaf").alias("_leaf"), "n", *(f"b{c}{i}" for c in "xy" for i in "01"))
        opened = rest.drop("leaf").join(below, [*keys, "level", "cx", "cy"]).withColumns({"_least": least, "_most": most})
        opened = promised(opened).where("_least <= best")
        open_ = checkpointed(opened.select(*keys, *own, (F.col("level") + 1).alias("level"), F.col("_kx").alias("cx"), F.col("_ky").alias("cy"), F.col("_leaf").alias("leaf"), "best"))
    inside = each.where(F.col("level") >= F.col("_top")).join(cells.where("leaf").select(*keys, "level", "cx", "cy"), [*keys, "level", "cx", "cy"], "left_semi")
    return done.join(inside.select(*keys, "level", "cx", "cy", F.col("_x").alias("_rx"), F.col("_y").alias("_ry")), [*keys, "level", "cx", "cy"]).select(*keys, *own, "_rx", "_ry")


def nearest(left: DataFrame, right: DataFrame, keys: Keys, radius: float | None = None, metric: str = "l2", seq: str = "seq", x: str = "x", y: str = "y", k: int = 1) -> DataFrame:
    """For each left row its k nearest right rows (ties: the smaller seq): l_* and r_* columns and dist; rows without one are left out.

    Without a radius drawings of up to SMALL right rows compare all of them as a list; in others rings of cells find the
    candidates (``near_candidates``). Rows without coordinates are near nothing.
    """
    if radius is not None:
        pairs = near_pairs(left, right, keys, radius, x, y, metric)
    else:
        dist = _gap(metric, F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")), F.abs(F.col(f"l_{y}") - F.col(f"r_{y}"))).alias("dist")
        a, b = (prefixed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), p, keys) for df, p in ((left, "l_"), (right, "r_")))
        most = b.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most > SMALL:
            here = {"_x": F.col(f"l_{x}").cast("double"), "_y": F.col(f"l_{y}").cast("double")}
            there = {"_rx": F.col(f"r_{x}").cast("double"), "_ry": F.col(f"r_{y}").cast("double")}
            # of right rows at one place only the k of the smallest seq can count
            b = b.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, f"r_{x}", f"r_{y}").orderBy(f"r_{seq}"))).where(F.col("_n") <= k).drop("_n")
            places = near_candidates(a.select(*keys, *(c.alias(n) for n, c in here.items())).distinct(), b.select(*keys, there["_rx"].alias("_x"), there["_ry"].alias("_y")).distinct(), keys, k, metric)
            a, b = a.withColumns(here), b.withColumns(there)
            pairs = a.join(places, [*keys, "_x", "_y"]).join(b, [*keys, "_rx", "_ry"]).select(*(c for c in [*a.columns, *b.columns[len(keys):]] if c not in ("_x", "_y", "_rx", "_ry")), dist)
        else:
            return _nearest_of_few(a, b, keys, metric, seq, x, y, k)
    rest = [c for c in pairs.columns if c not in keys]
    if k > 1:
        order = Window.partitionBy(*keys, f"l_{seq}").orderBy("dist", f"r_{seq}")
        return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    best = pairs.groupBy(*keys, F.col(f"l_{seq}").alias("_l")).agg(F.min_by(F.struct(*rest), F.struct("dist", f"r_{seq}")).alias("_m"))
    return best.select(*keys, "_m.*")


def _nearest_of_few(a: DataFrame, b: DataFrame, keys: Keys, metric: str, seq: str, x: str, y: str, k: int) -> DataFrame:
    """``nearest`` in drawings of up to SMALL right rows: these travel as one list, so that no pair is made or sorted."""
    own = [c for c in b.columns if c not in keys]
    lists = b.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_b"))
    gap = lambda r: _gap(metric, F.abs(F.col(f"l_{x}") - r[f"r_{x}"]), F.abs(F.col(f"l_{y}") - r[f"r_{y}"]))
    each = F.transform("_b", lambda r, i: F.struct(gap(r).alias("dist"), r[f"r_{seq}"].alias("seq"), i.alias("i")))
    best = F.array(F.array_min(each)) if k == 1 else F.slice(F.array_sort(each), 1, k)
    left = [c for c in a.columns if c not in keys]
    out = a.join(lists, list(keys)).withColumn("_p", best).select(*keys, *left, "_b", F.posexplode("_p").alias("_n", "_m"))
    out = out.withColumn("_r", F.get("_b", F.col("_m.i"))).select(*keys, *left, *(F.col(f"_r.{c}").alias(c) for c in own), F.col("_m.dist").alias("dist"), (F.col("_n") + 1).alias("place"))
    return out if k > 1 else out.drop("place")


def sheets(legends: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Sheets of a drawing: borders half-way between neighbouring legends, 40000 beyond the outer ones."""
    w = Window.partitionBy(*keys).orderBy("x", "seq")
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    return legends.select(*keys, F.row_number().over(w).alias("sheet_no"), F.coalesce((F.col("x") + before) / 2, F.col("x") - 40000).alias("x_left"), F.coalesce((F.col("x") + after) / 2, F.col("x") + 40000).alias("x_right"))


def sheet_elevations(sheet: DataFrame, elevations: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """Sheets with the elevation of the same place: the lowest of a file's distinct elevations for the first, and so on; null beyond."""
    e = elevations.where("elevation is not null").select(*keys, "elevation").distinct()
    e = e.withColumn("sheet_no", F.row_number().over(Window.partitionBy(*keys).orderBy("elevation")))
    return sheet.join(e, [*keys, "sheet_no"], "left")


def assign_sheet(points: DataFrame, sheet: DataFrame, keys: Keys = ("file_id",), x: str = "x") -> DataFrame:
    """Points with the number of the first sheet that their x lies in, or null."""
    s = sheet.select(*keys, "sheet_no", *(F.col(c).cast("double").alias(c) for c in ("x_left", "x_right")), F.lit(0.0).alias("_s"))
    at = points.select(*keys, F.col(x).cast("double").alias("_px")).distinct().withColumn("_p", F.lit(0.0))
    first = box_join(at, s, keys, ("_px", "_p", "_px", "_p"), ("x_left", "_s", "x_right", "_s")).groupBy(*keys, "_px").agg(F.min("sheet_no").alias("sheet_no"))
    return points.withColumn("_px", F.col(x).cast("double")).join(first, [*keys, "_px"], "left").select(*points.columns, "sheet_no")


def union_positions(a: DataFrame, b: DataFrame, keys: Keys, tol: float = 15.0, seq: str = "seq") -> DataFrame:
    """The rows of ``a`` and those of ``b`` that lie within ``tol`` of none of them."""
    taken = near_pairs(b, a, keys, tol).select(*keys, F.col(f"l_{seq}").alias(seq)).distinct()
    return a.unionByName(b.join(taken, [*keys, seq], "left_anti"))


def inserted_block_texts(texts: DataFrame, inserts: DataFrame) -> DataFrame:
    """Texts of blocks that the drawing inserts."""
    return texts.join(inserts.select("file_id", "block_name"), ["file_id", "block_name"], "left_semi")


def merge_tokens(words: DataFrame, suffix: str = "^(А|АЭ)$", keys: Keys = ("file_id", "page"), dx: float = 12.0, dy: float = 5.0) -> DataFrame:
    """Numbers with the suffix word right of them made one; each suffix is used once, by the nearest number before it."""
    from drawlake.operators.iterative import greedy_match

    digits = words.where(F.col("text").rlike("^[0-9]+$")).select(*keys, "seq", F.col("x1").alias("x"), F.col("top").alias("y"), "text")
    tails = words.where(F.col("text").rlike(suffix)).select(*keys, "seq", F.col("x0").alias("x"), F.col("top").alias("y"), "text")
    pairs = near_pairs(digits, tails, keys, max(dx, dy) * 1.5).where((F.col("r_x") - F.col("l_x") > 0) & (F.col("r_x") - F.col("l_x") < dx) & (F.abs(F.col("r_y") - F.col("l_y")) < dy))
    used = greedy_match(pairs.withColumn("first", F.col("l_seq").cast("double")), keys, "l_seq", "r_seq", "first")
    joined = used.select(*keys, F.col("l_seq").alias("seq"), F.col("r_text").alias("_tail"))
    gone = used.select(*keys, F.col("r_seq").alias("seq"))
    return words.join(gone, [*keys, "seq"], "left_anti").join(joined, [*keys, "seq"], "left").withColumn("text", F.concat("text", F.coalesce("_tail", F.lit("")))).drop("_tail")


def mount_heights(anchors: DataFrame, words: DataFrame, keys: Keys = ("file_id", "page"), radius: float = 90.0) -> DataFrame:
    """A mounting height for each anchor, from the nearest word that gives one, with how sure it is.

    Inline (h=2.5) 0.95; a value and the next word a unit 0.85; a prefix and the next word a value 0.75; a
    compact form 0.65; none: the page's most frequent height 0.35.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    t, after = F.col("text"), F.lead("text").over(w)

    def number(c):
        return F.replace(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")

    kind = (
        F.when(t.rlike(r"(?iu)^[hн]\s*=\s*[0-9]+(?:[.,][0-9]+)?\s*м?$"), F.struct(number(t).alias("value"), F.lit(0.95).alias("sure")))
        .when(t.rlike(r"^[0-9]+[.,][0-9]+$") & after.rlike(r"(?iu)^м\.?$"), F.struct(number(t).alias("value"), F.lit(0.85).alias("sure")))
        .when(t.rlike(r"(?iu)^[hн]\s*=?$") & after.rlike(r"^[0-9]+(?:[.,][0-9]+)?"), F.struct(number(after).alias("value"), F.lit(0.75).alias("sure")))
        .when(t.rlike(r"(?iu)^\+?[0-9]+[.,][0-9]+м$"), F.struct(number(t).alias("value"), F.lit(0.65).alias("sure")))
    )
    heights = words.withColumn("k", kind).where(F.col("k").isNotNull() & F.col("k.value").between(1, 20)).select(*keys, "seq", F.col("x0").alias("x"), F.col("top").alias("y"), "k.value", "k.sure")
    usual = heights.groupBy(*keys, "value").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("value", F.struct("n", (-F.col("value")).alias("o"))).alias("usual"))
    best = nearest(anchors.select(*keys, "seq", "x", "y"), heights, keys, radius).select(*keys, F.col("l_seq").alias("seq"), F.col("r_value").alias("value"), F.col("r_sure").alias("sure"))
    out = anchors.join(best, [*keys, "seq"], "left").join(usual, list(keys), "left")
    return out.withColumns({"height": F.coalesce("value", "usual"), "confidence": F.coalesce("sure", F.when(F.col("usual").isNotNull(), 0.35))}).drop("value", "sure", "usual")
