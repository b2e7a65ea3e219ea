"""Greedy matching, suppression and routes as rounds of set operations.

A sequential greedy choice in a strict order equals rounds in which everything that is first among all that it
conflicts with is taken at once. The driver only runs the loop; rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.operators.graph import checkpointed, components, stored

Keys = Sequence[str]


def greedy_match(pairs: DataFrame, group: Keys, left: str, right: str, dist: str) -> DataFrame:
    """One-to-one pairs, nearest first (ties: smaller left, then right): all columns of the pairs taken."""
    live, taken = checkpointed(pairs), None
    while not live.isEmpty():
        order = [F.col(dist), F.col(left), F.col(right)]
        by_left, by_right = Window.partitionBy(*group, left).orderBy(*order), Window.partitionBy(*group, right).orderBy(*order)
        best = live.withColumns({"_l": F.row_number().over(by_left), "_r": F.row_number().over(by_right)}).where("_l = 1 and _r = 1").drop("_l", "_r")
        best = checkpointed(best)
        taken = best if taken is None else taken.unionByName(best)
        live = live.join(best.select(*group, left), [*group, left], "left_anti").join(best.select(*group, right), [*group, right], "left_anti")
        live = checkpointed(live)
    return live if taken is None else taken


def serial_match(pairs: DataFrame, group: Keys, left: str, right: str, place: str) -> DataFrame:
    """One-to-one pairs as left rows in their order choose what is left of their lists, by ``place``: (group, left, right).

    In each round all left rows ask for the best on their lists at once, and a right row strikes itself off the lists of all that
    come after the first that asks: whom it gets in the end is that one or an earlier one. Rounds end when no two ask for one.
    """
    live = checkpointed(pairs.select(*group, left, right, place))
    while True:
        asked = checkpointed(live.groupBy(*group, left).agg(F.min_by(right, place).alias(right)))
        first = asked.groupBy(*group, right).agg(F.min(left).alias("_first"))
        if first.count() == asked.count():
            return asked.select(*group, left, right)
        live = checkpointed(live.join(first, [*group, right], "left").where(F.col("_first").isNull() | (F.col(left) <= F.col("_first"))).drop("_first"))


def suppressed(conflicts: DataFrame, keys: Keys, better: str = "better", worse: str = "worse") -> DataFrame:
    """(keys, id) of rows that a kept row suppresses; ``conflicts`` holds (keys, better, worse)."""
    live, gone = checkpointed(conflicts.select(*keys, F.col(better).alias("b"), F.col(worse).alias("w")).distinct()), None
    while not live.isEmpty():
        heads = live.select(*keys, "b").distinct().join(live.select(*keys, F.col("w").alias("b")).distinct(), [*keys, "b"], "left_anti")
        out = checkpointed(live.join(heads, [*keys, "b"], "left_semi").select(*keys, F.col("w").alias("id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        live = live.join(out.withColumnRenamed("id", "w"), [*keys, "w"], "left_anti").join(out.withColumnRenamed("id", "b"), [*keys, "b"], "left_anti")
        live = checkpointed(live)
    return live.select(*keys, F.col("w").alias("id")) if gone is None else gone


def _kept(df: DataFrame, gone: DataFrame, keys: Keys, seq: str) -> DataFrame:
    return df.join(gone.withColumnRenamed("id", seq), [*keys, seq], "left_anti")


def dedup_points(df: DataFrame, keys: Keys, tol: float, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Points at least ``tol`` from every point kept before them (by seq). A drawing's points go in turn, as pairs of dense ones are too many."""
    from drawlake.operators.turns import first_near, gone_points, in_turn, sized

    at = {"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}
    rows, large = sized(df, keys)
    few = df if large is None else df.join(large, list(keys), "left_anti").select(*df.columns)
    each = in_turn(few.withColumns(at), rows, keys, [seq], [seq, "_x", "_y"], first_near(tol, nearest=False), "_first", df.schema[seq].dataType)
    kept = each.where(F.col("_first").isNull() | (F.col("_first") == F.col(seq))).select(*df.columns)
    if large is None:
        return kept
    many = df.join(large, list(keys), "left_semi").select(*df.columns)
    gone = gone_points(many.select(*keys, F.col(seq).alias("seq"), at["_x"].alias("x"), at["_y"].alias("y")), keys, tol)
    return kept.unionByName(_kept(many, gone.withColumnRenamed("seq", "id"), keys, seq).select(*df.columns))


def _before(conf: str, seq: str) -> Column:
    return (F.col(f"l_{conf}") > F.col(f"r_{conf}")) | ((F.col(f"l_{conf}") == F.col(f"r_{conf}")) & (F.col(f"l_{seq}") < F.col(f"r_{seq}")))


def nms(det: DataFrame, keys: Keys, ratio: float = 0.6, min_radius: float = 60.0, iou: float = 0.3, seq: str = "det_id") -> DataFrame:
    """Detections kept by confidence: one is dropped if it lies nearer to a kept one than the kept one's radius, or overlaps it by ``iou``.

    A kept one's reach is a box of its own size, so that a huge one sets no other's cells.
    """
    from drawlake.operators.spatial import box_join

    radius = F.greatest(ratio * F.greatest("w", "h"), F.lit(min_radius))
    slim = det.select(*keys, seq, F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), "w", "h", "confidence").withColumn("radius", radius)

    def side(prefix, half):
        d = slim.select(*keys, *(F.col(c).alias(prefix + c) for c in slim.columns if c not in keys))
        for c, s in (("x", "w"), ("y", "h")):
            reach = half(F.col(f"{prefix}{s}") / 2, F.col(f"{prefix}radius")).cast("double")
            d = d.withColumns({f"{prefix}{c}0": F.col(f"{prefix}{c}") - reach, f"{prefix}{c}1": F.col(f"{prefix}{c}") + reach})
        return d

    box = lambda p: (f"{p}x0", f"{p}y0", f"{p}x1", f"{p}y1")
    pairs = box_join(side("l_", F.greatest), side("r_", lambda half, r: half), keys, box("l_"), box("r_")).where(_before("confidence", seq) & (F.col(f"l_{seq}") != F.col(f"r_{seq}")))
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")

    def shared(c, s):
        return F.greatest(F.lit(0.0), F.least(F.col(f"l_{c}") + F.col(f"l_{s}") / 2, F.col(f"r_{c}") + F.col(f"r_{s}") / 2) - F.greatest(F.col(f"l_{c}") - F.col(f"l_{s}") / 2, F.col(f"r_{c}") - F.col(f"r_{s}") / 2))

    both = shared("x", "w") * shared("y", "h")
    union = F.col("l_w") * F.col("l_h") + F.col("r_w") * F.col("r_h") - both
    hit = pairs.where((F.sqrt(dx * dx + dy * dy) < F.col("l_radius")) | ((union > 0) & (both / union >= iou)))
    return _kept(det, suppressed(hit, keys, f"l_{seq}", f"r_{seq}"), keys, seq)


def cross_nms(det: DataFrame, keys: Keys, exempt: DataFrame | None = None, radius: float = 25.0, gap: float = 0.04, seq: str = "det_id", label: str = "symbol_index") -> DataFrame:
    """Detections of which no kept one of another class within ``radius`` is surer by ``gap``; pairs of classes in ``exempt`` (a, b) don't compete."""
    from drawlake.operators.spatial import near_pairs

    slim = det.select(*keys, seq, F.col("cx").alias("x"), F.col("cy").alias("y"), "confidence", F.col(label).alias("k"))
    pairs = near_pairs(slim, slim, keys, radius).where((F.col("l_k") != F.col("r_k")) & (F.col("l_confidence") - F.col("r_confidence") >= gap))
    if exempt is not None:
        both = exempt.select(F.col("a").alias("l_k"), F.col("b").alias("r_k")).union(exempt.select("b", "a"))
        pairs = pairs.join(both, ["l_k", "r_k"], "left_anti")
    return _kept(det, suppressed(pairs, keys, f"l_{seq}", f"r_{seq}"), keys, seq)


def routes(segments: DataFrame, keys: Keys = ("file_id", "page", "color", "linewidth"), tol: float = 2.0) -> DataFrame:
    """Connected runs of segments that share an end (both coordinates within ``tol``): count, length and box of each."""
    at = segments.withColumn("sid", F.xxhash64(*keys, "seq"))
    ends = at.select(*keys, "sid", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select(*keys, "sid", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    # an end goes to the cells that its square of the tolerance meets; they are wide, so mostly to one, and one shuffle serves all
    cell = lambda c: F.floor(c / (8.0 * tol)).cast("long")
    met = lambda c: F.explode(F.sequence(cell(F.col(c) - tol - F.abs(c) * 1e-12), cell(F.col(c) + tol + F.abs(c) * 1e-12)))
    dealt = ends.withColumn("_cx", met("x")).withColumn("_cy", met("y")).repartition(*keys, "_cx", "_cy")
    # ends at one place hang on the smallest of them, and only places are held against each other
    dealt = dealt.withColumn("first", F.min("sid").over(Window.partitionBy(*keys, "_cx", "_cy", "x", "y")))
    places = dealt.where("sid = first").select(*keys, "_cx", "_cy", "sid", "x", "y")
    side = lambda k: places.select(*keys, "_cx", "_cy", *(F.col(c).alias(f"{k}_{c}") for c in ("sid", "x", "y")))
    close = (F.col("a_sid") < F.col("b_sid")) & (F.abs(F.col("a_x") - F.col("b_x")) < tol) & (F.abs(F.col("a_y") - F.col("b_y")) < tol)
    pairs = side("a").hint("merge").join(side("b"), [*keys, "_cx", "_cy"]).where(close)
    comp = components(pairs.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).union(dealt.where("sid <> first").select("first", "sid")))
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    slim = at.select(*keys, "sid", length.alias("length"), F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    rows = slim.join(comp, slim["sid"] == comp["id"], "left").withColumn("route", F.coalesce("comp", "sid"))
    return rows.groupBy(*keys, "route").agg(F.count("*").alias("n_segments"), F.round(F.sum("length"), 4).alias("length"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def adaptive_threshold(det: DataFrame, keys: Keys, base: float = 0.32, low: float = 0.30, high: float = 0.62) -> DataFrame:
    """A threshold for each group: the larger of the base, the 97th percentile and the 99th less 0.015, between low and high."""
    p = F.percentile("confidence", F.array(F.lit(0.97), F.lit(0.99)))
    return det.groupBy(*keys).agg(p.alias("p")).select(*keys, F.greatest(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(base), F.col("p")[0], F.col("p")[1] - 0.015))).alias("threshold"))


def disambiguate(det: DataFrame, words: DataFrame, hints: DataFrame, keys: Keys, seq: str = "det_id", label: str = "symbol_index", cluster: float = 25.0, reach: float = 40.0) -> DataFrame:
    """One class for each place: detections within ``cluster`` of the surest one there share its place, and the class
    of which most hint words (label, token) stand within ``reach`` is taken; the surest one's where none does."""
    from drawlake.operators.spatial import near_pairs

    ranked = det.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), seq)))
    pts = stored(ranked.select(*keys, F.col("_o").alias("seq"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col(label).alias("label")), "ranked")
    seeds = stored(dedup_points(pts, keys, cluster), "seeds")
    own = near_pairs(pts, seeds, keys, cluster).groupBy(*keys, F.col("l_seq").alias("seq")).agg(F.min("r_seq").alias("place"))
    placed = pts.join(own, [*keys, "seq"])
    said = words.join(hints.select(F.col("label").alias("hint"), F.col("token").alias("text")), "text").select(*keys, "hint", F.col("x0").alias("x"), F.col("top").alias("y"))
    # seeds lie apart, so that they are the ones to be dealt
    hits = near_pairs(said, seeds.select(*keys, "seq", "x", "y"), keys, reach).groupBy(*keys, F.col("r_seq").alias("place"), F.col("l_hint").alias("label")).agg(F.count("*").alias("n"))
    votes = placed.join(hits, [*keys, "place", "label"], "left")
    return votes.groupBy(*keys, "place").agg(F.max_by("label", F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("seq")).alias("o"))).alias(label), F.count("*").alias("n_detections"))


def detect_counts(det: DataFrame, zones: DataFrame, keys: Keys = ("file_id", "page"), seq: str = "det_id", label: str = "symbol_index", cap: int = 80) -> DataFrame:
    """Counts by symbol with what each stage leaves: threshold, zones, suppression by class, cap, suppression across classes.

    Zones come before suppression on purpose: a hit in a legend would else suppress a real one.
    """
    from drawlake.operators.sequences import top_k
    from drawlake.operators.spatial import exclude_zones

    by = [*keys, label]
    limit = adaptive_threshold(det, by)
    sure = det.join(limit, by).where(F.col("confidence") >= F.col("threshold")).drop("threshold")
    outside = exclude_zones(sure, zones, keys, x="cx", y="cy")
    single = nms(outside, by, seq=seq)
    capped = top_k(single, by, [F.desc("confidence"), F.col(seq)], cap)
    final = cross_nms(capped, keys, seq=seq, label=label)

    def count(df, name):
        return df.groupBy(*by).agg(F.count("*").alias(name))

    out = count(det, "n_raw")
    for df, name in ((sure, "n_sure"), (outside, "n_outside"), (single, "n_single"), (capped, "n_capped"), (final, "n_final")):
        out = out.join(count(df, name), by, "left")
    return out.na.fill(0, ["n_sure", "n_outside", "n_single", "n_capped", "n_final"])


def detection_stages(det: DataFrame, zones: DataFrame, classes: DataFrame, words: DataFrame, hints: DataFrame, exempt: DataFrame | None = None, keys: Keys = ("file_id", "page"), seq: str = "det_id", label: str = "symbol_index", cap: int = 80) -> tuple[DataFrame, DataFrame]:
    """(counts, detections): detections by class as they pass all stages, with what each stage leaves of every class.

    ``classes`` (label, one_letter, color): symbols of one letter and a mark take an adaptive threshold, a wide suppression
    (1.2 sides, 120 at least), the surest of each cell and at most ``cap``; all others the threshold they came with and the usual
    suppression. Detections over text or of the wrong shape (flags over_text, bad_shape) go, and those whose own color is
    another than their class's; none seen is accepted. Then classes suppress each other, but for exempt pairs, and each place
    takes the class that most of its hint words name.
    """
    from drawlake.operators.graph import checkpointed
    from drawlake.operators.sequences import best_per_cell, top_k
    from drawlake.operators.spatial import exclude_zones

    by = [*keys, label]
    stages = {}
    own = det.join(classes.select(label, "one_letter", F.coalesce("color", F.lit("")).alias("_color")), label)
    letter = F.coalesce(F.col("one_letter"), F.lit(False))
    limit = adaptive_threshold(own.where(letter), by)
    stages["n_sure"] = now = own.join(limit, by, "left").where(F.col("threshold").isNull() | (F.col("confidence") >= F.col("threshold"))).drop("threshold")
    stages["n_outside"] = now = checkpointed(exclude_zones(now, zones, keys, x="cx", y="cy"))
    stages["n_single"] = now = nms(now.where(letter), by, 1.2, 120.0, seq=seq).unionByName(nms(now.where(~letter), by, seq=seq))
    flagged = F.coalesce(F.col("over_text"), F.lit(False)) | F.coalesce(F.col("bad_shape"), F.lit(False))
    stages["n_shaped"] = now = now.where(~flagged)
    seen = F.coalesce(F.col("color"), F.lit(""))
    stages["n_colored"] = now = checkpointed(now.where((F.col("_color") == "") | (seen == "") | (seen == F.col("_color"))))
    few = top_k(best_per_cell(now.where(letter), by, seq=seq), by, [F.desc("confidence"), F.col(seq)], cap)
    stages["n_capped"] = now = few.unionByName(now.where(~letter))
    stages["n_crossed"] = now = checkpointed(cross_nms(now, keys, exempt, seq=seq, label=label))
    final = disambiguate(now, words, hints, keys, seq=seq, label=label)
    out = own.groupBy(*by).agg(F.count("*").alias("n_raw"))
    for name, df in stages.items():
        out = out.join(df.groupBy(*by).agg(F.count("*").alias(name)), by, "left")
    out = out.join(final.groupBy(*by).agg(F.count("*").alias("n_final")), by, "full_outer")
    return out.na.fill(0), final
