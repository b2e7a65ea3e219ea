"""From counts of drawings to quantities of a project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import rules as R
from drawlake.operators.graph import dealt, numbered, once, stored

Keys = Sequence[str]
LABELS = [label for _, label in R.HEIGHTS] + [R.HIGHEST]
#: Fixed value: the height that a class stands for when lengths are dealt out.
MIDDLES = dict(zip(LABELS, (2.5, 9.0, 16.5, 27.5)))


def merge_elevations(equip: DataFrame, project: str = "project", pair: tuple[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """Equipment over overlapping plans: by name and elevation the plan type with the largest total, then sums by height class.

    Needs (project, plan_type, elevation, name, category, count). Rows without an elevation join the project's only
    elevation if it has just one. With ``pair`` (and a column seq) plans of these two types that lack their counterpart first
    join one of their height class that has it (``pair_orphans``). ``rows``, how many there are, is counted where it isn't given.
    """
    from drawlake.functions.text import height_category

    equip = equip if pair is None else pair_orphans(equip, (project,), pair)
    # only rows without an elevation meet their project's
    own = equip.groupBy(project).agg(F.min("elevation").alias("_lo"), F.max("elevation").alias("_hi")).where("_lo = _hi").select(project, "_lo")
    bare = equip.where("elevation is null").join(own, project, "left").withColumn("elevation", F.col("_lo")).select(*equip.columns)
    e = equip.where("elevation is not null").unionByName(bare)
    e = dealt(e, equip.count() if rows is None else rows, project, "category", "name")
    by_plan = e.groupBy(project, "elevation", "category", "name", "plan_type").agg(F.sum("count").cast("long").alias("count"))
    most = by_plan.groupBy(project, "elevation", "category", "name").agg(F.max("count").alias("count"))
    height = F.coalesce(height_category(F.col("elevation")), F.lit(LABELS[0]))
    return most.groupBy(project, height.alias("height"), "category", "name").agg(F.sum("count").cast("long").alias("count"))


def pair_orphans(equip: DataFrame, keys: Keys = ("project",), pair: tuple[str, str] = ("освещение", "привязка"), seq: str = "seq") -> DataFrame:
    """``equip`` with the elevations of plans that lack their counterpart moved to one that has it.

    Plans of the two types belong together. Elevations of a project are gone through in the order of their first row (by seq):
    one that has only one of the types moves to the first other elevation of the same height class that has, or by then has
    got, the other type. Rows of other plan types, and those without an elevation, stay as they are.
    """
    from drawlake.functions.text import height_category

    both = F.col("plan_type").isin(*pair) & F.col("elevation").isNotNull()
    at = equip.where(both).groupBy(*keys, height_category(F.col("elevation")).alias("_class"), "elevation").agg(F.min(seq).alias("_s"), F.bool_or(F.col("plan_type") == pair[0]).alias("a"), F.bool_or(F.col("plan_type") == pair[1]).alias("b"))
    # a class of a project has a handful of elevations: (elevation, a, b, where it is now) in order
    one = F.struct("_s", "elevation", "a", "b")
    lists = at.groupBy(*keys, "_class").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["elevation"].alias("e"), x["a"].alias("a"), x["b"].alias("b"), x["elevation"].alias("to"))).alias("_l"))

    def step(state, x):
        now = F.filter(state, lambda y: y["e"] == x["e"])[0]
        peer = F.try_element_at(F.filter(state, lambda y: (y["e"] != x["e"]) & (y["to"] == y["e"]) & F.when(now["a"], y["b"]).otherwise(y["a"])), F.lit(1))
        moves = (now["a"] != now["b"]) & peer.isNotNull()
        return F.when(~moves, state).otherwise(F.transform(state, lambda y: F.when(y["e"] == now["e"], F.struct(y["e"].alias("e"), y["a"].alias("a"), y["b"].alias("b"), peer["e"].alias("to"))).when(y["e"] == peer["e"], F.struct(y["e"].alias("e"), F.lit(True).alias("a"), F.lit(True).alias("b"), y["to"].alias("to"))).otherwise(y)))

    moved = lists.select(*keys, F.explode(F.aggregate("_l", F.col("_l"), step)).alias("_m")).select(*keys, F.col("_m.e").alias("elevation"), F.col("_m.to").alias("_to"))
    out = equip.where(both).join(moved, [*keys, "elevation"]).withColumn("elevation", F.col("_to")).select(*equip.columns)
    return out.unionByName(equip.where(~F.coalesce(both, F.lit(False))))


def by_height(equip: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, name, category, a column h0 to h3 for each height class, total): rows with a count above 0, class skip apart."""
    from drawlake.functions.text import classify_equipment, normalize_name

    e = equip.withColumns({"name": normalize_name(F.col("name")), "category": F.coalesce(F.col("category"), classify_equipment(F.col("name"))) if "category" in equip.columns else classify_equipment(F.col("name"))})
    e = e.where((F.col("category") != "skip") & (F.col("count") > 0)).withColumn("height", F.coalesce("height", F.lit(LABELS[0])))
    wide = e.groupBy(*keys, "name", "category").agg(*[F.sum(F.when(F.col("height") == label, F.col("count")).otherwise(0)).cast("long").alias(f"h{k}") for k, label in enumerate(LABELS)], F.sum("count").cast("long").alias("total"))
    return wide


def merge_cables(cables: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Cables of all files by type: counts, metres, and metres by laying method as a map."""
    total = cables.groupBy(*keys, "cable_type").agg(F.sum("count").cast("long").alias("count"), F.sum("total_length_m").cast("long").alias("total_length_m"))
    laid = cables.select(*keys, "cable_type", F.explode("length_by_laying").alias("method", "m")).groupBy(*keys, "cable_type", "method").agg(F.sum("m").cast("long").alias("m"))
    maps = laid.groupBy(*keys, "cable_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "m")))).alias("length_by_laying"))
    return total.join(maps, [*keys, "cable_type"], "left")


def distribute_lengths(cables: DataFrame, equip: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Metres by type and height class: at a known elevation there; the rest in proportion to the equipment's count times
    the class's middle height, rounded half to even; the lowest class where there is no equipment."""
    from drawlake.functions.text import height_category

    known = cables.where("elevation is not null").select(*keys, "cable_type", height_category(F.col("elevation")).alias("height"), F.col("total_length_m").cast("double").alias("m"))
    middle = F.create_map(*[F.lit(x) for kv in MIDDLES.items() for x in kv])
    weights = equip.groupBy(*keys, "height").agg(F.sum("count").alias("n")).withColumn("w", F.col("n") * F.try_element_at(middle, F.col("height")))
    shares = weights.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*keys))).select(*keys, "height", "share")
    rest = cables.where("elevation is null").select(*keys, "cable_type", "total_length_m").join(shares, list(keys), "left")
    rest = rest.select(*keys, "cable_type", F.coalesce("height", F.lit(LABELS[0])).alias("height"), F.bround(F.col("total_length_m") * F.coalesce("share", F.lit(1.0))).alias("m"))
    return known.unionByName(rest).groupBy(*keys, "cable_type", "height").agg(F.sum("m").cast("long").alias("length_m"))


def tray_lengths(segments: DataFrame, keys: Keys = ("project",), center: str = r"(?iu)ось|осев|center") -> DataFrame:
    """Metres of tray from millimetre lines: those of the centre-line layer, or half of the outline where there is none."""
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    axis = F.coalesce(F.col("layer").rlike(center), F.lit(False))
    n = segments.groupBy(*keys).agg(F.sum(F.when(axis, length)).alias("a"), F.sum(F.when(~axis, length)).alias("o"))
    return n.select(*keys, F.round(F.when(F.col("a") > 0, F.col("a") / 1000).otherwise(F.coalesce("o", F.lit(0.0)) / 2000), 4).alias("tray_m"))


def trays_by_height(trays: DataFrame, lengths: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Whole metres of tray by height class: at a known class (keys, height, tray_m) there; without one as the cables' metres
    (keys, height, length_m) lie, or in the lowest class where there are none. Classes that round to nothing fall away."""
    t = trays.where("tray_m > 0")
    total = F.sum("length_m").over(Window.partitionBy(*keys))
    share = lengths.groupBy(*keys, "height").agg(F.sum("length_m").alias("length_m")).withColumn("share", F.when(total > 0, F.col("length_m") / total)).where("share is not null").select(*keys, F.col("height").alias("_h"), "share")
    loose = t.where("height is null").select(*keys, "tray_m").join(share, list(keys), "left").select(*keys, F.coalesce("_h", F.lit(LABELS[0])).alias("height"), (F.col("tray_m") * F.coalesce("share", F.lit(1.0))).alias("tray_m"))
    out = t.where("height is not null").select(*keys, "height", F.col("tray_m").cast("double").alias("tray_m")).unionByName(loose)
    return out.groupBy(*keys, "height").agg(F.bround(F.round(F.sum("tray_m"), 9)).cast("long").alias("tray_m")).where("tray_m > 0")


def apportion(weights: DataFrame, keys: Keys, quantity: str, weight: str, order: Sequence[Column]) -> DataFrame:
    """Adds part: the quantity in proportion to the weights, rounded half to even, largest share first, never more than is
    left, and what remains to the last."""
    w = Window.partitionBy(*keys)
    rows = weights.withColumn("_t", F.sum(weight).over(w)).withColumn("_pos", F.row_number().over(w.orderBy(F.desc(weight), *order)))
    asked = F.when(F.col("_t") > 0, F.bround(F.col(quantity) * F.col(weight) / F.col("_t"))).otherwise(0).cast("long")
    rows = rows.withColumn("_a", asked)
    listed = rows.groupBy(*keys).agg(F.first(quantity).cast("long").alias("_q"), F.sort_array(F.collect_list(F.struct("_pos", "_a"))).alias("_l"))

    def step(acc, x):
        got = F.when(x["_pos"] == F.size("_l"), acc["left"]).otherwise(F.least(x["_a"], acc["left"]))
        return F.struct((acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(F.struct(x["_pos"].alias("_pos"), got.alias("part")))).alias("out"))

    start = F.struct(F.col("_q").alias("left"), F.array().cast("array<struct<_pos:int,part:bigint>>").alias("out"))
    parts = listed.select(*keys, F.explode(F.aggregate("_l", start, step, lambda a: a["out"])).alias("_o")).select(*keys, F.col("_o._pos").alias("_pos"), F.col("_o.part").alias("part"))
    return rows.join(parts, [*keys, "_pos"]).drop("_t", "_pos", "_a")


def replace_with_spec(cables: DataFrame, spec: DataFrame, keys: Keys = ("project",), least: int = 3) -> DataFrame:
    """Cable metres from the specification where it names at least three cables, else from the plans."""
    from drawlake.functions.cables import parse_cable

    metres = spec.where(F.lower(F.trim("unit")).isin("м", "м.", "метр")).select(*keys, parse_cable(F.col("description"))["type"].alias("cable_type"), F.col("quantity").cast("long").alias("total_length_m")).where("cable_type is not null and total_length_m > 0")
    spec_by = metres.groupBy(*keys, "cable_type").agg(F.sum("total_length_m").alias("total_length_m"))
    enough = spec_by.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    plan = cables.select(*keys, "cable_type", F.col("total_length_m").cast("long").alias("total_length_m")).join(enough, list(keys), "left_anti")
    return spec_by.join(enough, list(keys), "left_semi").withColumn("source", F.lit("spec")).unionByName(plan.withColumn("source", F.lit("plan")))


def transfer_laying(spec: DataFrame, plan: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """(keys, cable_type, method, m): the specification's metres (keys, cable_type, total_length_m) by laying method, in the
    proportions that the plans' cables of the type (keys, cable_type, method, m) have, rounded half to even."""
    total = F.sum("m").over(Window.partitionBy(*keys, "cable_type"))
    donors = plan.groupBy(*keys, "cable_type", "method").agg(F.sum("m").alias("m")).withColumn("share", F.when(total > 0, F.col("m") / total)).where("share is not null")
    return spec.join(donors.select(*keys, "cable_type", "method", "share"), [*keys, "cable_type"]).select(*keys, "cable_type", "method", F.bround(F.col("total_length_m") * F.col("share")).cast("long").alias("m"))


def deflate_cables(cables: DataFrame, panels: DataFrame, keys: Keys = ("project",), files: DataFrame | None = None) -> DataFrame:
    """Guards against schemas that show more than the project's own panels; projects whose specification names none stay as they are.

    A project whose schema cables come of one file of the building's own (a number like 8.2 before the section in its name, and
    either sheets of its own or read once) is divided by the schema's panels over the specification's, if that is over 1.5. Else,
    where lengths pass 15000 m a panel and 50000 m in all, and the schemas name over twice the specification's panels,
    lengths shrink by that ratio, or fall away below a fifth. Counts follow, but stay 1 at least.

    ``panels``: (keys, name, source) with source schema or spec; ``files``: (keys, filename, n_results, sheeted) of the
    schemas that give cables.
    """
    n = panels.groupBy(*keys).agg(F.countDistinct(F.when(F.col("source") == "schema", F.col("name"))).alias("n_schema"), F.countDistinct(F.when(F.col("source") == "spec", F.col("name"))).alias("n_spec"))
    total = cables.groupBy(*keys).agg(F.sum("total_length_m").alias("total"))
    c = cables.join(total, list(keys)).join(n, list(keys), "left")
    own = F.lit(False)
    if files is not None:
        building = F.col("filename").rlike(r"(?iu)[0-9]+[.,][0-9]+.*(?:ЭО|ЭМ|EO|EM)") & (F.col("sheeted") | (F.col("n_results") == 1))
        c = c.join(files.groupBy(*keys).agg(F.when(F.count("*") == 1, F.bool_and(building)).alias("_own")), list(keys), "left")
        own = F.coalesce("_own", F.lit(False))
    ratio = F.col("n_spec") / F.col("n_schema")
    much = (F.col("total") >= 50000) & (F.col("total") / F.col("n_spec") > 15000) & (F.col("n_schema") > 2 * F.col("n_spec"))
    known = F.coalesce((F.col("n_spec") > 0) & (F.col("n_schema") > 0), F.lit(False))
    several = (F.col("n_schema") > 1) & (F.col("n_schema") / F.col("n_spec") > 1.5)
    factor = F.when(~known, 1.0).when(own, F.when(several, ratio).otherwise(1.0)).when(much, F.when(ratio < 0.2, 0.0).otherwise(ratio)).otherwise(1.0)
    c = c.withColumn("_factor", factor).where("_factor > 0").withColumn("total_length_m", F.bround(F.col("total_length_m") * F.col("_factor")).cast("long"))
    if "count" in cables.columns:
        c = c.withColumn("count", F.greatest(F.lit(1), F.bround(F.col("count") * F.col("_factor"))).cast(cables.schema["count"].dataType))
    return c.where("total_length_m > 0").select(*cables.columns)


def split_even(equip: DataFrame, elevations: str = "elevations", count: str = "count") -> DataFrame:
    """Counts of a plan for several elevations dealt out evenly, the remainder to the last."""
    n = F.size(elevations)
    rows = equip.select("*", F.posexplode(elevations).alias("_i", "elevation"), n.alias("_n"))
    whole = F.expr(f"{count} div _n")
    return rows.withColumn(count, F.when(F.col("_i") == F.col("_n") - 1, F.col(count) - whole * (F.col("_n") - 1)).otherwise(whole)).drop("_i", "_n", elevations)


def derive_materials(cables: DataFrame, equip: DataFrame, keys: Keys = ("project",), floors: int = 1) -> DataFrame:
    """Materials that follow from cables and equipment: connections, boxes, sleeves, shrink tubes, penetrations, conduit, holders.

    ``cables``: (keys, cable_type, count, total_length_m); ``equip``: (keys, category, count).
    """
    from drawlake.functions.cables import cable_attrs

    # types repeat within a project: what they say is worked out of their sums
    by_type = cables.groupBy(*keys, "cable_type").agg(F.sum("count").alias("count"), F.sum("total_length_m").alias("total_length_m"))
    a = by_type.withColumn("a", cable_attrs(F.col("cable_type")))
    c = a.groupBy(*keys).agg(F.sum(F.col("count") * F.col("a.conductors")).alias("ends"), F.sum("count").alias("n_cables"), F.sum("total_length_m").alias("m"))
    e = equip.groupBy(*keys).agg(F.sum(F.when(F.col("category").isin("luminaire", "indicator", "socket", "switch"), F.col("count")).otherwise(0)).alias("points"))
    out = c.join(e, list(keys), "left").na.fill(0, ["points"])
    conduit = F.bround(F.col("m") * 0.9)
    return out.select(
        *keys, F.bround(F.col("ends") * 2 / floors).cast("long").alias("connections"), F.ceil(F.col("points") / 3).cast("long").alias("junction_boxes"), (F.col("n_cables") * 3).cast("long").alias("sleeves"),
        (F.col("n_cables") * 2).cast("long").alias("heat_shrink"), F.col("n_cables").cast("long").alias("penetrations"), conduit.cast("long").alias("conduit_m"), F.ceil(conduit / 0.8).cast("long").alias("holders"),
    )


def conduit_by_diameter(cables: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """(keys, diameter, length_m, holders): nine tenths of the metres, by the conduit that each section takes."""
    from drawlake.functions.cables import cable_attrs

    by_type = cables.groupBy(*keys, "cable_type").agg(F.sum("total_length_m").alias("total_length_m"))
    m = by_type.groupBy(*keys, cable_attrs(F.col("cable_type"))["conduit_mm"].alias("diameter")).agg(F.sum("total_length_m").alias("m"))
    length = F.bround(F.col("m") * 0.9)
    return m.select(*keys, "diameter", length.cast("long").alias("length_m"), F.ceil(length / 0.8).cast("long").alias("holders"))


def merge_conduit(derived: DataFrame, spec: DataFrame, cables: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """(keys, diameter, length_m, holders): derived conduit of diameters that the specification lacks, scaled down to twice the
    cables' metres (200 at least) in all; where both name fewer than three diameters, 20 and 25 too, from the cables that take them.

    ``derived``: (keys, diameter, length_m, holders); ``spec``: (keys, diameter); ``cables``: (keys, cable_type, total_length_m).
    """
    from drawlake.functions.cables import cable_attrs

    metres = cables.groupBy(*keys).agg(F.sum("total_length_m").alias("_m"))
    d = derived.join(spec.select(*keys, "diameter"), [*keys, "diameter"], "left_anti").join(metres, list(keys))
    total, cap = F.sum("length_m").over(Window.partitionBy(*keys)), F.greatest(2 * F.col("_m"), F.lit(200))
    d = d.withColumns({"_t": total, "_k": F.when(total > cap, cap / total).otherwise(1.0)})
    d = d.select(*keys, "diameter", *[F.bround(F.col(c) * F.col("_k")).cast("long").alias(c) for c in ("length_m", "holders")])
    named = d.select(*keys, "diameter").unionByName(spec.select(*keys, "diameter")).distinct()
    few = metres.join(named.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys), "left").where(F.coalesce("_n", F.lit(0)) < 3).select(*keys)
    usual = cables.select(*keys, cable_attrs(F.col("cable_type"))["conduit_mm"].alias("diameter"), F.bround(F.col("total_length_m") * 0.9).alias("m")).where(F.col("diameter").isin(20, 25))
    usual = usual.join(few, list(keys), "left_semi").join(named, [*keys, "diameter"], "left_anti").groupBy(*keys, "diameter").agg(F.sum("m").cast("long").alias("length_m")).where("length_m > 0")
    return d.unionByName(usual.withColumn("holders", F.ceil(F.col("length_m") / 0.8).cast("long")))


def dedup_cables(cables: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """The first file, by name, of each cable type and length."""
    w = Window.partitionBy(*keys, "cable_type", "total_length_m").orderBy("file_id", "seq")
    return cables.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def dedup_floors(files: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """The best file of each plan category and elevation: by priority, then total, then name."""
    w = Window.partitionBy(*keys, "category", "elevation").orderBy("priority", F.desc("total"), "file_id")
    return files.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def resolve_names(equip: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Made-up names replaced by the first real one of the same symbol and elevation in other files."""
    from drawlake.functions.text import is_auto_detected

    real = equip.where(~is_auto_detected(F.col("name"))).groupBy(*keys, "symbol", F.col("elevation").alias("_e")).agg(F.min_by("name", F.struct("file_id", "seq")).alias("_real"))
    real = real.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("symbol").alias("_s"), "_e", "_real")
    on = (F.col("symbol") == F.col("_s")) & F.col("elevation").eqNullSafe(F.col("_e"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = equip.join(real, on, "left").withColumn("name", F.when(is_auto_detected(F.col("name")), F.coalesce("_real", "name")).otherwise(F.col("name")))
    return out.select(*equip.columns)


def rollup_bill(items: DataFrame, keys: Keys = ()) -> DataFrame:
    """A row for each name: total, the files' parts as a formula, the files, and a number in the order of names."""
    by_file = items.groupBy(*keys, "name", "file_id").agg(F.sum("count").cast("long").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("file_id", "n")))
    out = by_file.groupBy(*keys, "name").agg(F.sum("n").alias("total"), F.array_join(F.transform(parts, lambda s: s["n"].cast("string")), "+").alias("formula"), F.array_join(F.transform(parts, lambda s: s["file_id"].cast("string")), ", ").alias("refs"))
    return out.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))) if keys else numbered(out, ["name"])


def grand_totals(items: DataFrame, keys: Keys) -> DataFrame:
    """Counts by the keys with all their subtotals and the grand total; level tells how many keys a row sums over."""
    return items.rollup(*keys).agg(F.sum("count").cast("long").alias("count"), F.grouping_id().alias("level"))


def commissioning(panels: DataFrame, cables: DataFrame, keys: Keys = ("project",), equip: DataFrame | None = None, floors: int = 1) -> DataFrame:
    """Quantities of tests: lines, twice as many measurements, a third as many phase checks, one breaker test a panel.

    Lines are the cables by floor and the panels' feeds; without any, the panels' circuits (one at least each) and feeds;
    without those, the luminaires; one at least where there is any equipment. ``panels``: (keys, circuit_count, has_feed if known);
    ``cables``: (keys, count); ``equip``: (keys, category, count).
    """
    feed = F.col("has_feed").cast("int") if "has_feed" in panels.columns else F.lit(0)
    p = panels.groupBy(*keys).agg(F.count("*").alias("n_panels"), F.sum(F.greatest(F.coalesce("circuit_count", F.lit(0)), F.lit(1))).alias("circuits"), F.sum(feed).alias("feeds"))
    c = cables.groupBy(*keys).agg(F.sum("count").alias("n_cables"))
    out = p.join(c, list(keys), "full_outer")
    if equip is not None:
        out = out.join(equip.groupBy(*keys).agg(F.sum(F.when(F.col("category") == "luminaire", F.col("count")).otherwise(0)).alias("lights"), F.sum("count").alias("items")), list(keys), "full_outer")
    else:
        out = out.withColumns({"lights": F.lit(0), "items": F.lit(0)})
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    runs = F.bround(none("n_cables") / floors) + none("feeds")
    lines = F.when(runs > 0, runs).when(none("circuits") + none("feeds") > 0, none("circuits") + none("feeds")).when(none("lights") > 0, none("lights")).otherwise(F.when(none("items") > 0, 1).otherwise(0))
    return out.select(*keys, lines.cast("long").alias("lines"), (lines * 2).cast("long").alias("measurements"), F.ceil(lines / 3).cast("long").alias("phase_checks"), none("n_panels").alias("breaker_tests"))


def earthwork(electrodes: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """3.2 cubic metres for each earth electrode, with a decimal comma."""
    n = electrodes.groupBy(*keys).agg(F.sum("count").alias("n"))
    return n.select(*keys, F.replace(F.format_string("%.1f", F.col("n") * F.lit(3.2)), F.lit("."), F.lit(",")).alias("qty"))


def assemble_bill(equip: DataFrame, cables: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Numbered bill rows: a work row by section and height for each item, with its material row (no number) below.

    ``equip``: (keys, category, name, height, count); ``cables``: (keys, cable_type, method, length_m).
    """
    from drawlake.functions.cables import cable_attrs
    from drawlake.functions.text import map_work

    # names and cable types repeat over projects: what they say is worked out once
    w, a = F.col("_w"), F.col("_a")
    order = F.create_map(*[F.lit(x) for k, label in enumerate(LABELS) for x in (label, k)])
    equip = stored(equip.where("count > 0").select(*keys, "category", "name", "height", "count"), "bill-equip")
    named = once(equip, "name", nulls=True, _w=map_work(F.col("name")))
    e = named.select(*keys, F.lit(1).alias("part"), F.col("category").alias("section"), F.try_element_at(order, F.col("height")).alias("rank"), F.concat_ws(" на высоте ", w["work"], F.col("height")).alias("work"), w["unit"].alias("unit"), F.col("name").alias("material"), F.col("count").cast("long").alias("qty"))
    where = F.coalesce(F.nullif(F.col("method"), F.lit("")), F.lit("открыто"))
    klass = F.when(F.contains(where, F.lit("лотке")), a["mass_class"]).otherwise(a["section_class"])
    cables = stored(cables.where("length_m > 0").select(*keys, "cable_type", "method", "length_m"), "bill-cables")
    typed = once(cables, "cable_type", nulls=True, _a=cable_attrs(F.col("cable_type")))
    c = typed.select(*keys, F.lit(2).alias("part"), a["normal_brand"].alias("section"), F.lit(0).alias("rank"), F.concat_ws(" ", F.lit("Прокладка кабеля"), where, klass).alias("work"), F.lit("м").alias("unit"), a["material"].alias("material"), F.col("length_m").cast("long").alias("qty"))
    rows = e.unionByName(c)
    # one shuffle serves sums, numbers and lines
    place = ["part", "section", "rank", "work", "unit"]
    lines = rows.repartition(*keys).groupBy(*keys, *place, "material").agg(F.sum("qty").alias("qty"))
    lines = lines.withColumn("number", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*place)))
    own = Window.partitionBy(*keys, "number")
    lines = lines.withColumns({"line": F.row_number().over(own.orderBy("material")), "total": F.sum("qty").over(own)})
    one = lambda line, name, qty: F.struct(line.alias("line"), F.col(name).alias("name"), F.col(qty).alias("qty"))
    top, sub = one(F.lit(0), "work", "total"), one(F.col("line"), "material", "qty")
    lines = lines.select(*keys, "number", "section", "unit", F.explode(F.when(F.col("line") == 1, F.array(top, sub)).otherwise(F.array(sub))).alias("_r"))
    return lines.select(*keys, "number", "_r.line", "section", "_r.name", "unit", "_r.qty")
