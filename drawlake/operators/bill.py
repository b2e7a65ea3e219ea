"""A project's whole bill: rules of sections as data, rows numbered by ranges.

Every row carries its place as columns: section (part), group in it (sub), two ranks (a, b), the first item of its work (c, d),
line (0 the work, else its materials), and the material's own place (e, f). Sorting by them gives the bill; no project's rows meet
in one task, but the entries of one work do, and what a quantity sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from drawlake.functions import rules as R
from drawlake.functions.cables import cable_attrs
from drawlake.functions.text import grounding_work, mounting_type, pvc_diameters
from drawlake.operators.compare import _inside, not_in_plan
from drawlake.operators.graph import once, stored
from drawlake.operators.rollup import LABELS, commissioning, earthwork

Keys = Sequence[str]
PLACE = {"part": "int", "sub": "long", "a": "int", "b": "int", "c": "long", "d": "long", "line": "int", "e": "long", "f": "int"}
ROW = {"head": "string", "name": "string", "unit": "string", "qty": "string", "formula": "string"}
PART = {name: k for k, (name, _) in enumerate(R.BILL_SECTIONS)}
HEAD = dict(R.BILL_SECTIONS)


def filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def shown(quantity: Column) -> Column:
    """A quantity as bills write it: whole numbers without decimals."""
    q = quantity.cast("double")
    return F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string"))


def _of(kind: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind)


def _rows(df: DataFrame, keys: Keys, section: str | Column, **columns) -> DataFrame:
    """Rows of a section: what isn't given is 0 or null, its header is the section's."""
    known = isinstance(section, str)
    given = {"part": F.lit(PART[section]) if known else _of(section, PART), "head": F.nullif(F.lit(HEAD[section]) if known else _of(section, HEAD), F.lit(""))} | columns
    column = lambda k, t, otherwise: (given[k] if isinstance(given.get(k), Column) else F.lit(given.get(k, otherwise))).cast(t).alias(k)
    return df.select(*keys, *(column(k, t, 0) for k, t in PLACE.items()), *(column(k, t, None) for k, t in ROW.items()))


def _grouped(entries: DataFrame, keys: Keys) -> DataFrame:
    """Works with what they sum over below: entries (keys, part, sub, head, a, b, work, own, unit, name, m, adds, line, seq, pos) of one
    work are those of equal place and text, and ``own`` where they stand for themselves. Works come in the order of their first entry;
    those that nothing adds to, and what belongs to them, fall away."""
    # entries of a work meet once; its first one carries the work's own row
    w = Window.partitionBy(*keys, "part", "sub", "a", "b", "head", "work", "own", "unit").orderBy("seq", "pos")
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, first = F.sum(F.when(F.col("adds"), F.col("m"))).over(all_of), F.first(F.struct("seq", "pos")).over(all_of)
    e = entries.withColumns({"total": total, "first": first, "_k": F.row_number().over(w)}).where("total is not null")
    e = e.withColumn("top", F.explode(F.when(F.col("_k") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    own = lambda work, entry: F.when(F.col("top"), work).otherwise(entry)
    place = {"part": F.col("part"), "sub": F.col("sub"), "a": F.col("a"), "b": F.col("b"), "c": F.col("first.seq"), "d": F.col("first.pos"), "head": F.col("head"), "unit": F.col("unit")}
    return _rows(e, keys, "cables", **(place | {"line": own(F.lit(0), F.col("line")), "e": own(F.lit(0), F.col("seq")), "f": own(F.lit(0), F.col("pos")), "name": own(F.col("work"), F.col("name")), "qty": shown(own(F.col("total"), F.col("m")))}))


def _written(parts: list[DataFrame]) -> DataFrame:
    """Rows of a section, written: one plan over all sections would take more of the driver's memory than its rows deserve."""
    return stored(reduce(DataFrame.unionByName, parts).withColumns({"c": F.coalesce("c", F.lit(0)), "e": F.coalesce("e", F.lit(0))}), "bill")


def place_rows(rows: DataFrame, keys: Keys, order: Sequence[str], counted: Column, place: str = "place", number: str = "number", keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (their columns ``keep``, if given) with their place among the rows of equal keys, from 1, and the number of those that are counted (null for others).

    Ranges of (keys, order) deal the rows; what lies before a range and what lies before its keys are sums of a row a range and
    a row a key, so that no task sees all rows of a key.
    """
    every = [*keys, *order]

    def counted_up(batches):
        """A sorted range with each row's place in it and the sum of _w up to it."""
        n = m = 0
        for b in batches:
            sums = m + np.cumsum(b.column("_w").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n + 1, n + 1 + b.num_rows)), pa.array(sums)], [*b.schema.names, "_n", "_m"])
            if b.num_rows:
                n, m = n + b.num_rows, int(sums[-1])

    r = rows.withColumn("_w", F.coalesce(counted, F.lit(False)).cast("long")).repartitionByRange(*every).sortWithinPartitions(*every)
    r = r.select(*(rows.columns if keep is None else keep), "_w", F.spark_partition_id().alias("_part"))
    r = stored(r.mapInArrow(counted_up, StructType([*r.schema.fields, StructField("_n", LongType()), StructField("_m", LongType())])), "placed")
    sizes = r.groupBy("_part").agg(F.max("_n").alias("_n"), F.max("_m").alias("_m"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "0") for c in ("_n", "_m"))), "sizes")
    r = r.join(F.broadcast(sizes), "_part").withColumns({"_n": F.col("_n") + F.col("_n0"), "_m": F.col("_m") + F.col("_m0")}).drop("_n0", "_m0", "_part")
    # written, so that a small one goes to the rows and these stay where they are
    first = stored(r.groupBy(*keys).agg((F.min("_n") - 1).alias("_n1"), F.min(F.col("_m") - F.col("_w")).alias("_m1")), "first")
    out = r.join(first, list(keys))
    return out.withColumns({place: F.col("_n") - F.col("_n1"), number: F.when(F.col("_w") == 1, F.col("_m") - F.col("_m1"))}).drop("_n", "_m", "_n1", "_m1", "_w")


def tray_accessories(trays: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """(keys, line, name, qty): what a project's metres of tray (keys, qty) take of plates, turns, branches, supports, anchors and bolts."""
    metres = trays.groupBy(*keys).agg(F.sum("qty").alias("m")).where("m > 0")
    n = [F.greatest(F.bround(F.col("m") / per), F.lit(float(least))) for _, per, least in R.TRAY_PARTS]
    parts = [*((name, q) for (name, _, _), q in zip(R.TRAY_PARTS, n)), (R.TRAY_BOLTS, 2 * n[0] + 2 * n[1] + n[3])]
    return metres.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("line"), F.lit(name).alias("name"), q.cast("long").alias("qty")) for k, (name, q) in enumerate(parts, 1)))))


def _shares(projects: DataFrame, shares: DataFrame | None, keys: Keys) -> DataFrame:
    """(keys, height, rank, share) of lengths by height; all of it at the lowest where none is known."""
    whole = F.array(F.struct(F.lit(LABELS[0]).alias("height"), F.lit(1.0).alias("share")))
    rank = _of(F.col("height"), {x: k for k, x in enumerate(LABELS)})
    if shares is None:
        return projects.select(*keys, F.inline(whole)).withColumn("rank", rank)
    s = shares.where(F.col("height").isin(*LABELS)).groupBy(*keys, "height").agg(F.sum("length_m").cast("double").alias("m"))
    total = s.groupBy(*keys).agg(F.sum("m").alias("t"))
    of = s.join(total, list(keys)).where("t > 0").groupBy(*keys).agg(F.collect_list(F.struct("height", (F.col("m") / F.col("t")).alias("share"))).alias("s"))  # four at most
    return projects.join(of, list(keys), "left").select(*keys, F.inline(F.coalesce("s", whole))).where("share > 0").withColumn("rank", rank)


def _cable_rows(cables: DataFrame, heights: DataFrame, keys: Keys) -> list[DataFrame]:
    c = cables.withColumns({"brand": F.col("at.brand"), "wire": F.col("at.is_wire")})
    wires = _grouped(c.where("wire").select(*keys, F.lit(PART["wires"]).alias("part"), F.lit(0).alias("sub"), F.lit(HEAD["wires"]).alias("head"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(R.WIRE_WORK).alias("work"), F.lit("").alias("own"), F.lit("м").alias("unit"), F.col("at.material").alias("name"), F.col("total_length_m").alias("m"), F.lit(True).alias("adds"), F.lit(1).alias("line"), "seq", F.lit(0).alias("pos")), keys)
    c = c.where("not wire")
    brands = c.groupBy(*keys, "brand").agg(F.min("seq").alias("sub")).join(heights, list(keys))  # few a project
    c = c.join(brands, [*keys, "brand"])
    length = F.bround(F.col("total_length_m") * F.col("share")).cast("long")
    laid = F.filter(F.transform(F.coalesce("laying", F.array().cast("array<struct<method:string,m:bigint>>")), lambda x: F.struct(x["method"].alias("method"), F.bround(x["m"] * F.col("share")).cast("long").alias("m"))), lambda x: x["m"] > 0)
    usual = F.array(F.struct(F.lit(R.USUAL_LAYING).alias("method"), length.alias("m")))
    c = c.where(length > 0).withColumn("_laid", laid).select("*", F.posexplode(F.when(F.size("_laid") > 0, F.col("_laid")).otherwise(usual)).alias("pos", "l"))
    how, method, mass, section = F.lower("l.method"), F.col("l.method"), F.col("at.mass_class"), F.col("at.section_class")
    under, heavy = how.rlike(R.UNDERGROUND), how.rlike(R.IN_TRAY) & ~mass.isin("", R.LIGHT_CABLE)
    where = F.concat(method, F.lit(" на высоте "), F.col("height"))
    sized = F.when(~how.rlike(R.IN_TRAY) & how.rlike(R.IN_CONDUIT) & (section != ""), F.concat(F.lit(" ("), section, F.lit(")"))).otherwise("")
    work = F.when(under, R.UNDERGROUND_WORK).when(heavy, F.concat(F.lit("Прокладка кабеля ("), mass, F.lit(") "), where)).otherwise(F.concat(F.lit("Прокладка кабеля "), where, sized, F.lit(":")))
    block = F.when(under, 3).when(heavy, 1).otherwise(2)
    entries = c.select(*keys, F.lit(PART["cables"]).alias("part"), "sub", filled(HEAD["cables"], F.col("at.normal_brand")).alias("head"), F.col("rank").alias("a"), block.alias("b"), work.alias("work"), F.when(block != 2, F.concat_ws(":", "seq", "pos")).otherwise("").alias("own"), F.lit("м").alias("unit"), F.col("at.material").alias("name"), F.col("l.m").alias("m"), F.lit(True).alias("adds"), F.lit(1).alias("line"), "seq", "pos")
    return [wires, _grouped(entries, keys)]


def _lights(items: DataFrame, keys: Keys, signs: DataFrame) -> list[DataFrame]:
    """Luminaires by height and mounting; signs by height with the pictograms of that height; pictograms alone where no sign is."""
    rank, name = _of(F.col("height"), {x: k for k, x in enumerate(LABELS)}), F.col("name")
    lit = once(items.where(F.col("kind").isin("luminaire", "indicator", "pictogram") & (F.col("qty") > 0)), "name", mount=mounting_type(name)).withColumn("rank", rank)
    is_light, at = F.col("kind") == "luminaire", F.col("height")
    mount = {k: n for n, (k, _) in enumerate(R.MOUNTING_WORKS)}
    works = None
    for kind, text in R.MOUNTING_WORKS:
        works = F.when(F.col("mount") == kind, filled(text, at)) if works is None else works.when(F.col("mount") == kind, filled(text, at))
    entries = lit.where("rank is not null").select(
        *keys, F.lit(PART["lights"]).alias("part"), F.when(is_light, F.col("rank") * 10 + _of(F.col("mount"), mount)).otherwise(100 + F.col("rank")).alias("sub"), F.lit(HEAD["lights"]).alias("head"), F.lit(0).alias("a"), F.lit(0).alias("b"),
        F.when(is_light, works).otherwise(filled(R.SIGN_WORK, at)).alias("work"), F.lit("").alias("own"), F.lit("шт").alias("unit"), F.when(is_light, filled(R.LUMINAIRE, name)).otherwise(name).alias("name"),
        F.col("qty").alias("m"), (F.col("kind") != "pictogram").alias("adds"), F.when(F.col("kind") == "pictogram", 2).otherwise(1).alias("line"), "seq", F.lit(0).alias("pos"),
    )
    alone = lit.where("kind = 'pictogram'").join(signs, list(keys), "left_anti").groupBy(*keys, "name").agg(F.min("seq").alias("seq"), F.sum("qty").alias("qty"))
    return [_grouped(entries, keys), _rows(alone, keys, "lights", sub=200, c=F.col("seq"), name=name, unit="шт", qty=shown(F.col("qty")))]


def _conduit(items: DataFrame, derived: DataFrame, cables: DataFrame, heights: DataFrame, projects: DataFrame, keys: Keys) -> list[DataFrame]:
    pvc = items.where("kind = 'pvc'").withColumn("diameter", F.try_element_at(pvc_diameters(F.col("name")), F.lit(1)))
    tube = F.coalesce(F.col("unit").isin(*R.METRES) & (F.col("qty") > 0) & F.col("diameter").isNotNull(), F.lit(False))
    named = pvc.where(tube).groupBy(*keys, "diameter").agg(F.sum(F.floor("qty")).alias("m"))
    own = derived.where("what = 'conduit' and qty > 0").groupBy(*keys, F.col("size").alias("diameter")).agg(F.sum("qty").cast("long").alias("m")).join(named, [*keys, "diameter"], "left_anti")
    tubes = named.unionByName(own)
    total = tubes.groupBy(*keys).agg(F.sum("m").alias("m")).join(heights, list(keys)).withColumn("h", F.bround(F.col("m") * F.col("share")).cast("long")).where("h > 0")
    each = tubes.join(total.drop("m"), list(keys)).withColumn("m", F.bround(F.col("m") * F.col("share")).cast("long")).where("m > 0")
    known = tubes.select(*keys).distinct()
    holders = derived.where("what = 'holders' and qty > 0").join(known, list(keys), "left_semi")
    pulled = cables.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum("total_length_m").alias("m")).join(known, list(keys), "left_anti")
    blank = projects.join(known, list(keys), "left_anti").join(pulled, list(keys), "left_anti")
    text = lambda c: F.col(c).cast("string")
    return [
        _rows(pvc.where(~tube), keys, "conduit", a=1, c=F.col("seq"), name=F.col("name"), unit=F.col("unit"), qty=shown(F.col("qty"))),
        _rows(total, keys, "conduit", a=2, b=F.col("rank"), name=filled(R.CONDUIT_WORK, F.col("height")), unit="м", qty=text("h")),
        _rows(each, keys, "conduit", a=2, b=F.col("rank"), line=1, e=-F.col("diameter"), name=filled(R.CONDUIT_PIPE, text("diameter")), unit="м", qty=text("m")),
        _rows(holders, keys, "conduit", a=3, line=1, e=F.col("size"), name=filled(R.CONDUIT_HOLDER, text("size")), unit="шт", qty=text("qty")),
        _rows(pulled, keys, "conduit", a=4, name=R.PULLING_WORK, unit="м", qty=text("m"), formula=filled(R.PULLING_LINES, text("n"))),
        _rows(pulled, keys, "conduit", a=4, line=1, name=R.BLANK["pulling"], unit="м", qty=""),
        _rows(blank, keys, "conduit", a=5, line=1, name=R.BLANK["conduit"], unit="", qty=""),
    ]


def _grounding(items: DataFrame, projects: DataFrame, keys: Keys) -> list[DataFrame]:
    low = F.lower("name")
    block = F.when(low.rlike(R.ELECTRODES), 2).when(low.rlike(R.EQUALISATION), 5).otherwise(3)
    g = once(items.where("kind = 'grounding'"), "name", block=block, work=grounding_work(F.col("name")))
    earth = earthwork(g.where("block = 2 and qty > 0").withColumnRenamed("qty", "count"), keys).select("*", F.posexplode(F.array(*map(F.lit, R.EARTHWORKS))).alias("k", "name"))
    same = g.where("block = 5").select(*keys).distinct()
    return [
        _rows(earth, keys, "grounding", a=1, c=F.col("k"), name=F.col("name"), unit="м³", qty=F.col("qty")),
        _rows(g, keys, "grounding", a=F.col("block"), c=F.col("seq"), name=F.col("work"), unit=F.col("unit"), qty=shown(F.col("qty"))),
        _rows(same, keys, "grounding", a=4, name=R.EQUALISATION_WORK, unit="", qty=""),
        _rows(projects.join(g, list(keys), "left_anti"), keys, "grounding", a=6, line=1, name=R.BLANK["grounding"], unit="", qty=""),
        _rows(projects.join(items.where("kind = 'lightning'"), list(keys), "left_anti"), keys, "lightning", line=1, name=R.BLANK["lightning"], unit="", qty=""),
    ]


def _tests(items: DataFrame, panels: DataFrame, cables: DataFrame, keys: Keys, floors: int) -> list[DataFrame]:
    equip = items.where(F.col("kind").isin("luminaire", "switch", "socket", "outlet")).select(*keys, F.col("kind").alias("category"), F.col("qty").alias("count"))
    n = commissioning(panels, cables, keys, equip, floors).where("lines > 0")
    n = n.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(work).alias("name"), F.lit(unit).alias("unit"), F.col(q).alias("qty")) for k, (q, work, unit) in enumerate(R.TESTS)))))
    circuits = F.greatest(F.coalesce("circuit_count", F.lit(0)), F.lit(1)).cast("string")
    return [
        _rows(n, keys, "tests", a=1, c=F.col("k"), name=F.col("name"), unit=F.col("unit"), qty=F.col("qty").cast("string")),
        _rows(panels, keys, "tests", a=2, c=F.col("seq"), name=filled(R.PANEL_TEST, F.col("name")), unit="шт", qty=F.when(F.coalesce("breaker", F.lit("")) != "", F.concat(circuits, F.lit("/1"))).otherwise(circuits)),
        _rows(panels.groupBy(*keys).agg(F.count("*").alias("n")), keys, "tests", a=3, name=R.LIGHTING_TEST, unit="шт", qty=F.col("n").cast("string")),
    ]


def section_bill(items: DataFrame, cables: DataFrame, panels: DataFrame, derived: DataFrame, shares: DataFrame | None = None, keys: Keys = ("project",), floors: int = 1) -> DataFrame:
    """The whole bill of each project: (keys, place, level, number, name, unit, qty, formula), level 'section', 'work' or 'material'.

    ``items``: (keys, seq, kind, name, unit, height, qty), kinds luminaire, indicator and pictogram by height class; spec_panel,
    switch, socket, outlet, material, spec_cable, tray (metres by height), tray_item, pvc, grounding and lightning.
    ``cables``: (keys, seq, cable_type, count, total_length_m, laying), laying an array of (method, m). ``panels``: (keys, seq, name,
    breaker, circuit_count, has_feed). ``derived``: (keys, what, size, qty), what as in ``DERIVED_ROWS``, conduit and holders by
    size (diameter). ``shares``: (keys, height, length_m) of the plans' cables, by which lengths are dealt to heights.

    Items of equal kind, name and unit count as one, at the first's place. Specified panels that a drawn one's name holds (or is
    held by), specified cables that hold a drawn type, derived boxes and sleeves of projects that list their own are left out.
    Rows with a null key or name fall away, null quantities are 0, an unknown height has no light rows. ``seq`` orders the rows.
    """
    known = reduce(lambda c, k: c & F.col(k).isNotNull(), keys, F.lit(True))
    items = items.where(known & F.col("name").isNotNull() | known & (F.col("kind") == "tray")).withColumns({"qty": F.coalesce(F.col("qty").cast("double"), F.lit(0.0)), "unit": F.coalesce("unit", F.lit("шт"))})
    cables = cables.where(known & F.col("cable_type").isNotNull()).na.fill(0, ["count", "total_length_m"])
    # written once: every section reads its own kinds
    items, cables = stored(items, "items"), stored(once(stored(cables, "cables"), "cable_type", at=cable_attrs(F.col("cable_type"))), "cables")
    panels, derived = panels.where(known & F.col("name").isNotNull()), derived.where(known).na.fill(0, ["qty"])
    projects = items.select(*keys).unionByName(cables.select(*keys)).unionByName(panels.select(*keys)).unionByName(derived.select(*keys)).distinct()
    projects = stored(projects, "projects")
    heights = stored(_shares(projects, shares, keys), "heights")
    having = lambda kind, pattern="": items.where((F.col("kind") == kind) & F.lower("name").rlike(pattern)).select(*keys).distinct()

    one = items.where(F.col("kind").isin(*(w[0] for w in R.ITEM_WORKS))).groupBy(*keys, "kind", "name", "unit").agg(F.min("seq").alias("seq"), F.sum("qty").alias("qty"))
    one = stored(one.where(~F.col("kind").isin("socket", "outlet") | (F.col("qty") > 0)), "single")
    bare = lambda c: F.regexp_replace(c, "[- ]", "")
    spec = not_in_plan(one.where("kind = 'spec_panel'").withColumns({"_full": F.col("name"), "name": bare("name")}), panels.withColumn("name", bare("name")), keys, both_ways=True).withColumn("name", F.col("_full")).drop("_full")
    lower = lambda df, c: df.select(*keys, F.lower(c).alias("_n")).distinct()
    drawn = _inside(lower(cables, "cable_type"), lower(one.where("kind = 'spec_cable'"), "name"), keys).select(*keys, F.col("large").alias("_low")).distinct()
    extra = one.where("kind = 'spec_cable'").withColumn("_low", F.lower("name")).join(drawn, [*keys, "_low"], "left_anti").drop("_low")
    with_cables = cables.select(*keys).distinct().withColumn("_drawn", F.lit(True))
    one = one.where("kind not in ('spec_panel', 'spec_cable')").unionByName(stored(spec, "spec")).unionByName(stored(extra, "spec")).join(with_cables, list(keys), "left")
    section, name = _of(F.col("kind"), {w[0]: w[1] for w in R.ITEM_WORKS}), F.col("name")
    before, after = (_of(F.col("kind"), {w[0]: w[3].split("{}")[i] for w in R.ITEM_WORKS}) for i in (0, 1))
    head = F.when((F.col("kind") == "spec_cable") & F.col("_drawn").isNull(), R.SPEC_CABLES_ONLY).otherwise(_of(section, HEAD))
    parts = [_rows(one, keys, section, head=head, a=_of(F.col("kind"), {w[0]: w[2] for w in R.ITEM_WORKS}), c=F.col("seq"), name=F.concat(before, name, after), unit=F.col("unit"), qty=shown(F.col("qty")))]
    parts.append(_rows(panels, keys, "panels", a=1, c=F.col("seq"), name=filled(R.PANEL_WORK, name), unit="шт", qty="1"))

    d = derived.where((F.col("qty") > 0) & F.col("what").isin(*(r[0] for r in R.DERIVED_ROWS))).groupBy(*keys, "what").agg(F.sum("qty").alias("qty"))
    what = F.col("what")
    with_panels = panels.select(*keys).unionByName(having("spec_panel")).distinct()
    d = d.where("what <> 'connections'").unionByName(d.where("what = 'connections'").join(with_panels, list(keys), "left_semi"))
    boxes, sleeves = what.startswith("boxes_"), what.isin("sleeves", "shrink")
    d = d.where(~boxes & ~sleeves).unionByName(d.where(boxes).join(having("switch", R.OWN_BOXES), list(keys), "left_anti")).unionByName(d.where(sleeves).join(having("material", R.OWN_SLEEVES), list(keys), "left_anti"))
    group = d.select(*keys, "what").where(what.isin(*(h[0] for h in R.DERIVED_HEADS)))
    of = lambda i, rows: _of(what, {r[0]: r[i] for r in rows})
    led = _of(what, {"sleeves": "sleeves", "shrink": "sleeves", "foam": "steel_sleeves", "gun": "steel_sleeves", "steel_sleeves": "steel_sleeves"})
    d = d.where(led.isNull()).unionByName(d.where(led.isNotNull()).withColumn("_led", led).join(group.withColumnRenamed("what", "_led"), [*keys, "_led"], "left_semi").drop("_led"))
    parts.append(_rows(d, keys, of(1, R.DERIVED_ROWS), a=of(2, R.DERIVED_ROWS), line=of(3, R.DERIVED_ROWS), name=of(4, R.DERIVED_ROWS), unit="шт", qty=shown(F.col("qty"))))
    parts.append(_rows(group, keys, of(1, R.DERIVED_HEADS), a=of(2, R.DERIVED_HEADS), name=of(3, R.DERIVED_HEADS), unit="", qty=""))
    done = [_written(parts[:2]), _written(parts[2:])]

    trays = items.where("kind = 'tray' and qty > 0").groupBy(*keys, "height").agg(F.sum("qty").alias("qty")).withColumn("rank", _of(F.col("height"), {x: k for k, x in enumerate(LABELS)})).where("rank is not null")
    tray_items, metres = items.where("kind = 'tray_item'"), F.col("unit").isin(*R.METRES)
    done.append(_written([
        _rows(trays, keys, "trays", a=1, b=F.col("rank"), name=filled(R.TRAY_WORK, F.col("height")), unit="м", qty=shown(F.col("qty"))),
        _rows(tray_items, keys, "trays", a=F.when(metres, 2).otherwise(3), c=F.when(metres, F.col("seq")), line=F.when(metres, 0).otherwise(1), e=F.when(metres, 0).otherwise(F.col("seq")), name=name, unit=F.col("unit"), qty=shown(F.col("qty"))),
        _rows(tray_accessories(trays.join(tray_items.where(~metres), list(keys), "left_anti"), keys), keys, "trays", a=4, line=F.col("line"), name=name, unit="шт", qty=F.col("qty").cast("string")),
    ]))
    done.append(_written(_lights(items, keys, items.where("kind = 'indicator' and qty > 0").select(*keys).distinct())))
    done += [_written([rows]) for rows in _cable_rows(cables, heights, keys)]
    done.append(_written(_conduit(items, derived, cables, heights, projects, keys)))
    done.append(_written(_grounding(items, projects, keys)))
    done.append(_written(_tests(items, panels, cables, keys, floors)))

    body = reduce(DataFrame.unionByName, done)
    always = projects.select(*keys, F.explode(F.array(*map(F.lit, R.ALWAYS))).alias("s")).select(*keys, _of(F.col("s"), PART).alias("part"), F.lit(0).cast("long").alias("_g"), _of(F.col("s"), HEAD).alias("head"))
    sub = F.when(F.col("part") == PART["cables"], F.col("sub")).otherwise(0)
    heads = body.where("head is not null").select(*keys, "part", sub.alias("_g"), "head").unionByName(always).distinct()
    heads = stored(_rows(heads, keys, "tests", part=F.col("part"), sub=F.col("_g"), a=-1, line=-1, head=F.col("head"), name=F.col("head")), "heads")  # small, and ranges read their rows twice
    out = place_rows(body.unionByName(heads).drop("head"), keys, [*PLACE, "name"], F.col("line") == 0, keep=[*keys, "line", "name", "unit", "qty", "formula"])
    level = F.when(F.col("line") < 0, "section").when(F.col("line") == 0, "work").otherwise("material")
    return out.select(*keys, "place", level.alias("level"), "number", "name", "unit", "qty", "formula")
