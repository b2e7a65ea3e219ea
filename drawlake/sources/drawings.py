"""Reading drawings, entity tables and bills; writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entity tables of a project folder, as ``read_entities`` looks for them.
TABLES = ("files", "texts", "inserts", "circles", "cells", "layouts", "pages", "words", "segments", "chars", "rects", "legend_items", "detections", "equipment", "cables", "spec_items", "reference_bill", "generated_bill")


def file_inventory(spark: SparkSession, root: str, exts: Sequence[str] = ("dxf", "dwg", "pdf")) -> DataFrame:
    """(path, stem, ext, section, size): files below ``root`` with these extensions, the first path of each stem in small letters.

    Parts of the path that start with a dot, or with an underscore but for ``_converted_dxf``, are passed over. The
    contents are not read.
    """
    # Spark's listing passes over names that start with an underscore, so the folders of converted files are named
    paths, hadoop = [root], spark._jvm.org.apache.hadoop.fs
    for below in (f"{root.rstrip('/')}/_converted_dxf", f"{root.rstrip('/')}/*/_converted_dxf"):
        pattern = hadoop.Path(below)
        if pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
            paths.append(below)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("size"))
    tail = F.substring(F.col("path"), F.lit(1), F.length("path"))
    parts = F.split(F.regexp_replace(tail, "^[a-z]+:/*", ""), "/")
    base = F.length(F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/")))
    below = F.filter(F.split(F.substring(F.regexp_replace(tail, "^[a-z]+:/*", ""), base + 2, F.length("path")), "/"), lambda p: p != "")
    name = F.element_at(parts, -1)
    out = files.withColumns({"below": below, "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "stem": F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))})
    out = out.where(F.col("ext").isin(*exts) & ~F.exists("below", lambda p: p.startswith(".") | (p.startswith("_") & (p != "_converted_dxf"))))
    out = out.withColumn("section", F.when(F.size("below") > 1, F.element_at("below", 1)))
    return out.withColumn("_p", F.row_number().over(Window.partitionBy("stem").orderBy("path"))).where("_p = 1").select("path", "stem", "ext", "section", "size")


def dxf_entities(lines: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """(keys, section, entity, kind, layer, text, x, y) from a drawing's lines (keys, line_no from 0, line).

    Lines pair up as code and value. Code 0 starts an entity; chunks of codes 3 and 1 join in order to its text; the last
    10 and 20 are its place; sections run from 2/NAME to 0/ENDSEC. Entities without text or place fall away.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    pair = lines.withColumn("value", F.lead("line").over(w)).where("line_no % 2 = 0").select(*keys, "line_no", F.trim("line").alias("code"), "value")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    named = (F.col("code") == "2") & (F.lag("value").over(w) == "SECTION") & (F.lag("code").over(w) == "0")
    ended = (F.col("code") == "0") & (F.col("value") == "ENDSEC")
    pair = pair.withColumn("_s", F.when(named, F.col("value")).when(ended, ""))
    pair = pair.withColumn("section", F.last("_s", ignorenulls=True).over(upto)).withColumn("entity", F.sum(F.when(F.col("code") == "0", 1).otherwise(0)).over(upto))
    chunks = F.sort_array(F.collect_list(F.when(F.col("code").isin("1", "3"), F.struct("line_no", "value"))))
    at = lambda code: F.max_by("value", F.when(F.col("code") == code, F.col("line_no"))).try_cast("double")
    out = pair.where("section <> ''").groupBy(*keys, "section", "entity").agg(
        F.max(F.when(F.col("code") == "0", F.col("value"))).alias("kind"), F.max_by("value", F.when(F.col("code") == "8", F.col("line_no"))).alias("layer"),
        F.array_join(F.transform(chunks, lambda s: s["value"]), "").alias("text"), at("10").alias("x"), at("20").alias("y"),
    )
    return out.where("text <> '' and x is not null and y is not null")


def read_dxf_entities(spark: SparkSession, path: str) -> DataFrame:
    """Text entities of ASCII drawings; file_id is the path. A drawing's lines are split inside Spark."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_id"), "value")
    lines = whole.select("file_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return dxf_entities(lines)


def section_fallback(entities: DataFrame, measured: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Entities of the section ENTITIES; those of BLOCKS only for files where ``measured`` (keys, total_length_m) has no metres."""
    some = measured.where("total_length_m > 0").select(*keys).distinct()
    main = entities.where("section = 'ENTITIES'")
    blocks = entities.where("section = 'BLOCKS'").join(some, list(keys), "left_anti")
    return main.unionByName(blocks)


def read_entities(spark: SparkSession, folder: str, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The entity tables of a folder by name; those that aren't there are left out."""
    out = {}
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
    return out


def table_cells(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of table blocks, texts of other blocks); model and paper space belong to neither."""
    block = F.coalesce("block_name", F.lit(""))
    cells = texts.where(block.startswith("*T"))
    other = texts.where((block != "") & ~block.startswith("*T") & ~F.upper(block).rlike(r"^\*(MODEL|PAPER)_SPACE"))
    return cells, other


def quantity(c: Column) -> Column:
    """The number that a quantity text holds: itself, or the first one in it, with a decimal comma or point."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(plain, F.replace(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double"))


def reference_bill(rows: DataFrame) -> DataFrame:
    """Bill rows (case, row_num, name, unit, qty text): no empty names; a name with neither number nor quantity heads a
    section and stays as such; other rows need a quantity above 0."""
    r = rows.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("name", F.trim("name"))
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    r = r.withColumns({"is_section": empty("row_num") & empty("qty"), "qty": quantity(F.col("qty"))})
    return r.where(F.col("is_section") | (F.col("qty") > 0))


def bill_from_lines(lines: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """(keys, name, qty) from lines in which a name, the line 'шт' and a number follow one another; a match uses up its lines."""
    w = Window.partitionBy(*keys).orderBy("seq")
    t = lines.select(*keys, "seq", F.trim("text").alias("name"), F.lower(F.trim(F.lead("text", 1).over(w))).alias("u"), F.trim(F.lead("text", 2).over(w)).alias("q"), F.row_number().over(w).alias("n"))
    hit = t.where(F.col("u").isin("шт", "шт.") & F.col("q").rlike("^[0-9]+$") & (F.col("name") != ""))
    # matches that start two lines apart share a line: of such a chain every other one holds
    hit = hit.withColumn("_from", F.when(F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)) != 2, F.col("n")))
    hit = hit.withColumn("_from", F.max("_from").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("(n - _from) % 4 = 0")
    return hit.select(*keys, "seq", "name", F.col("q").cast("int").alias("qty"))


def write_csv(df: DataFrame, path: str) -> None:
    """symbol, name, count, count_ae and total, with semicolons and a header."""
    df.select("symbol", "name", "count", "count_ae", (F.col("count") + F.col("count_ae")).alias("total")).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def report(equip: DataFrame, cables: DataFrame, key: str = "file_id") -> DataFrame:
    """A row for each file: its equipment and cables, nested, and their totals."""
    e = equip.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("symbol", "name", "count", "count_ae"))).alias("equipment"), F.sum(F.col("count") + F.col("count_ae")).alias("n_equipment"))
    c = cables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cable_type", "count", "total_length_m"))).alias("cables"), F.sum("total_length_m").alias("cable_m"))
    return e.join(c, key, "full_outer")


def report_totals(reports: DataFrame) -> DataFrame:
    """One row: files, equipment and cable metres of all reports."""
    return reports.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_equipment"), F.lit(0)).cast("long").alias("n_equipment"), F.coalesce(F.sum("cable_m"), F.lit(0)).cast("long").alias("cable_m"))


def report_json(equip: DataFrame, cables: DataFrame, key: str = "file_id") -> DataFrame:
    """The report as one JSON text a file."""
    r = report(equip, cables, key)
    return r.select(key, F.to_json(F.struct(*r.columns)).alias("json"))
