"""Registered queries: each operator bound to the given tables, and the SQL that states the same rows.

Tables are read as drawings: line items as points of a sheet (a supplier), as cables and as equipment; orders as
files; embeddings as detections; documents as running text; conversations as lines in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions import cables as C
from drawlake.functions import rules as R
from drawlake.functions import text as T
from drawlake.operators import compare, counting, iterative, rollup, schedules, sequences, spatial
from drawlake.operators.graph import dealt, once, shared_dir
from drawlake.sources import drawings
from drawlake.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Expressions that Spark and the oracle's SQL read alike.
POINT = "l_suppkey AS sheet, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_quantity * 100 AS x, l_extendedprice / 10 AS y, l_returnflag AS symbol"
ZONE = "s_suppkey AS sheet, s_suppkey AS seq, 'zone' AS zone, (s_suppkey % 10) * 300.0 AS x0, (s_suppkey % 7) * 500.0 AS y0, (s_suppkey % 10) * 300.0 + 900.0 AS x1, (s_suppkey % 7) * 500.0 + 2500.0 AS y1"
#: A Cyrillic equipment name from a part's type and name.
NAME = "concat(CASE p_size % 8 WHEN 0 THEN 'Светильник ' WHEN 1 THEN 'Розетка ' WHEN 2 THEN 'Выключатель ' WHEN 3 THEN 'Щит ЩО' WHEN 4 THEN 'Световой указатель ' WHEN 5 THEN 'Кабель ' WHEN 6 THEN 'Коробка распределительная ' ELSE 'Датчик ' END, p_name)"
#: A cable text from a line item and its part.
CABLE = "concat(CASE p_size % 3 WHEN 0 THEN 'ВВГнг(А)-LS ' WHEN 1 THEN 'ППГнг(А)-HF ' ELSE 'ПуВВнг ' END, cast(p_size % 4 + 2 AS VARCHAR(9)), 'х', CASE p_size % 5 WHEN 0 THEN '1,5' WHEN 1 THEN '2,5' WHEN 2 THEN '4' WHEN 3 THEN '6' ELSE '10' END, CASE l_linenumber % 3 WHEN 0 THEN ' в гофре' WHEN 1 THEN ' в гофре, в лотке' ELSE '' END, ' L=', cast(cast(l_quantity AS INT) AS VARCHAR(9)), 'м')"
EQUIPMENT = f"{NAME} AS name, p_size * 0.7 AS elevation, l_returnflag AS plan_type, cast(l_quantity AS INT) AS count, l_suppkey AS project, l_orderkey AS file_id, l_linenumber AS seq"
DET = "vec_id AS det_id, vec_id % 10 AS page, label AS symbol_index, CAST(embedding[{a}] AS DOUBLE) * 1000 AS cx, CAST(embedding[{b}] AS DOUBLE) * 1000 AS cy, 20.0 AS w, 20.0 AS h, abs(CAST(embedding[{c}] AS DOUBLE)) AS confidence"
JOINED = "lineitem JOIN part ON l_partkey = p_partkey"


def points(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr(*_split(POINT))


def zones(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr(*_split(ZONE))


def detections(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").selectExpr(*_split(DET.format(a=0, b=1, c=2)))


def items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def equipment(spark, sf_dir):
    return items(spark, sf_dir).selectExpr(*_split(EQUIPMENT))


def cable_texts(spark, sf_dir):
    return items(spark, sf_dir).selectExpr("l_suppkey AS project", "l_orderkey AS file_id", f"{CABLE} AS text")


def _split(columns: str) -> list[str]:
    """Top-level commas part the columns."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        if not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(columns[at:i])
                at = i + 1
    return [x.strip() for x in [*out, columns[at:]]]


P = f"(SELECT {POINT} FROM lineitem)"
Z = f"(SELECT {ZONE} FROM supplier)"
D = f"(SELECT {DET.format(a=1, b=2, c=3)} FROM embeddings)"
E = f"(SELECT {EQUIPMENT} FROM {JOINED})"
X = f"(SELECT l_suppkey AS project, l_orderkey AS file_id, {CABLE} AS text FROM {JOINED})"
HEIGHT = "CASE WHEN elevation < 5 THEN 'до 5 метров' WHEN elevation < 13 THEN 'от 5 до 13 метров' WHEN elevation < 20 THEN 'от 13 до 20 метров' ELSE 'от 20 до 35 метров' END"


def rules_sql(column: str, rules: R.Rules, otherwise: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules)
    return f"CASE {arms} ELSE '{otherwise}' END"


CLASS = f"CASE WHEN {' OR '.join(f'''contains(lower(name), '{w}')''' for w in R.NON_EQUIPMENT)} THEN 'skip' ELSE {rules_sql('name', R.EQUIPMENT[1:], 'luminaire')} END"
PLAIN = "trim(regexp_replace(regexp_replace(trim(name), '^(?:Светодиодный светильник |Светильник |Световые указатели |Световой указатель )', ''), '\\s+', ' ', 'g'))"

# --- column functions -----------------------------------------------------------------------------------------


@query(f"SELECT name, {PLAIN} AS plain, {CLASS} AS category, {rules_sql('name', R.SPECIFICATION[:5], 'x')} AS upper_class, count(*) AS n FROM {E} GROUP BY ALL")
def b8_classify(spark, sf_dir):
    n = F.col("name")
    e = equipment(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return e.select("name", T.normalize_name(n).alias("plain"), T.classify_equipment(n).alias("category"), T.first_of(n, R.SPECIFICATION[:5], "x").alias("upper_class"), "n")


@query(f"SELECT name, CASE WHEN name LIKE 'Коробка распред%' THEN 'junction_box' WHEN name LIKE 'Светильник%' THEN 'luminaire' WHEN name LIKE 'Розетка%' THEN 'socket' WHEN name LIKE 'Выключатель%' THEN 'switch' WHEN name LIKE 'Щит%' THEN 'panel' WHEN name LIKE 'Кабель%' THEN 'cable' WHEN name LIKE 'Датчик%' THEN 'sensor' ELSE 'other' END AS category, CASE WHEN name LIKE 'Щит%' THEN 'комп' WHEN name LIKE 'Кабель%' THEN 'м' ELSE 'шт' END AS unit, count(*) AS n FROM {E} GROUP BY ALL")
def b9_map_work(spark, sf_dir):
    w = T.map_work(F.col("name"))
    return equipment(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).select("name", w["category"].alias("category"), w["unit"].alias("unit"), "n")


@query(f"SELECT elevation, {HEIGHT} AS height, count(*) AS n FROM {E} GROUP BY ALL")
def b6_height_category(spark, sf_dir):
    return equipment(spark, sf_dir).select("elevation", T.height_category(F.col("elevation")).alias("height")).groupBy("elevation", "height").agg(F.count("*").alias("n"))


@query(f"""SELECT text, replace(regexp_extract(text, '^(.*[0-9]х[0-9,]+)', 1), 'х', '×') AS type, cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT) AS length_m, regexp_extract(text, '(в гофре(, в лотке)?)', 1) AS suffix, count(*) AS n FROM {X} GROUP BY ALL""")
def b11_parse_cable(spark, sf_dir):
    c = C.parse_cable(F.col("text"))
    n = cable_texts(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n"))
    return n.select("text", c["type"].alias("type"), c["length_m"].alias("length_m"), C.cable_suffix(F.col("text")).alias("suffix"), "n")


_SEC = "CAST(replace(regexp_extract(text, 'х([0-9,]+)', 1), ',', '.') AS DOUBLE)"
_COR = "CAST(regexp_extract(text, '([0-9]+)х', 1) AS INT)"


@query(f"SELECT text, {_COR} AS cores, {_SEC} AS section, {_COR} * {_SEC} AS total_section, CASE WHEN {_SEC} <= 1.5 THEN 16 WHEN {_SEC} <= 2.5 THEN 20 WHEN {_SEC} <= 6 THEN 25 ELSE 32 END AS conduit_mm, starts_with(text, 'ПуВВ') AS is_wire, concat('суммарное сечение до ', CASE WHEN {_COR} * {_SEC} <= 6 THEN 6 WHEN {_COR} * {_SEC} <= 16 THEN 16 WHEN {_COR} * {_SEC} <= 35 THEN 35 ELSE 70 END, ' мм2') AS section_class, count(*) AS n FROM {X} GROUP BY ALL")
def b14_cable_attrs(spark, sf_dir):
    a = C.cable_attrs(F.col("text"))
    cols = ["cores", "section", "total_section", "conduit_mm", "is_wire", "section_class"]
    n = cable_texts(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n"))
    return n.select("text", *[a[c].alias(c) for c in cols], "n")


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) / greatest(len(a), len(b)) AS overlap FROM t""")
def b21_token_overlap(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.token_overlap(F.col("p_name"), F.col("p_type")).alias("overlap"))


@query("SELECT doc_id, reverse(text) AS reversed FROM documents")
def b22_reverse_words(spark, sf_dir):
    return T.reverse_words(read(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("reversed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 4, 0) AS halves, CAST(ceil(l_quantity / 0.8) AS BIGINT) AS holders, round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 6) AS length FROM lineitem")
def b24_rounding(spark, sf_dir):
    from drawlake.functions import geometry as G

    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.half_even(q / 4).alias("halves"), G.holders(q).alias("holders"), F.round(G.segment_length(F.lit(0.0), F.lit(0.0), q, n), 6).alias("length"))


# --- points and zones -----------------------------------------------------------------------------------------


@query(f"SELECT p.* FROM {P} p WHERE NOT EXISTS (SELECT 1 FROM {Z} z WHERE z.sheet = p.sheet AND p.x > z.x0 AND p.x < z.x1 AND p.y > z.y0 AND p.y < z.y1)")
def c2_exclude_zones(spark, sf_dir):
    return spatial.exclude_zones(points(spark, sf_dir), zones(spark, sf_dir), ["sheet"])


@query(f"SELECT p.sheet, p.seq, z.zone FROM {P} p LEFT JOIN {Z} z ON z.sheet = p.sheet AND p.x BETWEEN z.x0 - 2 AND z.x1 + 2 AND p.y BETWEEN z.y0 - 2 AND z.y1 + 2")
def c2_zone_of(spark, sf_dir):
    return spatial.zone_of(points(spark, sf_dir), zones(spark, sf_dir), ["sheet"]).select("sheet", "seq", "zone")


@query(f"SELECT a.sheet, a.seq, count(*) AS n FROM {P} a JOIN {P} b ON a.sheet = b.sheet AND a.seq <> b.seq AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300 GROUP BY ALL")
def c8_neighbour_counts(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.neighbour_counts(p, p, ["sheet"], 300.0)


@query(f"SELECT a.sheet, a.seq FROM {P} a WHERE (SELECT count(*) FROM {P} b WHERE a.sheet = b.sheet AND a.seq <> b.seq AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300) < 3")
def c8_reject_dense(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.reject_dense(p, p, ["sheet"], 300.0, 3).select("sheet", "seq")


@query(f"""SELECT sheet, seq, nearest, round(dist, 6) AS dist FROM (SELECT a.sheet, a.seq, b.seq AS nearest, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
row_number() OVER (PARTITION BY a.sheet, a.seq ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.seq) AS r FROM {P} a JOIN {P} b ON a.sheet = b.sheet AND a.symbol = 'A' AND b.symbol = 'R' AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 500) WHERE r = 1""")
def d2_nearest_within(spark, sf_dir):
    p = points(spark, sf_dir)
    n = spatial.nearest(p.where("symbol = 'A'"), p.where("symbol = 'R'"), ["sheet"], 500.0)
    return n.select("sheet", F.col("l_seq").alias("seq"), F.col("r_seq").alias("nearest"), F.round("dist", 6).alias("dist"))


@query(f"""SELECT sheet, seq, breaker FROM (SELECT a.sheet, a.seq, b.seq AS breaker, row_number() OVER (PARTITION BY a.sheet, a.seq ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.seq) AS r FROM {P} a JOIN (SELECT sheet, min(seq) AS seq, x, min(y) AS y FROM {P} WHERE symbol = 'N' GROUP BY sheet, x) b ON a.sheet = b.sheet WHERE a.symbol = 'A') WHERE r = 1""")
def d3_nearest_l1(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.where("symbol = 'N'").groupBy("sheet", "x").agg(F.min("seq").alias("seq"), F.min("y").alias("y"))
    return spatial.nearest(p.where("symbol = 'A'"), b, ["sheet"], metric="l1").select("sheet", F.col("l_seq").alias("seq"), F.col("r_seq").alias("breaker"))


@query(f"""WITH g AS (SELECT s_nationkey AS file_id, s_suppkey AS seq, s_acctbal AS x FROM supplier),
s AS (SELECT file_id, row_number() OVER w AS sheet_no, coalesce((x + lag(x) OVER w) / 2, x - 40000) AS x_left, coalesce((x + lead(x) OVER w) / 2, x + 40000) AS x_right FROM g WINDOW w AS (PARTITION BY file_id ORDER BY x, seq))
SELECT c_custkey, min(sheet_no) AS sheet_no FROM customer LEFT JOIN s ON c_nationkey = file_id AND c_acctbal BETWEEN x_left AND x_right GROUP BY c_custkey""")
def d4_sheets(spark, sf_dir):
    s = spatial.sheets(read(spark, sf_dir, "supplier").selectExpr("s_nationkey AS file_id", "s_suppkey AS seq", "s_acctbal AS x"))
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS file_id", "c_acctbal AS x")
    return spatial.assign_sheet(c, s).select("c_custkey", "sheet_no")


@query(f"SELECT sheet, seq, symbol FROM {P} WHERE symbol = 'A' UNION ALL SELECT b.sheet, b.seq, b.symbol FROM {P} b WHERE b.symbol = 'R' AND NOT EXISTS (SELECT 1 FROM {P} a WHERE a.symbol = 'A' AND a.sheet = b.sheet AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150)")
def d18_union_positions(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.union_positions(p.where("symbol = 'A'"), p.where("symbol = 'R'"), ["sheet"], 150.0).select("sheet", "seq", "symbol")


@query()
def d1_greedy_match(spark, sf_dir):
    p = points(spark, sf_dir)
    pairs = spatial.near_pairs(p.where("symbol = 'A'"), p.where("symbol = 'R'"), ["sheet"], 200.0)
    return iterative.greedy_match(pairs.select("sheet", "l_seq", "r_seq", "dist"), ["sheet"], "l_seq", "r_seq", "dist")


@query()
def g4_dedup_points(spark, sf_dir):
    return iterative.dedup_points(points(spark, sf_dir), ["sheet"], 150.0)


@query()
def g1_routes(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file_id", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq", "l_linestatus AS color", "l_quantity * 10 AS x0", "l_linenumber * 100.0 AS y0", "l_quantity * 10 + l_discount * 200 AS x1", "l_linenumber * 100.0 + l_tax * 1000 AS y1")
    return iterative.routes(s, ("file_id", "color")).drop("route")  # an id made of hashes


# --- detections -----------------------------------------------------------------------------------------------


@query(f"SELECT page, symbol_index, greatest(0.30, least(0.62, greatest(0.32, quantile_cont(confidence, 0.97), quantile_cont(confidence, 0.99) - 0.015))) AS threshold FROM {D} GROUP BY ALL")
def e32_adaptive_threshold(spark, sf_dir):
    return iterative.adaptive_threshold(detections(spark, sf_dir), ["page", "symbol_index"])


@query(f"SELECT det_id, page, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, det_id) AS r FROM {D}) WHERE r <= 80")
def f11_top_k(spark, sf_dir):
    return sequences.top_k(detections(spark, sf_dir), ["page"], [F.desc("confidence"), F.col("det_id")], 80).select("det_id", "page", "confidence")


@query(f"SELECT det_id, page FROM (SELECT *, row_number() OVER (PARTITION BY page, floor(cx / 120), floor(cy / 120) ORDER BY confidence DESC, det_id) AS r FROM {D}) WHERE r = 1")
def f11_best_per_cell(spark, sf_dir):
    return sequences.best_per_cell(detections(spark, sf_dir), ["page"]).select("det_id", "page")


@query()
def g2_nms(spark, sf_dir):
    return iterative.nms(detections(spark, sf_dir), ["page"])


@query()
def g3_cross_nms(spark, sf_dir):
    return iterative.cross_nms(detections(spark, sf_dir), ["page"])


@query()
def g6_detect_counts(spark, sf_dir):
    z = read(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS BIGINT) AS page", "-100.0 AS x0", "-100.0 AS y0", "50.0 AS x1", "50.0 AS y1")
    return iterative.detect_counts(detections(spark, sf_dir), z, ("page",))


def _page_words(spark, sf_dir):
    """Parts as words of the detections' pages, and the sizes that hint at each class."""
    words = read(spark, sf_dir, "part").selectExpr("p_partkey % 10 AS page", "concat('s', p_size % 12) AS text", "p_retailprice - 1400 AS x0", "(p_partkey % 97 - 48) * 20.0D AS top")
    return words, read(spark, sf_dir, "embeddings").select("label").distinct().selectExpr("label", "concat('s', label) AS token")


@query()
def g5_disambiguate(spark, sf_dir):
    words, hints = _page_words(spark, sf_dir)
    return iterative.disambiguate(detections(spark, sf_dir), words, hints, ["page"], cluster=100.0, reach=200.0)


@query()
def g6_detection_stages(spark, sf_dir):
    det = detections(spark, sf_dir).withColumns({"over_text": F.col("det_id") % 11 == 0, "bad_shape": F.col("det_id") % 13 == 0, "color": F.element_at(F.array(F.lit(""), F.lit("red"), F.lit("blue")), (F.col("det_id") % 3 + 1).cast("int"))})
    classes = det.select("symbol_index").distinct().selectExpr("symbol_index", "symbol_index % 2 = 0 AS one_letter", "CASE symbol_index % 3 WHEN 0 THEN 'red' ELSE '' END AS color")
    z = read(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS BIGINT) AS page", "-100.0D AS x0", "-100.0D AS y0", "50.0D AS x1", "50.0D AS y1")
    words, hints = _page_words(spark, sf_dir)
    return iterative.detection_stages(det, z, classes, words, hints, keys=("page",))[0]


# --- ordered rows ---------------------------------------------------------------------------------------------


@query(f"SELECT sheet, seq, CAST(sum(s) OVER (PARTITION BY sheet ORDER BY y, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY sheet ORDER BY y, seq) > 50 THEN 1 ELSE 0 END AS s FROM {P})")
def f1_cluster_by_gap(spark, sf_dir):
    return sequences.cluster_by_gap(points(spark, sf_dir), ["sheet"], "y", 50.0).select("sheet", "seq", "cluster")


@query()
def f2_cluster_by_anchor(spark, sf_dir):
    return sequences.cluster_by_anchor(points(spark, sf_dir), ["sheet"], "y", 200.0).select("sheet", "seq", "cluster")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS back FROM conversations""")
def f4_pair_lookback(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("asked", F.expr("CASE WHEN role = 'user' THEN text END"))
    return sequences.pair_lookback(c, ["conv_id"], "asked", ["turn"]).select("conv_id", "turn", "back")


@query(f"SELECT sheet, y AS median FROM (SELECT sheet, y, row_number() OVER (PARTITION BY sheet ORDER BY y) AS r, count(*) OVER (PARTITION BY sheet) AS n FROM {P}) WHERE r = n // 2 + 1")
def f13_upper_median(spark, sf_dir):
    return sequences.upper_median(points(spark, sf_dir), ["sheet"], "y")


@query("SELECT p_name, count(*) AS total FROM part GROUP BY 1 ORDER BY total DESC, p_name LIMIT 10")
def f12_top_n(spark, sf_dir):
    return sequences.top_n(read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("total")), [F.desc("total"), F.col("p_name")], 10)


@query(f"""WITH rows_at AS (SELECT DISTINCT sheet, x AS y FROM {P} WHERE symbol = 'N'), spans AS (SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY y) - 1 AS row, y - 3 AS lo, lead(y) OVER (PARTITION BY sheet ORDER BY y) - 3 AS hi FROM rows_at)
SELECT p.sheet, p.seq, CAST(s.row AS INT) AS row FROM {P} p JOIN spans s ON p.sheet = s.sheet AND (s.row = 0 OR p.x >= lo) AND (hi IS NULL OR p.x < hi)""")
def d16_assign_rows(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = p.where("symbol = 'N'").select("sheet", F.col("x").alias("y"))
    return sequences.assign_rows(p.withColumn("top", F.col("x")), rows, ["sheet"]).select("sheet", "seq", "row")


# --- counting -------------------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT DISTINCT sheet, symbol FROM {P}), f AS (SELECT p.* FROM {P} p WHERE NOT EXISTS (SELECT 1 FROM {Z} z WHERE z.sheet = p.sheet AND p.x > z.x0 AND p.x < z.x1 AND p.y > z.y0 AND p.y < z.y1))
SELECT l.sheet, l.symbol, count(f.seq) AS count, 0 AS count_ae FROM l LEFT JOIN f ON l.sheet = f.sheet AND l.symbol = f.symbol GROUP BY ALL""")
def e1_count_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    return counting.count_labels(p.withColumn("text", F.col("symbol")).drop("symbol"), p.select("sheet", "symbol").distinct(), zones(spark, sf_dir), keys=("sheet",))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(line, E' \\n\\t\\r'), '\\s+')) AS symbol FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '[0-9]{6,}'))
SELECT doc_id, symbol, count(*) AS count FROM w WHERE symbol IN ('the', 'of', 'and', 'la', 'der') GROUP BY ALL""")
def e2_count_tokens(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    symbols = spark.createDataFrame([(s,) for s in ("the", "of", "and", "la", "der")], "symbol string")
    return counting.count_tokens(lines, symbols, ("doc_id",))


@query(f"""SELECT project, type, count(*) AS count, sum(length_m)::BIGINT AS total_length_m FROM (SELECT DISTINCT project, replace(regexp_extract(text, '^(.*[0-9]х[0-9,]+)', 1), 'х', '×') AS type, cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT) AS length_m, regexp_extract(text, '(в гофре(, в лотке)?)', 1) AS suffix FROM {X}) GROUP BY ALL""")
def e6_cable_totals(spark, sf_dir):
    return counting.cable_totals(counting.cable_hits(cable_texts(spark, sf_dir), ("project",)), ("project",))


@query(f"""WITH h AS (SELECT project, replace(regexp_extract(text, '^(.*[0-9]х[0-9,]+)', 1), 'х', '×') AS type, cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT) AS m, regexp_extract(text, '(в гофре(, в лотке)?)', 1) AS lay FROM {X}),
s AS (SELECT project, type, 'в гофре' AS method, round_even(m * CASE WHEN lay = 'в гофре' THEN 1.0 ELSE 0.1 END, 0) AS m FROM h WHERE lay <> '' UNION ALL SELECT project, type, 'в лотке', round_even(m * 0.9, 0) FROM h WHERE lay = 'в гофре, в лотке')
SELECT project, type, method, sum(m)::BIGINT AS length_m FROM s WHERE m > 0 GROUP BY ALL""")
def e7_cable_by_laying(spark, sf_dir):
    return counting.cable_by_laying(counting.cable_hits(cable_texts(spark, sf_dir), ("project",)), ("project",))


@query("""WITH t AS (SELECT l_suppkey AS file_id, l_returnflag AS symbol, count(*) AS c FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), d AS (SELECT l_suppkey AS file_id, l_returnflag AS symbol, count(*) AS c FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL),
b AS (SELECT file_id, symbol, coalesce(t.c, 0) AS t, coalesce(d.c, 0) AS d FROM t FULL JOIN d USING (file_id, symbol))
SELECT file_id, symbol, CASE WHEN t = d OR d = 0 THEN t WHEN t = 0 AND d > 20 THEN 0 WHEN t = 0 THEN d WHEN d > 3 * t THEN t WHEN t > 3 * d THEN d ELSE greatest(t, d) END AS count,
CASE WHEN t = d THEN 'equal' WHEN d = 0 THEN 'text' WHEN t = 0 AND d > 20 THEN 'dropped' WHEN t = 0 THEN 'detected' WHEN d > 3 * t THEN 'text' WHEN t > 3 * d THEN 'detected' ELSE 'larger' END AS rule FROM b""")
def e37_arbitrate(spark, sf_dir):
    n = lambda where: read(spark, sf_dir, "lineitem").where(where).groupBy(F.col("l_suppkey").alias("file_id"), F.col("l_returnflag").alias("symbol")).agg(F.count("*").alias("count"))
    return counting.arbitrate(n("l_linestatus = 'F'"), n("l_linenumber < 3"), ("file_id", "symbol"))


@query("""SELECT l_suppkey AS file_id, count(DISTINCT CASE WHEN l_linenumber = 1 THEN (round(l_quantity), round(l_extendedprice / 1000)) END) AS n_red, count(DISTINCT CASE WHEN l_linenumber <> 1 THEN (round(l_quantity), round(l_extendedprice / 1000)) END) AS n_other FROM lineitem GROUP BY 1""")
def e4_count_circles(spark, sf_dir):
    return counting.count_circles(read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file_id", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_linenumber AS color"))


@query("""WITH n AS (SELECT l_suppkey AS file_id, l_returnflag AS color, count_if(l_linenumber = 1) AS line, count_if(l_linenumber = 2) AS rect, count_if(l_linenumber > 2) AS char FROM lineitem GROUP BY ALL)
SELECT *, line + rect + char AS total, row_number() OVER (PARTITION BY file_id ORDER BY line + rect + char DESC, color) AS place FROM n""")
def e26_color_palette(spark, sf_dir):
    return counting.color_palette(read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file_id", "l_returnflag AS color", "CASE l_linenumber WHEN 1 THEN 'line' WHEN 2 THEN 'rect' ELSE 'char' END AS kind"))


# --- roll-up --------------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT *, {CLASS} AS category FROM {E}), p AS (SELECT project, elevation, category, name, plan_type, sum(count) AS count FROM e GROUP BY ALL), m AS (SELECT project, elevation, category, name, max(count) AS count FROM p GROUP BY ALL)
SELECT project, {HEIGHT} AS height, category, name, sum(count)::BIGINT AS count FROM m GROUP BY ALL""")
def e10_merge_elevations(spark, sf_dir):
    parts = once(read(spark, sf_dir, "part").selectExpr("*", f"{NAME} AS name"), "name", category=T.classify_equipment(F.col("name")))
    li = read(spark, sf_dir, "lineitem")
    e = li.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr("name", "category", *_split(EQUIPMENT)[1:])
    return rollup.merge_elevations(e, rows=li.count())


@query(f"""WITH e AS (SELECT *, {CLASS} AS category FROM {E}), p AS (SELECT project, elevation, category, name, plan_type, sum(count) AS count FROM e GROUP BY ALL), m AS (SELECT project, elevation, category, name, max(count) AS count FROM p GROUP BY ALL), h AS (SELECT project, {PLAIN} AS name, category, elevation, count FROM m)
SELECT project, name, category, sum(CASE WHEN elevation < 5 THEN count ELSE 0 END)::BIGINT AS h0, sum(CASE WHEN elevation >= 5 AND elevation < 13 THEN count ELSE 0 END)::BIGINT AS h1, sum(CASE WHEN elevation >= 13 AND elevation < 20 THEN count ELSE 0 END)::BIGINT AS h2, sum(CASE WHEN elevation >= 20 THEN count ELSE 0 END)::BIGINT AS h3, sum(count)::BIGINT AS total FROM h WHERE category <> 'skip' GROUP BY ALL""")
def e11_by_height(spark, sf_dir):
    """Equipment per height class over all plans."""
    return rollup.by_height(e10_merge_elevations(spark, sf_dir), ["project"])


@query(f"""WITH c AS (SELECT project, replace(regexp_extract(text, '^(.*[0-9]х[0-9,]+)', 1), 'х', '×') AS cable_type, sum(cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT)) AS m FROM {X} GROUP BY ALL),
n AS (SELECT project, {HEIGHT} AS height, sum(count) AS count FROM {E} GROUP BY ALL),
q AS (SELECT project, height, count * CASE height WHEN 'до 5 метров' THEN 2.5 WHEN 'от 5 до 13 метров' THEN 9 WHEN 'от 13 до 20 метров' THEN 16.5 ELSE 27.5 END::DOUBLE AS w FROM n),
s AS (SELECT project, height, w / sum(w) OVER (PARTITION BY project) AS share FROM q)
SELECT project, cable_type, height, CAST(round_even(m * share, 0) AS BIGINT) AS length_m FROM c JOIN s USING (project)""")
def e13_distribute_lengths(spark, sf_dir):
    hits = counting.cable_hits(cable_texts(spark, sf_dir), ("project",))
    c = hits.groupBy("project", F.col("type").alias("cable_type")).agg(F.sum("length_m").alias("total_length_m")).withColumn("elevation", F.lit(None).cast("double"))
    e = equipment(spark, sf_dir).withColumn("height", T.height_category(F.col("elevation")))
    return rollup.distribute_lengths(c, e)


@query("""WITH l AS (SELECT l_suppkey AS project, l_returnflag AS layer, sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AS d FROM lineitem)
SELECT project, round(CASE WHEN sum(CASE WHEN layer = 'A' THEN d END) > 0 THEN sum(CASE WHEN layer = 'A' THEN d END) / 1000 ELSE coalesce(sum(CASE WHEN layer <> 'A' THEN d END), 0) / 2000 END, 4) AS tray_m FROM l GROUP BY 1""")
def e14_tray_lengths(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS project", "l_returnflag AS layer", "0.0 AS x0", "0.0 AS y0", "l_quantity AS x1", "cast(l_linenumber AS DOUBLE) AS y1")
    return rollup.tray_lengths(s, center="^A$")


@query()
def e15_apportion(spark, sf_dir):
    w = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("part_no")).agg(F.sum("l_quantity").alias("weight"))
    return rollup.apportion(w.withColumn("qty", F.lit(100) + F.col("project") % 17), ["project"], "qty", "weight", [F.col("part_no")])


@query("""WITH s AS (SELECT p_partkey, p_size AS n, p_size % 4 + 1 AS k FROM part)
SELECT p_partkey, i AS elevation, CAST(CASE WHEN i = k THEN n - (n // k) * (k - 1) ELSE n // k END AS BIGINT) AS n FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM s)""")
def e22_split_even(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS BIGINT) AS n", "sequence(1, p_size % 4 + 1) AS elevations")
    return rollup.split_even(p, count="n").select("p_partkey", "elevation", "n")


@query(f"""WITH f AS (SELECT name, project AS file_id, sum(count) AS n FROM {E} GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS total, string_agg(n::BIGINT::VARCHAR, '+' ORDER BY file_id) AS formula, string_agg(file_id::VARCHAR, ', ' ORDER BY file_id) AS refs, row_number() OVER (ORDER BY name) AS number FROM f GROUP BY name""")
def e24_rollup_bill(spark, sf_dir):
    return rollup.rollup_bill(equipment(spark, sf_dir).withColumn("file_id", F.col("project")))


@query(f"SELECT plan_type, {HEIGHT} AS height, sum(count)::BIGINT AS count, grouping(plan_type) * 2 + grouping({HEIGHT}) AS level FROM {E} GROUP BY ROLLUP (plan_type, {HEIGHT})")
def e24_grand_totals(spark, sf_dir):
    e = equipment(spark, sf_dir).withColumn("height", T.height_category(F.col("elevation")))
    return rollup.grand_totals(e, ["plan_type", "height"])


@query(f"""WITH c AS (SELECT project, {_COR} AS cores, {_SEC} AS sec, cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT) AS m FROM {X}), t AS (SELECT project, sum(cores) AS ends, count(*) AS n, sum(m) AS m FROM c GROUP BY 1),
e AS (SELECT project, sum(CASE WHEN {CLASS} IN ('luminaire', 'indicator', 'socket', 'switch') THEN count ELSE 0 END) AS points FROM {E} GROUP BY 1)
SELECT project, (ends * 2)::BIGINT AS connections, ceil(points / 3)::BIGINT AS junction_boxes, (n * 3)::BIGINT AS sleeves, (n * 2)::BIGINT AS heat_shrink, n::BIGINT AS penetrations, round_even(m * 0.9::DOUBLE, 0)::BIGINT AS conduit_m, ceil(round_even(m * 0.9::DOUBLE, 0) / 0.8::DOUBLE)::BIGINT AS holders FROM t JOIN e USING (project)""")
def e18_derive_materials(spark, sf_dir):
    hits = counting.cable_hits(cable_texts(spark, sf_dir), ("project",)).select("project", F.col("type").alias("cable_type"), F.lit(1).alias("count"), F.col("length_m").alias("total_length_m"))
    e = once(equipment(spark, sf_dir), "name", category=T.classify_equipment(F.col("name")))
    return rollup.derive_materials(hits, e)


@query(f"""WITH c AS (SELECT project, CASE WHEN {_SEC} <= 1.5 THEN 16 WHEN {_SEC} <= 2.5 THEN 20 WHEN {_SEC} <= 6 THEN 25 ELSE 32 END AS diameter, cast(regexp_extract(text, 'L=([0-9]+)', 1) AS INT) AS m FROM {X})
SELECT project, diameter, round_even(sum(m) * 0.9::DOUBLE, 0)::BIGINT AS length_m, ceil(round_even(sum(m) * 0.9::DOUBLE, 0) / 0.8::DOUBLE)::BIGINT AS holders FROM c GROUP BY ALL""")
def e19_conduit(spark, sf_dir):
    hits = counting.cable_hits(cable_texts(spark, sf_dir), ("project",)).select("project", F.col("type").alias("cable_type"), F.col("length_m").alias("total_length_m"))
    return rollup.conduit_by_diameter(hits)


@query(f"SELECT project, file_id, seq, cable_type, total_length_m FROM (SELECT *, row_number() OVER (PARTITION BY project, cable_type, total_length_m ORDER BY file_id, seq, l_partkey) AS r FROM (SELECT l_suppkey AS project, l_orderkey AS file_id, l_linenumber AS seq, l_partkey, p_type AS cable_type, cast(l_quantity AS INT) AS total_length_m FROM {JOINED})) WHERE r = 1")
def f6_dedup_cables(spark, sf_dir):
    c = items(spark, sf_dir).selectExpr("l_suppkey AS project", "l_orderkey AS file_id", "l_linenumber AS seq", "p_type AS cable_type", "cast(l_quantity AS INT) AS total_length_m")
    return rollup.dedup_cables(c)


@query("SELECT file_id, category, elevation, total FROM (SELECT o_orderkey AS file_id, o_orderpriority AS category, o_custkey AS elevation, o_totalprice AS total, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def f7_dedup_floors(spark, sf_dir):
    f = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", "o_orderpriority AS category", "o_custkey AS elevation", "o_orderstatus AS priority", "o_totalprice AS total")
    return rollup.dedup_floors(f, ()).select("file_id", "category", "elevation", "total")


@query("""WITH e AS (SELECT o_orderkey AS file_id, o_custkey % 50 AS symbol, month(o_orderdate) AS elevation, CASE WHEN o_orderkey % 3 = 0 THEN concat('[Auto-detected ', o_orderkey, ']') ELSE o_orderpriority END AS name FROM orders),
r AS (SELECT symbol, elevation, arg_min(name, file_id) AS known FROM e WHERE NOT starts_with(name, '[Auto-detected ') GROUP BY ALL)
SELECT file_id, symbol, elevation, CASE WHEN starts_with(name, '[Auto-detected ') THEN coalesce(known, name) ELSE name END AS name FROM e LEFT JOIN r USING (symbol, elevation)""")
def d6_resolve_names(spark, sf_dir):
    e = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", "0 AS seq", "0 AS project", "o_custkey % 50 AS symbol", "month(o_orderdate) AS elevation", "CASE WHEN o_orderkey % 3 = 0 THEN concat('[Auto-detected ', o_orderkey, ']') ELSE o_orderpriority END AS name")
    return rollup.resolve_names(e).select("file_id", "symbol", "elevation", "name")


@query()
def e34_assemble_bill(spark, sf_dir):
    e = e10_merge_elevations(spark, sf_dir).where("category <> 'skip'")
    c = counting.cable_by_laying(counting.cable_hits(cable_texts(spark, sf_dir), ("project",)), ("project",)).withColumnRenamed("type", "cable_type")
    return rollup.assemble_bill(e, c)


@query("""WITH s AS (SELECT l_suppkey AS file_id, l_returnflag AS color, l_linenumber AS linewidth, sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AS pt FROM lineitem)
SELECT file_id, color, linewidth, round(sum(pt), 3) AS length_pt, round(sum(pt * 0.05::DOUBLE), 3) AS length_m, count(*) AS n_segments, grouping(color) * 2 + grouping(linewidth) AS level FROM s GROUP BY GROUPING SETS ((file_id, color, linewidth), (file_id, color), (file_id))""")
def e25_measure_lines(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file_id", "l_returnflag AS color", "l_linenumber AS linewidth", "0.0 AS x0", "0.0 AS y0", "l_quantity AS x1", "cast(l_linenumber AS DOUBLE) AS y1")
    scale = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS file_id", "0.05D AS m_per_pt")
    return schedules.measure_lines(s, scale)


# --- comparison -----------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_name AS name, count(*) AS c FROM part WHERE p_size < 25 GROUP BY 1), p AS (SELECT p_name AS name, count(*) AS c FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT name, coalesce(t.c, 0) AS truth, coalesce(p.c, 0) AS predicted, coalesce(p.c, 0) - coalesce(t.c, 0) AS delta, CASE WHEN t.c IS NULL THEN 'extra' WHEN p.c IS NULL THEN 'missing' WHEN t.c = p.c THEN 'exact' WHEN abs(t.c - p.c) <= 1 THEN 'near' ELSE 'off' END AS status FROM t FULL JOIN p USING (name)""")
def d11_compare_counts(spark, sf_dir):
    n = lambda where: read(spark, sf_dir, "part").where(where).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("count"))
    return compare.compare_counts(n("p_size < 25"), n("p_size % 2 = 0"))


@query("""WITH f AS (SELECT o_orderstatus, lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS number, concat('/d/', lpad((o_orderkey % 1000)::VARCHAR, 3, '0'), '-', o_orderkey, '.dxf') AS path FROM orders)
SELECT number, min(CASE WHEN o_orderstatus = 'F' THEN path END) AS path_a, min(CASE WHEN o_orderstatus = 'O' THEN path END) AS path_b FROM f GROUP BY 1 HAVING path_a IS NOT NULL AND path_b IS NOT NULL""")
def d8_pair_files(spark, sf_dir):
    f = read(spark, sf_dir, "orders").selectExpr("o_orderstatus", "concat('/d/', lpad(cast(o_orderkey % 1000 AS STRING), 3, '0'), '-', o_orderkey, '.dxf') AS path")
    return compare.pair_files(f.where("o_orderstatus = 'F'"), f.where("o_orderstatus = 'O'"))


@query("""WITH s AS (SELECT p_partkey, p_brand AS project, p_name AS name FROM part WHERE p_size <= 10), p AS (SELECT p_brand AS project, concat(p_name, ' ', p_type) AS plan FROM part WHERE p_size > 10)
SELECT p_partkey, project, name FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project = s.project AND contains(lower(plan), lower(name)))""")
def d12_not_in_plan(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    spec = p.where("p_size <= 10").selectExpr("p_partkey", "p_brand AS project", "p_name AS name")
    plan = p.where("p_size > 10").selectExpr("p_brand AS project", "concat(p_name, ' ', p_type) AS name")
    return compare.not_in_plan(spec, plan)


@query()
def d9_reconcile(spark, sf_dir):
    e = equipment(spark, sf_dir)
    gen = e.where("plan_type = 'A'").groupBy(F.col("project").alias("case"), "name").agg(F.sum("count").alias("total"))
    ref = e.where("plan_type <> 'A'").groupBy(F.col("project").alias("case"), F.concat(F.lit("Монтаж "), F.col("name")).alias("name")).agg(F.sum("count").alias("qty"))
    return compare.reconcile(gen, ref)


@query("""WITH m AS (SELECT l_suppkey AS "case", CASE l_linenumber % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'quantity' WHEN 2 THEN 'missing' ELSE 'extra' END AS status FROM lineitem)
SELECT "case", count_if(status <> 'extra') AS n_reference, count_if(status IN ('matched', 'quantity')) AS n_named, count_if(status = 'matched') AS n_exact, count_if(status = 'extra') AS n_extra, round(100.0::DOUBLE * count_if(status IN ('matched', 'quantity')) / greatest(count_if(status <> 'extra'), 1), 4) AS name_pct, round(100.0::DOUBLE * count_if(status = 'matched') / greatest(count_if(status <> 'extra'), 1), 4) AS exact_pct FROM m GROUP BY ROLLUP ("case")""")
def e35_accuracy(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS case", "CASE l_linenumber % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'quantity' WHEN 2 THEN 'missing' ELSE 'extra' END AS status")
    return compare.accuracy(m)


# --- sources and streams --------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, name, qty, is_section FROM (SELECT o_orderkey, trim(o_orderpriority) AS name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS qty, o_orderkey % 5 = 0 AS is_section FROM orders WHERE o_orderkey % 7 <> 0) WHERE is_section OR qty > 0""")
def a5_reference_bill(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS name", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_orderkey AS STRING) END AS row_num", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(replace(cast(o_totalprice AS STRING), '.', ','), ' шт') END AS qty")
    return drawings.reference_bill(rows).select("o_orderkey", "name", "qty", "is_section")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_suppkey AS file_id, n * 3 AS seq, l_returnflag AS name, cast(l_quantity AS INT) AS qty FROM t""")
def a6_bill_from_lines(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    li = dealt(li, li.count() * 3, "l_suppkey").withColumn("n", F.expr("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)"))
    lines = li.select(F.col("l_suppkey").alias("file_id"), F.posexplode(F.array("l_returnflag", F.lit("шт"), F.col("l_quantity").cast("int").cast("string"))).alias("k", "text"), "n")
    return drawings.bill_from_lines(lines.select("file_id", (F.col("n") * 3 + F.col("k")).alias("seq"), "text"))


@query(f"SELECT project AS file_id, count(*) AS n_rows, sum(count)::BIGINT AS n_equipment FROM {E} GROUP BY 1")
def a8_report(spark, sf_dir):
    e = equipment(spark, sf_dir).selectExpr("project AS file_id", "name AS symbol", "name", "count", "0 AS count_ae")
    c = cable_texts(spark, sf_dir).selectExpr("project AS file_id", "text AS cable_type", "1 AS count", "1 AS total_length_m")
    return drawings.report(e, c).select("file_id", F.size("equipment").cast("long").alias("n_rows"), F.col("n_equipment").cast("long").alias("n_equipment"))


def _events(spark, sf_dir):
    return ingest.stream_table(spark, f"{sf_dir}/event[s].parquet", read(spark, sf_dir, "events").schema)


def _finished(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("SELECT event_type, count(*) AS n_rows, round(sum(value), 4) AS qty FROM events GROUP BY 1")
def s1_stream_bill(spark, sf_dir):
    import uuid

    at = f"{shared_dir(spark)}/bill-{uuid.uuid4().hex}"
    _finished(ingest.stream_bill(_events(spark, sf_dir), ["event_type"], "value", f"{at}/state", f"{at}/bill"))
    return ingest.latest_bill(spark, f"{at}/bill", ["event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def s3_stream_dedup(spark, sf_dir):
    import uuid

    at = f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    first = ingest.stream_dedup(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type")
    _finished(first.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start())
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/rows")
