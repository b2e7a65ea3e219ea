import random

from pyspark.sql import functions as F

from drawlake.operators import compare, counting, iterative, rollup, schedules, sequences, spatial, tables
from drawlake.sources import drawings


def random_points(n, seed, side=300):
    r = random.Random(seed)
    return [(f"f{r.randrange(2)}", i, float(r.randrange(side)), float(r.randrange(side)), r.randrange(100) / 100) for i in range(n)]


def test_dedup_points_is_the_sequential_form(spark):
    rows = random_points(120, 1)
    kept = []
    for f, i, x, y, _ in rows:
        if all(f != g or ((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= 25 for g, _, a, b in kept):
            kept.append((f, i, x, y))
    df = spark.createDataFrame(rows, "f string, seq long, x double, y double, c double")
    assert sorted(r["seq"] for r in iterative.dedup_points(df, ["f"], 25.0).collect()) == sorted(k[1] for k in kept)


def test_nms_is_the_sequential_form(spark):
    rows = random_points(120, 2)
    kept = []
    for f, i, x, y, c in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(f != g or ((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= 40 for g, _, a, b in kept):
            kept.append((f, i, x, y))
    df = spark.createDataFrame([(*r, 10.0, 10.0) for r in rows], "f string, det_id long, cx double, cy double, confidence double, w double, h double")
    assert sorted(r["det_id"] for r in iterative.nms(df, ["f"], min_radius=40.0).collect()) == sorted(k[1] for k in kept)


def test_greedy_match_is_the_sequential_form(spark):
    r = random.Random(3)
    pairs = sorted({("g", a, b): ("g", a, b, float(r.randrange(20))) for a in range(15) for b in range(15) if r.random() < 0.5}.values(), key=lambda p: (p[3], p[1], p[2]))
    used_a, used_b, expected = set(), set(), []
    for _, a, b, _d in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.append((a, b))
    df = spark.createDataFrame(pairs, "g string, a long, b long, d double")
    assert sorted((x["a"], x["b"]) for x in iterative.greedy_match(df, ["g"], "a", "b", "d").collect()) == sorted(expected)


def test_anchor_clusters(spark):
    ys = [0.0, 3.0, 5.0, 5.1, 9.0, 20.0, 24.0, 26.0]
    out, first, n = {}, None, -1
    for y in ys:
        if first is None or y - first > 5:
            first, n = y, n + 1
        out[y] = n
    df = spark.createDataFrame([("p", y) for y in ys], "p string, y double")
    assert {r["y"]: r["cluster"] for r in sequences.cluster_by_anchor(df, ["p"], "y", 5.0).collect()} == out


def test_routes_join_at_ends(spark):
    rows = [("f", 1, 0.0, 0.0, 10.0, 0.0), ("f", 2, 10.5, 0.5, 10.0, 10.0), ("f", 3, 50.0, 50.0, 60.0, 50.0)]
    df = spark.createDataFrame(rows, "f string, seq long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["n_segments"] for r in iterative.routes(df, ("f",)).collect()) == [1, 2]


def test_apportion_gives_all(spark):
    df = spark.createDataFrame([("p", "a", 10, 1.0), ("p", "b", 10, 1.0), ("p", "c", 10, 1.0)], "p string, k string, q int, w double")
    assert {r["k"]: r["part"] for r in rollup.apportion(df, ["p"], "q", "w", [F.col("k")]).collect()} == {"a": 3, "b": 3, "c": 4}


def test_count_labels_with_variants(spark):
    texts = spark.createDataFrame([("f", 1, "5", 0.0, 0.0), ("f", 2, "5АЭ", 1.0, 1.0), ("f", 3, "5А", 2.0, 2.0), ("f", 4, "5", 100.0, 100.0)], "file_id string, seq long, text string, x double, y double")
    legend = spark.createDataFrame([("f", "5", "Светильник"), ("f", "6", "Розетка")], "file_id string, symbol string, name string")
    boxes = spark.createDataFrame([("f", 90.0, 90.0, 110.0, 110.0)], "file_id string, x0 double, y0 double, x1 double, y1 double")
    assert {r["symbol"]: (r["count"], r["count_ae"]) for r in counting.count_labels(texts, legend, boxes).collect()} == {"5": (2, 1), "6": (0, 0)}


def test_spec_table(spark):
    def table(ys):
        words = [("Поз.", 100.0, 100.0), ("Наименование", 150.0, 100.0), ("Кол.", 300.0, 100.0)]
        for n, y in enumerate(ys, 1):
            words += [(str(n), 100.0, y), (f"Item{n}", 155.0, y)]
        return spark.createDataFrame([("f", 1, i, t, x, x + 20, y, y + 8) for i, (t, x, y) in enumerate(words)], "file_id string, page int, seq long, text string, x0 double, x1 double, top double, bottom double")

    assert [r["symbol"] for r in sequences.spec_tables(table([130.0, 150.0, 170.0])).orderBy("top").collect()] == ["1", "2", "3"]
    assert sequences.spec_tables(table([130.0, 150.0])).count() == 0
    assert sequences.spec_tables(table([130.0, 150.0, 170.0, 350.0])).count() == 3


def test_identifier_runs(spark):
    def page(words):
        return spark.createDataFrame([("f", 1, i, t, x, x + 5, y) for i, (t, x, y) in enumerate(words)], "file_id string, page int, seq long, text string, x0 double, x1 double, top double")

    aligned = [(t, 50.0, 100.0 + 20 * k) for k, t in enumerate(("1", "2", "5А", "А2"))]
    assert sequences.identifier_runs(page(aligned)).count() == 4
    assert sequences.identifier_runs(page(aligned[:3])).count() == 0
    assert sequences.identifier_runs(page([(t, 50.0 + 40 * k, y) for k, (t, _, y) in enumerate(aligned)])).count() == 0
    beside = [w for t, x, y in aligned for w in ((t, x, y), ("word", x + 40, y))]
    assert sequences.density_runs(page(beside)).count() == 4


def test_table_bounds(spark):
    rows = [(200.0, y, 240.0, y) for y in (120.0, 140.0, 160.0)] + [(x, 120.0, x, 160.0) for x in (200.0, 240.0)]
    segs = spark.createDataFrame([("f", 1, k, *r) for k, r in enumerate(rows)], "file_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double")
    head = spark.createDataFrame([("f", 1, 0, 200.0, 110.0)], "file_id string, page int, seq long, x0 double, top double")
    got = tables.line_bounds(segs, head).first()
    assert (got["x0"], got["x1"], got["row_ys"], got["col_xs"]) == (200.0, 240.0, [120.0, 140.0, 160.0], [200.0, 240.0])


def test_reversed_page_flags(spark):
    def flags(words):
        df = spark.createDataFrame([("f", 1, w) for w in words], "file_id string, page int, text string")
        return counting.page_flags(df, ["кабель", "щит", "группа", "длина", "марка"]).first()["is_reversed"]

    assert flags(["кабель"[::-1], "щит"[::-1], "группа"[::-1], "длина"[::-1], "марка"[::-1]])
    assert not flags(["кабель"[::-1], "щит"[::-1]])
    assert not flags([*(w[::-1] for w in ("кабель", "щит", "группа")), "кабель", "щит", "группа", "длина", "марка"])


def test_compare_drawing_006(spark):
    truth = spark.createDataFrame([(f"n{i}", c) for i, c in enumerate([30, 2, 9, 5, 11, 2, 2, 4, 6])], "name string, count long")
    pred = spark.createDataFrame([(f"n{i}", c) for i, c in enumerate([30, 1, 4, 3, 2, 1, 2, 4])], "name string, count long")
    got = compare.compare_counts(truth, pred).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"exact": 3, "near": 2, "off": 3, "missing": 1}


def test_reconcile(spark):
    gen = spark.createDataFrame([("c", "Монтаж светильников UNI", 5.0), ("c", "Розетка РА16-003 двойная", 2.0), ("c", "Лишнее", 1.0)], "case string, name string, total double")
    ref = spark.createDataFrame([("c", "Светильник UNI", 5.0), ("c", "Монтаж розетки двойной", 3.0), ("c", "Щит ЩО", 1.0)], "case string, name string, qty double")
    got = {(r["ref_name"], r["gen_name"]): r["status"] for r in compare.reconcile(gen, ref).collect()}
    assert got == {("Светильник UNI", "Монтаж светильников UNI"): "matched", ("Монтаж розетки двойной", "Розетка РА16-003 двойная"): "quantity", ("Щит ЩО", None): "missing", (None, "Лишнее"): "extra"}


def test_reconcile_sums_and_keeps_reference_order(spark):
    gen = spark.createDataFrame([("c", "Светильник UNI", 2.0), ("c", "Светильник UNI", 3.0), ("c", "Кабель силовой бббб", 1.0)], "case string, name string, total double")
    ref = spark.createDataFrame([("c", "Светильник UNI", 5.0), ("c", "Кабель силовой аааа", 1.0), ("c", "Кабель силовой ббб", 1.0)], "case string, name string, qty double")
    got = {(r["ref_name"], r["gen_name"]): r["status"] for r in compare.reconcile(gen, ref).collect()}
    assert got == {("Светильник UNI", "Светильник UNI"): "matched", ("Кабель силовой аааа", "Кабель силовой бббб"): "matched", ("Кабель силовой ббб", None): "missing"}


def test_counts_of_names_that_differ(spark):
    frame = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "case string, name string, count long")
    got = compare.compare_named_counts(frame([("Светильник потолочный", 5), ("[? нет", 2), ("Щит ЩО", 1)]), frame([("Светильник потолочный UNI", 4), ("", 1)]))
    assert sorted((r["status"], r["delta"]) for r in got.collect()) == [("missing", None), ("quantity", -1.0)]
    rate = compare.accuracy(got).where("case = 'c'").first()
    assert (rate["n_reference"], rate["name_pct"], rate["exact_pct"]) == (2, 50.0, 0.0)


def test_not_in_plan_is_containment(spark):
    frame = lambda names: spark.createDataFrame([(i, "p", n) for i, n in enumerate(names)], "id long, project string, name string")
    spec, plan = ["Розетка", "ЩО", "+", "", None, "Щит распределительный ЩР-1", "Кабель"], ["Блок РОЗЕТКАМИ", "щоУ + ", "ЩР-1"]
    for names in (spec, spec * 2):
        got = compare.not_in_plan(frame(names), frame(plan)).collect()
        assert sorted(str(r["name"]) for r in got) == sorted([str(n) for n in names if n in (None, "Щит распределительный ЩР-1", "Кабель")])
        both = compare.not_in_plan(frame(names), frame(plan), both_ways=True).collect()
        assert sorted(str(r["name"]) for r in both) == sorted([str(n) for n in names if n in (None, "Кабель")])


def test_dxf_entities(spark):
    lines = ["0", "SECTION", "2", "ENTITIES", "0", "MTEXT", "8", "L1", "3", "Hello ", "1", "World", "10", "1.5", "20", "2.5", "0", "LINE", "10", "0", "0", "ENDSEC", "0", "EOF"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file_id string, line_no int, line string")
    assert [(r["section"], r["kind"], r["layer"], r["text"], r["x"], r["y"]) for r in drawings.dxf_entities(df).collect()] == [("ENTITIES", "MTEXT", "L1", "Hello World", 1.5, 2.5)]


def test_file_inventory(spark, tmp_path):
    for p in ("ЭО/a.dxf", "_tmp/b.dxf", ".git/c.dxf", "_converted_dxf/d.dxf", "x/A.DXF", "x/e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {(r["stem"], r["section"]) for r in drawings.file_inventory(spark, str(tmp_path)).collect()}
    assert {s for s, _ in got} == {"a", "d"}


def test_report_and_csv(spark, tmp_path):
    e = spark.createDataFrame([("f", "1", "Светильник", 3, 1)], "file_id string, symbol string, name string, count int, count_ae int")
    c = spark.createDataFrame([("f", "ВВГ", 1, 10)], "file_id string, cable_type string, count int, total_length_m int")
    assert '"n_equipment":4' in drawings.report_json(e, c).first()["json"]
    drawings.write_csv(e, str(tmp_path / "out"))
    assert spark.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "out")).first()["total"] == "4"


def test_schedule(spark):
    words = spark.createDataFrame([("f", 1, 1, "3х2,5", 100.0, 120.0, 100.0), ("f", 1, 2, "ЩО1-Гр.7", 110.0, 140.0, 150.0), ("f", 1, 3, "L=12м", 120.0, 130.0, 110.0)], "file_id string, page int, seq long, text string, x0 double, x1 double, top double")
    got = schedules.cable_schedule(schedules.cable_runs(words)).first()
    assert (got["label"], got["n_runs"], got["sections"], got["length_m"]) == ("ЩО1-Гр.7", 1, ["3х2,5"], 12.0)


def test_merge_legends(spark):
    rows = [("f", 1, 1, "1", "short", 0.0, 0.0, 1.0, 1.0), ("f", 1, 2, "2", "b", 0.0, 0.0, 1.0, 1.0), ("f", 2, 3, "1", "a longer one", 5.0, 5.0, 6.0, 6.0), ("f", 2, 4, "3", "c", 5.0, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "file_id string, page int, seq long, symbol string, description string, x0 double, y0 double, x1 double, y1 double")
    assert {r["symbol"]: r["description"] for r in compare.merge_legends(df).collect()} == {"1": "a longer one", "2": "b", "3": "c"}


def test_merge_tokens(spark):
    words = spark.createDataFrame([("f", 1, 1, "5", 0.0, 5.0, 10.0), ("f", 1, 2, "АЭ", 7.0, 12.0, 11.0), ("f", 1, 3, "7", 50.0, 55.0, 10.0)], "file_id string, page int, seq long, text string, x0 double, x1 double, top double")
    assert sorted(r["text"] for r in spatial.merge_tokens(words).collect()) == ["5АЭ", "7"]


def made_detections(seed, n):
    r = random.Random(seed)
    return [(i, r.randrange(2), r.randrange(3), r.uniform(0, 600), r.uniform(0, 600), r.uniform(10, 120), r.uniform(10, 120), round(r.uniform(0.1, 1), 3)) for i in range(n)]


DETECTION = "det_id long, page long, symbol_index long, cx double, cy double, w double, h double, confidence double"


def test_detection_stages_against_a_sequential_form(spark):
    import numpy as np

    rows = made_detections(3, 260)
    zones = [(0, 100.0, 100.0, 300.0, 250.0), (1, 0.0, 0.0, 90.0, 600.0)]

    def near(a, b):
        return ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5

    def iou(a, b):
        x = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
        y = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
        both = max(0, x) * max(0, y)
        return both / (a[5] * a[6] + b[5] * b[6] - both)

    def kept(some, bad):
        out = []
        for d in sorted(some, key=lambda d: (-d[7], d[0])):
            if not any(bad(k, d) for k in out):
                out.append(d)
        return out

    want, final = {}, []
    for page in range(2):
        single = []
        for label in range(3):
            own = [d for d in rows if d[1] == page and d[2] == label]
            p97, p99 = np.percentile([d[7] for d in own], [97, 99])
            sure = [d for d in own if d[7] >= max(0.3, min(0.62, max(0.32, p97, p99 - 0.015)))]
            outside = [d for d in sure if not any(z[0] == page and z[1] < d[3] < z[3] and z[2] < d[4] < z[4] for z in zones)]
            one = kept(outside, lambda k, d: near(k, d) < max(0.6 * max(k[5], k[6]), 60) or iou(k, d) >= 0.3)
            want[page, label] = [len(own), len(sure), len(outside), len(one), len(one[:80])]
            single += one[:80]
        final += kept(single, lambda k, d: k[2] != d[2] and near(k, d) <= 25 and k[7] - d[7] >= 0.04)
    z = spark.createDataFrame(zones, "page long, x0 double, y0 double, x1 double, y1 double")
    got = iterative.detect_counts(spark.createDataFrame(rows, DETECTION), z, ("page",)).collect()
    for r in got:
        n = sum(d[1] == r["page"] and d[2] == r["symbol_index"] for d in final)
        assert [r[c] for c in ("n_raw", "n_sure", "n_outside", "n_single", "n_capped", "n_final")] == [*want[r["page"], r["symbol_index"]], n]


def test_places_against_a_sequential_form(spark):
    rows = made_detections(4, 150)
    r = random.Random(9)
    words = [(p, r.choice(["one", "two", "three", "other"]), r.uniform(0, 600), r.uniform(0, 600)) for p in range(2) for _ in range(120)]
    hints = [(0, "one"), (1, "two"), (2, "three")]
    want = []
    for page in range(2):
        left = sorted((d for d in rows if d[1] == page), key=lambda d: (-d[7], d[0]))
        order = {d[0]: k for k, d in enumerate(left)}
        while left:
            first = left[0]
            place = [d for d in left if ((d[3] - first[3]) ** 2 + (d[4] - first[4]) ** 2) ** 0.5 < 25]
            said = {k: sum(w[0] == page and w[1] == t and ((w[2] - first[3]) ** 2 + (w[3] - first[4]) ** 2) ** 0.5 <= 40 for w in words) for k, t in hints}
            best = max(place, key=lambda d: (said[d[2]], -order[d[0]]))
            want.append((page, best[2], len(place)))
            left = [d for d in left if d not in place]
    got = iterative.disambiguate(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(words, "page long, text string, x0 double, top double"), spark.createDataFrame(hints, "label long, token string"), ["page"]).collect()
    assert sorted((x["page"], x["symbol_index"], x["n_detections"]) for x in got) == sorted(want)


def test_assembled_bill(spark):
    equip = [("p", "luminaire", "Светильник А", "до 5 метров", 3), ("p", "luminaire", "Светильник А", "от 5 до 13 метров", 2), ("p", "socket", "Розетка Б", "до 5 метров", 4), ("p", "socket", "Розетка В", "до 5 метров", 0)]
    cables = [("p", "ВВГнг(А)-LS 3×1,5", "в гофре", 10), ("p", "ВВГнг(А)-LS 3×1,5", "в лотке", 5), ("p", "ВВГнг(А)-LS 5×4", "", 7)]
    got = rollup.assemble_bill(spark.createDataFrame(equip, "project string, category string, name string, height string, count int"), spark.createDataFrame(cables, "project string, cable_type string, method string, length_m long")).orderBy("number", "line").collect()
    rows = [(r["number"], r["line"], r["name"], r["unit"], r["qty"]) for r in got]
    assert [x for x in rows if x[1] == 0] == [
        (1, 0, "Монтаж светильника А на высоте до 5 метров", "шт", 3), (2, 0, "Монтаж светильника А на высоте от 5 до 13 метров", "шт", 2), (3, 0, "Монтаж розетки Б на высоте до 5 метров", "шт", 4),
        *[(n, 0, x, "м", q) for n, (x, q) in enumerate([("Прокладка кабеля в гофре суммарное сечение до 6 мм2", 10), ("Прокладка кабеля в лотке массой до 1 кг", 5), ("Прокладка кабеля открыто суммарное сечение до 35 мм2", 7)], 4)],
    ]
    assert [(n, k, q) for n, k, _, _, q in rows if k] == [(1, 1, 3), (2, 1, 2), (3, 1, 4), (4, 1, 10), (5, 1, 5), (6, 1, 7)]
    assert sorted(x[2] for x in rows if x[1]) == sorted(["Светильник А"] * 2 + ["Розетка Б", "Кабель ВВГнг(А)-LS сечением 3х1,5", "Кабель ВВГнг(А)-LS сечением 3х1,5", "Кабель ВВГнг(А)-LS сечением 5х4"])


def test_numbers_and_stored_tables(spark):
    import os

    from drawlake.operators.graph import _own_dir, clear_stored, numbered, once, stored

    r = random.Random(8)
    names = [f"n{k:03d}" for k in range(300)]
    rows = [(x, None if x == "n005" else x) for x in names]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, text string").repartition(5)
    assert [(x["name"], x["number"]) for x in numbered(df, ["name"]).orderBy("number").collect()] == [(n, k + 1) for k, n in enumerate(names)]
    both = once(df.unionByName(df), "text", size=F.length("text"))
    assert both.count() == 598 and {x["size"] for x in both.collect()} == {4}
    assert stored(df, "x").count() == 300
    clear_stored(spark)
    assert not os.path.exists(_own_dir(spark).removeprefix("file:"))


def test_orphan_plans_against_a_sequential_form(spark):
    r = random.Random(6)
    rows = [(f"p{p}", r.choice(["освещение", "привязка", "привязка", "розетки"]), r.choice([1.0, 2.0, 3.0, 4.0, 7.8, 9.0, 10.0, 14.0, None]), k, 1) for p in range(40) for k in range(r.randrange(1, 9))]
    limit = lambda e: sum(e >= x for x in (5, 13, 20))
    want = []
    for p in sorted({x[0] for x in rows}):
        groups = {}
        for x in rows:
            if x[0] == p and x[1] != "розетки" and x[2] is not None:
                groups.setdefault(x[2], []).append(x)
        to = {e: e for e in groups}
        for e in list(groups):
            if e not in groups:
                continue
            kinds = {x[1] for x in groups[e]}
            if len(kinds) == 2:
                continue
            for other in list(to):
                if other != e and other in groups and limit(other) == limit(e) and {x[1] for x in groups[other]} - kinds:
                    groups[other] += groups.pop(e)
                    to = {a: other if b == e else b for a, b in to.items()}
                    break
        want += [(p, x[3], to.get(x[2], x[2]) if x[1] != "розетки" else x[2]) for x in rows if x[0] == p]
    got = rollup.pair_orphans(spark.createDataFrame(rows, "project string, plan_type string, elevation double, seq long, count long")).collect()
    key = lambda t: (t[0], t[1])
    assert sorted(((x["project"], x["seq"], x["elevation"]) for x in got), key=key) == sorted(want, key=key)


def test_alike_candidates_lose_no_pair(spark):
    from difflib import SequenceMatcher

    r = random.Random(8)
    texts = ["".join(r.choice("abcdeщ ") for _ in range(r.randrange(1, 14))) for _ in range(80)] + ["светильник led", "кинельтевс del", "a", "aa", "aaaaaaaa"]
    a = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "case int, left int, l_text string")
    b = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts[::-1])], "case int, right int, r_text string")
    for threshold in (0.45, 0.8):
        got = {(x["case"], x["left"], x["right"]) for x in compare.alike_candidates(a, b, ["case"], threshold).collect()}
        want = {(i % 2, i, j) for i, s in enumerate(texts) for j, t in enumerate(texts[::-1]) if i % 2 == j % 2 and SequenceMatcher(None, s, t).ratio() >= threshold}
        assert want <= got and len(got) < 85 * 85 / 2


def test_annotations_take_legend_names_in_turn(spark):
    legend = spark.createDataFrame([(1, 1, "1", "Светильник SLICK PRS LED 30 with driver box 5000K"), (1, 2, "2", "Светильник SLICK PRS LED 50 with driver box"), (1, 3, "3", "OPL ECO LED 600"), (1, 4, "", "Прокладка LED")], "file_id int, seq int, symbol string, description string")
    notes = spark.createDataFrame([(1, 1, "SLICK.PRS LED 30 5000K", 133), (1, 2, "SLICK.PRS LED 30", 7), (1, 3, "LED 50", 4), (1, 4, "SLICK LED 50 box", 9)], "file_id int, seq int, name string, count int")
    got = sorted((r["symbol"], r["name"], r["count"]) for r in compare.enrich_annotations(notes, legend).collect())
    assert got == [("", "LED 50", 4), ("", "SLICK.PRS LED 30", 7), ("1", "Светильник SLICK PRS LED 30 with driver box 5000K", 133), ("2", "Светильник SLICK PRS LED 50 with driver box", 9), ("3", "OPL ECO LED 600", 0)]


def iou(a, b):
    x = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
    y = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
    both = max(0, x) * max(0, y)
    return both / (a[5] * a[6] + b[5] * b[6] - both)


def kept(some, bad):
    out = []
    for d in sorted(some, key=lambda d: (-d[7], d[0])):
        if not any(bad(k, d) for k in out):
            out.append(d)
    return out


def test_all_detection_stages_against_a_sequential_form(spark):
    import numpy as np

    r = random.Random(12)
    base = made_detections(6, 200)
    flags = [(r.random() < 0.1, r.random() < 0.05, r.choice(["", "red", "blue"])) for _ in base]
    rows = [(*d, *f) for d, f in zip(base, flags)]
    zones = [(0, 100.0, 100.0, 220.0, 260.0)]
    classes = {0: (True, "red"), 1: (False, ""), 2: (False, "blue")}
    exempt = [(0, 1)]
    words = [(p, r.choice(["one", "two", "three"]), r.uniform(0, 600), r.uniform(0, 600)) for p in range(2) for _ in range(80)]
    hints = [(0, "one"), (1, "two"), (2, "three")]
    far = lambda a, b: ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5
    want, finals = {}, []
    for page in range(2):
        left = []
        for k, (letter, color) in classes.items():
            own = [d for d in rows if d[1] == page and d[2] == k]
            p97, p99 = np.percentile([d[7] for d in own], [97, 99])
            sure = [d for d in own if not letter or d[7] >= max(0.3, min(0.62, max(0.32, p97, p99 - 0.015)))]
            outside = [d for d in sure if not any(z[0] == page and z[1] < d[3] < z[3] and z[2] < d[4] < z[4] for z in zones)]
            ratio, least = (1.2, 120) if letter else (0.6, 60)
            one = kept(outside, lambda a, b: far(a, b) < max(ratio * max(a[5], a[6]), least) or iou(a, b) >= 0.3)
            shaped = [d for d in one if not d[8] and not d[9]]
            colored = [d for d in shaped if not color or not d[10] or d[10] == color]
            capped = colored
            if letter:
                cells = {}
                for d in sorted(colored, key=lambda d: (-d[7], d[0])):
                    cells.setdefault((d[3] // 120, d[4] // 120), d)
                capped = sorted(cells.values(), key=lambda d: (-d[7], d[0]))[:80]
            want[page, k] = [len(own), len(sure), len(outside), len(one), len(shaped), len(colored), len(capped)]
            left += capped
        crossed = kept(left, lambda a, b: a[2] != b[2] and {a[2], b[2]} != {0, 1} and far(a, b) <= 25 and a[7] - b[7] >= 0.04)
        for k in classes:
            want[page, k].append(sum(d[2] == k for d in crossed))
        rest = sorted(crossed, key=lambda d: (-d[7], d[0]))
        order = {d[0]: i for i, d in enumerate(rest)}
        while rest:
            place = [d for d in rest if far(d, rest[0]) < 25]
            said = {k: sum(w[0] == page and w[1] == t and ((w[2] - rest[0][3]) ** 2 + (w[3] - rest[0][4]) ** 2) ** 0.5 <= 40 for w in words) for k, t in hints}
            finals.append((page, max(place, key=lambda d: (said[d[2]], -order[d[0]]))[2]))
            rest = [d for d in rest if d not in place]
    det = spark.createDataFrame(rows, DETECTION + ", over_text boolean, bad_shape boolean, color string")
    counts, final = iterative.detection_stages(
        det, spark.createDataFrame(zones, "page long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(k, *v) for k, v in classes.items()], "symbol_index long, one_letter boolean, color string"),
        spark.createDataFrame(words, "page long, text string, x0 double, top double"), spark.createDataFrame(hints, "label long, token string"), spark.createDataFrame(exempt, "a long, b long"), ("page",),
    )
    assert sorted((x["page"], x["symbol_index"]) for x in final.collect()) == sorted(finals)
    names = ["n_raw", "n_sure", "n_outside", "n_single", "n_shaped", "n_colored", "n_capped", "n_crossed", "n_final"]
    for x in counts.collect():
        assert [x[n] for n in names] == [*want[x["page"], x["symbol_index"]], finals.count((x["page"], x["symbol_index"]))]


def test_signs_by_their_models_core(spark):
    plan = spark.createDataFrame([("p", '"ВЫХОД" MERCURY LED 24'), ("p", "Указатель Exit-1")], "project string, name string")
    spec = [("p", "Световой указатель MERCURY LED", ""), ("p", "Световой указатель MARS 22", ""), ("p", "Световой указатель MERCURY LED 24 IP65", None), ("p", "Знак", "exit-1"), ("q", "Световой указатель MERCURY LED", ""), ("p", "Знак Z", "ab")]
    got = compare.signs_not_in_plan(spark.createDataFrame(spec, "project string, name string, model string"), plan)
    assert sorted((r["project"], r["name"]) for r in got.collect()) == [("p", "Знак Z"), ("p", "Световой указатель MARS 22"), ("q", "Световой указатель MERCURY LED")]
