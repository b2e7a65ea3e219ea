import random

from drawlake.operators import iterative, legends


def test_descriptions_and_lines(spark):
    texts = spark.createDataFrame([("f", 1, "Условные обозначения", 10.0, 90.0), ("f", 2, "Светильник LED", 10.0, 80.0), ("f", 3, "Розетка двойная\nx", 10.0, 70.0), ("f", 4, "Светильник LED", 500.0, 70.0), ("f", 5, "5", 10.0, 60.0)], "file_id string, seq long, text string, x double, y double")
    boxes = spark.createDataFrame([("f", 0.0, 0.0, 100.0, 100.0)], "file_id string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["symbol"], r["description"]) for r in legends.legend_descriptions(texts, boxes).orderBy("symbol").collect()] == [("L1", "Светильник LED"), ("L2", "Розетка двойная")]
    rows = [("a", i, t) for i, t in enumerate(["x", "Условные обозначения", "1\tСветильник", "2\tРозетка", "Примечание", "3\tЩит"])] + [("b", i, t) for i, t in enumerate(["Условные обозначения", "1", "2", "Светильник LED", "Розетка двойная"])]
    got = legends.legend_from_lines(spark.createDataFrame(rows, "file_id string, seq long, text string"))
    assert sorted((r["file_id"], r["symbol"], r["description"]) for r in got.collect()) == [("a", "1", "Светильник"), ("a", "2", "Розетка"), ("b", "1", "Светильник LED"), ("b", "2", "Розетка двойная")]


def test_signs_colours_and_names(spark):
    words = spark.createDataFrame([("f", 1, 1, "ВЫХОД", 5.0, 5.0), ("f", 1, 2, "ДОХЫВ", 50.0, 50.0), ("f", 1, 3, "вход", 50.0, 50.0)], "file_id string, page int, seq long, text string, x0 double, top double")
    zones = spark.createDataFrame([("f", 1, 0.0, 0.0, 10.0, 10.0)], "file_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert legends.pictograms(words, zones).first()["count"] == 1
    items = spark.createDataFrame([("Розетка", "#FF0000"), ("Прокладка кабеля", "#00ff00"), ("[Auto-detected 5]", None)], "name string, color string")
    assert [r["name"] for r in legends.drop_non_equipment(items).collect()] == ["Розетка"]
    assert legends.filter_colors(items, show=["#ff0000"]).count() == 1 and legends.filter_colors(items, hide=["#ff0000"]).count() == 2


def test_marker_positions(spark):
    at = "file_id string, seq long, text string, x double, y double"
    labels = spark.createDataFrame([("f", 1, "5", 0.0, 0.0), ("f", 2, "5", 1.0, 0.0), ("f", 3, "5", 900.0, 0.0)], at)
    notes = spark.createDataFrame([("f", 4, "Светильник большой", 5.0, 5.0)], "file_id string, seq long, name string, x double, y double")
    inserts = spark.createDataFrame([("f", 5, "BLK", 7.0, 7.0)], "file_id string, seq long, block_name string, x double, y double")
    circles = spark.createDataFrame([("f", 6, 1, 9.0, 9.0)], "file_id string, seq long, color int, x double, y double")
    items = spark.createDataFrame([("f", "5", "a"), ("f", "P1", "Светильник большой"), ("f", "BLK", "b"), ("f", "C1", "c")], "file_id string, symbol string, name string")
    got = legends.marker_positions(labels, notes, inserts, circles, items).collect()
    assert sorted((r["symbol"], r["seq"]) for r in got) == [("5", 1), ("5", 3), ("BLK", 5), ("C1", 6), ("P1", 4)]


def test_content_legend(spark):
    rows = [("f", 1, i, t, x, x + 20, y) for i, (t, x, y) in enumerate([(s, x, 110.0 + 20 * k) for k, n in enumerate(("Светильник", "Розетка")) for s, x in ((str(k), 205.0), (n, 230.0))])]
    words = spark.createDataFrame(rows, "file_id string, page int, seq long, text string, x0 double, x1 double, top double")
    lines = [(200.0, y, 400.0, y) for y in (105.0, 125.0, 145.0)] + [(x, 105.0, x, 145.0) for x in (200.0, 225.0, 400.0)]
    segs = spark.createDataFrame([("f", 1, *r) for r in lines], "file_id string, page int, x0 double, y0 double, x1 double, y1 double")
    got = legends.content_legends(words, segs).first()
    assert (got["x0"], got["x1"], got["method"]) == (200.0, 400.0, "frame")


def test_methods_in_order(spark):
    def rows(file, page, method, tolerance, start, *texts):
        return [(file, page, method, tolerance, start + k, s, d, 10.0 * page, 0.0, 10.0 * page + k, 5.0) for k, (s, d) in enumerate(texts)]

    found = [
        # the wider tolerance counts, as the descriptions of the narrower are poor; content of a page with a header does not
        *rows("a", 0, "header", 3, 0, ("1", ""), ("2", "x")), *rows("a", 0, "header", 7, 10, ("1", "лампа"), ("2", "щит"), ("3", None)), *rows("a", 0, "content", None, 20, ("9", "нет")), *rows("a", 0, "density", None, 30, ("8", "нет")),
        # good descriptions end the search though the wider tolerance would score more; the other page brings nothing new
        *rows("b", 0, "header", 3, 0, ("1", "лампа"), ("1", "лампа большая"), ("", "выход")), *rows("b", 0, "header", 7, 10, ("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")), *rows("b", 1, "content", None, 20, ("1", "лампа очень большая"), ("", "вход")),
        # a new symbol on one page lets all others join; the longest description stays, of equal ones the better candidate's
        *rows("c", 0, "content", None, 0, ("A", "ab"), ("B", "первый"), ("B", "первый длинный"), ("", "Выход")), *rows("c", 1, "spec", None, 10, ("a ", "abc"), ("b", "второй")), *rows("c", 2, "content", None, 20, ("z", ""), ("", "выход")),
        # nothing but density
        *rows("d", 1, "density", None, 0, ("1", "")), *rows("d", 0, "density", None, 10, ("2", "")),
    ]
    got = legends.legend_of_file(spark.createDataFrame(found, "file_id string, page long, method string, tolerance int, seq long, symbol string, description string, x0 double, y0 double, x1 double, y1 double")).collect()
    of = lambda f: (sorted((r["seq"], r["symbol"], r["description"]) for r in got if r["file_id"] == f), {(r["best_page"], r["method"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got if r["file_id"] == f})
    assert of("a") == ([(10, "1", "лампа"), (11, "2", "щит"), (12, "3", "")], {(0, "header", 0.0, 0.0, 2.0, 5.0)})
    assert of("b") == ([(0, "1", "лампа"), (1, "1", "лампа большая"), (2, "", "выход")], {(0, "header", 0.0, 0.0, 2.0, 5.0)})
    assert of("c") == ([(1, "B", "первый"), (3, "", "Выход"), (10, "a ", "abc"), (20, "z", "")], {(0, "content", 0.0, 0.0, 21.0, 5.0)})
    assert of("d") == ([(0, "1", ""), (10, "2", "")], {(0, "density", 0.0, 0.0, 10.0, 5.0)})


def test_small_legends_are_matched_as_lists(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f, left, 10 * k + left, r.choice([0.0, 1.0, 2.5]) + r.randrange(9) * 100, f"{f}{k}", reach) for f, n, reach in (("a", 4, 300.0), ("b", 7, 1000.0), ("c", 1, 0.5)) for left in (True, False) for k in range(n + left)]
    rows += [("d", True, 1, 0.0, "only", 300.0), ("e", False, 1, 0.0, "only", 300.0)]
    want = []
    for f in "abc":
        used = set()
        sides = [[x for x in rows if x[0] == f and x[1] is left] for left in (True, False)]
        for d, a, b in sorted((abs(x[3] - y[3]), x[2], y[2]) for x in sides[0] for y in sides[1] if abs(x[3] - y[3]) <= x[5]):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                want.append((f, a, b))
    df = spark.createDataFrame(rows, "file_id string, left boolean, seq long, y double, text string, reach double")
    pairs = lambda: sorted((x["file_id"], x["l_seq"], x["r_seq"]) for x in legends._level_match(df, ["file_id"]).collect())
    for listed in (0, 20):  # all of them in rounds, or the larger one alone
        monkeypatch.setattr(legends, "LISTED", listed)
        assert pairs() == sorted(want)
    monkeypatch.setattr(legends, "LISTED", 1024)

    def rounds(*_):
        raise AssertionError("small legends take no rounds")

    monkeypatch.setattr(iterative, "greedy_match", rounds)
    assert pairs() == sorted(want)
    texts = spark.createDataFrame([("f", 1, "1", 10.0, 10.0), ("f", 2, "2", 10.0, 400.0), ("f", 3, "Светильник первый", 20.0, 30.0), ("f", 4, "Светильник второй", 20.0, 380.0), ("f", 5, "Прокладка кабеля", 20.0, 10.0), ("f", 6, "2", 10.0, 300.0)], "file_id string, seq long, text string, x double, y double")
    boxes = spark.createDataFrame([("f", 0.0, 0.0, 100.0, 500.0)], "file_id string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(x) for x in legends.legend_numbered(texts, boxes).collect()) == [("f", "1", "Светильник первый"), ("f", "2", "Светильник второй")]
