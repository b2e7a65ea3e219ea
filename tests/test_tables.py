"""Bounds of legend tables and split rows, against sequential forms and worked cases."""

import random

from drawlake.operators import tables as T

SEG = "file_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double"
HEAD = "file_id int, page int, seq int, x0 double, top double"
WORD = "file_id int, page int, seq int, text string, x0 double, x1 double, top double, bottom double"


def h(x0, x1, y):
    return x0, y, x1, y


def v(x, y0, y1):
    return x, y0, x, y1


def frames(spark, lines, heads=(), words=()):
    segments = spark.createDataFrame([(1, 1, k, *map(float, x)) for k, x in enumerate(lines)], SEG)
    headers = spark.createDataFrame([(1, 1, k, float(x), float(y)) for k, (x, y) in enumerate(heads)], HEAD)
    return segments, headers, spark.createDataFrame([(1, 1, k, t, float(a), float(b), float(c), float(d)) for k, (t, a, b, c, d) in enumerate(words)], WORD)


def by_hand(lines, x, y):
    """The table of one header, line after line."""
    flat = [(min(a, c), max(a, c), min(b, d)) for a, b, c, d in lines if abs(d - b) < 2 and abs(c - a) > 25]
    flat = [x_ for x_ in flat if y - 30 < x_[2] < y + 1000 and x_[0] < x + 800 and x_[1] > x - 300]
    near = [x_ for x_ in flat if x_[1] > x - 200 and x_[0] < x + 200]
    flat = near or flat
    if not flat:
        return None
    keys, of = [], []
    for a, b, _ in flat:
        k = next((i for i, (p, q) in enumerate(keys) if abs(p - round(a)) < 5 and abs(q - round(b)) < 5), None)
        if k is None:
            keys.append((round(a), round(b)))
            k = len(keys) - 1
        of.append(k)
    good = [(min(abs(flat[j][2] - y) for j in range(len(flat)) if of[j] == k), k) for k in range(len(keys)) if of.count(k) >= 2 and 40 <= keys[k][1] - keys[k][0] <= 800]
    if good:
        x0, x1 = keys[min(good)[1]]
    else:
        left, right = [round(a) for a, _, _ in flat], [round(b) for _, b, _ in flat]
        x0, x1 = max(left, key=left.count), max(right, key=right.count)
    rows = sorted({round(c, 1) for a, b, c in flat if abs(round(a) - x0) < 5 and abs(round(b) - x1) < 5})
    if not rows:
        return None
    up = [(a, min(b, d), max(b, d)) for a, b, c, d in lines if abs(c - a) < 2 and abs(d - b) > 25 and x0 - 5 < a < x1 + 5]
    cols = [a for a, lo, hi in up if lo < rows[0] + 20 and hi > rows[-1] - 20] or [a for a, lo, hi in up if hi > rows[0] - 5 and lo < rows[-1] + 5]
    return x0, x1, rows, sorted({round(a, 1) for a in cols}) or [x0, x1]


def found(df):
    return {r["head_seq"]: (r["x0"], r["x1"], list(r["row_ys"]), list(r["col_xs"])) for r in df.collect()}


def test_narrow_frames_and_frames_without_verticals(spark):
    cases = [
        ([h(200, 240, 120), h(200, 240, 140), h(200, 240, 160), v(200, 120, 160), v(240, 120, 160)], (200, 100), 3, [200, 240]),
        ([h(200, 260, 130), h(200, 260, 150), h(200, 260, 170)], (210, 100), 3, [200, 260]),
        ([h(200, 260, 130), h(200, 260, 150), h(200, 260, 170), v(230, 135, 165)], (210, 100), 3, [230]),
    ]
    for lines, head, n, cols in cases:
        got = found(T.line_bounds(*frames(spark, lines, [head])[:2]))[0]
        assert len(got[2]) == n and got[3] == cols and got == by_hand(lines, *head)


def test_bounds_against_the_sequential_form(spark):
    r = random.Random(3)
    lines = []
    for _ in range(60):
        x, w = r.choice([100, 103, 107, 111, 400, 900]) + r.random(), r.choice([30, 120, 123, 127, 350, 900])
        lines.append(h(x, x + w, r.randrange(50, 900) + r.choice([0.0, 0.04, 0.5])))
    lines += [v(r.randrange(90, 1200), r.randrange(40, 300), r.randrange(330, 950)) for _ in range(25)]
    r.shuffle(lines)
    heads = [(r.randrange(0, 1300), r.randrange(0, 800)) for _ in range(25)] + [(9000, 9000)]
    got = found(T.line_bounds(*frames(spark, lines, heads)[:2]))
    want = {k: b for k, head in enumerate(heads) if (b := by_hand(lines, *head)) is not None}
    assert got == want


def test_second_table_and_words_alone(spark):
    lines = [h(100, 300, y) for y in (120, 140, 160)] + [h(420, 620, y) for y in (118, 140, 160, 180)]
    words = [("Наименование", 500, 560, 121, 131), ("светильник", 450, 500, 145, 150)]
    got = {(r["table_no"], r["method"], r["x0"], r["x1"], len(r["row_ys"])) for r in T.legend_tables(*frames(spark, lines, [(110, 100)], words)).collect()}
    assert got == {(1, "lines", 100.0, 300.0, 3), (2, "lines", 420.0, 620.0, 4)}
    columns = [("Обозначение", 100, 150, 110, 118), ("Наименование", 200, 260, 110, 118), ("1А", 105, 115, 130, 138), ("Щит", 210, 230, 132, 140), ("2", 105, 112, 150, 158), ("далеко", 1500, 1550, 150, 158)]
    row = T.legend_tables(*frames(spark, [], [(90, 100)], columns)).collect()[0]
    assert (row["method"], row["x0"], row["x1"], row["y0"], row["y1"]) == ("header words", 80.0, 790.0, 100.0, 163.0)
    assert row["row_ys"] == [100.0, 130.0, 150.0] and row["col_xs"] == [80.0, 190.0, 690.0, 790.0]
    plain = [("1", 100, 108, 130, 138), ("Светильник", 140, 200, 130, 138), ("2А", 100, 112, 150, 158), ("Розетка", 140, 190, 151, 159)]
    row = T.legend_tables(*frames(spark, [], [(90, 100)], plain)).collect()[0]
    assert (row["method"], row["x0"], row["x1"], row["y1"]) == ("equipment words", 90.0, 210.0, 164.0)
    assert row["row_ys"] == [100.0, 130.0, 150.0] and row["col_xs"] == [90.0, 122.0, 210.0]
    assert T.legend_tables(*frames(spark, [], [(90, 100)], plain[:2])).count() == 0


def test_rows_of_two_symbols(spark):
    rows = spark.createDataFrame([(1, 1, k, 100.0, 200.0, 400.0, 240.0, 150.0) for k in range(3)], "file_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double, symbol_x1 double")
    symbols = spark.createDataFrame([(1, 1, k, k * 10 + j, t, 105.0 + j, top, top + 8) for k in range(3) for j, (t, top) in enumerate([("4", 202.0), ("4АЭ", 225.0)]) if k != 2 or j == 0], "file_id int, page int, row int, seq int, text string, x0 double, top double, bottom double")
    marks = [(1, 1, "line", 1, 110.0, 205.0, 130.0, 205.0, "blue"), (1, 1, "rect", 2, 110.0, 230.0, 130.0, 236.0, "red"), (1, 1, "rect", 3, 110.0, 231.0, 130.0, 237.0, "red"), (1, 1, "line", 4, 0.0, 220.0, 900.0, 220.0, "grey"), (1, 1, "line", 5, 110.0, 206.0, 112.0, 206.0, "black")]
    marks = spark.createDataFrame(marks, "file_id int, page int, kind string, seq int, x0 double, y0 double, x1 double, y1 double, color_class string")
    got = sorted((r["seq"], r["part"], r["symbol"], r["y0"], r["y1"], r["color"]) for r in T.sub_rows(rows, symbols, marks).collect())
    assert got == [(0, 1, "4", 200.0, 217.5, "blue"), (0, 2, "4АЭ", 217.5, 240.0, "red"), (1, 1, "4", 200.0, 217.5, "blue"), (1, 2, "4АЭ", 217.5, 240.0, "red"), (2, 1, "4", 200.0, 240.0, "red")]
    one = T.sub_rows(rows, symbols, marks.where("color_class <> 'blue'")).where("seq = 0").collect()
    assert [(r["part"], r["symbol"], r["color"]) for r in one] == [(1, "4", "red")]
