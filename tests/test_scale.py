"""Steps that must not grow faster than their input: what they deal, compare or broadcast, and that results stay the same."""

from pyspark.sql import functions as F

from drawlake.operators import compare, graph, iterative, legends, rollup, schedules, sequences, spatial, tables
from drawlake.sources import drawings


def test_routes_hang_equal_ends_on_one(spark, monkeypatch):
    """Segments that meet in one place give an edge each, not one for each two of them."""
    edges = []
    own = iterative.components
    monkeypatch.setattr(iterative, "components", lambda e: edges.append(e.distinct().count()) or own(e))
    s = [(1, i, 0.0, 0.0, 100.0 + 10 * i, 5.0) for i in range(60)] + [(1, 60, 1.9, -1.9, 0.0, 900.0), (1, 61, 0.0, 902.0, 9.0, 999.0), (1, 62, 15.5, 899.0, 50.0, 50.0)]
    df = spark.createDataFrame(s, "file_id int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = iterative.routes(df, ("file_id",)).collect()
    assert sorted(r.n_segments for r in got) == [1, 1, 61]
    assert edges[0] < 2 * len(s)


def test_legend_checks_are_counted_not_paired(spark):
    """4000 items of one symbol and look are 8 million pairs, which the check must not make."""
    items = [(1, i, "7" if i < 4000 else "", "red" if i % 2 else "blue", i % 3) for i in range(4003)] + [(2, 1, "a", "red", 0), (2, 2, "b", "red", 1), (2, 3, "c", None, 9)]
    df = spark.createDataFrame(items, "file_id int, seq int, symbol string, color string, look int")
    near = spark.createDataFrame([(1, 0, 1, 0.95), (2, 0, 1, 0.95), (2, 9, 9, 0.95)], "file_id int, a int, b int, score double")
    got = compare.validate_legend(df, near)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "a_seq" not in plan
    status = {(r.file_id, r.seq): r.status for r in got.collect()}
    assert len(status) == len(items) and {status[1, i] for i in range(4000)} == {"unresolvable"}
    # of the last three two look alike, blue both and without text; those of file 2 carry different text
    assert [status[1, i] for i in (4000, 4001, 4002)] == ["unresolvable", "ok", "unresolvable"] and [status[2, i] for i in (1, 2, 3)] == ["conflict", "conflict", "ok"]


def test_confusable_entries_meet_by_their_other_words(spark):
    df = spark.createDataFrame([(1, i, f"светильник вид {i} {('левый', 'правый')[i % 2]}") for i in range(40)] + [(1, 90, "светильник вид 5 левый"), (1, 91, "вид 5 правый светильник")], "file_id int, symbol int, description string")
    got = compare.confusable_pairs(df, ("левый", "правый"))
    assert {(r.a, r.b) for r in got.collect()} == {(5, 90), (90, 91)}
    assert "_core" in got._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_hold_no_list_of_a_page(spark):
    df = spark.range(3000).selectExpr("1 AS file_id", "id AS seq", "id DIV 3 * 20.0 + id % 3 * 3 AS y")
    got = sequences.cluster_by_anchor(df, ["file_id"], "y", 5.0)
    assert {(r.seq, r.cluster) for r in got.collect()} == {(i, i // 3 * 2 + (i % 3 == 2)) for i in range(3000)}
    assert "_run" in got._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_rows_are_not_broadcast(spark):
    """A table's size is guessed before its rows are dealt to cells, so that its copies would go to the driver."""
    p = spark.range(50).selectExpr("1 AS file_id", "id AS seq", "id * 3.0D AS x", "0.0D AS y")
    b = p.selectExpr("file_id", "x AS b0", "y AS b1", "x + 4 AS b2", "y + 4 AS b3")
    for got, n in ((spatial.near_pairs(p, p, ["file_id"], 3.0), 148), (spatial.box_join(p, b, ["file_id"], ("x", "y", "x", "y"), ("b0", "b1", "b2", "b3")), 99)):
        assert got.count() == n
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_panels_told_apart_by_seq_alone(spark):
    """A circuit that two drawings show counts once, at the nearer panel; a panel that two show has the nearest breaker of both."""
    at = lambda *rows: spark.createDataFrame(rows, "file_id int, seq int, x double, y double, text string")
    texts, breakers = at((1, 1, 0.0, 0.0, "ЩР1"), (2, 1, 0.0, 0.0, "ЩР1")), at((1, 5, 9.0, 0.0, "QF1"), (2, 6, 2.0, 0.0, "QF2"))
    circuits = at((1, 8, 1.0, 0.0, "c"), (2, 8, 4.0, 0.0, "c"), (2, 9, 4.0, 0.0, "c"))
    got = lambda **more: sorted((r.file_id, r.breaker, r.circuit_count) for r in schedules.panels(texts, breakers, circuits, **more).collect())
    assert got(ids=("seq",)) == [(1, "QF2", 2), (2, "QF2", 2)]
    assert got() == [(1, "QF1", 1), (2, "QF2", 2)]
    found = spark.createDataFrame([(1, 1, "ЩО1", 0.0, 0.0), (2, 1, "ЩО1", 0.0, 0.0)], "file_id int, seq int, name string, x double, y double")
    words = spark.createDataFrame([(1, 7, "н1 ППГнг що-1"), (2, 6, "н2 ППГнг що-1"), (2, 8, "KM-1")], "file_id int, seq int, text string")
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, f"QF{i}.1") for i in range(3)], "file_id int, table_id int, x double, y double, text string")
    rows = lambda **more: sorted((r.file_id, r.feed, r.circuit_count) for r in schedules.panel_details(found, words, cells, **more).collect())
    assert rows() == [(1, "н1 ППГнг що-1", 3), (2, "н2 ППГнг що-1", 1)]
    assert rows(ids=("seq",)) == [(f, "н2 ППГнг що-1", 3) for f in (1, 1, 2, 2)]


def test_rows_are_not_dealt_by_their_text(spark, monkeypatch):
    """Of few texts each has many rows: they stay where they are; of many texts a frequent one is dealt in parts."""
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id < 150 THEN 'hot' ELSE concat('t', id) END AS text")
    for few in (graph.FEW, 3):
        monkeypatch.setattr(graph, "FEW", few)
        got = graph.once(df, "text", n=F.length("text"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (few > 3) and ("_salt" in plan) == (few == 3)
        assert {(r.id, r.n) for r in got.collect()} == {(i, 3 if i < 150 else 4) for i in range(200) if i % 50}
        kept = graph.once(df, "text", nulls=True, n=F.coalesce(F.length("text"), F.lit(-1))).collect()
        assert len(kept) == 200 and {r.n for r in kept if r.id % 50 == 0} == {-1}


def test_bill_reads_a_name_once(spark):
    """Works are told from distinct names, and an item whose height is unknown keeps its material row."""
    equip = spark.createDataFrame([(p, "socket", "Розетка 1", h, 2) for p in range(40) for h in ("до 5 метров", None)], "project int, category string, name string, height string, count int")
    cables = spark.createDataFrame([(p, "ППГнг(А)-HF 3×1,5", "в лотке", 9) for p in range(40)], "project int, cable_type string, method string, length_m int")
    got = rollup.assemble_bill(equip, cables)
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r.number, r.line, r.qty) for r in got.where("project = 7").collect()]
    assert sorted(rows) == [(n, line, q) for n, q in ((1, 2), (2, 2), (3, 9)) for line in (0, 1)]


def test_nearest_of_few_makes_no_pairs(spark):
    """Each left row meets its drawing's few right rows as one list; ties go to the smaller seq, also for the k nearest."""
    a = spark.range(90).selectExpr("id % 3 AS file_id", "id AS seq", "id * 1.0D AS x", "5.0D AS y")
    b = spark.range(60).selectExpr("id % 3 AS file_id", "99 - id AS seq", "id DIV 3 * 4.0D AS x", "5.0D AS y").where("file_id < 2")
    right = [tuple(r) for r in b.collect()]
    for k in (1, 3):
        got = spatial.nearest(a, b, ["file_id"], metric="l1", k=k)
        want = {(r.seq, n + 1, *m) for r in a.collect() for n, m in enumerate(sorted((abs(r.x - x), s) for f, s, x, _ in right if f == r.file_id)[:k])}
        assert {(r.l_seq, r.place if k > 1 else 1, r.dist, r.r_seq) for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "min_by" not in plan and "row_number" not in plan


def test_serial_choice_in_few_rounds(spark, monkeypatch):
    """All may want all, yet rounds are few; the pairs are those of rows that choose one after another."""
    import random

    rnd, rounds = random.Random(3), []
    own = iterative.checkpointed
    monkeypatch.setattr(iterative, "checkpointed", lambda df: rounds.append(1) or own(df))
    lists = {(g, a): rnd.sample(range(40), 40 if g else 3) for g in range(2) for a in range(30)}
    rows = [(g, a, b, p) for (g, a), bs in lists.items() for p, b in enumerate(bs)]
    got = iterative.serial_match(spark.createDataFrame(rows, "g int, a int, b int, p int"), ["g"], "a", "b", "p")
    want, taken = set(), set()
    for (g, a), bs in sorted(lists.items()):
        b = next((b for b in bs if (g, b) not in taken), None)
        taken.add((g, b))
        want |= {(g, a, b)} if b is not None else set()
    assert {tuple(r) for r in got.collect()} == want and len(rounds) < 40


def test_elevations_in_parts_of_so_many_rows(spark, monkeypatch):
    """A task's rows are as many in a larger table, and only rows without an elevation meet their project's."""
    monkeypatch.setattr(graph, "PART", 50)
    rows = [(p, f"s{k % 2}", float(k % 3) if p < 19 else 7.0, f"n{k % 9}", "socket", 1) for p in range(20) for k in range(60)] + [(p, "s0", None, "n0", "socket", 5) for p in (18, 19)]
    df = spark.createDataFrame(rows, "project int, plan_type string, elevation double, name string, category string, count int")
    for given in (None, len(rows)):
        got = rollup.merge_elevations(df, rows=given)
        assert got.rdd.getNumPartitions() >= len(rows) / 50
        sums = {(r.project, r.height, r.name): r["count"] for r in got.collect()}
        low, next_ = rollup.LABELS[:2]
        # the project of one elevation takes its loose row there: 4 of s0 and 3 of s1 have the name n0; elsewhere it stays apart
        assert sums[19, next_, "n0"] == 9 and (19, low, "n0") not in sums and sums[18, low, "n0"] == sums[0, low, "n0"] + 5


def test_lines_are_sorted_once(spark):
    """Names, units and numbers follow one another in one order; of matches that share a line every other one holds."""
    lines = ["a", "шт", "2", "шт", "3", "шт", "4", "b", "шт.", "5", "", "шт", "6", "c", "шт", "x", "d", "шт", "7"]
    df = spark.createDataFrame([(f, 10 * i, text) for f in range(3) for i, text in enumerate(lines)], "file_id int, seq int, text string")
    got = drawings.bill_from_lines(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want = {(f, *r) for f in range(3) for r in ((0, "a", 2), (40, "3", 4), (70, "b", 5), (160, "d", 7))}
    assert {tuple(r) for r in got.collect()} == want


def test_marks_meet_rows_once(spark, monkeypatch):
    """A row's parts are told apart where its marks meet it; a mark goes to cells of its own size only where boxes are as small."""
    joins, own = [], tables.box_join
    monkeypatch.setattr(tables, "box_join", lambda *a: joins.append(a) or own(*a))
    rows = spark.createDataFrame([(1, 1, s, 0.0, 100.0 * s, 300.0, 100.0 * s + 40, 50.0) for s in range(3)], "file_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double, symbol_x1 double")
    numbers = [(1, 1, s, text, 5.0, 100.0 * s + top, 100.0 * s + top + 8) for s in range(2) for text, top in (("1", 2.0), ("2", 25.0))]
    symbols = spark.createDataFrame(numbers, "file_id int, page int, row int, text string, x0 double, top double, bottom double")
    drawn = [(0, "red", 3.0), (0, "blue", 30.0), (0, "blue", 36.0), (1, "red", 3.0), (1, "black", 30.0)]
    marks = spark.createDataFrame([(1, 1, "line", i, 9.0, 100.0 * s + y, 17.0, 100.0 * s + y, c) for i, (s, c, y) in enumerate(drawn)], "file_id int, page int, kind string, seq int, x0 double, y0 double, x1 double, y1 double, color_class string")
    got = {(r.seq, r.part): (r.symbol, r.y0, r.y1, r.color) for r in tables.sub_rows(rows, symbols, marks).collect()}
    assert got == {(0, 1): ("1", 0.0, 17.5, "red"), (0, 2): ("2", 17.5, 40.0, "blue"), (1, 1): ("1", 100.0, 140.0, "red"), (2, 1): (None, 200.0, 240.0, "")}
    assert len(joins) == 1
    plan = own(*joins[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "array(3)" not in plan


def test_legend_items_are_grouped_once(spark):
    """What the methods found is written once: the result reads that, not the items again."""
    cols = "file_id int, page int, method string, tolerance int, seq int, symbol string, description string, x0 double, y0 double, x1 double, y1 double"
    found = [(1, 1, 1, "a", "first one"), (1, 1, 2, "b", "second"), (1, 2, 3, "A", "the longer first one"), (1, 2, 4, "c", None), (2, 1, 5, "a", "x"), (2, 2, 6, "A", "y")]
    items = spark.createDataFrame([(f, p, "spec", None, s, symbol, text, 1.0 * p, 0.0, 9.0, 9.0) for f, p, s, symbol, text in found], cols)
    got = legends.legend_of_file(items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert {(r.file_id, r.best_page, r.seq, r.x0) for r in got.collect()} == {(1, 1, 2, 1.0), (1, 1, 3, 1.0), (1, 1, 4, 1.0), (2, 1, 5, 1.0)}


def test_small_bills_are_matched_without_pairs(spark, monkeypatch):
    """Rows of a bill choose in turn in one task; bills too large for that choose in rounds, and get the same."""
    import random
    from difflib import SequenceMatcher

    rnd, rounds = random.Random(5), []
    own = iterative.serial_match
    monkeypatch.setattr(iterative, "serial_match", lambda *a: rounds.append(1) or own(*a))
    words = ["насос", "клапан", "задвижка", "фильтр", "led", "50 вт", "ip65", "щщ"]
    names = lambda: {" ".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(12)}
    bills = [(c, sorted(names()), sorted(names())) for c in range(9)] + [(None, ["насос"], ["насос"]), (10, [], ["led"]), (11, ["led"], [])]
    gen, ref = (spark.createDataFrame([(b[0], n, 1.0) for b in bills for n in b[side]], f"case int, name string, {q} double") for side, q in ((1, "total"), (2, "qty")))
    want = set()
    for c, g, r in bills[:-3]:
        left = [n for n in g if n not in r]
        want |= {(c, n, n, 1.0) for n in g if n in r}
        for n in r:
            if n not in g:
                score, k = max(((SequenceMatcher(None, n, t).ratio(), -i) for i, t in enumerate(left)), default=(0, 0))
                if score >= 0.45:
                    want.add((c, n, left.pop(-k), score))
    for limit in (compare.PAIRS, 20):
        monkeypatch.setattr(compare, "PAIRS", limit)
        got = compare.reconcile(gen, ref).collect()
        assert {(r.case, r.ref_name, r.gen_name, r.score) for r in got if r.score is not None} == want
        assert sum(r.score is None for r in got) == sum(len(g) + len(r) for _, g, r in bills) - 2 * len(want)
        assert len(rounds) == (limit == 20)


def test_annotations_choose_without_pairs(spark, monkeypatch):
    """Entries of one text are a queue: what an annotation fits is not written out. Large files, in rounds, give the same."""
    import random

    from drawlake.operators import turns

    rnd, rounds = random.Random(4), []
    own = iterative.serial_match
    monkeypatch.setattr(iterative, "serial_match", lambda *a: rounds.append(1) or own(*a))
    colors, kinds = ["red", "blue", "old", "new"], ["ring", "bolt", "plate"]
    text = lambda n: " ".join(rnd.sample(colors, 2) + [rnd.choice(kinds)] + ["led", str(rnd.randrange(10, 13))][:n])
    legend = [(f, s, str(s), text(2)) for f in range(3) for s in rnd.sample(range(200), 60)]
    notes = [(f, s, text(rnd.choice((0, 1, 2))), 1) for f in range(3) for s in rnd.sample(range(200), 50)]
    want, taken = set(), set()
    for f, s, name, _ in sorted(notes):
        words = set(name.split())
        numbers = {w for w in words if w.isdigit()}
        found = [(-len(words & set(d.split())) / len(words), b) for g, b, _, d in legend if g == f and (f, b) not in taken and numbers <= set(d.split())]
        share, b = min(found, default=(0, 0))
        if share <= -0.6:
            taken.add((f, b))
            want.add((f, s, b))
    a = spark.createDataFrame(notes, "file_id int, seq long, name string, count int")
    b = spark.createDataFrame(legend, "file_id int, seq int, symbol string, description string")
    for limits in ({}, {"REMEMBERED": 5}, {"ONE_TASK": 20, "BUCKETS": 2}):
        for k, v in limits.items():
            monkeypatch.setattr(turns, k, v)
        got = compare.enrich_annotations(a, b).collect()
        assert {(r.file_id, r.a_seq, r.b_seq) for r in got if r.a_seq is not None and r.b_seq is not None} == want and len(got) == len(notes) + len(legend) - len(want)
        assert len(rounds) == ("ONE_TASK" in limits)


def kept_in_order(points, fits):
    """Seqs that stay of (seq, x, y): rows of one seq stay or go together, rows without a seq or place stay and keep none off."""
    out, places = set(), []
    for s in sorted({p[0] for p in points if p[0] is not None}):
        own = [p for p in points if p[0] == s and None not in p]
        if not any(fits(p, q) for p in own for q in places):
            out.add(s)
            places += own
    return out


def test_dense_points_make_no_pairs(spark, monkeypatch):
    """Of thousands of points in one place the first stays, and no two of them are written as a pair; nor are a large drawing's."""
    import math
    import random

    from drawlake.operators import turns

    rnd, paired = random.Random(6), []
    own = spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda left, right, *a, **k: paired.append((left, right)) or own(left, right, *a, **k))
    monkeypatch.setattr(iterative, "suppressed", None)
    rows = [(1, s, rnd.gauss(0, 4), rnd.gauss(0, 4)) for s in rnd.sample(range(900), 900)] + [(2, s % 40, rnd.uniform(-90, 90), rnd.uniform(0, 30)) for s in range(60)]
    rows += [(2, 50, None, 1.0), (2, 51, float("nan"), 1.0), (2, None, 0.0, 0.0), (None, 1, 0.0, 0.0), (None, 1, 0.0, 0.0), (3, 7, 10.0, 0.0), (3, 5, 0.0, 0.0), (3, 9, 20.0, 0.0)]
    df = spark.createDataFrame(rows, "page int, seq long, x double, y double")
    far = lambda p, q: math.dist(p[1:], q[1:]) < 10
    want = {(g, s) for g in (1, 2, 3) for s in kept_in_order([r[1:] for r in rows if r[0] == g and r[2] == r[2]], far)}
    want |= {(2, 51), (2, None), (None, 1)}
    for limit in (turns.ONE_TASK, 50):
        monkeypatch.setattr(turns, "ONE_TASK", limit)
        got = [(r.page, r.seq) for r in iterative.dedup_points(df, ["page"], 10.0).collect()]
        assert set(got) == want and len(got) == sum((r[0], r[1]) in want for r in rows)
        assert bool(paired) == (limit == 50)
    # what is left of a large page meets the few that stay
    assert all(right.count() < 120 for _, right in paired)


def test_anchors_are_found_without_pairs(spark, monkeypatch):
    """Each row goes to the first anchor that fits, in one pass over its drawing; large drawings get the same."""
    import random

    from drawlake.operators import turns

    rnd, paired = random.Random(7), []
    for module in (spatial, tables):
        own = module.near_pairs
        monkeypatch.setattr(module, "near_pairs", lambda *a, own=own, **k: paired.append(1) or own(*a, **k))
    rows = [(f, s if f else s % 70, rnd.randrange(40) / 2, rnd.randrange(80) / 2, s) for f in range(3) for s in rnd.sample(range(90), 90)]
    rows += [(1, 95, None, 0.0, 0), (None, 1, 0.0, 0.0, 0), (1, None, 0.0, 0.0, 0)]
    want = []
    for f in range(3):
        fits = lambda p, q: abs(p[1] - q[1]) < 5 and abs(p[2] - q[2]) < 5
        own = [r[1:4] for r in rows if r[0] == f and None not in r]
        heads = kept_in_order(own, fits)
        first = {s: min(q[0] for p in own for q in own if p[0] == s and q[0] in heads and fits(p, q)) for s, _, _ in own}
        want += [(*r, first[r[1]]) for r in rows if r[0] == f and None not in r]
    df = spark.createDataFrame(rows, "file_id int, seq long, rx0 double, rx1 double, n int")
    for limit in (turns.ONE_TASK, 30):
        monkeypatch.setattr(turns, "ONE_TASK", limit)
        got = tables.anchor_groups(df, ["file_id"], "rx0", "rx1")
        assert sorted(tuple(r) for r in got.select(*df.columns, "anchor").collect()) == sorted(want)
        assert bool(paired) == (limit == 30)
