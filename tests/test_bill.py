"""The whole bill of a project: a worked example of each section, numbers and places, edge cases."""

import random

from pyspark.sql import functions as F

from drawlake.operators import bill, schedules

ITEM = "project string, seq long, kind string, name string, unit string, height string, qty double"
CABLE = "project string, seq long, cable_type string, count long, total_length_m long, laying array<struct<method:string,m:long>>"
PANEL = "project string, seq long, name string, breaker string, circuit_count long, has_feed boolean"
DERIVED = "project string, what string, size int, qty long"
LOW, MIDDLE = "до 5 метров", "от 5 до 13 метров"


def tables(spark, items=(), cables=(), panels=(), derived=()):
    return [spark.createDataFrame(list(x), s) for x, s in ((items, ITEM), (cables, CABLE), (panels, PANEL), (derived, DERIVED))]


def listed(df, project="p"):
    rows = sorted((r["place"], r["level"], r["number"], r["name"], r["unit"], r["qty"], r["formula"]) for r in df.where(F.col("project") == project).collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    numbers = [r[2] for r in rows if r[1] == "work"]
    assert numbers == list(range(1, len(numbers) + 1)) and all(r[2] is None for r in rows if r[1] != "work")
    return [(r[1][0], r[3], r[5]) for r in rows]


def test_sections_of_a_whole_bill(spark):
    items = [
        ("p", 1, "spec_panel", "Щит ЩО-1", "шт", None, 1.0), ("p", 2, "spec_panel", "Щит ЩР-9", "шт", None, 2.0),
        ("p", 3, "luminaire", "SLICK.PRS", "шт", LOW, 4.0), ("p", 4, "luminaire", "MARS 2", "шт", LOW, 3.0), ("p", 5, "luminaire", "ARCTIC", "шт", LOW, 2.0), ("p", 3, "luminaire", "SLICK.PRS", "шт", MIDDLE, 1.0),
        ("p", 6, "indicator", "Указатель", "шт", LOW, 2.0), ("p", 7, "pictogram", "Выход", "шт", LOW, 5.0), ("p", 7, "pictogram", "Выход", "шт", MIDDLE, 1.0),
        ("p", 8, "switch", "Выключатель", "шт", None, 6.0), ("p", 9, "socket", "Розетка", "шт", None, 0.0), ("p", 10, "outlet", "Кабельный вывод", "шт", None, 2.0),
        ("p", 11, "material", "Хомут", "шт", None, 7.5), ("p", 12, "spec_cable", "ВВГнг(А)-LS 3х1,5 с запасом", "м", None, 9.0), ("p", 13, "spec_cable", "КГ 1х16", "м", None, 8.0),
        ("p", 14, "tray", None, "м", MIDDLE, 30.0), ("p", 15, "tray_item", "Лоток 100х50", "м", None, 12.0),
        ("p", 16, "pvc", "Труба ПВХ д.20мм", "м", None, 50.0), ("p", 17, "pvc", "Держатель д.20мм", "шт", None, 60.0),
        ("p", 18, "grounding", "Коробка уравнивания потенциалов", "шт", None, 1.0), ("p", 19, "grounding", "Стержень заземления", "шт", None, 3.0), ("p", 20, "grounding", "Полоса 40х4", "м", None, 25.0),
    ]
    cables = [
        ("p", 1, "ВВГнг(А)-LS 3х1,5", 2, 100, [("в гофре", 60), ("в лотке", 40)]), ("p", 2, "ВВГнг(А)-LS 5х2,5", 1, 50, [("в лотке", 50)]), ("p", 3, "ВВГнг(А)-LS 5х25", 1, 20, None),
        ("p", 4, "ППГнг(А)-HF 3х1,5", 1, 30, [("в земле", 30)]), ("p", 5, "ПуВВнг 1х6", 1, 10, None),
    ]
    panels = [("p", 1, "ЩО-1", "QF1 25A/3", 8, True), ("p", 2, "ЩАО", None, 0, False)]
    derived = [("p", "connections", None, 40), ("p", "boxes_lighting", None, 6), ("p", "sleeves", None, 15), ("p", "shrink", None, 10), ("p", "steel_sleeves", None, 5), ("p", "foam", None, 1), ("p", "conduit", 20, 70), ("p", "conduit", 16, 100), ("p", "holders", 16, 125)]
    shares = spark.createDataFrame([("p", LOW, 300), ("p", MIDDLE, 100)], "project string, height string, length_m long")
    got = listed(bill.section_bill(*tables(spark, items, cables, panels, derived), shares))
    w = "Прокладка кабеля "
    want = [
        ("s", "Щитовое оборудование", None), ("w", "Монтаж щита распределительного ЩО-1", "1"), ("w", "Монтаж щита распределительного ЩАО", "1"), ("w", "Монтаж Щит ЩР-9", "2"), ("w", "Подключение жил кабелей до 10 мм2", "40"),
        ("s", "Монтаж светильников и ламп", None), ("w", f"Монтаж светильников на шпильках к перекрытию на высоте {LOW}:", "6"), ("m", "Светодиодный светильник SLICK.PRS", "4"), ("m", "Светодиодный светильник ARCTIC", "2"),
        ("w", f"Монтаж настенного светодиодного светильника на высоте {LOW}:", "3"), ("m", "Светодиодный светильник MARS 2", "3"), ("w", f"Монтаж светильников на шпильках к перекрытию на высоте {MIDDLE}:", "1"), ("m", "Светодиодный светильник SLICK.PRS", "1"),
        ("w", f"Монтаж настенного указателя светодиодного (с пиктограммой) {LOW}:", "2"), ("m", "Указатель", "2"), ("m", "Выход", "5"),
        ("s", "Монтаж электроустановочных изделий", None), ("w", "Монтаж Выключатель", "6"), ("w", "Монтаж Кабельный вывод", "2"), ("w", "Монтаж коробки распределительной 85x85x40 мм", "6"),
        ("w", "Соединение жил кабелей методом опрессовки", ""), ("m", "Луженая гильза ГМЛ", "15"), ("m", "Термоусадочная трубка ТТК (4:1)", "10"),
        ("s", "Монтажные изделия и материалы", None), ("w", "Хомут", "7.5"),
        ("s", "Кабель ВВГнг(А)-LS", None), ("w", f"{w}(массой до 2 кг) в лотке на высоте {LOW}", "15"), ("m", "Кабель ВВГнг(А)-LS сечением 5х25", "15"),
        ("w", f"{w}в гофре на высоте {LOW} (суммарное сечение до 6 мм2):", "45"), ("m", "Кабель ВВГнг(А)-LS сечением 3х1,5", "45"), ("w", f"{w}в лотке на высоте {LOW}:", "68"), ("m", "Кабель ВВГнг(А)-LS сечением 3х1,5", "30"), ("m", "Кабель ВВГнг(А)-LS сечением 5х2,5", "38"),
        ("w", f"{w}(массой до 2 кг) в лотке на высоте {MIDDLE}", "5"), ("m", "Кабель ВВГнг(А)-LS сечением 5х25", "5"), ("w", f"{w}в гофре на высоте {MIDDLE} (суммарное сечение до 6 мм2):", "15"), ("m", "Кабель ВВГнг(А)-LS сечением 3х1,5", "15"),
        ("w", f"{w}в лотке на высоте {MIDDLE}:", "22"), ("m", "Кабель ВВГнг(А)-LS сечением 3х1,5", "10"), ("m", "Кабель ВВГнг(А)-LS сечением 5х2,5", "12"),
        ("s", "Кабель ППГнг-(А)-HF", None), ("w", "Прокладка кабеля в земле", "22"), ("m", "Кабель ППГнг-(А)-HF сечением 3х1,5", "22"), ("w", "Прокладка кабеля в земле", "8"), ("m", "Кабель ППГнг-(А)-HF сечением 3х1,5", "8"),
        ("s", "Провод", None), ("w", "Прокладка провода с медной многопроволочной жилой, допускающего частые изгибы. Размотка провода с барабана", "10"), ("m", "Провод ПуВВнг сечением 1х6", "10"),
        ("s", "Кабельная продукция (дополнительно по спецификации)", None), ("w", "Кабель КГ 1х16", "8"),
        ("s", "Монтаж кабельных лотков и соединительных деталей", None), ("w", f"Лоток металлический штампованный по установленным конструкциям, ширина лотка: до 200 мм, высота {MIDDLE}:", "30"), ("w", "Лоток 100х50", "12"),
        ("m", "Соединительная пластина для лотка", "10"), ("m", "Угол горизонтальный 90 гр.", "2"), ("m", "Т-ответвитель", "1"), ("m", "Консоль / подвес для лотка", "20"), ("m", "Анкерный болт с гайкой", "20"), ("m", "Болт, гайка, шайба (комплект крепежа)", "44"),
        ("w", "Выполнение проходки кабеля через стены", ""), ("m", "Двухкомпонентная огнестойкая пена, DN1201", "1"), ("m", "Гильза закладная труба сталь ВГП Ду 20 (Дн 26,8x2,5) ГОСТ 3262-75", "5"),
        ("s", "Монтаж ПВХ изделий и труб", None), ("w", "Держатель д.20мм", "60"), *[row for h, (t, a, b) in ((LOW, (112, 38, 75)), (MIDDLE, (38, 12, 25))) for row in (
            ("w", f"Монтаж гофрированной трубы ПВХ гибкой гофр. с креплением клипсами каждые 0,8 метра на высоте {h}:", str(t)), ("m", "Труба ПВХ гибкая гофр. д.20мм, лёгкой с протяжкой", str(a)), ("m", "Труба ПВХ гибкая гофр. д.16мм, лёгкой с протяжкой", str(b)))],
        ("m", "Держатель оцинкованный двусторонний, д.16мм, с крепежными отверстиями 6,5 х 5 мм", "125"),
        ("s", "Монтаж системы заземления", None), ("w", "Разработка грунта для прокладки горизонтального заземлителя.", "9,6"), ("w", "Засыпка траншеи (под горизонтальное заземление).", "9,6"), ("w", "Забивка стержень заземления", "3"), ("w", "Прокладка полоса 40х4", "25"),
        ("w", "Монтаж системы уравнивания потенциалов", ""), ("w", "Установка коробка уравнивания потенциалов", "1"),
        ("s", "Монтаж системы молниезащиты", None), ("m", "[Заполнить вручную из проекта молниезащиты]", ""),
        ("s", "Пусконаладочные работы", None), ("w", "Измерение сопротивления изоляции", "7"), ("w", "Определение целостности жил кабеля и фазировка кабельной линии", "7"), ("w", "Проверка наличия цепи между заземлителями и заземленными элементами", "14"), ("w", "Лаборатория передвижная монтажно-измерительная", "3"),
        ("w", "Проверка срабатывания автоматических выключателей в щите ЩО-1 (однополюсных/трехполюсных)", "8/1"), ("w", "Проверка срабатывания автоматических выключателей в щите ЩАО (однополюсных/трехполюсных)", "1"), ("w", "Проверка осветительной сети на правильность зажигания групп внутреннего освещения", "2"),
    ]
    assert got == want


def test_bills_of_little(spark):
    none = bill.section_bill(*tables(spark))
    assert none.count() == 0
    items = [("a", 1, "pictogram", "Выход", "шт", LOW, 2.0), ("a", 1, "pictogram", "Выход", "шт", MIDDLE, 3.0), ("a", 2, "switch", "Коробка", "шт", None, None), ("a", 3, "material", "Гильза ГМЛ", "шт", None, 4.0), ("b", 1, "spec_cable", "КГ", None, None, 2.0), (None, 1, "switch", "x", "шт", None, 1.0), ("a", 5, "switch", None, "шт", None, 1.0)]
    cables = [("c", 1, "ВВГ 3х1,5", 2, 9, None), ("c", 1, None, 2, 9, None)]
    derived = [("a", "boxes_power", None, 3), ("a", "sleeves", None, 3), ("a", "shrink", None, 3), ("a", "connections", None, 3), ("c", "foam", None, 3), ("c", "boxes_power", None, 2)]
    df = bill.section_bill(*tables(spark, items, cables, [], derived)).cache()
    blank = [("s", "Монтаж ПВХ изделий и труб", None), ("m", "[Заполнить вручную]", ""), ("s", "Монтаж системы заземления", None), ("m", "[Заполнить вручную из проекта заземления]", ""), ("s", "Монтаж системы молниезащиты", None), ("m", "[Заполнить вручную из проекта молниезащиты]", ""), ("s", "Пусконаладочные работы", None)]
    a = listed(df, "a")
    assert a[:6] == [("s", "Монтаж светильников и ламп", None), ("w", "Выход", "5"), ("s", "Монтаж электроустановочных изделий", None), ("w", "Монтаж Коробка", "0"), ("s", "Монтажные изделия и материалы", None), ("w", "Гильза ГМЛ", "4")]
    assert a[6:13] == blank and [x[2] for x in a[13:]] == []
    assert listed(df, "b") == [("s", "Кабельная продукция (по спецификации)", None), ("w", "Кабель КГ", "2"), *blank]
    c = listed(df, "c")
    assert c[:2] == [("s", "Монтаж электроустановочных изделий", None), ("w", "Монтаж коробки соединительной с кабельными вводами 100x100x50 мм", "2")]
    assert ("w", "Затяжка кабеля в гофрированные трубы", "9") in c and ("m", "[Гофротруба ПВХ -- марка и количество по кабеленесущим планам]", "") in c
    assert {r["formula"] for r in df.where("formula is not null").collect()} == {"~2 линий (уточнить по планам)"}
    df.unpersist()


def test_places_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), k, r.random() < 0.5) for k in range(500)]
    got = bill.place_rows(spark.createDataFrame(rows, "project string, k long, w boolean").repartition(7), ["project"], ["k"], F.col("w")).collect()
    want = []
    for p in "ab":
        n = 0
        for place, (_, k, w) in enumerate(sorted(x for x in rows if x[0] == p), 1):
            n += w
            want.append((p, k, place, n if w else None))
    assert sorted((x["project"], x["k"], x["place"], x["number"]) for x in got) == sorted(want, key=lambda x: x[:2])


def test_panels_feeds_and_circuits(spark):
    found = spark.createDataFrame([("f", 1, "ЩО-1", 0.0, 0.0), ("f", 2, "ЩАО-1", 100.0, 0.0), ("f", 3, "ЩР-12", 0.0, 100.0), ("f", 4, "ЩР-1", 500.0, 500.0), ("g", 1, "ЩО-1", None, None)], "file_id string, seq long, name string, x double, y double")
    texts = [("f", 1, "н2 ППГнг щ р 12"), ("f", 2, "н1 ВБШв ЩР-1\nвторая строка ППГ"), ("f", 3, "ЩО-1 ППГ"), ("f", 4, "н5 КГ ЩО-1"), ("f", 5, None), ("g", 1, "KM-1"), *(("f", 6 + k, f"KM-{k}") for k in range(3)), ("f", 20, "KM-1a")]
    cells = [("f", 1, 90.0, 1.0, f"QF-1.{k}") for k in range(4)] + [("f", 2, 120.0, 0.0, "QF2.1"), ("f", 3, 10.0, 10.0, "QF 1.1"), ("f", 3, 10.0, 10.0, "QF1"), ("f", 4, 0.0, 0.0, None)]
    got = schedules.panel_details(found, spark.createDataFrame(texts, "file_id string, seq long, text string"), spark.createDataFrame(cells, "file_id string, table_id long, x double, y double, text string"))
    assert sorted((r["file_id"], r["name"], r["feed"], r["circuit_count"]) for r in got.collect()) == sorted([
        ("f", "ЩО-1", None, 3), ("f", "ЩАО-1", None, 4), ("f", "ЩР-12", "н2 ППГнг щ р 12", 0), ("f", "ЩР-1", "н2 ППГнг щ р 12", 0), ("g", "ЩО-1", None, 1)], key=lambda r: (r[0], r[1]))
    assert schedules.panel_details(found.limit(0), spark.createDataFrame([], "file_id string, seq long, text string"), spark.createDataFrame([], "file_id string, table_id long, x double, y double, text string")).count() == 0


def test_works_and_places_take_one_shuffle(spark):
    entry = "project string, part int, sub long, head string, a int, b int, work string, own string, unit string, name string, m long, adds boolean, line int, seq long, pos int"
    rows = [("p", 1, 5, "h", 0, 0, w, "", "шт", f"{w}{k}", k, w != "z" and k != 3, 1, 10 - k, 0) for w in "xyz" for k in (1, 2, 3)]
    got = bill._grouped(spark.createDataFrame(rows, entry).repartition(3), ["project"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["line"], r["name"], r["qty"], r["c"], r["d"], r["e"]) for r in got.collect()) == sorted(
        [(0, w, "3", 7, 0, 0) for w in "xy"] + [(1, f"{w}{k}", str(k), 7, 0, 10 - k) for w in "xy" for k in (1, 2, 3)])
    df = spark.range(1000).selectExpr("concat('p', id % 7) AS project", "id AS k", "id % 3 = 0 AS w", "'long' AS dropped")
    placed = bill.place_rows(df, ["project"], ["k"], F.col("w"), keep=["project", "k"])
    assert placed.columns == ["project", "k", "place", "number"] and "Exchange hashpartitioning(project" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["place"], r["number"]) for r in placed.where("project = 'p1'").collect()) == [(k, n + 1, sum(x % 3 == 0 for x in range(1, k + 1, 7)) if k % 3 == 0 else None) for n, k in enumerate(range(1, 1000, 7))]
