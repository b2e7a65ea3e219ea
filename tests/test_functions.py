import pytest
from pyspark.sql import functions as F

from drawlake.functions import cables as C
from drawlake.functions import geometry as G
from drawlake.functions import text as T

CASES = [
    (lambda c: T.map_work(c)["work"], "ЩР-12", "Монтаж щита распределительного ЩР-12"),
    (lambda c: T.map_work(c)["work"], "Кабель ВВГнг 3х1.5", "Прокладка кабеля ВВГнг 3х1.5"),
    (lambda c: T.map_work(c)["work"], "Розетка РА16-003", "Монтаж розетки РА16-003"),
    (lambda c: T.map_work(c)["category"], "Нечто", "other"),
    *((lambda c: F.to_csv(T.map_work(c, F.lit("компл.")), {"sep": "|"}), name, want) for name, want in (
        ("Светильник светодиодный UNI/R EVO", "luminaire|Монтаж светильника светодиодный UNI/R EVO|шт"),
        ("Светильник светодиодный аварийный", "luminaire_emergency|Монтаж светильника аварийного светодиодный|шт"),
        ("Светильник аварийный MARS 2223-4 LED с пиктограммой", "luminaire_emergency|Монтаж светильника аварийного MARS 2223-4 LED с пиктограммой|шт"),
        ("Указатель EXIT", "luminaire_exit|Монтаж указателя аварийного освещения EXIT|шт"),
        ("Щит ЩО1", "panel|Монтаж щита распределительного ЩО1|комп"), ("ВРУ-1", "panel|Монтаж щита распределительного ВРУ-1|комп"),
        ("Кабель ППГнг-(А)-HF (прокладка)", "cable|Прокладка кабеля ППГнг-(А)-HF|м"), ("Кабель ВВГнг(А)-LS 3x1.5 (ЩО1-Гр.7)", "cable|Прокладка кабеля ВВГнг(А)-LS 3x1.5|м"),
        ("Кабель 1х40 (?-1х40)", "cable|Прокладка кабеля 1х40|м"), ("Кабель ВВГ сеч. 3х2,5", "cable|Прокладка кабеля ВВГ 3х2,5|м"),
        ("Труба ПВХ гибкая гофр. д.16мм", "conduit_pipe|Монтаж трубы гофрированной ПВХ гибкая гофр. д.16мм|м"), ("Датчик движения", "sensor|Монтаж датчика движения|шт"),
        ("УЗО 40А 30мА", "circuit_breaker|Монтаж автоматического выключателя УЗО 40А 30мА|шт"), ("Клеммник WAGO 3x2.5", "terminal|Подключение WAGO 3x2.5|шт"),
        ("Контактор КМИ-10910 9А", "contactor|Монтаж контактора КМИ-10910 9А|шт"), ("Стержень заземления стальной", "ground_rod|Забивка стержня заземления стальной|шт"),
        ("Контур заземления", "grounding|Прокладка заземлителя|м"), ("Электросчетчик Меркурий 230", "other|Монтаж Электросчетчик Меркурий 230|комп"), ("Розетка", "socket|Монтаж розетки Розетка|шт"),
    )),
    (lambda c: C.parse_cable(c)["type"], "ППГнг(А)-HF 3х2,5 в гофре ΔU=0,18% L=13м", "ППГнг(А)-HF 3×2,5"),
    (lambda c: C.parse_cable(c)["length_m"], "ППГнг(А)-HF 3х2,5 в гофре ΔU=0,18% L=13м", 13),
    (C.cable_suffix, "ППГнг(А)-HF 3х2,5 в гофре ΔU=0,18% L=13м", "0.18|в гофре"),
    (lambda c: F.to_json(C.split_laying(c)), "в гофре, в лотке", '[{"method":"в гофре","share":0.1},{"method":"в лотке","share":0.9}]'),
    (C.brand_family, "ППГнг-(А)-HF 3×1.5", "ППГнг-(А)-HF"),
    (lambda c: C.cable_attrs(c)["total_section"], "X 5×16", 80.0),
    (lambda c: C.cable_attrs(c)["mass_class"], "X 5×16", "массой до 2 кг"),
    (lambda c: C.cable_attrs(c)["material"], "ППГнг(А)-HF 3×1.5", "Кабель ППГнг-(А)-HF сечением 3х1,5"),
    (C.is_cross_section, "3х1,5", True),
    (C.is_cross_section, "A3x3", False),
    (C.is_cross_section, "600х800", False),
    (C.reverse_section, "5,1х3", "3х5,1"),
    (lambda c: C.reverse_section(c, fix_size=True), "5,1х3", "3х1,5"),
    (T.drawing_no, "006 - План", "006"),
    (T.drawing_no, "План", None),
    (T.strip_mtext, r"{\fISOCPEUR|b0|i1|c0;text} \Pa{\C1;b}", "text \nab"),
    (T.strip_mtext_line, r"a\Pb", "a b"),
    (T.classify_plan, "План розеточной сети", "розетки"),
    (T.classify_plan, "Схема".encode("cp866").decode("cp850"), "схема"),
    (T.classify_plan, "СО.dwg", "спецификация"),
    (T.elevation_float, "План на отм. +7,800", 7.8),
    (T.elevation_str, "План кровли", "roof"),
    (T.elevations_all, "на отм. +7,800 и +11.100", [7.8, 11.1]),
    (T.parse_elevation, "+7800", 7.8),
    (T.bill_key, "Монтаж светильников светодиодный UNI/R", "светильник uni/r"),
    (T.normalize_unit, "компл.", "комп"),
    (T.section_type, "a/ЭО/x.dwg", "ЭО"),
    (T.section_type, "12-ЭОМ.dwg", "ЭОМ"),
    (T.classify_equipment, "Розетка двойная", "socket"),
    (T.classify_equipment, "[Auto-detected 5]", "skip"),
    (T.classify_specification, "Наклейка на указатель", "material"),
    (T.pvc_diameters, "Труба д.16мм и d20", [16, 20]),
    (T.is_char_split, "а б в слово", True),
]


@pytest.mark.parametrize("f, text, expected", CASES)
def test_column_function(spark, f, text, expected):
    df = spark.createDataFrame([(text,), (None,)], "t string").withColumn("r", f(F.col("t")))
    assert df.where("t is not null").first()["r"] == expected
    df.where("t is null").collect()


def test_colours(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.5],), ([1.0, 1.0, 0.0, 0.0],), (None,)], "c array<double>").withColumn("rgb", G.color_rgb(F.col("c")))
    got = [(r["k"], r["h"]) for r in df.select(G.color_class(F.col("rgb")).alias("k"), G.color_hex(F.col("rgb")).alias("h")).collect()]
    assert got == [("red", "#ff0000"), ("grey", "#808080"), ("blue", "#0000ff"), ("", None)]
