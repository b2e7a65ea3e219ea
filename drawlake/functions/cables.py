"""Column functions on cable and wire texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.functions import rules as R

#: Brands, and how type and length are written.
CABLE_TYPE = r"((?:ВБШвнг|ВБбШвнг|ВВГнг|ППГнг|АВВГнг|КГнг|АПвПу|ПвПу)(?:\([А-Яа-яA-Za-z]+\))?-[A-Z]+\s+[0-9]+[хx×][0-9]+[.,]?[0-9]*|(?:ПуВВнг|ПуВВ|ПВС|ПВ[13]|ШВВП|ППВ|АПВ)(?:\([А-Яа-яA-Za-z]+\))?(?:-[A-Z]+)?\s+[0-9]+[хx×][0-9]+[.,]?[0-9]*)"
LENGTH = r"L\s*[=-]\s*([0-9]+)"
VOLTAGE_DROP = r"[Δ∆]U\s*=\s*([0-9]+[.,][0-9]+)\s*%"
_PLACE = r"в\s+(?:кабель[- ]канале|гофре|лотке|трубе\s+ПНД|траншее)"
LAYING = rf"(?iu)({_PLACE}(?:\s*,\s*{_PLACE})*)"
SECTION = r"(?iu)([0-9]+)\s*[хx×]\s*([0-9]+[.,]?[0-9]*)"


def parse_cable(c: Column) -> Column:
    """(type, length_m): the first cable or wire type, its sign of multiplication made ×, and the first length."""
    kind = F.regexp_extract(c, CABLE_TYPE, 1)
    length = F.regexp_extract(c, LENGTH, 1)
    return F.struct(F.when(kind != "", F.translate(kind, "хx", "××")).alias("type"), F.when(length != "", length.try_cast("int")).alias("length_m"))


def sheet_lengths(c: Column) -> Column:
    """Every length from 1 to 5000 that follows a brand within 60 characters of a plan's text."""
    found = F.regexp_extract_all(c, F.lit(r"(?iu)(?:ВБШвнг|ВБбШвнг|ВВГнг|ППГнг|АВВГнг|КГнг|АПвПу|ПвПу|ПуВВнг|ПуВВ|ПВС)[^,;]{0,60}L\s*[=-]\s*([0-9]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.between(1, 5000))


def laying_method(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(c, LAYING, 1)))


def cable_suffix(c: Column) -> Column:
    """Voltage drop and laying method, which tell cables of one type and length apart; empty if neither is given."""
    drop = F.replace(F.regexp_extract(c, VOLTAGE_DROP, 1), F.lit(","), F.lit(".")).try_cast("double").cast("string")
    lay = laying_method(c)
    return F.concat_ws("|", drop, F.when(lay != "", lay))


def split_laying(c: Column) -> Column:
    """The parts of a combined method with their shares: tray and conduit 0.9 to 0.1, others alike."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    pair = (n == 2) & F.exists(parts, lambda p: F.contains(p, F.lit("лотке"))) & F.exists(parts, lambda p: F.contains(p, F.lit("гофре")))

    def share(p):
        return F.struct(p.alias("method"), F.when(pair, F.when(F.contains(p, F.lit("лотке")), 0.9).otherwise(0.1)).otherwise(F.lit(1.0) / n).alias("share"))

    return F.when(n <= 1, F.array(F.struct(c.alias("method"), F.lit(1.0).alias("share")))).otherwise(F.transform(parts, share))


def cores(c: Column) -> Column:
    return F.regexp_extract(c, SECTION, 1).try_cast("int")


def gauge(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, SECTION, 2), F.lit(","), F.lit(".")).try_cast("double")


def brand_family(c: Column) -> Column:
    b = F.regexp_replace(F.trim(F.regexp_replace(c, SECTION, "")), r"[ -]+$", "")
    return F.when(b == "", c).otherwise(b)


def normal_brand(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(ППГнг)\(", "$1-(")


def is_wire(c: Column) -> Column:
    return brand_family(c).rlike("^(?:" + "|".join(R.WIRE_PREFIXES) + ")")


def cable_attrs(c: Column) -> Column:
    """What a cable type says: cores, section, brand, conduit, weight and the classes that work rows name."""
    n, s = cores(c), gauge(c)
    total = F.coalesce(n * s, F.lit(0.0))
    table = F.create_map(*[x for (k, v), w in R.CABLE_WEIGHTS.items() for x in (F.lit(f"{k}|{v}"), F.lit(w))])
    weight = F.coalesce(F.try_element_at(table, F.concat_ws("|", n.cast("string"), s.cast("string"))), 0.012 * n * s + 0.05 * n)

    def upto(v, limits, text, unit):
        out = None
        for k in limits:
            label = f"{text} {k} {unit}"
            out = F.when(v <= k, label) if out is None else out.when(v <= k, label)
        return out.otherwise(f"{text} {limits[-1]} {unit}")

    conduit = None
    for limit, d in R.CONDUIT_LIMITS:
        conduit = F.when(s <= limit, d) if conduit is None else conduit.when(s <= limit, d)
    described = F.regexp_extract(F.trim(c), r"(?iu)^(.*?)\s+([0-9]+[хx×][0-9]+[.,]?[0-9]*)(.*)$", 1)
    size = F.replace(F.translate(F.regexp_extract(F.trim(c), r"(?iu)^(.*?)\s+([0-9]+[хx×][0-9]+[.,]?[0-9]*)(.*)$", 2), "×x", "хх"), F.lit("."), F.lit(","))
    rest = F.trim(F.regexp_extract(F.trim(c), r"(?iu)^(.*?)\s+([0-9]+[хx×][0-9]+[.,]?[0-9]*)(.*)$", 3))
    noun = F.when(is_wire(c), "Провод").otherwise("Кабель")
    text = F.when(size != "", F.concat_ws(" ", noun, normal_brand(described), F.lit("сечением"), size, F.when(rest != "", rest))).otherwise(F.concat_ws(" ", noun, F.trim(c)))
    return F.struct(
        n.alias("cores"), s.alias("section"), total.alias("total_section"), brand_family(c).alias("brand"), normal_brand(brand_family(c)).alias("normal_brand"), is_wire(c).alias("is_wire"),
        F.coalesce(n, F.lit(3)).alias("conductors"), F.when(s.isNull(), 20).otherwise(conduit.otherwise(32)).alias("conduit_mm"),
        F.when(s.isNull(), "").otherwise(upto(weight, R.MASS_LIMITS, "массой до", "кг")).alias("mass_class"),
        F.when(total <= 0, "").otherwise(upto(total, R.SECTION_LIMITS, "суммарное сечение до", "мм2")).alias("section_class"), text.alias("material"),
    )


def reversed_length(c: Column) -> Column:
    """The metres that a length written backwards gives: 'м52=L' is 25; null for other words."""
    n = F.regexp_extract(F.reverse(c), r"^L=([0-9]+(?:[,.][0-9]+)?)м$", 1)
    return F.when(n != "", F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))


def reversed_brand(c: Column) -> Column:
    """The brand that a word written backwards holds; null if none."""
    b = F.reverse(F.regexp_extract(c, "(" + "|".join(R.REVERSED_BRANDS) + ")", 1))
    return F.when(b != "", b)


def is_cross_section(c: Column) -> Column:
    """Whether a word is a cable's cross-section: no paper size, bracket, third dimension, nor cores or gauge too large."""
    n, g = F.regexp_extract(c, r"^([0-9]+)[хxХX]([0-9]+(?:[,.][0-9]+)?)$", 1).try_cast("double"), F.replace(F.regexp_extract(c, r"^([0-9]+)[хxХX]([0-9]+(?:[,.][0-9]+)?)$", 2), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(~c.rlike(r"(?iu)^[AА][0-9][хx][0-9]$") & ~c.rlike(r"[()]") & (n <= 19) & (g <= 95), F.lit(False))


def normalize_section(c: Column) -> Column:
    return F.translate(c, "xX", "хх")


def reverse_section(c: Column, fix_size: bool = False) -> Column:
    """A section of a page written backwards: '5,1х3' gives '3х5,1', with ``fix_size`` '3х1,5'; null if it is none."""
    pattern = r"^([0-9]{1,4}(?:[,.][0-9]{1,2})?)[хxХX]([0-9]{1,2})$"
    size, n = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(n != "", F.concat(n, F.lit("х"), F.reverse(size) if fix_size else size))
