"""Column functions on names and texts of drawings. All are Catalyst expressions; nulls stay null unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.functions import rules as R


def first_of(c: Column, rules: R.Rules, otherwise: str) -> Column:
    """The label of the first rule with a keyword in the lower-cased text."""
    low = F.lower(c)
    out = None
    for label, words in rules:
        test = low.rlike("|".join(map(re.escape, words)))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(c.isNotNull(), out.otherwise(otherwise))


def strip_mtext(c: Column) -> Column:
    """Drawing text without its markup: braced codes are unwrapped three levels deep, breaks become line feeds."""
    for _ in range(3):
        for pattern in (r"\{\\f[^;]*;([^}]*)\}", r"\{\\C[0-9]+;([^}]*)\}", r"\{\\[A-Za-z][^;]*;([^}]*)\}"):
            c = F.regexp_replace(c, pattern, "$1")
    c = F.regexp_replace(c, r"\\P", "\n")
    for pattern in (r"\\f[^;]*;", r"\\p[^;]*;", r"\\[A-Za-z][^;]*;", r"\\L", r"[{}]"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_mtext_line(c: Column) -> Column:
    """The same on one line."""
    return F.regexp_replace(F.regexp_replace(strip_mtext(c), r"\s*\n\s*", " "), r"^\s+|\s+$", "")


def _page_map(read_as: str, written_in: str) -> tuple[str, str, str]:
    """(characters of the upper half as wrongly read, as meant, and all that the wrong page can hold)."""
    wrong, right = [], []
    for b in range(128, 256):
        try:
            wrong.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            continue
        try:
            right.append(bytes([b]).decode(written_in))
        except UnicodeDecodeError:
            wrong.pop()
    return "".join(wrong), "".join(right), "".join(wrong)


def recover_cyrillic(c: Column) -> Column:
    """A name whose bytes were read in a wrong code page, put right by the first pair of pages that gives Cyrillic."""
    tries = []
    for read_as, written_in in R.CODE_PAGES:
        wrong, right, known = _page_map(read_as, written_in)
        outside = F.translate(c, known, "")
        fixed = F.translate(c, wrong, right)
        tries.append(F.when(~outside.rlike(r"[^\x00-\x7F]") & fixed.rlike(r"[Ѐ-ӿ]"), fixed))
    garbled = ~c.rlike(r"[Ѐ-ӿ]") & c.rlike(r"[\u0080-ÿ]")
    return F.when(garbled, F.coalesce(*tries, c)).otherwise(c)


def _plan_type(c: Column) -> Column:
    low = F.lower(c)
    spec = (low.startswith("со") & (F.length(c) < 10)) | F.contains(low, F.lit("спецификац"))
    known = first_of(c, R.PLAN, "другое")
    return F.when(known != "другое", known).when(spec, "спецификация").otherwise(known)


def classify_plan(c: Column) -> Column:
    """The plan type of a file name; names that say nothing are tried again with their code page put right."""
    plain = _plan_type(c)
    return F.when(plain == "другое", _plan_type(recover_cyrillic(c))).otherwise(plain)


_ELEVATION = r"(?iu)на отм[-._ ]*([+-]?[0-9]+[-.,][0-9]+)"


def elevation_str(c: Column) -> Column:
    raw = F.regexp_extract(c, _ELEVATION, 1)
    return F.when(raw != "", F.replace(raw, F.lit(","), F.lit("."))).when(F.contains(F.lower(c), F.lit("кровл")), "roof")


def elevation_float(c: Column) -> Column:
    raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, _ELEVATION, 1), "[,-]", "."), r"^\+", "")
    return F.when(raw != "", raw.try_cast("double"))


def elevations_all(c: Column) -> Column:
    """Every elevation that follows the first mark, in metres."""
    tail = F.regexp_extract(c, r"(?iu)на отм[-._ ]*(.*)$", 1)
    return F.transform(F.regexp_extract_all(tail, F.lit(r"([+-]?[0-9]+[.,][0-9]+)"), F.lit(1)), parse_elevation)


def parse_elevation(c: Column) -> Column:
    v = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"^\+", "").try_cast("double")
    return F.when(F.abs(v) >= 100, v / 1000).otherwise(v)


def height_category(c: Column) -> Column:
    out = None
    for limit, label in R.HEIGHTS:
        out = F.when(c < limit, label) if out is None else out.when(c < limit, label)
    return F.when(c.isNotNull(), out.otherwise(R.HIGHEST))


def normalize_name(c: Column) -> Column:
    """A name without the first luminaire prefix that it starts with, blanks made single."""
    pattern = "^(?:" + "|".join(R.LUMINAIRE_PREFIXES) + ")"
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), pattern, ""), r"\s+", " "))


def classify_equipment(c: Column) -> Column:
    low = F.lower(c)
    skip = "|".join(map(re.escape, R.EQUIPMENT[0][1])) + r"|[0-9]+\s*мм\s*[xх×]\s*[0-9]+\s*мм"
    made_up = F.contains(c, F.lit("[?")) | F.contains(c, F.lit("[Auto"))
    later = first_of(c, R.EQUIPMENT[1:], "")
    return F.when(low.rlike(skip), "skip").otherwise(F.coalesce(F.nullif(later, F.lit("")), F.when(made_up, "skip").otherwise("luminaire")))


def classify_specification(c: Column) -> Column:
    low = F.lower(c)
    led = F.contains(low, F.lit("led")) & ~F.contains(low, F.lit("розетк"))
    upper = F.nullif(first_of(c, R.SPECIFICATION[:5], ""), F.lit(""))
    return F.coalesce(upper, F.when(led, "luminaire").otherwise(first_of(c, R.SPECIFICATION[5:], "material")))


def first_match(c: Column, patterns, otherwise: str) -> Column:
    """The label of the first (label, pattern) that is found in the text."""
    out = None
    for label, pattern in patterns:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return F.when(c.isNotNull(), out.otherwise(otherwise))


def legend_category(c: Column) -> Column:
    return first_of(c, R.LEGEND, "")


def text_bill_category(c: Column) -> Column:
    return first_of(c, R.TEXT_BILL, "Unknown")


def bill_class(c: Column) -> Column:
    return first_match(F.lower(c), R.BILL, "other")


def mounting_type(c: Column) -> Column:
    return first_match(c, [(label, f"(?iu){p}") for label, p in R.MOUNTING], "stud")


def normalize_unit(c: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(c), r"\.+$", ""))
    table = F.create_map(*[F.lit(x) for kv in R.UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.trim(c))


def section_type(c: Column) -> Column:
    """The design section that a path names: by folder, by a delimited code in the file name, by its prefix."""
    up, name = F.upper(c), F.upper(F.regexp_extract(c, r"([^/\\]*)$", 1))
    order = ("ЭОМ", "ЭО", "ЭМ", "ЭГ")
    out = None
    for test in (lambda s: up.rlike(rf"(^|[/\\]){s}[/\\]"), lambda s: name.rlike(rf"[-_. ]{s}([-_. ]|$)"), lambda s: name.startswith(s)):
        for s in order:
            out = F.when(test(s), s) if out is None else out.when(test(s), s)
    return out


def section_type_loose(c: Column) -> Column:
    """The first section code that stands anywhere in the path; '' for none."""
    return first_match(F.upper(c), [(s, s) for s in ("ЭО", "ЭМ", "ЭГ", "ЭС")], "")


def drawing_no(c: Column) -> Column:
    n = F.regexp_extract(c, r"^\s*([0-9]{3})", 1)
    return F.when(n != "", n)


def bill_key(c: Column) -> Column:
    """The form of a bill row's name that is compared."""
    c = F.lower(F.trim(c))
    for pattern, to in R.KEY_REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(F.trim(c), r"[,.:; ]+$", "")


def _detail(name: Column, category: str) -> Column:
    """What a work of a category says of the thing itself; the whole name where nothing is left of it."""
    if category == "panel":
        found = F.trim(F.regexp_extract(name, "(?iu)" + R.PANEL_NAME, 1))
    else:
        found = name
        for pattern, to in R.DETAILS.get(category, R.DETAILS[""]):
            found = F.regexp_replace(found, "(?iu)" + pattern, to)
        found = F.trim(found)
    return F.when(found == "", name).otherwise(found)


def map_work(c: Column, unit: Column | None = None) -> Column:
    """(category, work, unit) of an equipment name; ``unit`` is the source's, for names of no category. A blank name has no work."""
    source = normalize_unit(F.coalesce(unit, F.lit("шт"))) if unit is not None else F.lit("шт")
    name = F.trim(c)
    rule = None
    for k, (_, pattern, _, _) in enumerate(R.WORKS):
        hit = F.lower(name).rlike(pattern)
        rule = F.when(hit, k) if rule is None else rule.when(hit, k)

    def made(v: Column) -> Column:
        details = None
        for category in dict.fromkeys(w[0] for w in R.WORKS if w[0] in R.DETAILS or w[0] == "panel"):
            hit, own = v["rule"].isin(*(k for k, w in enumerate(R.WORKS) if w[0] == category)), _detail(v["name"], category)
            details = F.when(hit, own) if details is None else details.when(hit, own)
        with_detail = v["rule"].isin(*(k for k, w in enumerate(R.WORKS) if w[2].endswith("{}")))
        of = lambda i: F.get(F.array(*(F.lit(w[i].removesuffix("{}")) for w in R.WORKS)), v["rule"])
        work = F.when(with_detail, F.concat(of(2), details.otherwise(_detail(v["name"], "")))).otherwise(of(2))
        known = F.struct(of(0).alias("category"), F.regexp_replace(F.trim(work), r"\s{2,}", " ").alias("work"), of(3).alias("unit"))
        other = F.struct(F.lit("other").alias("category"), F.concat(F.lit("Монтаж "), v["name"]).alias("work"), v["unit"].alias("unit"))
        blank = F.struct(F.lit("unknown").alias("category"), F.lit("").alias("work"), v["unit"].alias("unit"))
        return F.when(v["name"] == "", blank).when(v["rule"].isNotNull(), known).otherwise(other)

    # the rule is found once, however many of its fields are read
    found = F.transform(F.array(F.struct(name.alias("name"), rule.alias("rule"), source.alias("unit"))), made)
    return F.when(c.isNotNull(), found[0])


def model_core(c: Column) -> Column:
    """What is left of a lit sign's name without the words for the sign and what it says, in small letters."""
    bare = F.trim(F.regexp_replace(c, "(?iu)" + R.SIGN_NAME, ""))
    return F.lower(F.trim(F.regexp_replace(bare, "(?iu)" + R.SIGN_TEXT, " ")))


def grounding_work(c: Column) -> Column:
    """The work row of an earthing part: its work, and the name with a small first letter."""
    return F.concat_ws(" ", first_of(c, R.GROUNDING_WORKS, "Монтаж"), F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


def pvc_diameters(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?iu)(?:д|d)[.\s]*([0-9]{2})\s*(?:мм)?"), F.lit(1)), lambda x: x.cast("int"))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([0-9a-zA-Z_а-яА-ЯёЁ]+)"), F.lit(1)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger count; 0 where either has none."""
    ta, tb = tokens(a), tokens(b)
    most = F.greatest(F.size(ta), F.size(tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / most).otherwise(0.0)


def long_text_cut(c: Column, limit: int = 120) -> Column:
    """A long text up to its first sentence's end, or else to the last word that fits."""
    sentence = F.regexp_extract(c, r"^(.{10,}?[.;])\s", 1)
    words = F.regexp_extract(F.substring(c, 1, limit), r"^(.*)\s[^\s]*$", 1)
    return F.when(F.length(c) <= limit, c).when((sentence != "") & (F.length(sentence) <= limit), sentence).when(words != "", words).otherwise(F.substring(c, 1, limit))


def is_title_block(c: Column) -> Column:
    """Whether a text is of a title block: one of its words, a date, or words run together."""
    words = F.arrays_overlap(F.split(F.trim(c), r"\s+"), F.array(*[F.lit(w) for w in R.TITLE_WORDS]))
    return words | c.rlike(r"[0-9]{2}\.[0-9]{2}\.[0-9]{2,4}") | c.rlike("|".join(map(re.escape, R.TITLE_PARTS)))


def strip_notes(c: Column) -> Column:
    """A description without what follows a note's first words; empty if it begins with one or under five characters are left."""
    # of several notes the earliest cuts
    cut = F.regexp_replace(c, "(?ius)[ .,;:]*(?:" + "|".join(map(re.escape, R.NOTES)) + ").*$", "")
    return F.when(F.length(F.trim(cut)) < 5, "").otherwise(cut)


def split_on_duplicates(c: Column) -> Column:
    """A text up to the second occurrence of its first repeated word of five Cyrillic letters, if ten characters stand before it."""
    low = F.lower(c)
    found = F.transform(F.regexp_extract_all(c, F.lit("([А-ЯЁа-яё]{5,})"), F.lit(1)), F.lower)
    word = F.try_element_at(F.filter(found, lambda x, i: F.array_contains(F.slice(found, F.lit(1), i), x)), F.lit(1))
    at = F.call_function("locate", word, low, F.call_function("locate", word, low) + 1)
    first = F.regexp_replace(F.substring(c, F.lit(1), at - 1), r"[ .,;:]+$", "")
    return F.when((at > 11) & (F.length(first) >= 10), first).otherwise(c)


def clean_description(c: Column) -> Column:
    """A description that is too long cut to its first sentence, else at a repeated word, else at a blank."""
    most = R.LONGEST_DESCRIPTION
    sentence = F.trim(F.split(c, r"(?<=\.)\s+(?=[A-ZА-ЯЁ])", 2)[0])
    text = F.when((F.length(sentence) < F.length(c)) & (F.length(sentence) <= most), sentence).otherwise(F.when(F.length(sentence) < F.length(c), sentence).otherwise(c))
    once = split_on_duplicates(text)
    head = F.substring(once, 1, most)
    words = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    cut = F.regexp_replace(F.when(F.length(words) > most // 2, words).otherwise(head), r"[ .,;:]+$", "")
    return F.when(F.length(c) <= most, c).when(F.length(once) <= most, once).otherwise(cut)


def is_placeholder(c: Column) -> Column:
    return F.trim(c).rlike(r"^\[.*\]$")


def is_suspicious(c: Column) -> Column:
    """Whether a description is too long or speaks of the sheet, not of equipment."""
    return (F.length(c) > R.LONGEST_DESCRIPTION) | c.rlike("(?iu)" + R.SUSPICIOUS)


def is_char_split(c: Column) -> Column:
    """Whether over half of the tokens have at most two characters."""
    t = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(t) == 0, False).otherwise(F.size(F.filter(t, lambda x: F.length(x) <= 2)) * 2 > F.size(t))


def is_non_countable(c: Column) -> Column:
    return c.rlike("^(?:" + "|".join(R.NON_COUNTABLE_PREFIXES) + ")")


def is_auto_detected(c: Column) -> Column:
    return c.rlike(r"(?iu)^\[Auto-detected\s|^\[Обозначение\s")


def reverse_words(df, text_col: str = "text"):
    """``df`` with its text written backwards, its geometry as it was."""
    return df.withColumn(text_col, F.reverse(F.coalesce(F.col(text_col), F.lit(""))))
