"""Matching and scoring: bills, drawings of two formats, legends."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from drawlake.functions.text import bill_key, drawing_no, is_non_countable, model_core, normalize_name, tokens

Keys = Sequence[str]


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks; for pairs that are alike enough in their characters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def pair_files(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """Drawings of two sets with the same number, the first path of each."""
    first = lambda df, name: df.withColumn("number", drawing_no(F.regexp_extract(path, r"([^/\\]*)$", 1))).where("number is not null").groupBy("number").agg(F.min(path).alias(name))
    return first(a, "path_a").join(first(b, "path_b"), "number")


def alike_candidates(left: DataFrame, right: DataFrame, keys: Keys, threshold: float) -> DataFrame:
    """(keys, left, right, l_text, r_text): all pairs whose ``seq_ratio`` may reach ``threshold``, of (keys, left, l_text) and (keys, right, r_text).

    The characters that two texts match are at most those that they share as multisets, and at least threshold / 2 of both
    lengths must match. Nearly all texts of a bill share that many, so that no index by characters spares comparisons, as single
    characters may match. But drawings share texts: of all that meet in one, each pair of texts is told once.
    """
    met = _met_texts(left, right, keys, threshold)
    return _with_texts(left, right, keys, met).select(*keys, "left", "right", "l_text", "r_text")


def _met_texts(left: DataFrame, right: DataFrame, keys: Keys, threshold: float) -> DataFrame:
    """Distinct (l_text, r_text) that meet under some key and share enough characters."""
    shorter, both = F.least(F.length("l_text"), F.length("r_text")), F.length("l_text") + F.length("r_text")
    texts = [df.where(F.length(c) > 0).select(*keys, c).distinct() for df, c in ((left, "l_text"), (right, "r_text"))]
    met = texts[0].join(texts[1], list(keys)).where(shorter >= threshold / 2 * both - 1e-9).select("l_text", "r_text").distinct()

    def marked(df, text, name):
        chars = F.sort_array(F.split(text, ""))
        return df.select(text).distinct().select(text, F.transform(chars, lambda c, i: F.concat(c, (i + 2 - F.array_position(chars, c)).cast("string"))).alias(name))

    pairs = met.join(marked(texts[0], "l_text", "_all"), "l_text").join(marked(texts[1], "r_text", "_other"), "r_text")
    return pairs.where(F.size(F.array_intersect("_all", "_other")) >= threshold / 2 * (F.size("_all") + F.size("_other")) - 1e-9).select("l_text", "r_text")


def _with_texts(left: DataFrame, right: DataFrame, keys: Keys, texts: DataFrame) -> DataFrame:
    """Rows of both sides under one key whose texts are a row of ``texts`` (l_text, r_text, more)."""
    return left.join(right, list(keys)).join(texts, ["l_text", "r_text"])


#: Pairs of rows of a bill, and rows of its right side, up to which one task compares them.
PAIRS, RIGHT = 1_000_000, 20_000


def _alike_in_turn(left: DataFrame, right: DataFrame, keys: Keys, threshold: float) -> DataFrame:
    """(keys, ref, gen, score): left rows (ref, l_text), in their order, take the most similar right row (gen, r_text) that is left.

    Of most bills few rows are left: they go in turn, and nothing is paired. In the others all pairs of texts that may be alike are
    compared apart, each once, and rows choose in rounds.
    """
    from drawlake.operators.graph import stored
    from drawlake.operators.iterative import serial_match
    from drawlake.operators.turns import in_turn, most_alike

    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    row = lambda df, side, n, text: df.where(known).select(*keys, F.lit(side).alias("_side"), F.col(n).alias("_n"), F.col(text).alias("_text"))
    both = stored(row(right, 0, "gen", "r_text").unionByName(row(left, 1, "ref", "l_text")), "unmatched")
    sizes = stored(both.groupBy(*keys).agg(F.count_if(F.col("_side") == 1).alias("_l"), F.count_if(F.col("_side") == 0).alias("_r")).where("_l > 0 and _r > 0"), "sizes")
    few = (F.col("_l") * F.col("_r") <= PAIRS) & (F.col("_r") <= RIGHT)
    rows, large = sizes.agg(F.coalesce(F.sum(F.when(few, F.col("_l") + F.col("_r"))), F.lit(0)), F.count_if(~few)).first()
    turns = in_turn(both.join(sizes.where(few).select(*keys), list(keys), "left_semi"), rows, keys, ["_side", "_n"], ["_side", "_n", "_text"], most_alike(threshold), "_at", StructType([StructField("gen", right.schema["gen"].dataType), StructField("score", DoubleType())]))
    found = turns.where("_at is not null").select(*keys, F.col("_n").alias("ref"), "_at.gen", "_at.score")
    if not large:
        return found
    left, right = (df.join(sizes.where(~few).select(*keys), list(keys), "left_semi") for df in (left, right))
    # of the earlier rows each takes one, so that the k-th has one left among its k most similar
    left = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ref")))
    alike = stored(_met_texts(left, right, keys, threshold).repartition("l_text", "r_text").withColumn("score", seq_ratio("l_text", "r_text")).where(F.col("score") >= threshold), "alike")
    scored = _with_texts(left, right, keys, alike).select(*keys, "ref", "gen", "score", "_k")
    scored = scored.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "ref").orderBy(F.desc("score"), "gen"))).where("_p <= _k").drop("_k")
    scored = stored(scored, "scored")
    return found.unionByName(scored.join(serial_match(scored, keys, "ref", "gen", "_p"), [*keys, "ref", "gen"]).select(*keys, "ref", "gen", "score"))


def reconcile(generated: DataFrame, reference: DataFrame, threshold: float = 0.45, keys: Keys = ("case",)) -> DataFrame:
    """Reference and generated bill rows matched one to one: by equal key first, then each reference row, in the order
    of names, takes the most similar generated row that is left. Rows of a side with equal keys are one, with their sum.

    ``generated``: (keys, name, total); ``reference``: (keys, name, qty). Status: matched, quantity, missing, extra.
    """
    from drawlake.operators.graph import once, stored

    def numbered(df, q, side):
        rows = once(df, "name", nulls=True, _key=bill_key(F.col("name")))
        rows = rows.groupBy(*keys, F.col("_key").alias(f"{side}_key")).agg(F.min("name").alias(f"{side}_name"), F.sum(F.col(q).cast("double")).alias(f"{side}_qty"))
        return rows.withColumn(side, F.row_number().over(Window.partitionBy(*keys).orderBy(f"{side}_name", f"{side}_key")))

    g, r = stored(numbered(generated, "total", "gen"), "gen"), stored(numbered(reference, "qty", "ref"), "ref")
    exact = r.withColumnRenamed("ref_key", "key").join(g.withColumnRenamed("gen_key", "key"), [*keys, "key"]).select(*keys, "ref", "gen", F.lit(1.0).alias("score"))
    g2, r2 = g.join(exact.select(*keys, "gen"), [*keys, "gen"], "left_anti"), r.join(exact.select(*keys, "ref"), [*keys, "ref"], "left_anti")
    left = r2.where(F.length("ref_key") > 0).select(*keys, "ref", F.col("ref_key").alias("l_text"))
    right = g2.where(F.length("gen_key") > 0).select(*keys, "gen", F.col("gen_key").alias("r_text"))
    pairs = exact.unionByName(_alike_in_turn(left, right, keys, threshold))
    out = r.join(pairs, [*keys, "ref"], "left").join(g.drop("gen_key"), [*keys, "gen"], "full_outer")
    status = F.when(F.col("gen").isNull(), "missing").when(F.col("ref").isNull(), "extra").when(F.abs(F.col("ref_qty") - F.col("gen_qty")) >= 0.01, "quantity").otherwise("matched")
    return out.select(*keys, "ref_name", "gen_name", "ref_qty", "gen_qty", "score", status.alias("status"))


def accuracy(matches: DataFrame, keys: Keys = ("case",)) -> DataFrame:
    """Shares of reference rows with a right name, and with a right quantity too, by case and overall (null key)."""
    is_ref = F.col("status") != "extra"
    n, name, exact = F.count_if(is_ref), F.count_if(F.col("status").isin("matched", "quantity")), F.count_if(F.col("status") == "matched")
    return matches.rollup(*keys).agg(n.alias("n_reference"), name.alias("n_named"), exact.alias("n_exact"), F.count_if(F.col("status") == "extra").alias("n_extra"), F.round(100.0 * name / F.greatest(n, F.lit(1)), 4).alias("name_pct"), F.round(100.0 * exact / F.greatest(n, F.lit(1)), 4).alias("exact_pct"))


def compare_counts(truth: DataFrame, predicted: DataFrame, keys: Keys = ("name",)) -> DataFrame:
    """Counts of two sources side by side with their difference; a side that lacks a name counts 0."""
    both = truth.select(*keys, F.col("count").alias("truth")).join(predicted.select(*keys, F.col("count").alias("predicted")), list(keys), "full_outer")
    status = F.when(F.col("truth").isNull(), "extra").when(F.col("predicted").isNull(), "missing").when(F.col("truth") == F.col("predicted"), "exact").when(F.abs(F.col("truth") - F.col("predicted")) <= 1, "near").otherwise("off")
    return both.select(*keys, F.coalesce("truth", F.lit(0)).cast("long").alias("truth"), F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"), (F.coalesce("predicted", F.lit(0)) - F.coalesce("truth", F.lit(0))).cast("long").alias("delta"), status.alias("status"))


def compare_named_counts(truth: DataFrame, predicted: DataFrame, threshold: float = 0.45, keys: Keys = ("case",)) -> DataFrame:
    """Counts of two sources whose spelling differs, matched as ``reconcile`` does; ``accuracy`` gives the match rates.

    Both: (keys, name, count). Names that are empty take no part, nor do unread ones ('[?...') of the truth.
    """
    named = F.coalesce("name", F.lit("")) != ""
    t = truth.where(named & ~F.col("name").startswith("[?")).select(*keys, "name", F.col("count").alias("qty"))
    p = predicted.where(named).select(*keys, "name", F.col("count").alias("total"))
    return reconcile(p, t, threshold, keys).withColumn("delta", F.col("gen_qty") - F.col("ref_qty"))


def compare_sources(reference: DataFrame, a: DataFrame, b: DataFrame, keys: Keys = ("name",)) -> DataFrame:
    """Which of two sources has each reference row."""
    out = reference.join(a.select(*keys, F.col("count").alias("a")), list(keys), "left").join(b.select(*keys, F.col("count").alias("b")), list(keys), "left")
    found = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "a").when(F.col("b").isNotNull(), "b").otherwise("none")
    return out.withColumn("found", found)


def _inside(small: DataFrame, large: DataFrame, keys: Keys) -> DataFrame:
    """(keys, small, large): distinct names ``_n`` of one table within names of the other, found by the rarest run of three
    characters of the smaller (all of a shorter one)."""
    runs = lambda k: f"CASE WHEN length(_n) >= {k} THEN transform(sequence(1, length(_n) - {k - 1}), i -> substr(_n, i, {k})) ELSE array() END"
    every = large.select(*keys, F.col("_n").alias("large"), F.explode(F.expr(f"array_distinct(concat(array(''), {runs(1)}, {runs(2)}, {runs(3)}))")).alias("_g"))
    own = small.select(*keys, F.col("_n").alias("small"), F.explode(F.expr(f"CASE WHEN length(_n) < 3 THEN array(_n) ELSE {runs(3)} END")).alias("_g"))
    own = own.join(every.groupBy(*keys, "_g").agg(F.count("*").alias("_c")), [*keys, "_g"], "left")
    own = own.groupBy(*keys, "small").agg(F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_g"))
    return own.join(every, [*keys, "_g"]).where(F.contains("large", "small")).select(*keys, "small", "large")


def not_in_plan(spec: DataFrame, plan: DataFrame, keys: Keys = ("project",), both_ways: bool = False) -> DataFrame:
    """Specification rows whose name no plan row's name contains (or, both ways, is contained in), in any case of letters."""
    names = lambda df: df.select(*keys, F.lower("name").alias("_n")).where("_n is not null").distinct()
    s, p = names(spec), names(plan)
    found = _inside(s, p, keys).select(*keys, F.col("small").alias("_n"))
    if both_ways:
        found = found.unionByName(_inside(p, s, keys).select(*keys, F.col("large").alias("_n")))
    return spec.withColumn("_n", F.lower("name")).join(found.distinct(), [*keys, "_n"], "left_anti").select(*spec.columns)


def signs_not_in_plan(spec: DataFrame, plan: DataFrame, keys: Keys = ("project",)) -> DataFrame:
    """Lit signs of a specification (name, model) that the plan (name) lacks: none of its names holds the row's model or plain name
    (three characters at least), nor do the cores of either (six at least) hold each other."""
    own = spec.select(*keys, "name", "model", F.explode(F.array(F.coalesce("model", F.lit("")), F.coalesce(normalize_name(F.col("name")), F.lit("")))).alias("_t"))
    own = own.select(*keys, "name", "model", F.lower(F.trim("_t")).alias("_n"), model_core(F.col("_t")).alias("_core"))
    there = plan.select(*keys, F.lower("name").alias("_n"), model_core(F.col("name")).alias("_core")).where("_n is not null")
    names = lambda df, c, least: df.select(*keys, F.col(c).alias("_n")).where(F.length("_n") >= least).distinct()
    plain = _inside(names(own, "_n", 3), names(there, "_n", 1), keys).select(*keys, F.col("small").alias("_n")).distinct()
    a, b = names(own, "_core", 6), names(there, "_core", 6)
    cores = _inside(a, b, keys).select(*keys, F.col("small").alias("_core")).unionByName(_inside(b, a, keys).select(*keys, F.col("large").alias("_core"))).distinct()
    known = own.join(plain, [*keys, "_n"], "left_semi").select(*keys, "name", "model").unionByName(own.join(cores, [*keys, "_core"], "left_semi").select(*keys, "name", "model")).distinct()
    same = [spec[k] == known[k] for k in keys] + [spec[c].eqNullSafe(known[c]) for c in ("name", "model")]
    return spec.join(known, same, "left_anti")


def confusable_pairs(legend: DataFrame, apart: Sequence[str], keys: Keys = ("file_id",)) -> DataFrame:
    """Pairs of legend entries told apart by known words only: at least three shared tokens (two for short ones) and an
    overlap of 0.8 (0.6)."""
    known = F.array(*[F.lit(x) for x in apart])
    t = legend.select(*keys, "symbol", F.array_sort(tokens(F.col("description"))).alias("t"))
    # but for the known words two entries' tokens are equal, so that few sets of tokens meet
    core = F.array_except("t", known)
    sets = t.select(*keys, "t").distinct().withColumn("_core", F.array_sort(core))
    a, b = sets.select(*keys, "_core", F.col("t").alias("ta")), sets.select(*keys, "_core", F.col("t").alias("tb"))
    shared, most = F.size(F.array_intersect("ta", "tb")), F.greatest(F.size("ta"), F.size("tb"))
    enough = F.when(most <= 4, (shared >= 2) & (shared / most >= 0.6)).otherwise((shared >= 3) & (shared / most >= 0.8))
    alike = a.join(b, [*keys, "_core"]).where((F.col("ta") != F.col("tb")) & enough).select(*keys, "ta", "tb")
    first, second = (t.select(*keys, F.col("symbol").alias(k), F.col("t").alias(f"t{k}")) for k in "ab")
    return first.join(alike.hint("merge"), [*keys, "ta"]).join(second.hint("merge"), [*keys, "tb"]).where("a < b").select(*keys, "a", "b")


def validate_legend(items: DataFrame, similarity: DataFrame, keys: Keys = ("file_id",), alike: float = 0.9) -> DataFrame:
    """Each legend item as ok, conflict or unresolvable: same symbol twice, or a symbol that looks like another's.

    Items that differ in colour, or carry different text, can be told apart. ``similarity``: (keys, a, b, score) by seq, a < b,
    or, where items have a column ``look`` (how the symbol is drawn), by look, a <= b. An item needs no list of those that it is
    like, only whether there are any and whether one of them has its colour and text, so they are counted. A null symbol or colour is an empty one.
    """
    looks = "look" in items.columns
    rows = items.withColumns({"_symbol": F.coalesce("symbol", F.lit("")), "_color": F.coalesce("color", F.lit("")), "_look": F.col("look" if looks else "seq")})
    i = rows.select(*keys, F.col("_symbol").alias("symbol"), F.col("_color").alias("color"), F.col("_look").alias("look"))
    near = similarity.where(F.col("score") >= alike).where("a <= b" if looks else "a < b").select(*keys, "a", "b").distinct()
    both = near.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("look"), F.col("b").alias("other")), F.struct(F.col("b").alias("look"), F.col("a").alias("other")))).alias("p")).select(*keys, "p.look", "p.other").distinct()

    def met(*same):
        """(keys, look, same, n): rows of the looks that a look is like, itself included where it is like itself."""
        n = i.groupBy(*keys, F.col("look").alias("other"), *same).agg(F.count("*").alias("n"))
        own = both.join(n, [*keys, "other"]).groupBy(*keys, "look", *same)
        return own.agg(F.sum("n").alias("n"), F.max((F.col("look") == F.col("other")).cast("int")).alias("own"))

    looked = met().select(*keys, F.col("look").alias("_look"), (F.col("n") - F.col("own")).alias("_looks"))
    equal = met("symbol", "color").select(*keys, F.col("look").alias("_look"), F.col("symbol").alias("_symbol"), F.col("color").alias("_color"), (F.col("n") - F.col("own")).alias("_equal"))
    named = i.where("symbol <> ''").groupBy(*keys, F.col("symbol").alias("_symbol"), F.col("color").alias("_color")).agg(F.count("*").alias("_m"))
    named = named.withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys, "_symbol")))
    each = rows.join(looked, [*keys, "_look"], "left").join(equal, [*keys, "_look", "_symbol", "_color"], "left").join(named, [*keys, "_symbol", "_color"], "left")
    bad = (F.coalesce("_m", F.lit(1)) > 1) | (F.coalesce("_equal", F.lit(0)) > 0)
    hit = (F.coalesce("_n", F.lit(1)) > 1) | (F.coalesce("_looks", F.lit(0)) > 0)
    return each.select(*items.columns, F.when(bad, "unresolvable").when(hit, "conflict").otherwise("ok").alias("status"))


def merge_legends(items: DataFrame, keys: Keys = ("file_id",)) -> DataFrame:
    """The legend of a file: the page that scores most (1000 a symbol, 10 an item, 1 a description; the earlier on ties),
    and of other pages what a page that brings a new symbol holds; one item a symbol, the longer description wins."""
    it = items.withColumn("_k", F.lower(F.when(F.coalesce("symbol", F.lit("")) != "", F.col("symbol")).otherwise(F.col("description"))))
    page = it.groupBy(*keys, "page").agg((1000 * F.countDistinct(F.when(F.col("symbol") != "", F.col("symbol"))) + 10 * F.count("*") + F.count_if(F.col("description") != "")).alias("score"))
    best = page.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "page"))).where("_p = 1").select(*keys, F.col("page").alias("best_page"))
    it = it.join(best, list(keys))
    main = it.where(F.col("page") == F.col("best_page"))
    other = it.where(F.col("page") != F.col("best_page"))
    fresh = other.where(F.col("symbol") != "").join(main.select(*keys, "_k"), [*keys, "_k"], "left_anti").select(*keys, "page").distinct()
    pool = main.unionByName(other.join(fresh, [*keys, "page"], "left_semi").select(*main.columns))
    return pool.groupBy(*keys, "_k").agg(F.max_by(F.struct("symbol", "description"), F.struct(F.length("description").alias("n"), (F.col("page") == F.col("best_page")).alias("m"), (-F.col("seq")).alias("o"))).alias("i"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).select(*keys, "i.symbol", "i.description", "x0", "y0", "x1", "y1")


def legend_quality(items: DataFrame, keys: Keys = ("case",)) -> DataFrame:
    """Legend items by case and method, and how many lack a symbol or a description."""
    return items.groupBy(*keys, "method").agg(F.count("*").alias("n_items"), F.count_if(F.coalesce("symbol", F.lit("")) == "").alias("no_symbol"), F.count_if(F.length(F.coalesce("description", F.lit(""))) < 8).alias("poor_description"))


def bill_patterns(reference: DataFrame, keys: Keys = ()) -> DataFrame:
    """A reference bill by class and unit: works and materials (by leading verb), distinct names, totals."""
    from drawlake.functions.text import bill_class

    verb = F.lower(F.trim("name")).rlike(r"^(монтаж|установка|прокладка|забивка|крепление|окраска|подключение)\s")
    return reference.groupBy(*keys, bill_class(F.col("name")).alias("class"), "unit").agg(F.count("*").alias("n_rows"), F.count_if(verb).alias("n_works"), F.countDistinct("name").alias("n_names"), F.round(F.sum("qty"), 2).alias("total"))


def _words_in_rounds(a: DataFrame, b: DataFrame, keys: Keys, least: float) -> DataFrame:
    """(keys, a_seq, b_seq): the choices of ``enrich_annotations``, of (keys, a_seq, ta) and (keys, b_seq, tb), by pairs, in rounds."""
    from drawlake.operators.iterative import serial_match

    # equal texts are compared once; an entry is found by the number that fewest entries have or, for want of one, by those
    # rarest words of which it must share one
    ta, tb = a.select(*keys, "ta").distinct(), b.select(*keys, "tb").distinct()
    with_words = tb.select(*keys, "tb", F.explode("tb").alias("_t"))
    often = with_words.groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    number = F.col("_t").rlike("^[0-9]{2,}$")
    ranked = ta.select(*keys, "ta", F.explode("ta").alias("_t")).join(often, [*keys, "_t"], "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_is": number})
    own = Window.partitionBy(*keys, "ta")
    ranked = ranked.withColumns({"_place": F.row_number().over(own.orderBy(F.desc("_is"), "_n", "_t")), "_any": F.max("_is").over(own)})
    probes = F.when(F.col("_any"), 1).otherwise(F.size("ta") - F.ceil(F.size("ta") * least - 1e-9) + 1)
    met = ranked.where(F.col("_place") <= probes).select(*keys, "ta", "_t").join(with_words, [*keys, "_t"]).select(*keys, "ta", "tb").distinct()
    share = F.size(F.array_intersect("ta", "tb")) / F.size("ta")
    numbers = F.filter("ta", lambda w: w.rlike("^[0-9]{2,}$"))
    alike = met.where((F.size(F.array_except(numbers, "tb")) == 0) & (share >= least)).select(*keys, "ta", "tb", share.alias("_share"))
    # the k-th annotation of one set of words can't get any of the first k - 1 entries of its list
    a = a.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "ta").orderBy("a_seq")))
    fits = a.join(alike.hint("merge"), [*keys, "ta"]).join(b.hint("merge"), [*keys, "tb"])
    fits = fits.select(*keys, "a_seq", "b_seq", "_k", F.row_number().over(Window.partitionBy(*keys, "a_seq").orderBy(F.desc("_share"), "b_seq")).alias("_p")).where("_p >= _k")
    return serial_match(fits, keys, "a_seq", "b_seq", "_p")


def enrich_annotations(annotations: DataFrame, legend: DataFrame, keys: Keys = ("file_id",), least: float = 0.6) -> DataFrame:
    """Counted annotations under their legend entries' names: (keys, a_seq, b_seq, symbol, name, count).

    An annotation (seq, name, count) of three words at least takes the entry (seq, symbol, description) that has all its
    numbers of two digits or more and the largest share, ``least`` or more, of its words (Latin or digits). Each entry is
    used once: annotations choose in their order, of equal entries the first. The others keep their names; entries that
    nobody chose come with 0, but for those that aren't counted.
    """
    from drawlake.operators.graph import stored
    from drawlake.operators.turns import best_words, in_turn, sized

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[0-9]+)"), F.lit(1)))
    a = annotations.select(*keys, F.col("seq").alias("a_seq"), words("name").alias("ta")).where(F.size("ta") >= 3)
    b = legend.select(*keys, F.col("seq").alias("b_seq"), words("description").alias("tb")).where(F.size("tb") > 0)
    known = " and ".join(f"`{k}` is not null" for k in (*keys, "_seq"))
    row = lambda df, side, seq, t: df.select(*keys, F.lit(side).alias("_side"), F.col(seq).alias("_seq"), F.array_join(t, " ").alias("_words")).where(known)
    both = row(b, 0, "b_seq", "tb").unionByName(row(a, 1, "a_seq", "ta"))
    rows, large = sized(both, keys)
    few = both if large is None else both.join(large, list(keys), "left_anti").select(*both.columns)
    kind = b.schema["b_seq"].dataType
    turns = in_turn(few, rows, keys, ["_side", "_seq"], ["_side", "_seq", "_words"], best_words(least), "b_seq", kind)
    taken = turns.where("b_seq is not null").select(*keys, F.col("_seq").cast(a.schema["a_seq"].dataType).alias("a_seq"), "b_seq").distinct()
    if large is not None:
        taken = taken.unionByName(_words_in_rounds(*(df.join(large, list(keys), "left_semi") for df in (a, b)), keys, least))
    taken = stored(taken, "taken")
    named = legend.select(*keys, F.col("seq").alias("b_seq"), F.col("symbol").alias("_symbol"), "description")
    own = annotations.withColumnRenamed("seq", "a_seq").join(taken, [*keys, "a_seq"], "left").join(named, [*keys, "b_seq"], "left")
    own = own.select(*keys, "a_seq", "b_seq", F.coalesce("_symbol", F.lit("")).alias("symbol"), F.coalesce("description", "name").alias("name"), F.col("count").cast("long").alias("count"))
    rest = named.join(taken, [*keys, "b_seq"], "left_anti").where(~is_non_countable(F.col("description")))
    return own.unionByName(rest.select(*keys, F.lit(None).cast(own.schema["a_seq"].dataType).alias("a_seq"), "b_seq", F.col("_symbol").alias("symbol"), F.col("description").alias("name"), F.lit(0).cast("long").alias("count")))
