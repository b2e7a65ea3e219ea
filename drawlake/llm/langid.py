"""Language by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (n = 1 to 3) over all its training
texts. A document's own list is held against each profile: the out-of-place distance sums, over the document's
n-grams, how far each one's rank lies from its rank in the profile, with a fixed penalty for those not in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import fold_of

FOLDS, HELD_OUT = 4, 2
TOP = 400
MAX_N = 3
#: Distinct n-grams that a task gathers before it passes its counts on.
GATHER = 200_000
#: Letters of any script, with the marks that follow them.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BITS = 21


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text's words, lower-cased, each word between blanks; a code packs up to three code points.

    Only letters and single blanks are left, so a gram of n characters is told by its highest filled place.
    """
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = c == 32
    parts = [c[~blank]]
    two = (c[:-1] << _BITS) | c[1:]
    parts.append(two)
    # no gram runs over a word's end into the next word
    three = (two[:-1] << _BITS) | c[2:]
    parts.append(three[~blank[1:-1]])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:TOP]]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Each language's profile, counted over all rows with a language; TOP n-grams a language reach the driver."""

    def count(batches):
        held: dict[str, dict[int, int]] = {}

        def flush():
            for lang, c in held.items():
                k, v = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(v)], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part: dict[str, list] = {}
                for text, lang in zip(b.column("text")[at : at + 256], b.column("lang")[at : at + 256]):
                    part.setdefault(lang.as_py(), []).append(grams(text.as_py()))
                for lang, found in part.items():
                    k, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    v = np.bincount(where, np.concatenate([f[1] for f in found]), len(k)).astype(np.int64)
                    c = held.setdefault(lang, {})
                    for g, n in zip(k.tolist(), v.tolist()):
                        c[g] = c.get(g, 0) + n
                if sum(map(len, held.values())) > GATHER:
                    yield from flush()
        yield from flush()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= TOP)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "place", "gram").collect():
        out.setdefault(r[0], []).append((r[1], r[2]))
    return {lang: np.array([g for _, g in sorted(found)], np.int64) for lang, found in sorted(out.items())}


class Profiles:
    """Profiles laid out for lookups: sorted codes of all languages, and each code's rank by language."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(by_lang)
        self.codes = np.unique(np.concatenate([by_lang[x] for x in self.langs])) if self.langs else np.empty(0, np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ties go to the first language by name."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = ranked(codes, counts)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        rank = self.rank[at]
        away = np.where(rank < 0, TOP, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (TOP * len(top))


def languages(docs: DataFrame, profile: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""

    def run(batches):
        known = Profiles(profile)
        for b in batches:
            found = [known.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score.

    Profiles come of rows with a language whose fold isn't held out. Null texts, and texts without a letter,
    are ``und`` with score 0; so is everything where no language could be learned. Null ids pass (held_out
    null) and aren't learned from. Repeated rows count as often as they occur.
    """
    learn = docs.where(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    out = languages(docs, profiles(learn))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
