"""Near-duplicate documents by b-bit MinHash.

Of each document's set of five-word shingles, K minima are taken. Bands of four whole minima give the
candidates; only the B low bits of each minimum are kept as a packed signature, whose bit counts estimate
the similarity, corrected for chance collisions, before a link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import components, free_name, giving_back, shared_dir, stored

WORDS = 5
ROWS, BANDS = 4, 32
K = ROWS * BANDS
B = 2
#: A pair at similarity 0.75 meets in no band with a chance of (1 - 0.75^4)^32 = 5e-6.
SIMILAR = (75, 100)
#: Standard errors that an estimate may lie under the threshold and still be confirmed on the sets.
SIGMAS = 4.5
SEED = 20_241
CHUNK = 1 << 16
#: Members of a bucket that one task holds others against; larger buckets are split.
PART = 256

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.random.default_rng(SEED + 1).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(SEED + 2).integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _whole(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b"\x00".join(words), SEED)


def shingle_set(text: str | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer than five words count as one shingle; none if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([_whole(words)], np.uint64)
    known = {} if known is None else known
    if len(known) > 150_000:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for i in range(WORDS):
        s = mixed(s + h[i : i + n] * _PLACE[i])
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: packed planes (n, B * K / 64) and band keys (n, BANDS)."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    low = np.empty((len(sets), K), np.uint64)
    for k in range(K):
        x = (flat ^ _XOR[k]) * _ODD[k]
        x ^= x >> np.uint64(32)
        x *= _MIX
        low[:, k] = np.minimum.reduceat(x, starts)
    # the high bits order the shingles and so are small in every minimum; the low ones are as good as random
    planes = [np.packbits(((low >> np.uint64(3 + b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(B)]
    keys = mixed((mixed(low) * _BAND).reshape(len(sets), BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return np.concatenate(planes, axis=1), keys


PLANES = [f"p{i}" for i in range(B * K // 64)]
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), *[(p, pa.int64()) for p in PLANES], ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    known: dict[bytes, int] = {}

    def out(ids, sets):
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        planes, keys = np.zeros((len(ids), len(PLANES)), np.uint64), np.empty((0, BANDS), np.uint64)
        h = np.zeros((2, len(ids)), np.uint64)
        if len(full):
            planes[full], keys = signatures([sets[i] for i in full])
            h[:, full] = np.array([[xxhash.xxh64_intdigest(sets[i].tobytes(), seed) for i in full] for seed in (1, 2)], np.uint64)
        ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
        longs = [pa.array(x.view(np.int64)) for x in (h[0], h[1], *np.ascontiguousarray(planes.T))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *longs, lists], schema=_SIGNED)

    for batch in batches:
        ids, sets, size = [], [], 0
        for i, text in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            sets.append(shingle_set(text.as_py(), known))
            size += len(sets[-1])
            if size > CHUNK or len(ids) >= 2048:
                yield out(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield out(ids, sets)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_both", pa.int64()), ("n_any", pa.int64())])


def _confirm(batches):
    known: dict[bytes, int] = {}
    last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        rows = []
        for a, b, ta, tb in zip(*(batch.column(i) for i in range(4))):
            b = b.as_py()
            if last[0] != b:
                last = (b, shingle_set(tb.as_py(), known))
            s = shingle_set(ta.as_py(), known)
            at = np.minimum(np.searchsorted(last[1], s), max(len(last[1]) - 1, 0))
            both = int((last[1][at] == s).sum()) if len(last[1]) else 0
            rows.append((a.as_py(), b, both, len(s) + len(last[1]) - both))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, schema=_FOUND)


def estimate(x: str, y: str):
    """Similarity of two packed signatures: the share of equal b-bit minima, less what chance makes equal."""
    half = K // 64
    differ = sum(
        (F.bit_count(_any([F.col(f"{x}.{PLANES[b * half + i]}").bitwiseXOR(F.col(f"{y}.{PLANES[b * half + i]}")) for b in range(B)])) for i in range(half)),
        F.lit(0),
    )
    chance = 0.5**B
    return ((1 - differ / F.lit(float(K))) - chance) / (1 - chance)


def _any(bits):
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return out


def least_estimate() -> float:
    s, chance = SIMILAR[0] / SIMILAR[1], 0.5**B
    match = chance + (1 - chance) * s
    return s - SIGMAS * (match * (1 - match) / K) ** 0.5 / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets have 100 * intersection >= 75 * union. Documents with equal sets form a
    class that its smallest id stands for. In each band's bucket all members are first held against the
    smallest one; links found so are contracted, and only pairs of a bucket that lie in different components
    still are compared, so a large group costs in proportion to its size and yet no link is lost.

    Null or wordless texts: n_shingles 0, linked with nothing. A null id: kept, with a null component. An id
    that occurs in several rows: one result, of the row with the largest set (ties: the smaller set hash).
    Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(giving_back(_sign), "doc_id long, n long, h1 long, h2 long, " + "".join(f"{p} long, " for p in PLANES) + "bands array<long>"), "signed")
    slim = signed.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("h1")).alias("o"), "h1", "h2")).alias("s")).select("doc_id", "s.n", "s.h1", "s.h2")
    ids = stored(slim, "sets")
    classes = ids.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes")
    mine = signed.join(classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2"), ["doc_id", "n", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"])
    mine = stored(mine, "representatives")
    edges = _links(texts, mine)
    comp = components(edges)
    named = classes.join(comp, classes["rep"] == comp["id"], "left").select("n", "h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    out = ids.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.unionByName(signed.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that aren't their group's smallest id; of rows that share an id one stays.

    Rows with a null id stay. Only ids are matched with the rows, so a group of any size costs no more than its rows.
    """
    name, key = free_name(docs.columns, "other_id"), F.col(f"`{id_col}`")
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name))
    left = docs.join(gone.hint("merge"), key == F.col(name), "left_anti")
    again = stored(docs.where(key.isNotNull()).groupBy(key.alias(name)).count().where("count > 1").select(name), "repeated")
    if again.isEmpty():
        return left
    one = left.join(again, key == F.col(name), "left_semi").dropDuplicates([id_col])
    return left.join(again, key == F.col(name), "left_anti").unionByName(one)


def _links(texts: DataFrame, mine: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between class representatives, enough of them to span every component."""
    packed = mine.select("doc_id", F.struct(*PLANES).alias("s"))
    slots = mine.select("doc_id", F.explode("bands").alias("key"))
    heads = slots.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("size")).where("size > 1").select("key", "head")
    met = stored(slots.join(heads, "key"), "buckets")
    # the texts that any later step may want, fetched once; ids grow with the corpus, so none of these joins broadcasts them
    texts = stored(texts.join(met.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "candidate-texts")

    def likely(pairs: DataFrame) -> DataFrame:
        x, y = packed.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), packed.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", estimate("sa", "sb").alias("est")).where(F.col("est") >= least_estimate())

    def confirmed(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(the pairs that were tried, those that are links)"""
        pairs = stored(pairs.select("a", "b"), f"{name}-pairs")
        ta, tb = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")) for k in ("a", "b"))
        rows = pairs.hint("merge").join(ta, "a").hint("merge").join(tb, "b").select("a", "b", "ta", "tb")
        found = rows.mapInArrow(giving_back(_confirm), "a long, b long, n_both long, n_any long").where(F.col("n_both") * SIMILAR[1] >= F.col("n_any") * SIMILAR[0]).select("a", "b")
        return pairs, stored(found, f"{name}-links")

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        ca, cb = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)

    stars = stored(likely(met.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()), "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("o"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    tried, links = confirmed(best, "first")
    comp = components(links)
    links = links.unionByName(confirmed(across(stars.join(tried, ["a", "b"], "left_anti"), comp), "second")[1])
    comp = components(links)
    # What still lies apart in a bucket: the members outside the component of its head, against all. Such a
    # member may lie near thousands without a link, so its pairs are tested as they meet and only links leave
    # the join: by signature first, in the first bucket that both share, then on the full sets.
    placed = met.join(comp, met["doc_id"] == comp["id"], "left").select("key", "doc_id", "head", F.coalesce("comp", "doc_id").alias("c"))
    heads = comp.select(F.col("id").alias("head"), F.col("comp").alias("hc"))
    placed = stored(placed.join(heads, "head", "left").select("key", "doc_id", "c", (F.col("c") == F.coalesce("hc", "head")).alias("main")), "placed")
    apart = placed.groupBy("key").agg(F.count("*").alias("size"), F.max(~F.col("main")).alias("odd")).where("odd").select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    placed = stored(placed.join(apart, "key"), "apart")
    ids = placed.select("doc_id").distinct()
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(giving_back(_sets), "doc_id long, shingles array<long>")
    full = stored(mine.join(ids, "doc_id", "left_semi").select("doc_id", "bands", F.struct(*PLANES).alias("s")).join(sets, "doc_id").dropDuplicates(["doc_id"]), "apart-sets")
    rows = placed.join(full, "doc_id")
    # the members of a large bucket are dealt to parts, and the odd ones are held against each part
    x = rows.where("not main").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("x"), F.col("c").alias("cx"), F.col("s").alias("sx"), F.col("bands").alias("kx"), F.col("shingles").alias("hx"))
    y = rows.select(F.col("key").alias("y_key"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("y_part"), F.col("doc_id").alias("y"), F.col("c").alias("cy"), "main", F.col("s").alias("sy"), F.col("bands").alias("ky"), F.col("shingles").alias("hy"))
    # of two odd ones the smaller id leads; with a member of the head's component the odd one does
    turn = (F.col("cx") != F.col("cy")) & (F.col("main") | (F.col("x") < F.col("y")))
    first = F.col("key") == F.coalesce(*(F.when(F.get("kx", i) == F.get("ky", i), F.get("kx", i)) for i in range(BANDS)))
    equal = F.size(F.array_intersect("hx", "hy")) * (SIMILAR[0] + SIMILAR[1]) >= (F.size("hx") + F.size("hy")) * SIMILAR[0]
    last = x.join(y, (F.col("key") == F.col("y_key")) & (F.col("part") == F.col("y_part")) & turn & (estimate("sx", "sy") >= least_estimate()) & first & equal)
    return links.unionByName(stored(last.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "third-links"))


def _sets(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        found = [shingle_set(t.as_py(), known) for t in batch.column("text")]
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "shingles"])
