"""Near-duplicate vectors by NN-descent.

Distinct vectors of one label start with neighbours from several sign-code orders. Rounds then join neighbours
of neighbours and keep the nearest by sketch; a list that is full of likely links is saturated and may grow.
List entries that may reach the threshold are confirmed by the cosine itself; confirmed edges give components.
Vectors whose lists end saturated may have links that found no place: those of a label are held against each
other in blocks, and what links two components is added. Within each component, in blocks, every vector's links
are counted exactly. Recall is audited label by label with query vectors against all its rows; where it falls
short, more orders and rounds follow, then all of the label in blocks, and what the audit finds is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import components, stored

THRESHOLD = 0.98
BITS = 256
#: Sign bits that differ between unit vectors at the threshold: 16 on average, 4 standard deviations of 4 and more above it.
NEAR_BITS = 40
ORDERS, AHEAD = 12, 2
LIST, LONGEST_LIST = 6, 24
ROUNDS, TRIES = 3, 3
#: A round that changes fewer of the entries than this ends the descent.
SETTLED = 0.02
#: Every vector whose id has this divisor is a query of the audit; the share of their links that the graph must hold.
ASKED, ENOUGH = 20, 0.99
#: Rows of a block: for links counted, for links between components and for the audit.
BLOCK, WIDE = 512, 256
#: A product that is so near to the threshold is worked out again by the one form that decides.
CLOSE = 1e-9
SEED = 77

_WORDS = [f"s{i}" for i in range(BITS // 64)]


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).normal(size=(dim, BITS))


def _orders(attempt: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, 1, attempt))
    return np.stack([rng.permutation(BITS)[:64] for _ in range(ORDERS)])


def usable(values: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None for a vector that links with nothing."""
    if not values or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _prepare(attempt: int):
    orders = _orders(attempt)

    def run(batches):
        for b in batches:
            rows: dict[int, list] = {}
            for i, label, values in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist()):
                if i is None or label is None or (u := usable(values)) is None:
                    continue
                raw = (np.asarray(values, np.float64) + 0.0).tobytes()
                rows.setdefault(len(u), []).append((i, label, u, xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)))
            for dim, found in rows.items():
                unit = np.stack([r[2] for r in found])
                bits = (unit @ _planes(dim) > 0).astype(np.uint8)
                words = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
                codes = np.stack([np.ascontiguousarray(np.packbits(bits[:, o], axis=1)).view(">u8")[:, 0].astype(np.uint64) for o in orders], axis=1) ^ np.uint64(1 << 63)
                h = np.array([[r[3] for r in found], [r[4] for r in found]], np.uint64)
                ends = np.arange(0, len(found) * ORDERS + 1, ORDERS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in found], pa.int64()),
                        pa.array([f"{r[1]}:{dim}" for r in found], pa.string()),
                        pa.array(h[0].view(np.int64)),
                        pa.array(h[1].view(np.int64)),
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                        *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(len(_WORDS))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.reshape(-1).view(np.int64))),
                    ],
                    names=["id", "part", "h1", "h2", "unit", *_WORDS, "codes"],
                )

    return run


_EDGE = "u long, v long, d int, su struct<" + ",".join(f"{w}:bigint" for w in _WORDS) + ">, sv struct<" + ",".join(f"{w}:bigint" for w in _WORDS) + ">"


def _differ(a: str, b: str):
    out = F.lit(0)
    for w in _WORDS:
        out = out + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return out


def _beside(batches):
    """Of rows sorted by (part, t, code): each id with the next AHEAD ones of its part and order."""
    last: list[tuple] = []
    for b in batches:
        out = []
        for key_part, t, i in zip(b.column("part").to_pylist(), b.column("t").to_pylist(), b.column("id").to_pylist()):
            for k, (p, o, j) in enumerate(last):
                if p == key_part and o == t and i != j:
                    out.append((i, j))
            last = [*last, (key_part, t, i)][-AHEAD:]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])


def _start(vectors: DataFrame) -> DataFrame:
    """First lists: neighbours in the orders of the sign codes. Ranges, not keys, deal the rows, so no label is too large."""
    rows = vectors.select("id", "part", F.posexplode("codes").alias("t", "code"))
    rows = rows.repartitionByRange("part", "t", "code", "id").sortWithinPartitions("part", "t", "code", "id")
    pairs = rows.select("part", "t", "id").mapInArrow(_beside, "u long, v long")
    pairs = pairs.union(pairs.select("v", "u")).distinct()
    s = vectors.select("id", F.struct(*_WORDS).alias("s"))
    pairs = pairs.join(s.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(s.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    return pairs.select("u", "v", _differ("su", "sv").cast("int").alias("d"), "su", "sv")


def _lists(edges: DataFrame, limits: DataFrame | None) -> DataFrame:
    """The nearest of each u's candidates: LIST of them, more for those in ``limits`` (u, k)."""
    if limits is not None:
        edges = edges.join(limits, "u", "left")
        k = F.coalesce("k", F.lit(LIST))
    else:
        k = F.lit(LIST)
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return edges.withColumn("place", place).where(F.col("place") <= LONGEST_LIST).where(F.col("place") <= k).select("u", "v", "d", "su", "sv")


def descend(vectors: DataFrame) -> DataFrame:
    """Refined lists (u, v, d, su, sv) after rounds of joins of neighbours' neighbours."""
    graph = stored(_lists(_start(vectors), None), "graph").withColumn("new", F.lit(True))
    limits = None
    for _ in range(ROUNDS):
        flip = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", F.col("sv").alias("su"), F.col("su").alias("sv"), "new")
        back = flip.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("place") <= LIST).drop("place")
        around = graph.unionByName(back).groupBy("u", "v").agg(F.first("d").alias("d"), F.first("su").alias("su"), F.first("sv").alias("sv"), F.max("new").alias("new"))
        around = stored(around, "around")
        left = around.select(F.col("u").alias("w"), F.col("v").alias("u"), F.col("sv").alias("su"), F.col("new").alias("nu"))
        right = around.select(F.col("u").alias("w"), "v", "sv", F.col("new").alias("nv"))
        # either side of a pair that both lists hold was tried in an earlier round
        met = left.join(right, "w").where("u <> v and (nu or nv)").groupBy("u", "v").agg(F.first("su").alias("su"), F.first("sv").alias("sv"))
        met = met.select("u", "v", _differ("su", "sv").cast("int").alias("d"), "su", "sv", F.lit(True).alias("fresh"))
        old = around.select("u", "v", "d", "su", "sv", F.lit(False).alias("fresh"))
        both = met.unionByName(old).groupBy("u", "v").agg(F.first("d").alias("d"), F.first("su").alias("su"), F.first("sv").alias("sv"), F.min("fresh").alias("new"))
        # saturated lists grow
        full = graph.groupBy("u").agg(F.count_if(F.col("d") <= NEAR_BITS).alias("n"), F.count("*").alias("size")).where((F.col("n") == F.col("size")) & (F.col("size") >= LIST))
        limits = full.select("u", F.least(F.lit(LONGEST_LIST), F.col("size") * 2).alias("k"))
        flags = both.select("u", "v", "new")
        nearest = _lists(both.drop("new"), limits)
        graph = stored(nearest.join(flags, ["u", "v"]), "graph")
        counts = graph.agg(F.count("*"), F.count_if("new")).first()
        if counts[1] <= SETTLED * counts[0]:
            break
    return graph.select("u", "v", "d", "su", "sv")


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` and of ``y`` have a cosine of THRESHOLD or more; the same for a pair wherever it meets."""
    product = x @ y.T
    out = product >= THRESHOLD
    i, j = np.nonzero(np.abs(product - THRESHOLD) < CLOSE)
    out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= THRESHOLD
    return out


def _cosines(batches):
    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.float64).reshape(b.num_rows, -1) if len({len(x) for x in b.column(k).to_pylist()}) == 1 else None for k in ("a", "b"))
        if a is None:
            cos = np.array([np.einsum("ij,ij->i", np.frombuffer(x)[None], np.frombuffer(y)[None])[0] for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())])
        else:
            cos = np.einsum("ij,ij->i", a, c)
        keep = pa.array(cos >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


def _confirmed(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    likely = graph.where(F.col("d") <= NEAR_BITS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    unit = vectors.select("id", "unit")
    rows = likely.join(unit.select(F.col("id").alias("u"), F.col("unit").alias("a")), "u").join(unit.select(F.col("id").alias("v"), F.col("unit").alias("b")), "v")
    return rows.select("u", "v", "a", "b").mapInArrow(_cosines, "u long, v long")


def _groups(batches, names: list[str], keys: int):
    """Lists of rows with equal first ``keys`` columns, from batches in which such rows follow each other."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _answered(batches):
    for rows in _groups(batches, ["part", "block", "asked", "id", "unit"], 2):
        asked, own = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        if asked and own:
            q = np.stack([np.frombuffer(r[4]) for r in asked])
            hit = np.nonzero(_linked(q, np.stack([np.frombuffer(r[4]) for r in own])))
            found = [(asked[x][3], own[y][3]) for x, y in zip(*hit) if asked[x][3] != own[y][3]]
            yield _pairs([u for u, _ in found], [v for _, v in found])


def _audit(vectors: DataFrame) -> DataFrame:
    """Links (u, v) of the query vectors (those that a query id is a copy of, other ids at each attempt) with all others of their part, by brute force in blocks."""
    rows = vectors.select("part", "id", "unit", "query")
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    sizes = sizes.select("part", F.ceil(F.col("size") / WIDE).cast("long").alias("blocks"))
    rows = rows.join(sizes, "part").withColumn("asked", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    asked = rows.where("query").withColumn("asked", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = rows.unionByName(asked).select("part", "block", "asked", "id", "unit")
    return both.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(_answered, "u long, v long")


def _crossing(batches):
    """For each two components of a group of rows with a link between them, one such link."""
    for rows in _groups(batches, ["part", "lo", "hi", "side", "comp", "id", "unit"], 3):
        x = np.stack([np.frombuffer(r[6]) for r in rows])
        comp = np.array([r[4] for r in rows], np.int64)
        side = np.array([r[3] for r in rows]) == rows[0][1]
        a, b = (np.arange(len(rows)),) * 2 if rows[0][1] == rows[0][2] else (np.nonzero(side)[0], np.nonzero(~side)[0])
        near = _linked(x[a], x[b])
        near &= comp[a][:, None] != comp[b][None, :]
        i, j = np.nonzero(near)
        _, first = np.unique(np.stack([comp[a[i]], comp[b[j]]]), axis=1, return_index=True)
        yield _pairs([rows[a[i[k]]][5] for k in first], [rows[b[j[k]]][5] for k in first])


def _between(ids: DataFrame, vectors: DataFrame, comp: DataFrame) -> DataFrame:
    """Links (u, v) that join components, among all the vectors in ``ids`` of each part, exactly."""
    rows = vectors.select("part", "id", "unit").join(ids, "id", "left_semi").join(comp, "id", "left").select("part", "id", F.coalesce("comp", "id").alias("comp"), "unit")
    rows = stored(rows, "saturated")
    sizes = rows.groupBy("part").agg(F.count("*").alias("size")).select("part", F.ceil(F.col("size") / WIDE).cast("long").alias("blocks"))
    rows = rows.join(sizes, "part").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("part", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "comp", "id", "unit")
    return rows.repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi").mapInArrow(_crossing, "u long, v long")


def _counted(batches):
    """Rows sorted by (comp, lo, hi): links of each row with the rows of the other block (its own, if lo = hi), copies counted."""
    names = ["comp", "lo", "hi", "side", "id", "copies", "unit"]

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        x = np.stack([np.frombuffer(r[6]) for r in rows])
        copies = np.array([r[5] for r in rows], np.int64)
        if rows[0][1] == rows[0][2]:
            near = _linked(x, x)
            np.fill_diagonal(near, False)
            n = near @ copies
        else:
            side = np.array([r[3] for r in rows]) == rows[0][1]
            near = _linked(x[side], x[~side])
            n = np.zeros(len(rows), np.int64)
            n[side], n[~side] = near @ copies[~side], near.T @ copies[side]
        return [(r[4], int(k)) for r, k in zip(rows, n)]

    held: list[tuple] = []
    for b in batches:
        out = []
        for row in zip(*(b.column(n).to_pylist() for n in names)):
            if held and held[0][:3] != row[:3]:
                out += links(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["id", "n"])
    if held:
        out = links(held)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["id", "n"])


def _degrees(comp: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, n): each vector's links within its component. Components larger than BLOCK are dealt out as pairs of blocks."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size")).select("comp", F.ceil(F.col("size") / (BLOCK // 2)).cast("long").alias("blocks"))
    rows = comp.join(sizes, "comp").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("id", "comp", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    rows = rows.join(vectors.select("id", "copies", "unit"), "id").select("comp", "lo", "hi", "side", "id", "copies", "unit")
    rows = rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "id")
    return rows.mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall.

    Vectors are compared only under equal, non-null labels and at equal length; a null, empty or zero vector
    and one with null or non-finite components link with nothing. Exact copies (equal label and components)
    form a class that is compared once and counted with its size. A null vec_id: kept, no links, null
    component. Of rows that share a vec_id the first class by hash counts, as one. Other columns are ignored.
    ``recall`` is the share of the audited links of the vector's label whose ends the graph had in one component before
    the audit added the rest; null where the audit found none.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("label", F.col("label").cast("string"))
    links, comp = None, None
    for attempt in range(TRIES):
        schema = "id long, part string, h1 long, h2 long, unit binary, " + "".join(f"{w} long, " for w in _WORDS) + "codes array<long>"
        prepared = stored(rows.mapInArrow(_prepare(attempt), schema), "vectors")
        named = prepared.groupBy("id").agg(F.min(F.struct("part", "h1", "h2")).alias("c")).select("id", "c.*")
        classes = stored(named.groupBy("part", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max(F.pmod(F.col("id") - attempt, F.lit(ASKED)) == 0).alias("query")), "vector-classes")
        vectors = prepared.dropDuplicates(["id", "part", "h1", "h2"]).join(classes.withColumnRenamed("rep", "id"), ["id", "part", "h1", "h2"])
        vectors = stored(vectors, "distinct-vectors")
        graph = descend(vectors)
        found = stored(_confirmed(graph, vectors), "vector-links")
        links = found if links is None else links.unionByName(found)
        comp = components(links, "u", "v")
        saturated = graph.groupBy(F.col("u").alias("id")).agg(F.max("d").alias("d")).where(F.col("d") <= NEAR_BITS).select("id")
        crossed = stored(_between(saturated, vectors, comp), "crossed")
        if not crossed.isEmpty():
            links = links.unionByName(crossed)
            comp = components(links, "u", "v")
        checked = stored(_audit(vectors), "audit")
        cu, cv = comp.select(F.col("id").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
        seen = checked.join(vectors.select(F.col("id").alias("u"), "part"), "u").join(cu, "u", "left").join(cv, "v", "left")
        seen = stored(seen.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("cu") == F.col("cv")).alias("held")), "recall")
        missed = seen.where("held < n")
        if missed.isEmpty():
            break
        links = links.unionByName(checked)
        comp = components(links, "u", "v")
        low = missed.where(F.col("held") < ENOUGH * F.col("n"))
        if low.isEmpty():
            break
    else:
        crossed = stored(_between(vectors.join(low, "part", "left_semi").select("id"), vectors, comp), "crossed")
        comp = components(links.unionByName(crossed), "u", "v")
    degree = _degrees(comp, vectors)
    each = classes.join(comp, classes["rep"] == comp["id"], "left").drop("id").join(degree, F.col("rep") == F.col("id"), "left")
    audited = seen.select("part", (F.col("held") / F.col("n")).alias("recall"))  # a row a label
    each = each.join(audited, "part", "left").select("part", "h1", "h2", "recall", F.coalesce("comp", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = named.join(each, ["part", "h1", "h2"]).select(F.col("id"), "n_links", "component_id", "recall")
    ids = rows.where("vec_id is not null").select("vec_id").distinct().join(linked, F.col("vec_id") == F.col("id"), "left")
    out = ids.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "recall")
    none = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    return out.unionByName(none).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")
