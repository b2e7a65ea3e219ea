"""Choices that the rows of a group make one after another.

A group's rows stream through one task in their order, groups are many, and a task keeps what was chosen, not the rows.
Only groups of up to ONE_TASK rows go this way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heapify, heappop, heapreplace
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from drawlake.operators.graph import checkpointed, dealt, stored

Keys = Sequence[str]
#: Rows of a group up to which one task takes it: what it keeps of them is some 300 bytes a row at most.
ONE_TASK = 1_000_000
#: Buckets that groups are counted in first, so that only those of full buckets are counted one by one.
BUCKETS = 4096
#: Left texts that are held against all right ones of a bill at once.
BLOCK = 128


def sized(df: DataFrame, keys: Keys) -> tuple[int, DataFrame | None]:
    """How many rows there are, and the keys of groups of more than ONE_TASK rows, or None if there are none."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("_bucket")).count().collect()  # BUCKETS rows at most
    full = [r["_bucket"] for r in counts if r["count"] > ONE_TASK]
    large = checkpointed(df.where(bucket.isin(full)).groupBy(*keys).count().where(F.col("count") > ONE_TASK).select(*keys)) if full else None
    return sum(r["count"] for r in counts), None if large is None or large.isEmpty() else large


def in_turn(df: DataFrame, rows: int, keys: Keys, order: Keys, columns: Keys, start: Callable[[], Callable], name: str, kind: DataType) -> DataFrame:
    """``df`` of so many rows with a column ``name`` that each row gets in its turn.

    ``start`` makes a group's function. It gets the arrays of ``columns`` of rows that follow, and returns a list of their values;
    rows alike in ``order`` come together. A null key is a group by itself.
    """
    schema = StructType([*df.schema.fields, StructField(name, kind)])
    out = to_arrow_type(kind)
    keys, order, columns, names = list(keys), list(order), list(columns), [*df.columns, name]

    def differ(table, by):
        n = table.num_rows
        new = np.arange(n) == 0
        for c in by:
            col = table.column(c)
            new[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last, choose = None, None, None

        def done(table):
            nonlocal last, choose
            at = np.flatnonzero(differ(table, keys)).tolist()
            arrays, values = [table.column(c) for c in columns], []
            for i, (low, high) in enumerate(zip(at, [*at[1:], table.num_rows])):
                group = tuple(table.column(k)[low].as_py() for k in keys) if i == 0 or high == table.num_rows else ()
                if i or group != last or None in group:
                    choose = start()
                values += choose(*(a.slice(low, high - low) for a in arrays))
                last = group
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(values, out)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(differ(table, [*keys, *order]))[-1])  # the last ones may go on
            rest = table.slice(cut)
            if cut:
                yield done(table.slice(0, cut))
        if rest is not None:
            yield done(rest)

    return dealt(df, rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def first_near(tol: float, square: bool = False, nearest: bool = True) -> Callable[[], Callable]:
    """For (seq, x, y) in the order of seq: the seq of the first of the places taken so far that lies within ``tol``, or of the row
    itself, which then takes its place. ``square``: both coordinates differ by less, else the distance does. Without ``nearest``
    any place will do. Null for a row without a seq or place. Rows of one seq don't keep each other off."""
    wide, lost, step = tol * 1.001, -(1 << 62), 1 << 32
    around = [0, -1, 1, -step, step, -step - 1, -step + 1, step - 1, step + 1]

    def start():
        cells: dict[int, list] = {}

        def found(x, y, k):
            best = None
            for d in around:
                for px, py, s in cells.get(k + d, ()):
                    dx, dy = x - px, y - py
                    if (-tol < dx < tol and -tol < dy < tol) if square else math.sqrt(dx * dx + dy * dy) < tol:
                        if not nearest:
                            return s
                        if best is None or s < best:
                            best = s
            return best

        def choose(seq, x, y):
            x, y = (v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y))
            finite = np.isfinite(x) & np.isfinite(y)
            cx, cy = (np.clip(np.floor(np.where(finite, v, 0.0) / wide), -(1 << 29), 1 << 29).astype("int64") for v in (x, y))
            cells_of = np.where(finite, cx * step + cy, lost).tolist()
            out, seqs = [], seq.to_pylist()
            if len(set(seqs)) == len(seqs):
                for s, px, py, k in zip(seqs, x.tolist(), y.tolist(), cells_of):
                    first = None if k == lost or s is None else found(px, py, k)
                    if first is None and k != lost and s is not None:
                        first = s
                        cells.setdefault(k, []).append((px, py, s))
                    out.append(first)
                return out
            for s, own in groupby(zip(seqs, x.tolist(), y.tolist(), cells_of), lambda r: r[0]):
                own = list(own)
                there = [r for r in own if r[3] != lost] if s is not None else []
                hits = [h for h in (found(*r[1:]) for r in there) if h is not None]
                if hits:
                    out += [min(hits)] * len(own)
                    continue
                for _, px, py, k in there:
                    cells.setdefault(k, []).append((px, py, s))
                out += [s if there else None] * len(own)
            return out

        return choose

    return start


def _fits(tol: float, square: bool):
    return (F.abs(F.col("l_x") - F.col("r_x")) < tol) & (F.abs(F.col("l_y") - F.col("r_y")) < tol) if square else F.col("dist") < tol


def gone_points(points: DataFrame, keys: Keys, tol: float, square: bool = False) -> DataFrame:
    """(keys, seq) of points (keys, seq, x, y) of large groups that lie near an earlier one that stays: a group's first ONE_TASK points go
    in turn, what lies near those that stay falls away, and so on with the rest."""
    from drawlake.operators.spatial import near_pairs

    rest, gone = points.where("seq is not null"), None
    while True:
        ranked = stored(rest.withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy("seq"))), "ranked")
        head = ranked.where(F.col("_n") <= ONE_TASK).drop("_n")
        head = stored(in_turn(head, head.count(), keys, ["seq"], ["seq", "x", "y"], first_near(tol, square, nearest=False), "_first", points.schema["seq"].dataType), "head")
        stay, fallen = head.where("_first = seq").drop("_first"), head.where("_first <> seq").select(*keys, "seq")
        later = ranked.where(F.col("_n") > ONE_TASK).drop("_n")
        near = near_pairs(later, stay, keys, tol * 2**0.5 if square else tol).where(_fits(tol, square)).select(*keys, F.col("l_seq").alias("seq")).distinct()
        fallen = stored(fallen.unionByName(near), "fallen")
        gone = fallen if gone is None else gone.unionByName(fallen)
        rest = later.join(fallen, [*keys, "seq"], "left_anti")
        if rest.isEmpty():
            return gone


@lru_cache(maxsize=1 << 18)
def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


def most_alike(threshold: float) -> Callable[[], Callable]:
    """For (side, n, text), the right rows (side 0) first: the n and score (gen, score) of the most similar right row that is left,
    ``threshold`` at least, of equal ones the first. Null for right rows and for those that get none.

    Two texts match no more characters than they share as multisets, so that candidates are compared in the order of that
    bound, until it falls below the best ratio.
    """

    def start():
        numbers, texts, lengths, taken, chars, shares = [], [], [], [], {}, None

        def bounds(own):
            """Of each left text and right row."""
            both = np.zeros((len(own), len(texts)), "int32")
            counts = np.zeros((len(chars), len(own)), "int32")
            for i, t in enumerate(own):
                for c, m in Counter(t).items():
                    if c in chars:
                        counts[chars[c], i] = m
            for mine, theirs in zip(counts, shares):
                at = np.flatnonzero(mine)
                both[at] += np.minimum(mine[at, None], theirs)
            return 2.0 * both / (np.array([[len(t)] for t in own]) + np.array(lengths))

        def choose(side, n, text):
            nonlocal shares
            side, n, text = side.to_pylist(), n.to_pylist(), text.to_pylist()
            first = next((i for i, s in enumerate(side) if s), len(side))
            numbers.extend(n[:first])
            texts.extend(text[:first])
            out = [None] * len(side)
            if first == len(side) or not texts:
                return out
            if shares is None:
                lengths.extend(map(len, texts))
                chars.update((c, i) for i, c in enumerate(sorted(set().union(*texts))))
                shares = np.zeros((len(chars), len(texts)), "int32")
                for i, t in enumerate(texts):
                    for c, m in Counter(t).items():
                        shares[chars[c], i] = m
            for low in range(first, len(side), BLOCK):
                bound = bounds(text[low : low + BLOCK])
                bound[:, taken] = -1.0
                for i, row in enumerate(bound, low):
                    best, at = threshold, None
                    while row[k := int(row.argmax())] >= best:
                        score = _ratio(text[i], texts[k])
                        row[k] = -1.0
                        if score > best or score == best and (at is None or k < at):
                            best, at = score, k
                    if at is not None:
                        out[i] = {"gen": numbers[at], "score": best}
                        taken.append(at)
                        bound[:, at] = -1.0
            return out

        return choose

    return start


#: Of a group's sets of words: pairs of those that fit, which a task remembers.
REMEMBERED = 1_000_000


def best_words(least: float) -> Callable[[], Callable]:
    """For (side, seq, words), the entries (side 0) first: the seq of the entry that is left, has all the row's numbers of two digits or
    more and the largest share, ``least`` or more, of its words (parted by spaces); of equal ones the least seq. Null for entries.

    Entries of one text are a queue of their seqs, and equal rows share a list of the queues that fit: no row is paired.
    Rows of one seq choose once.
    """

    def start():
        queues: dict[str, list] = {}
        texts, ahead, having, fits, taken, size = [], [], {}, {}, set(), 0

        def head(c):
            q, p = texts[c][1], ahead[c]
            while p < len(q) and q[p] in taken:
                p += 1
            ahead[c] = p
            return q[p] if p < len(q) else None

        def ready():
            for t, q in queues.items():
                q.sort()
                for w in t.split():
                    having.setdefault(w, []).append(len(texts))
                texts.append((t, q))
                ahead.append(0)

        def levels(own):
            """Lists of (next seq, queue), as heaps, by falling share."""
            nonlocal size
            words = own.split()
            of = lambda w: (len(having.get(w, ())), w)
            numbers = [w for w in words if len(w) > 1 and "0" <= w[0] <= "9"]
            probes = [min(numbers, key=of)] if numbers else sorted(words, key=of)[: len(words) - math.ceil(len(words) * least - 1e-9) + 1]
            found: dict[float, list] = {}
            for c in dict.fromkeys(c for w in probes for c in having.get(w, ())):
                theirs = texts[c][0].split()
                share = sum(w in theirs for w in words) / len(words)
                if share >= least and all(n in theirs for n in numbers) and (seq := head(c)) is not None:
                    found.setdefault(share, []).append((seq, c))
            out = sorted(found.items(), reverse=True)
            for _, heap in out:
                heapify(heap)
            if size > REMEMBERED:
                fits.clear()
                size = 0
            size += sum(len(heap) for _, heap in out)
            fits[own] = out
            return out

        def best(own):
            for share, heap in fits[own] if own in fits else levels(own):
                while heap:
                    seq, c = heap[0]
                    now = head(c)
                    if now == seq:
                        return -share, seq
                    if now is None:
                        heappop(heap)
                    else:
                        heapreplace(heap, (now, c))
            return None

        def choose(side, seq, words):
            out = []
            for (s, k), own in groupby(zip(side.to_pylist(), seq.to_pylist(), words.to_pylist()), lambda r: r[:2]):
                own = [w for _, _, w in own]
                at = None
                if s == 0:
                    for w in own:
                        queues.setdefault(w, []).append(k)
                else:
                    if queues and not texts:
                        ready()
                    at = min((b for b in map(best, own) if b is not None), default=(0, None))[1]
                    if at is not None:
                        taken.add(at)
                out += [at] * len(own)
            return out

        return choose

    return start
