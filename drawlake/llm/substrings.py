"""Removal of repeated passages by super-k-mers.

A window is SPAN consecutive words of a document. Its minimiser is the smallest hash of its runs of RUN words;
consecutive windows of one minimiser travel as one packed string of words to the minimiser's bucket, so all equal
windows meet in one bucket. There their hashes are sorted, equal ones are compared byte by byte, and all but the
earliest of each are marked. Words under a mark go.

Runs of words that are frequent in the whole corpus are ranked behind all others: a window takes one as its minimiser
only where it holds nothing else, which is inside a passage that many documents share; such strings are equal, and
of equal strings a task sends only the earliest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, RUN = 20, 4
#: Buckets of one shuffle partition, which are worked on one after another.
SUB = 4
#: A run is frequent from this share of a partition's fair part on, so at most FREQUENT * partitions runs are.
FREQUENT = 8
#: Windows of one string at most: a text that repeats itself is cut, which loses nothing.
LONGEST = 256
#: Bytes of text that are worked on at once; a longer text is cut into overlapping parts. Bytes of one running sum.
CHUNK = 4 << 20
BLOCK = 1 << 17
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LAST = np.uint64(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STRING = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<i8"), ("size", "<i8")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


_held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers, or more, of the base and of its inverse."""
    if len(_held[0]) < n:
        for k, x in enumerate((_BASE, _UNBASE)):
            out = np.full(max(n, 2 * BLOCK), x, np.uint64)
            out[0] = 1
            _held[k] = np.multiply.accumulate(out)
    return _held


class Words:
    """Words of bytes, and hashes of any run of them from one running sum: of equal runs they are equal."""

    def __init__(self, data: np.ndarray):
        blank = _SPACE[data]
        edge = np.diff(np.r_[True, blank, True].view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.data = data

    def tidy(self) -> np.ndarray:
        """The words again with one space after each; start and end follow."""
        keep = ~_SPACE[self.data]
        keep[self.end[self.end < len(keep)]] = True
        size = self.end - self.start
        out = np.where(_SPACE[self.data], np.uint8(32), self.data)[keep]
        self.start = np.r_[0, np.cumsum(size + 1)[:-1]][: len(size)].astype(np.int64)
        self.end = self.start + size
        self.data = out if len(out) and out[-1] == 32 else np.r_[out, np.uint8(32)]
        return self.data

    def hashes(self, n: int) -> np.ndarray:
        """A hash for each run of n words, by its first word; running sums are made of BLOCK bytes at a time."""
        count = len(self.start) - n + 1
        out = np.empty(max(0, count), np.uint64)
        at = 0
        while at < count:
            lo = int(self.start[at])
            to = min(count, max(at + 1, int(np.searchsorted(self.start, lo + BLOCK))))
            first, last = self.start[at:to] - lo, self.end[at + n - 1 : to + n - 1] - lo
            up, down = _powers(int(last[-1]) + 1)
            total = np.empty(int(last[-1]) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.data[lo : lo + int(last[-1])]] * up[: int(last[-1])], out=total[1:])
            out[at:to] = mixed((total[last] - total[first]) * down[first])
            at = to
        return out


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _documents(batches):
    """(ids, tags, first word's number, texts) in parts of CHUNK bytes; a longer text comes in parts that share SPAN - 1 words."""
    ids, tags, froms, texts, size = [], [], [], [], 0
    for b in batches:
        for i, tag, t in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text")):
            raw = t.as_buffer()
            if raw is None or len(raw) == 0:
                continue
            if len(raw) > CHUNK:
                whole = Words(np.frombuffer(raw, np.uint8))
                at = 0
                while at < len(whole.start):
                    # as many words as fit, but always more than one window
                    to = min(len(whole.start), max(at + 2 * SPAN, int(np.searchsorted(whole.end, whole.start[at] + CHUNK, side="right"))))
                    yield [i], [tag], [at], [raw.slice(int(whole.start[at]), int(whole.end[to - 1] - whole.start[at])).to_pybytes()]
                    if to == len(whole.start):
                        break
                    at = to - SPAN + 1
                continue
            if size + len(raw) > CHUNK:
                yield ids, tags, froms, texts
                ids, tags, froms, texts, size = [], [], [], [], 0
            ids.append(i)
            tags.append(tag)
            froms.append(0)
            texts.append(raw.to_pybytes())
            size += len(raw)
    if texts:
        yield ids, tags, froms, texts


def _together(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, text of each word, its number in the text) of all texts."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    words = Words(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, words.start, side="right")
    first = np.searchsorted(of, np.arange(len(texts)))
    words.tidy()
    return words, of, np.arange(len(of)) - first[of]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    # a null id comes before all others; texts of one id are told apart by a hash
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def frequent_runs(rows: DataFrame, partitions: int, run: int = RUN) -> np.ndarray:
    """Sorted hashes of runs of words that hold a large share of all; at most FREQUENT * partitions, whatever the data's size.

    Each part of the texts passes on the runs that hold that share of the part itself; one that holds twice the
    share of the whole is found for certain, and only such as hold the share are kept. That list only balances the
    buckets: the result doesn't depend on it.
    """
    share = FREQUENT * partitions

    def count(batches):
        for _, _, _, texts in _documents(batches):
            words, of, _ = _together(texts)
            h = words.hashes(run)
            h = np.sort(h[of[: len(h)] == of[run - 1 :]]) if len(h) else h
            if not len(h):
                continue
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[at, len(h)])
            often = (n * share >= len(h)) & (n > 1)
            # the row of run 0 counts them all
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.int64(0), h[at[often]].view(np.int64)]), pa.array(np.r_[len(h), n[often]].astype(np.int64))], names=["h", "n"])

    found = rows.select("doc", "tag", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = sum(r["n"] for r in found.where("h = 0").collect())
    if not total:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r["h"] for r in found.where((F.col("h") != 0) & (F.col("n") * share >= total)).collect()], np.int64).view(np.uint64))


def super_kmers(ids, tags, froms, texts, frequent: np.ndarray, span: int, run: int):
    """(minimiser, string of words, doc, tag, first word, windows) of each run of windows of one minimiser."""
    words, of, place = _together(texts)
    h = words.hashes(run)
    n = len(of) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), [], np.empty(0, _STRING)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = np.where(frequent[at] == h, h | _LAST, h & ~_LAST)
    low = lowest(h, span - run + 1)[:n]
    whole = of[:n] == of[span - 1 :]
    cut = np.r_[True, (low[1:] != low[:-1]) | (of[1:n] != of[: n - 1])] if n else np.empty(0, bool)
    first = np.flatnonzero(cut & whole)
    # a window that leaves its text ends a string, as texts do
    stop = np.flatnonzero(np.r_[cut[1:] | ~whole[1:], True] & whole) + 1
    size = stop - first
    if (size > LONGEST).any():
        parts = -(-size // LONGEST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, stop = np.repeat(first, parts) + k * LONGEST, np.repeat(stop, parts)
        size = np.minimum(stop - first, LONGEST)
    raw = words.data.tobytes()
    strings = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first + size + span - 2].tolist())]
    out = np.empty(len(first), _STRING)
    text = of[first]
    out["doc"], out["tag"] = np.array(ids, np.int64)[text], np.array(tags, np.int64)[text]
    out["at"], out["size"] = place[first] + np.array(froms, np.int64)[text], size
    return low[first], strings, out


def _earliest(strings: list[bytes], where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the earliest of each string, places of the others that start later): the others' windows are repeats, wherever else they are."""
    order = np.lexsort((where["at"], where["doc"]))
    seen: dict[bytes, int] = {}
    first, later = [], []
    for k in order.tolist():
        j = seen.setdefault(strings[k], k)
        if j == k or (where["doc"][k] == where["doc"][j] and where["at"][k] == where["at"][j]):
            first.append(k)
        else:
            later.append(k)
    return np.array(first, np.int64), np.array(later, np.int64)


def repeats(strings: list[bytes], where: np.ndarray, span: int) -> np.ndarray:
    """Windows of a bucket's strings that another one of the bucket precedes: an array of (doc, tag, first word, 1).

    ``strings`` may hold several of ``where``'s strings in one, in their order.
    """
    words = Words(np.frombuffer(b" ".join([*strings, b""]), np.uint8))
    h = words.hashes(span)
    # of each string: its first word, and its windows
    count = where["size"] + span - 1
    first = np.repeat(np.cumsum(count) - count, where["size"])
    k = np.arange(len(first)) - np.repeat(np.cumsum(where["size"]) - where["size"], where["size"])
    at_word, of = first + k, np.repeat(np.arange(len(where)), where["size"])
    h, doc, at = h[at_word], where["doc"][of], where["at"][of] + k
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    near = np.zeros(len(order), bool)
    near[1:] |= same
    near[:-1] |= same
    order = order[near]  # only windows that share a hash
    if not len(order):
        return np.empty(0, _STRING)
    order = order[np.lexsort((at[order], doc[order], h[order]))]
    head = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
    lead = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
    a, b = words.start[at_word], words.end[at_word + span - 1]
    equal = _same_bytes(words.data, a[lead], a[order], b[lead] - a[lead], b[order] - a[order])
    hit = equal & ((doc[lead] != doc[order]) | (at[lead] != at[order]))
    found = [order[hit]]
    if not equal.all():  # different windows of one hash: those are told apart by their bytes
        raw = words.data.tobytes()
        odd, seen = order[~equal], {}
        for w in odd.tolist():
            j = seen.setdefault(raw[a[w] : b[w]], w)
            if (doc[j], at[j]) != (doc[w], at[w]):
                found.append(np.array([w]))
    w = np.concatenate(found)
    out = np.empty(len(w), _STRING)
    out["doc"], out["tag"], out["at"], out["size"] = doc[w], where["tag"][of[w]], at[w], 1
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the stretches at a and b are equal, eight bytes of all at a time."""
    out = size_a == size_b
    data = np.r_[data, np.zeros(8, np.uint8)]
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    todo = np.flatnonzero(out & (a != b))
    step = 0
    while len(todo):
        left = size_a[todo] - step
        diff = lanes[a[todo] + step] ^ lanes[b[todo] + step]
        short = left < 8
        diff[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[todo[diff != 0]] = False
        step += 8
        todo = todo[(diff == 0) & (left > 8)]
    return out


def _runs(found: np.ndarray) -> np.ndarray:
    """Marks joined where one window follows the other."""
    if not len(found):
        return found
    found = np.sort(found, order=["doc", "tag", "at"])
    end = found["at"] + found["size"]  # these grow inside a text, as strings share no window
    new = np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["tag"][1:] != found["tag"][:-1]) | (found["at"][1:] > end[:-1])]
    first = np.flatnonzero(new)
    out = found[first].copy()
    out["size"] = np.maximum.reduceat(end, first) - out["at"]
    return out


_MARKS = "doc long, tag long, at long, size long"


def _marks(found: np.ndarray) -> pa.RecordBatch:
    found = _runs(found)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in _STRING.names], names=list(_STRING.names))


def repeated_windows(docs: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """(doc, tag, at, size): stretches of ``size`` windows from word ``at`` on (from 0) that all have an earlier equal.

    ``doc`` is the id, the smallest long for a null one, and ``tag`` the xxhash64 of the text.
    """
    rows = _rows(docs)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_runs(rows, partitions, run)
    buckets = partitions * SUB

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for ids, tags, froms, texts in _documents(batches):
            low, strings, where = super_kmers(ids, tags, froms, texts, frequent, span, run)
            if not strings:
                continue
            first, later = _earliest(strings, where)
            out = [], []
            bucket = (mixed(low[first]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(bucket[order]) != 0, True]) + 1 if len(order) else []
            at = 0
            for end in ends:
                mine = first[order[at:end]]
                body = b" ".join([strings[k] for k in mine.tolist()])
                out[0].append(int(bucket[order[at]]))
                out[1].append(squeeze.compress(where[mine].tobytes() + body) + len(mine).to_bytes(4, "little"))
                at = end
            if len(later):  # repeats already: they go to any bucket, and on from there
                for k in range(0, len(later), 1 << 14):
                    out[0].append((int(low[later[k]]) ^ k) % buckets)
                    out[1].append(_runs(where[later[k : k + (1 << 14)]]).tobytes() + (0).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "packed"])

    def sort(batches):
        stretch = zstandard.ZstdDecompressor()
        held, now = [], None
        for b in batches:
            for bucket, packed in zip(b.column("bucket").to_pylist(), b.column("packed")):
                if bucket != now and held:
                    yield from decide(held)
                    held = []
                now = bucket
                raw = packed.as_py()
                n = int.from_bytes(raw[-4:], "little")
                if n:
                    raw = stretch.decompress(raw[:-4])
                    held.append((np.frombuffer(raw, _STRING, n), raw[n * _STRING.itemsize :]))
                else:
                    yield _marks(np.frombuffer(raw[:-4], _STRING))
        if held:
            yield from decide(held)

    def decide(held):
        where = np.concatenate([w for w, _ in held])
        found = repeats([s for _, s in held], where, span)
        if len(found):
            yield _marks(found)

    sent = rows.mapInArrow(pack, "bucket int, packed binary").repartitionById(partitions, F.floor(F.col("bucket") / SUB).cast("int")).sortWithinPartitions("bucket")
    return sent.mapInArrow(sort, _MARKS)


def _kept(text: bytes | None, at: list[int], size: list[int], span: int) -> tuple[list[bytes], int]:
    """(words that stay, words of the text)."""
    words = (text or b"").split()
    if not at:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, np.array(at), 1)
    np.add.at(gone, np.minimum(np.array(at) + np.array(size) + span - 1, len(words)), -1)
    stay = np.cumsum(gone[:-1]) == 0
    return [words[k] for k in np.flatnonzero(stay).tolist()], len(words)


def drop_repeats(docs: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words joined by one space) of every row of ``docs``.

    Words under a window of ``span`` words that also starts earlier - in a smaller doc_id, or earlier in the same one -
    go. A null id is smaller than all others; rows of one id are one document at the same places, so none of two equal
    rows precedes the other. Null and empty texts have no words and the hash of nothing. Every row gives one row; other
    columns are ignored; an empty table gives none.
    """
    marks = repeated_windows(docs, span, run).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "size")).alias("marks"))
    rows = _rows(docs).withColumn("none", F.col("doc") == F.lit(-(1 << 63)))
    joined = rows.join(marks, ["doc", "tag"], "left").select("doc", "none", "text", "marks")

    def cut(batches):
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for text, marks in zip(b.column("text"), b.column("marks")):
                found = marks.as_py() or []
                stay, words = _kept(text.as_py(), [m["at"] for m in found], [m["size"] for m in found], span)
                whole = b" ".join(stay)
                n.append(words)
                gone.append(words - len(stay))
                sha.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole)
            ids = pa.array([None if none else i for i, none in zip(b.column("doc").to_pylist(), b.column("none").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary").withColumn("text", F.col("text").cast("string"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
n AS (SELECT doc_id, unnest(generate_series(1, len(w) - {SPAN - 1})) AS p FROM t WHERE len(w) >= {SPAN}),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {SPAN - 1}], ' ') AS k FROM n JOIN t USING (doc_id)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p + d) AS g FROM later, range({SPAN}) r(d) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' ')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)"""
