"""Target-distribution importance resampling.

Hashed n-gram counts of the whole corpus and of a target are compared bucket by bucket; a document's weight is the
mean log ratio of its n-grams, and seeded Gumbel noise turns the largest weights into a draw without replacement.
Inside a task the n-grams of a batch are interned in an open-addressed table: each distinct n-gram is hashed to a
bucket once, and occurrences only carry the number of their slot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import CRC32_SQL, crc32_sql, free_name, stored
from drawlake.operators.graph import numbered

BUCKETS = 10_000
#: Runs of 1 to N words are features.
N = 1
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text that are interned in one table.
CHUNK = 8 << 20

#: Bytes of words: digits, a to z after lower-casing, and all that is outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Table:
    """An open-addressed table of byte strings: ``intern`` gives each occurrence the slot of its string.

    Slots are probed one after another from the key's low bits, all occurrences in step: those that meet a free slot
    put their key there (of several the last written wins and the others look again), those that meet their own key
    compare its bytes, all others go on. So two strings of equal key never share a slot. ``bucket`` and ``count``
    are columns beside the keys.
    """

    def __init__(self, most: int):
        size = 1 << max(4, (2 * most - 1).bit_length())
        self.mask = np.int64(size - 1)
        self.key = np.zeros(size, np.uint64)
        self.owner = np.full(size, -1, np.int64)
        self.bucket = np.zeros(size, np.int64)
        self.count = np.zeros(size, np.int64)

    def intern(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Slots of the strings data[start : start + length]; ``data`` ends with 8 bytes that belong to none."""
        lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(start))
        while len(left):
            at = slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]
            self.key[at[free]] = key[left[free]]
            own = self.owner[at]
            same = (self.key[at] == key[left]) & (length[own] == length[left])
            same[same] = _equal(data, lanes, start[own[same]], start[left[same]], length[left[same]])
            left = left[~same]
            slot[left] = (slot[left] + 1) & self.mask
        self.count += np.bincount(slot, minlength=len(self.count))
        return slot


def _equal(data: np.ndarray, lanes: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which strings are equal byte by byte, eight bytes at a time."""
    out = np.ones(len(a), bool)
    todo = np.flatnonzero(a != b)
    at = 0
    while len(todo):
        left = length[todo] - at
        diff = lanes[a[todo] + at] ^ lanes[b[todo] + at]
        keep = np.minimum(left, 8).astype(np.uint64)
        diff &= np.where(keep == 8, np.uint64(2**64 - 1), (np.uint64(1) << (keep * np.uint64(8))) - np.uint64(1))
        out[todo[diff != 0]] = False
        at += 8
        todo = todo[(diff == 0) & (left > 8)]
    return out


def features(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, features of each text before the next): runs of 1 to n words of each text, words parted by one space."""
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = _WORD[data]
    first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    last = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    size = last - first
    # words again, each followed by one space, so that a run of words is one stretch of bytes
    keep = word.copy()
    keep[last] = True
    data = np.where(word, data, np.uint8(32))[keep]
    start = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64) if len(size) else np.empty(0, np.int64)
    of = np.searchsorted(ends, first, side="right")
    starts, lengths, texts_of = [start], [size], [of]
    for k in range(2, n + 1):
        whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1]) if len(of) >= k else np.empty(0, np.int64)
        starts.append(start[whole])
        lengths.append(start[whole + k - 1] + size[whole + k - 1] - start[whole])
        texts_of.append(of[whole])
    counts = np.bincount(np.concatenate(texts_of), minlength=len(texts))
    order = np.argsort(np.concatenate(texts_of), kind="stable") if n > 1 else slice(None)
    return np.r_[data, np.zeros(8, np.uint8)], np.concatenate(starts)[order], np.concatenate(lengths)[order].astype(np.int64), counts


def interned(texts: list[bytes], n: int = N, buckets: int = BUCKETS) -> tuple[Table, np.ndarray, np.ndarray]:
    """(table, slot of each feature, features of each text): each distinct n-gram got its bucket once."""
    data, start, length, counts = features(texts, n)
    raw = data.tobytes()
    key = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + length).tolist())), np.uint64, len(start))
    table = Table(len(start))
    slot = table.intern(data, start, length, key)
    used = np.flatnonzero(table.owner >= 0)
    first, size = start[table.owner[used]], length[table.owner[used]]
    table.bucket[used] = [zlib.crc32(raw[a : a + m]) % buckets for a, m in zip(first.tolist(), size.tolist())]
    return table, slot, counts


def _chunks(batch: pa.RecordBatch):
    """(first row, texts as bytes) in parts of CHUNK bytes or one text."""
    at, held, size = 0, [], 0
    for k, t in enumerate(batch.column("text")):
        t = t.as_buffer()
        t = t.to_pybytes() if t is not None else b""
        if held and size + len(t) > CHUNK:
            yield at, held
            at, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _texts(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(df: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts of ``df`` fall into each bucket. A task passes on one count a bucket, so the driver gets ``buckets`` rows."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in _chunks(b):
                table, _, _ = interned(texts, n, buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, count in _texts(df).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, by bucket."""
    s, t, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row, in one pass."""

    def run(batches):
        for b in batches:
            words, counts, weights = [], [], []
            for _, texts in _chunks(b):
                table, slot, count = interned(texts, n, len(gain))
                ends = np.cumsum(count)
                total = np.r_[0, np.cumsum(gain[table.bucket][slot])]
                sums = total[ends] - total[ends - count]
                counts.append(count)
                weights.append(np.where(count > 0, sums // np.maximum(count, 1), 0))
                words.append(count if n == 1 else features(texts, 1)[3])
            arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, counts, weights)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "n_words", "n_features", "weight"])

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_sample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank counts those drawn from 1 and is null for the others.

    ``target`` needs a column text. Null texts have no features and weight 0; a null id is written empty into the seed
    of its noise and comes after others of equal score. Repeated rows have equal scores and are drawn each by itself.
    Other columns are ignored. Empty tables give no rows; an empty target makes rare buckets gain.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # stored, as dealing by ranges reads its input twice
    rows = stored(weighed(docs, gain, n), "weighed").withColumn("score", F.col("weight") + noise).withColumns({"_out": (F.col("n_words") < least_words).cast("int"), "_down": -F.col("score"), "_none": F.col("doc_id").isNull().cast("int")})
    placed = numbered(rows, ["_out", "_down", "_none", "doc_id"])
    drawn = placed.where("_out = 0").count() * percent // 100
    rank = F.when((F.col("_out") == 0) & (F.col("number") <= drawn), F.col("number").cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns and the rank in ``sample_rank``."""
    name, key = free_name(docs.columns, "sample_rank"), free_name([*docs.columns, "sample_rank"], "drawn_id")
    drawn = importance_sample(docs, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("rank").alias(name))
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).drop(key)


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
known AS (SELECT w, {crc32_sql('w')} % {BUCKETS} AS b FROM (SELECT w FROM words UNION SELECT w FROM goal), crc_tab),
s AS (SELECT b, count(*) AS n FROM words JOIN known USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM goal JOIN known USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
weights AS (SELECT doc_id, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM words JOIN known USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= total * {PERCENT} // 100 THEN r END AS rank FROM ranked"""
