"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Text is cut into words (blanks and what follows them), and words of equal length advance together, a position
at a time. Rolling substring hashes probe the sorted keys of the pieces for all places at once; a maximum over
the piece lengths picks each place's best last piece and stores it as backpointer.

Unigram models take the path of the largest sum of scores. For a BPE model that path is not what its merges
give, so the maximum runs over admissible paths only: a piece may follow another if merging their characters
leaves exactly the two (``apart``). Of all segmentations the one that merging makes is the only one whose
neighbours are all so, hence the path equals the library's result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import free_name, giving_back

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words up to this length advance in batches; longer ones are rare and go one by one.
LONG = 48
#: Cells (words times places) that one batch holds.
CELLS = 1 << 16
#: Encoded words of a generation: a worker remembers two, each word as the bytes of its ids, some 200 bytes in all.
KNOWN = 150_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER, _PAIRS = 20, 20
_NEVER = np.int64(1 << 40)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 0 ordinary, 1 byte, 2 control or unknown or unused
    unigram: bool
    unknown: int


def load(model_file: str = MODEL_FILE, unigram: bool = False) -> Vocabulary:
    """The vocabulary of a model with an identity normaliser, a leading blank and byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = range(m.get_piece_size())
    kinds = [1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0 for i in n]
    return Vocabulary([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds, unigram, m.unk_id())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Coder:
    def __init__(self, v: Vocabulary):
        self.v, self.size = v, len(v.pieces)
        plain = [i for i, k in enumerate(v.kinds) if k == 0]
        self.longest = max((len(v.pieces[i]) for i in plain), default=1)
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = _BASE
        self.power = np.multiply.accumulate(self.power)
        self.hash = np.zeros(self.size + 1, np.uint64)  # the last is the unknown character's, that no piece holds
        self.length = np.ones(self.size + 1, np.int64)
        for i in plain:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _codes(v.pieces[i]):
                    h = h * _BASE + (c + np.uint64(1))
            self.hash[i] = h
            self.length[i] = len(v.pieces[i])
        spread = self.hash[plain] * _BASE  # a short piece's hash has few bits
        order = np.argsort(spread, kind="stable")
        self.ids = np.array(plain, np.int64)[order]
        self.keys = spread[order]
        # the keys lie in order, so their first bits tell where to look: how many have them, and the place of the first
        bucket = (self.keys >> np.uint64(64 - _FILTER)).astype(np.int64)
        self.held = np.bincount(bucket, minlength=1 << _FILTER).astype(np.int8)
        self.first = (np.cumsum(self.held, dtype=np.int64) - self.held).astype(np.int32)
        self.most = int(self.held.max(initial=0))
        self.pair_key, self.pair_ok = np.full(1 << _PAIRS, -1, np.int64), np.zeros(1 << _PAIRS, bool)
        self.score = np.append(np.array(v.scores), 0.0)
        self.byte = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == 1}
        self.by_text = {v.pieces[i]: i for i in plain}
        self.unknown_score = min((v.scores[i] for i in plain), default=0.0) - 10.0
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, k in zip(v.pieces, v.kinds)]
        if v.unknown >= 0:
            self.raw[v.unknown] = " ⁇ ".encode()
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        if not v.unigram:
            self._histories()

    def _histories(self) -> None:
        """How each piece's characters merge: the places in the order of scores of its merges, and its outer symbols after each."""
        steps = self.longest
        ranks = np.empty(self.size + 1, np.int64)
        ranks[np.argsort(-self.score[:-1], kind="stable")] = np.arange(self.size)
        ranks[self.size] = _NEVER
        self.rank = ranks
        self.merge = np.full((self.size + 1, steps + 1), _NEVER)
        self.left, self.right = np.full((self.size + 1, steps + 1), self.size), np.full((self.size + 1, steps + 1), self.size)
        self.made = np.zeros(self.size + 1, bool)
        self.made[self.size] = True
        for i in map(int, self.ids):
            symbols = list(self.v.pieces[i])
            n = 0
            while True:
                self.left[i, n], self.right[i, n] = self.by_text.get(symbols[0], self.size), self.by_text.get(symbols[-1], self.size)
                found = [(ranks[p], k) for k in range(len(symbols) - 1) if (p := self.by_text.get(symbols[k] + symbols[k + 1])) is not None]
                if not found:
                    break
                r, k = min(found)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                self.merge[i, n] = r
                n += 1
            self.made[i] = len(symbols) == 1

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        out = np.full(h.shape, -1, np.int64)
        h = h * _BASE
        bucket = h >> np.uint64(64 - _FILTER)
        held = self.held[bucket]
        for k in range(self.most):
            at = np.nonzero(held > k)
            i = self.first[bucket[at]] + k
            same = self.keys[i] == h[at]
            out[tuple(x[same] for x in at)] = self.ids[i[same]]
        return out

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart``, with a table that remembers the last pair of each slot."""
        key = a * (self.size + 1) + b
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - _PAIRS)).astype(np.int64)
        new = np.unique(key[self.pair_key[slot] != key])
        if len(new):
            made = self.apart(new // (self.size + 1), new % (self.size + 1))
            at = ((new.astype(np.uint64) * _BASE) >> np.uint64(64 - _PAIRS)).astype(np.int64)
            self.pair_key[at], self.pair_ok[at] = new, made
            lost = self.pair_key[slot] != key  # two new pairs of one slot
            out = self.pair_ok[slot]
            if lost.any():
                out[lost] = made[np.searchsorted(new, key[lost])] if np.isin(key[lost], new).all() else self.apart(a[lost], b[lost])
            return out
        return self.pair_ok[slot]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b leaves just a and b: the merges of either side go by their
        rank, the left one first on ties, and none across the border comes before them."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y = self.right[a, i], self.left[b, j]
            p = self.probe(self.hash[x] * self.power[np.minimum(self.length[y], self.longest)] + self.hash[y])
            across = np.where((p >= 0) & (x < self.size) & (y < self.size) & (self.length[x] + self.length[y] <= self.longest), self.rank[p], _NEVER)
            ra, rb = self.merge[a, i], self.merge[b, j]
            joins = (across < ra) & (across <= rb)
            out[live[joins]] = False
            on = ~joins & ((ra < _NEVER) | (rb < _NEVER))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            first = ra <= rb
            i, j = i[on] + first, j[on] + ~first
        return out

    def _candidates(self, codes: np.ndarray) -> np.ndarray:
        """For (words, length) codes: the piece of k characters that ends at each place, by (k - 1, word, place); -1 for none."""
        n, size = codes.shape
        h = np.zeros((n, size + 1), np.uint64)
        for e in range(size):
            h[:, e + 1] = h[:, e] * _BASE + (codes[:, e] + np.uint64(1))
        out = np.full((min(self.longest, size), n, size + 1), -1, np.int64)
        for k in range(1, len(out) + 1):
            out[k - 1, :, k:] = self.probe(h[:, k:] - h[:, : size + 1 - k] * self.power[k])
        out[0, :, 1:][out[0, :, 1:] < 0] = self.size
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, one position of all of them at a time."""
        n, size = len(words), len(words[0])
        codes = _codes("".join(words)).reshape(n, size)
        found = self._candidates(codes)
        back = np.zeros((n, size + 1), np.int64)  # length of the best last piece
        last = np.full((n, size + 1), -1, np.int64)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        # all candidates by place, then word; a piece that merging never makes is none
        places = found.transpose(2, 1, 0)
        e_at, w_at, k_at = np.nonzero(places >= 0)
        ids = places[e_at, w_at, k_at]
        if not self.v.unigram:
            keep = self.made[ids]
            e_at, w_at, k_at, ids = e_at[keep], w_at[keep], k_at[keep], ids[keep]
        cost = np.where(ids == self.size, self.unknown_score, self.score[ids]) if self.v.unigram else None
        bounds = np.searchsorted(e_at, np.arange(size + 2))
        for e in range(1, size + 1):
            part = slice(bounds[e], bounds[e + 1])
            w, k, i = w_at[part], k_at[part], ids[part]
            start = e - k - 1
            value = best[w, start]
            if self.v.unigram:
                value = value + cost[part]
            else:
                live = np.flatnonzero((start > 0) & (value > -np.inf))
                value[live[~self.stay(last[w[live], start[live]], i[live])]] = -np.inf
            heads = np.flatnonzero(np.diff(w, prepend=-1))
            if not len(heads):
                continue
            most = np.maximum.reduceat(value, heads)
            top = np.flatnonzero((value == np.repeat(most, np.diff(heads, append=len(w)))) & (value > -np.inf))
            top = top[::-1]  # of equal ones the shortest is written last
            best[w[top], e], back[w[top], e], last[w[top], e] = value[top], k[top] + 1, i[top]
        # all paths back at once, each written from the right
        rows, at, step = np.arange(n), np.full(n, size), 0
        path = np.full((n, size), -1, np.int64)
        while (at > 0).any():
            step += 1
            path[:, size - step] = np.where(at > 0, last[rows, at], -1)
            at = at - np.where(at > 0, back[rows, at], 0)
        path = path[:, size - step :]
        # a path shorter than others has its blanks on the left
        skip, flat = (4 * ((path < 0).argmin(axis=1) + step * rows)).tolist(), path.astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip(skip, range(4 * step, 4 * step * n + 1, 4 * step))]
        for w in np.flatnonzero((path == self.size).any(axis=1)).tolist():
            out[w] = self._bytes([i for i in path[w].tolist() if i >= 0], words[w])
        return out

    def _long(self, word: str) -> bytes:
        """A long word's ids: all probes at once, then one place after the other."""
        size, codes = len(word), _codes(word)
        back, last, best = [0] * (size + 1), [-1] * (size + 1), [-np.inf] * (size + 1)
        best[0] = 0.0
        ok: dict[tuple[int, int], bool] = {}
        block = 4096
        for at in range(0, size, block):
            lo = max(0, at - self.longest)
            found = self._candidates(codes[None, lo : at + block])[:, 0, :]
            for e in range(at + 1, min(size, at + block) + 1):
                for k in np.flatnonzero(found[: min(e, len(found)), e - lo] >= 0).tolist():
                    i, s = int(found[k, e - lo]), e - k - 1
                    value = best[s]
                    if value == -np.inf:
                        continue
                    if self.v.unigram:
                        value += self.unknown_score if i == self.size else self.score[i]
                    elif not self.made[i]:
                        continue
                    elif s > 0:
                        pair = (last[s], i)
                        if pair not in ok:
                            ok[pair] = bool(self.stay(np.array([pair[0]]), np.array([i]))[0])
                        if not ok[pair]:
                            continue
                    if value > best[e]:
                        best[e], back[e], last[e] = value, k + 1, i
        e, ids = size, []
        while e > 0:
            ids.append(last[e])
            e -= back[e]
        return self._bytes(ids[::-1], word)

    def _bytes(self, ids: list[int], word: str) -> bytes:
        """The ids as 32-bit numbers; characters that no piece holds become their bytes (the unknown id where the model has none)."""
        out, at = [], 0
        for i in ids:
            if i == self.size:
                c = word[at].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in c] if self.byte else [self.v.unknown]
                at += 1
            else:
                out.append(i)
                at += len(self.v.pieces[i])
        return np.array(out, np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, where each text's end)."""
        cut = [_WORD.findall(f"{SPACE}{t.replace(' ', SPACE)}") if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.before, self.known = self.known, {}
        new: dict[int, list[str]] = {}
        for w in set(chain.from_iterable(cut)) - self.known.keys():
            if (ids := self.before.get(w)) is not None:
                self.known[w] = ids
            else:
                new.setdefault(len(w), []).append(w)
        for size, words in new.items():
            if size > LONG:
                self.known.update((w, self._long(w)) for w in words)
                continue
            step = max(1, CELLS // size)
            for at in range(0, len(words), step):
                self.known.update(zip(words[at : at + step], self._words(words[at : at + step])))
        parts = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        return np.frombuffer(b"".join(parts), np.int32), np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        size = self.raw_size[ids]
        upto = np.cumsum(size)
        at = np.repeat(self.raw_start[ids] - (upto - size), size) + np.arange(int(upto[-1]) if len(ids) else 0)
        raw, cuts = self.raw_bytes[at].tobytes(), np.concatenate(([0], upto))[np.concatenate(([0], ends))].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_all(texts)
        return [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


_CODERS: dict[str, Coder] = {}


def _coder(v: Vocabulary) -> Coder:
    """One coder a worker process and model: its tables take a second to build."""
    key = hashlib.sha256(repr((v.unigram, v.unknown, v.pieces, v.kinds, v.scores)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(v)
    return _CODERS[key]


def encoded(docs: DataFrame, model_file: str = MODEL_FILE, text_col: str = "text", unigram: bool = False) -> DataFrame:
    """``docs`` without its text, with ids (array of int), n_tokens and round_trip (whether decoding gives the text back).

    Null and empty texts have no ids. The blank sign U+2581 in a text counts as a blank, as the library has
    it. Repeated rows get equal ids; other columns pass, but for those with the new names, which are replaced.
    One pass, no shuffle.
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    model = docs.sparkSession.sparkContext.broadcast(load(model_file, unigram))  # a vocabulary's size is fixed
    names = [c for c in docs.columns if c.lower() not in (text_col.lower(), "ids", "n_tokens", "round_trip")]
    held = free_name(names, "held_text")

    def run(batches):
        coder = _coder(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [t or "" for t in part.column(held).to_pylist()]
                ids, ends = coder.encode_all(texts)
                same = [a == t.replace(SPACE, " ") for a, t in zip(coder.decode_all(ids, ends), texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array(np.diff(ends, prepend=0)), pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])

    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias(held))
    fields = [docs.schema[c] for c in names]
    return rows.mapInArrow(giving_back(run), StructType([*fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())]))


def decoded(rows: DataFrame, model_file: str = MODEL_FILE, ids_col: str = "ids") -> DataFrame:
    """``rows`` with text: what their ids decode to; null for null ids. Ids outside the vocabulary raise an error."""
    from pyspark.sql.types import StringType, StructField, StructType

    model = rows.sparkSession.sparkContext.broadcast(load(model_file))
    keep = rows.drop("text") if "text" in rows.columns and ids_col != "text" else rows

    def run(batches):
        coder = _coder(model.value)
        for b in batches:
            texts = [None if i is None else coder.decode(i) for i in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return keep.mapInArrow(giving_back(run), StructType([*keep.schema.fields, StructField("text", StringType())]))
