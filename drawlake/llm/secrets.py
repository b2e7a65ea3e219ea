"""Secret scans with a recursive decoding worklist.

Every text is scanned as it stands (layer 0). Fragments of a layer that look encoded - runs of percent
escapes, runs of Unicode or hex escapes, base64 words, compressed bytes - are unwrapped into new layers,
which are scanned and unwrapped in turn until nothing new appears. Layers already seen (by content) are
not taken up again, so cycles end. Compressed streams are read and scanned in pieces, cut where no match can
lie across. Findings of a layer are mapped to the text's own code points.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import giving_back

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: A failing run holds no passing one, so the two runs may ask for their length at once; the assign pattern may not.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Escapes, and what ends the run of characters around them: white space, and their first character where it begins none.
_PERCENT, _PERCENT_END = re.compile(r"%[0-9A-Fa-f]{2}"), re.compile(r"\s|%(?![0-9A-Fa-f]{2})")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_ESCAPE_END = re.compile(r"\s|\\(?!u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})")
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]")
#: Readable parts of bytes that aren't all text; no match is shorter than ``token=`` and six characters.
_PART = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]{12,}")
#: Twelve bytes take sixteen characters, and no finding is shorter than twelve.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What a compressed stream starts with, and how it is opened.
_MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor), (b"x\x01", zlib.decompressobj), (b"x\x5e", zlib.decompressobj), (b"x\x9c", zlib.decompressobj), (b"x\xda", zlib.decompressobj))
#: Each encoded fragment of a text has its own guard against bombs: bytes that streams in it may unfold to, and characters of its other layers.
MAX_STREAM, MAX_LAYERS = 1 << 30, 1 << 26
#: Bytes that a stream is read in; characters kept of a run that offers no place to cut, and again of its end when it is cut all the same.
PIECE, LONGEST_RUN, OVERLAP = 1 << 20, 1 << 26, 1 << 12
#: Where no match can lie across: single spaces away from assignments, line breaks that don't wrap base64.
_CUT = re.compile(r"""(?<=[^\s=:"'])[ \t](?=[^\s=:"'])|(?<=[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd])|(?<=[^\sA-Za-z0-9+/_=-])\n|(?<=\n)\n""")
_NEXT_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+)")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three kinds in ``text`` itself, by start, then kind."""
    found: list[Span] = []
    low = text.lower() if "=" in text or ":" in text else ""
    if low and ("pass" in low or "secret" in low or "token" in low or "api" in low):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A decoded text, and where its characters lie in the layer that it was decoded from (None: the original)."""

    def __init__(self, text: str, above: _Layer | None = None, local: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.above, self.local = text, above, local

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Code points of the original that text[start:end] came from."""
        layer: _Layer | None = self
        while layer is not None and layer.local is not None:
            start, end = layer.local(start, end)
            layer = layer.above
        return start, end


class _Places:
    """Where a decoded text's characters lie in the text above: one entry for a run of characters that were written in the same number of characters."""

    def __init__(self):
        self.at, self.source, self.width = array("q"), array("q"), array("q")
        self.text: list[str] = []
        self.size = 0

    def add(self, text: str, source: int, width: int) -> None:
        """``text``, of which each character takes ``width`` characters from ``source`` on."""
        if text:
            if not (self.at and self.width[-1] == width and self.source[-1] + (self.size - self.at[-1]) * width == source):
                self.at.append(self.size)
                self.source.append(source)
                self.width.append(width)
            self.text.append(text)
            self.size += len(text)

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return self.source[i] + (start - self.at[i]) * self.width[i], self.source[j] + (end - self.at[j]) * self.width[j]

    def layer(self, above: _Layer) -> _Layer:
        text, self.text = "".join(self.text), []
        return _Layer(text, above, self)


def _plain(raw: bytes) -> str | None:
    """Text of decoded bytes, if they are text: UTF-8 and hardly any control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and _readable(text) else None


def _readable(text: str) -> bool:
    return len(_ODD.findall(text)) * 20 <= len(text)


class _Stream:
    """Compressed bytes of a fragment, with all levels of compression below them."""

    def __init__(self, raw: bytes, above: _Layer, whole: tuple[int, int], first: Callable | None = None):
        self.raw, self.above, self.whole, self.first = raw, above, whole, first

    def windows(self) -> Iterator[_Layer]:
        """Text of all levels in windows; each level's pieces are read once, on their way to the next level."""
        levels: list[_Windows] = []
        for level, piece in _unfolded(self.raw, self.first):
            if level == len(levels):
                levels.append(_Windows())
            for text in levels[level].add(piece):
                yield _Layer(text, self.above, lambda start, end: self.whole)
        for level in levels:
            for text in level.rest():
                yield _Layer(text, self.above, lambda start, end: self.whole)


def _bare():
    return zlib.decompressobj(-15)


class _Inflater:
    """What compressed bytes unfold to, in pieces; streams that follow each other count, a damaged one ends it.
    ``first`` opens what starts with no known mark."""

    def __init__(self, first: Callable | None = None):
        self.first, self.open, self.held, self.dead = first, None, b"", False

    def pieces(self, data: bytes) -> Iterator[bytes]:
        if self.held:
            data, self.held = self.held + data, b""
        while not self.dead and (data or self.open is not None):
            if self.open is None:
                data = data if self.first else data.lstrip(b"\0")
                if len(data) < 6 and not self.first:
                    self.held = data  # too few to tell
                    return
                opener = next((f for magic, f in _MAGIC if data.startswith(magic)), self.first)
                self.first = None
                if opener is None:
                    break
                self.open = opener()
            try:
                got = self.open.decompress(data, PIECE)
            except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
                break
            d = self.open
            if d.eof:
                data, self.open = d.unused_data, None
            else:
                data = getattr(d, "unconsumed_tail", b"")
            if got:
                yield got
            if self.open is not None and not data and len(got) < PIECE and getattr(d, "needs_input", True):
                return
        else:
            return
        self.dead = True


def _unfolded(raw: bytes, first: Callable | None = None) -> Iterator[tuple[int, bytes]]:
    """(level, piece) of all that ``raw`` unfolds to, level below level, until one is no stream or begins like one before it.

    Each piece goes on to the level below before the next is read, on a stack of open streams, so that neither the
    number of levels nor their size matters.
    """
    levels, heads = [_Inflater(first)], {hashlib.blake2b(raw[:PIECE]).digest()}
    begun = 0
    work = [levels[0].pieces(raw)]
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
            continue
        level = len(work) - 1
        if level == begun:
            head = hashlib.blake2b(got[:PIECE]).digest()
            if head in heads:
                levels[level].dead = True
                work.pop()
                continue
            heads.add(head)
            begun += 1
            levels.append(_Inflater())
        yield level, got
        work.append(levels[level + 1].pieces(got))


def _stream(raw: bytes, above: _Layer, start: int, end: int) -> _Stream | None:
    """``raw``, decoded from above.text[start:end], as a stream; None if it is none. Bytes of an unmarked stream count as one if they unfold to text."""
    if len(raw) < 8:
        return None
    if next(_unfolded(raw), None) is not None:
        return _Stream(raw, above, (start, end))
    head = next(_unfolded(raw, _bare), (0, b""))[1]
    if len(head) >= 12 and _readable(head.decode("utf-8", "replace")):
        return _Stream(raw, above, (start, end), _bare)
    return None


class _Windows:
    """A stream's text in windows that end where no match can lie across. Bytes that are no UTF-8 give U+FFFD, which is part of no match and ends a run."""

    def __init__(self):
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.kept: list[str] = []
        self.size = 0

    def add(self, raw: bytes) -> Iterator[str]:
        text = self.decoder.decode(raw)
        last = None
        for start in (max(0, len(text) - OVERLAP), 0):
            for last in _CUT.finditer(text, start):
                pass
            if last:
                break
        self.kept.append(text[: last.end()] if last else text)
        self.size += len(self.kept[-1])
        if last or self.size > LONGEST_RUN:
            window = "".join(self.kept)
            self.kept = [text[last.end() :] if last else window[-OVERLAP:]]
            self.size = len(self.kept[0])
            yield window

    def rest(self) -> Iterator[str]:
        if self.size:
            yield "".join(self.kept)


def _runs(t: str, one: re.Pattern, end: re.Pattern) -> Iterator[tuple[int, int]]:
    """Where escapes stand, with the characters around them up to the next end on either side; each place is looked at once."""
    done = 0
    while (m := one.search(t, done)) is not None:
        start = done
        for x in end.finditer(t, done, m.start()):
            start = x.end()
        stop = end.search(t, m.end())
        done = stop.start() if stop else len(t)
        yield start, done


def _unescaped(layer: _Layer, start: int, end: int) -> Iterator[_Layer]:
    places, at, t = _Places(), start, layer.text
    for x in _ESCAPE.finditer(t, start, end):
        places.add(t[at : x.start()], at, 1)
        places.add(_chr(x), x.start(), x.end() - x.start())
        at = x.end()
    places.add(t[at:end], at, 1)
    yield places.layer(layer)


def _percent(layer: _Layer, start: int, end: int) -> Iterator[_Layer | _Stream]:
    """Percent escapes as UTF-8; bytes that aren't may be compressed."""
    t, places, at = layer.text, _Places(), start
    for x in _PERCENTS.finditer(t, start, end):
        s, e = x.span()
        places.add(t[at:s], at, 1)
        raw = bytes.fromhex(x.group().replace("%", ""))
        if (stream := _stream(raw, layer, s, e)) is not None:
            yield stream
        for part, n in _by_width(raw.decode("utf-8", "surrogateescape")):
            places.add(re.sub("[\ud800-\udfff]", "\ufffd", part), s, 3 * n)
            s += 3 * n * len(part)
        at = e
    places.add(t[at:end], at, 1)
    yield places.layer(layer)


#: Characters of one, two, three and four bytes of UTF-8; a byte that is none stands as a surrogate.
_WIDTHS = re.compile("([\x00-\x7f\udc80-\udcff]+)|([\x80-\u07ff]+)|([\u0800-\ud7ff\ue000-\uffff]+)|([\U00010000-\U0010ffff]+)")


def _by_width(text: str) -> Iterator[tuple[str, int]]:
    for m in _WIDTHS.finditer(text):
        yield m.group(), m.lastindex


def _chr(x: re.Match) -> str:
    v = int(next(g for g in x.groups() if g), 16)
    return chr(v) if v < 0x110000 and not 0xD800 <= v < 0xE000 else "\ufffd"


class _Based:
    """Where characters decoded from base64 lie among its characters: a byte k in 4k/3, and these in the lines that were joined."""

    def __init__(self, text: str, size: int, lines: list[tuple[int, int]], shift: int):
        self.size, self.lines, self.shift = size, lines, shift
        self.ends = list(itertools.accumulate(e - s for s, e in lines))
        self.bytes = _Places()  # its width is that of bytes
        if not text.isascii():
            at = 0
            for part, n in _by_width(text):
                self.bytes.add(part, at, n)
                at += n * len(part)
            self.bytes.text = []

    def _place(self, k: int) -> int:
        line = min(bisect_right(self.ends, k), len(self.lines) - 1)
        return self.lines[line][0] + k - (self.ends[line - 1] if line else 0)

    def local(self, from_: int) -> Callable[[int, int], tuple[int, int]]:
        """Of a layer that begins at character ``from_`` of the decoded text."""

        def found(start: int, end: int) -> tuple[int, int]:
            a, b = start + from_, end + from_
            if self.bytes.at:
                a, b = self.bytes(a, b)
            a, last = a * 4 // 3, (b - 1) * 4 // 3
            b = max(min(self.size, -(-b * 4 // 3)), last + 1)
            return self._place(self.shift + a), self._place(self.shift + b - 1) + 1

        return found


def _based(layer: _Layer, lines: list[tuple[int, int]]) -> Iterator[_Layer | _Stream]:
    """Base64 in one run, or in runs of lines that follow each other, from each of the four places that its first group may begin at."""
    whole = "".join(layer.text[s:e] for s, e in lines).rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        word = whole[shift:]
        if len(word) % 4 == 1:
            word = word[:-1]
        if len(word) < 16:
            return
        raw = base64.b64decode(word + "=" * (-len(word) % 4))
        text = raw.decode("utf-8", "surrogateescape")
        places = _Based(text, len(word), lines, shift)
        if (stream := _stream(raw, layer, places._place(shift), lines[-1][1])) is not None:
            yield stream
        plain = _plain(raw) is not None
        for start, end in [(0, len(text))] if plain else [x.span() for x in _PART.finditer(text)]:
            yield _Layer(text[start:end], layer, places.local(start))
        if plain:
            return


def _wrapped(t: str, m: re.Match) -> list[tuple[int, int]]:
    """The run of ``m`` and those of the lines after it, up to the first that is shorter than the one before."""
    lines = [m.span()]
    while t[lines[-1][1] - 1] != "=" and (x := _NEXT_LINE.match(t, lines[-1][1])):
        lines.append(x.span(1))
        if len(lines) > 2 and x.end() - x.start(1) < lines[-2][1] - lines[-2][0]:
            break
    s, e = lines[-1]
    lines[-1] = s, e + (0 if t[e - 1] == "=" else len(re.compile("={0,2}").match(t, e)[0]))
    return lines


def _unwrapped(layer: _Layer) -> Iterator[_Layer | _Stream]:
    t = layer.text
    if "%" in t:
        for start, end in _runs(t, _PERCENT, _PERCENT_END):
            yield from _percent(layer, start, end)
    if "\\" in t:
        for start, end in _runs(t, _ESCAPE, _ESCAPE_END):
            yield from _unescaped(layer, start, end)
    done = 0
    for m in _BASE64.finditer(t):
        if m.start() >= done and len(lines := _wrapped(t, m)) > 1:
            # the run's first line may be a word before the wrapped ones, its last a word after them
            wide = len(lines) > 2 or lines[1][1] - lines[1][0] >= 16
            for some in (lines, lines[:-1], lines[1:], lines[1:-1]) if wide else (lines,):
                if len(some) > 1:
                    yield from _based(layer, some)
            done = lines[-2][1] if len(lines) > 2 else lines[-1][0]
        yield from _based(layer, [m.span()])


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): a decoded finding is added unless another span of its kind holds its place.

    Layers are followed depth first, fragment by fragment of the text.
    """
    text = text or ""
    base = base_spans(text)
    found: set[Span] = set()
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    whole = _Layer(text)
    work: list[tuple] = [(whole, _unwrapped(whole))]
    room = [0, 0]
    while work:
        layer, below = work[-1]
        new = next(below, None)
        if new is None:
            work.pop()
            continue
        if len(work) == 1:
            room = [MAX_STREAM, MAX_LAYERS if isinstance(new, _Stream) else max(MAX_LAYERS, 16 * len(new.text))]
        if isinstance(new, _Stream):
            work.append((new, new.windows()))
            continue
        streamed = isinstance(layer, _Stream)
        if len(new.text) > room[not streamed]:
            if streamed:
                work.pop()
            continue
        mark = hashlib.blake2b(new.text.encode("utf-8", "surrogatepass") + repr((new.span(0, 1), len(new.text))).encode(), digest_size=16).digest()
        room[not streamed] -= len(new.text) if streamed or mark not in seen else 0
        if mark in seen or (not streamed and new.text == layer.text):
            continue
        seen.add(mark)
        work.append((new, _unwrapped(new)))
        for s, kind, e in base_spans(new.text):
            found.add((new.span(s, e)[0], kind, new.span(s, e)[1]))
    return base, _outer(base, found - set(base))


def _outer(base: list[Span], found: set[Span]) -> list[Span]:
    """All of ``base``, and of ``found`` what lies in no other span of its kind."""
    out, reach = list(base), [-1] * len(KINDS)
    own = set(base)
    for s, k, e in sorted([*base, *found], key=lambda x: (x[0], -x[2])):
        if e > reach[k] and (s, k, e) not in own:
            out.append((s, k, e))
        reach[k] = max(reach[k], e)
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(batches):
    for batch in batches:
        cols = [[], [], [], [], []]
        for text in batch.column(batch.num_columns - 1):
            base, spans = scan(text.as_py())
            for k in range(3):
                cols[k].append(sum(1 for x in base if x[1] == k))
            cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[4].append(joined(spans))
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
        names = [batch.schema.field(i).name for i in range(batch.num_columns - 1)] + ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, the digest of the base spans, all spans.

    A null or empty text has no spans: counts 0, the digest of the empty string, spans ''. Null ids and
    repeated rows pass through. Other columns are ignored. The work is per row, with no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(_scanned), f"doc_id long, {_OUT}")


def _masked(batches):
    for batch in batches:
        out = []
        for text in batch.column("text"):
            t = text.as_py()
            if t:
                spans, at, parts = scan(t)[1], 0, []
                for s, k, e in spans:
                    if e > at:
                        parts.append(t[at : max(s, at)] + (f"[{KINDS[k]}]" if s >= at else ""))
                        at = e
                t = "".join(parts) + t[at:]
            out.append(t)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; overlapping spans give one mark. All other columns stay."""
    return docs.mapInArrow(giving_back(_masked), docs.schema)
