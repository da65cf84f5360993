"""Secret scan with a worklist of decoded layers.

Each text is a layer. Encoded stretches of a layer (URL escapes, Unicode escapes, base64, and gzip
or zlib data below any of them or each other) are decoded into further layers until none is left;
every layer is scanned, and what is found is mapped back to the characters of the text that hold it.
Escapes nested more than ESCAPE_STEPS deep are unwrapped to their end at once, so that their time
follows the length of the text. Every start of compressed data is tried and read as far as it
inflates: each false start that inflates far costs its own length again.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed

KINDS = ("assign", "access", "hex")
MIN_BASE64 = 16  # characters of a stretch that is tried
BLOCK = 1 << 20  # bytes that are inflated at a time
SCAN_CHARS = 16 << 20  # characters of a decompressed layer that are scanned at a time
ESCAPE_STEPS = 4  # levels of escapes that are layers of their own; what is below them is unwrapped at once
MIN_TEXT = 0.9  # share of printable characters from which decoded bytes count as text


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = re.compile(rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_LINE = r"[ \t]*+\r?\n[ \t]*+"
# A stretch goes on over line breaks, as in MIME and PEM.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:%s[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{%d,}+)={0,2}" % (_LINE, MIN_BASE64))
_BREAK = re.compile(_LINE)
_DIVIDES = re.compile(r"[+/]")  # "-" and "_" in the standard alphabet
_STANDARD = str.maketrans("-_", "+/")
_ASCII = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")  # what can hold a secret, the shortest of which has 12 characters
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")  # starts of compressed data anywhere in a stretch

Span = tuple[int, int]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind; matches
    that are too short are dropped after matching."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """Decoded text; ``spans`` has where each character came from in the document (starts and ends
    never fall), or one place for all of them, or is None for the document itself. ``steps``: how
    many levels of escapes were unwrapped one by one to get here."""

    def __init__(self, text: str, spans: list[Span] | Span | None, steps: int = 0):
        self.text, self.steps = text, steps
        self.place = spans if isinstance(spans, tuple) else None
        self.starts = self.ends = None
        if isinstance(spans, list):
            self.starts, self.ends = array("q", [s for s, _ in spans]), array("q", [e for _, e in spans])

    def origin(self, start: int, end: int) -> Span:
        if self.place is not None:
            return self.place
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]


def _characters(data: bytes, places: list[Span]) -> tuple[str, list[Span]] | None:
    """UTF-8 bytes, each with its place, as characters; None if they are no text."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    spans, at = [], 0
    for c in text:
        n = len(c.encode("utf-8"))
        spans.append((places[at][0], places[at + n - 1][1]))
        at += n
    return text, spans


def _printable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= MIN_TEXT * len(text)


class Packed:
    """The bytes ``part`` of a stretch's data, compressed, below ``depth`` layers of compression, all
    from one place. They are not copied: many starts of one stretch may reach its end."""

    def __init__(self, data: bytes, part: Span, place: Span, depth: int = 1):
        self.data, self.part, self.place, self.depth = data, part, place, depth

    def blocks(self) -> Iterator[bytes]:
        out = _slices(self.data, *self.part)
        for _ in range(self.depth):
            out = _inflated(out)
        return out


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 0x8F == 8 and int.from_bytes(data[:2], "big") % 31 == 0


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All members of a compressed stream, block by block, then what follows them as it stands."""
    z, rest, members = None, b"", 0
    while True:
        if z is None:
            rest = rest.lstrip(b"\0") if members else rest
            while len(rest) < 3 and (more := next(chunks, None)) is not None:
                rest = (rest + more).lstrip(b"\0") if members else rest + more
            if not _compressed(rest):
                if members and rest:
                    yield b"\n" + rest
                    yield from chunks
                return
            z = zlib.decompressobj(wbits=47)
        try:
            out = z.decompress(rest, BLOCK)
        except zlib.error:
            return
        if out:
            yield out
        if z.eof:
            z, rest, members = None, z.unused_data, members + 1
            continue
        rest = z.unconsumed_tail
        if not rest and len(out) < BLOCK:
            rest = next(chunks, b"")
            if not rest:
                return


def _body(data: bytes, at: int, zeros: Sequence[int]) -> int | None:
    """Where the compressed data behind a gzip or zlib header begins; None if the bytes are none.
    ``zeros`` are the places of zero bytes, which end the names in a gzip header."""
    if data[at] != 0x1F:
        return at + 2 if _compressed(data[at:at + 3]) and not data[at + 1] & 0x20 else None
    if len(data) < at + 10 or data[at + 1] != 0x8B or data[at + 2] != 8 or data[at + 3] & 0xE0:
        return None
    flags, p = data[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(data[p:p + 2], "little")
    for named in (8, 16):
        if flags & named:
            k = bisect_left(zeros, p)
            if k == len(zeros):
                return None
            p = zeros[k] + 1
    p += flags & 2
    return p if p < len(data) else None


_PLAIN_HEADER = b"\x1f\x8b\x08" + bytes(7)


def _extent(data: bytes, at: int, body: int) -> tuple[int, bool]:
    """Bytes that the compressed members at a place take, 0 if they do not inflate, and whether they
    come to an end. A stream that breaks off takes all that was read."""
    header = _PLAIN_HEADER if data[at] == 0x1F else data[at:body]
    more = body - at - len(header)  # bytes of the header that are not read again
    z, rest, taken, read, made = zlib.decompressobj(wbits=47), b"", 0, 0, 0

    def found(n: int, whole: bool) -> tuple[int, bool]:
        return (n + more if n else 0), whole

    for chunk in chain([header], _slices(data, body, len(data))):
        rest, read = rest + chunk, read + len(chunk)
        while True:
            if z is None:
                if len(rest) < 3:
                    break
                if not _compressed(rest):
                    return found(taken, True)
                z = zlib.decompressobj(wbits=47)
            try:
                out = z.decompress(rest, BLOCK)
            except zlib.error:
                return found(taken, True) if taken else found(read if made else 0, False)
            made += len(out)
            if z.eof:
                rest = z.unused_data
                taken, z = read - len(rest), None
                continue
            rest = z.unconsumed_tail
            if not rest and len(out) < BLOCK:
                break
    return found(taken, True) if z is None else found(read if made else taken, False)


def _streams(data: bytes, starts: Sequence[int]) -> Iterator[tuple[int, int, bool]]:
    """(place, length, whole) of the compressed streams among rising places where one may start.

    A whole stream is not looked into. One that breaks off is, as it may be a false start, however
    many of these there are: real data may lie inside what they inflate.
    """
    zeros: Sequence[int] = np.flatnonzero(np.frombuffer(data, np.uint8) == 0).tolist() if starts else []
    done, tried = 0, set()
    for k in starts:
        if k < done:
            continue
        body = _body(data, k, zeros)
        if body is None or body in tried:  # another header in front of the same data
            continue
        tried.add(body)
        n, whole = _extent(data, k, body)
        if n:
            yield k, n, whole
        if whole:
            done = k + n


def _slices(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """The data from a place to another in growing parts: most starts inflate no further than the first."""
    size = 256
    while at < end:
        yield data[at:min(at + size, end)]
        at, size = at + size, min(2 * size, BLOCK)


# A character that no pattern and no encoding can hold: a long text may be cut behind it.
_APART = re.compile(r"[^A-Za-z0-9+/_.=\-\"' :%\\&#;\r\n\t]")


def _texts(blocks: Iterator[bytes]) -> Iterator[str]:
    """Decompressed bytes as text in parts of SCAN_CHARS or more, cut where no match and no encoded
    stretch can be cut in two."""
    decoder, held, new = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for block in blocks:
        held.append(decoder.decode(block))
        new += len(held[-1])
        if new < SCAN_CHARS:
            continue
        text, new = "".join(held), 0
        apart = _APART.search(text[::-1])
        if apart and not any(start.search(text) for start, _ in _ESCAPED):
            yield text[:len(text) - apart.start()]
            text = text[len(text) - apart.start():]
        held = [text]
    text = "".join(held) + decoder.decode(b"", True)
    if text:
        yield text


def _starts(forms) -> re.Pattern:
    """The first two bytes of gzip and zlib data, each as it stands or escaped."""
    heads = {0x1F: [0x8B]} | {c: [f for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20] for c in range(8, 0x80, 16)}
    either = lambda codes: "(?:" + "|".join(f"{forms(c)}|{re.escape(chr(c))}" for c in codes) + ")"
    return re.compile("|".join(either([c]) + either(second) for c, second in heads.items()))


def _caseless(code: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in code)


_SHORT = {"b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "a": 7}
# Starts of escaped compressed data, and its units: an escape or a plain character for each byte.
_ESCAPED = (
    (_starts(lambda c: "%" + _caseless(f"{c:02x}")), re.compile(r"%[0-9A-Fa-f]{2}|[\x00-\xff]")),
    (_starts(lambda c: r"\\(?:x|u00|U000000)" + _caseless(f"{c:02x}") + f"|&#(?:0*{c}|[xX]0*{_caseless(f'{c:x}')});" + (r"|\\b" if c == 8 else "")),
     re.compile(_UNICODE.pattern + r"|\\[btnvfra\\'\"/]|[\x00-\xff]")),
)


def _code(unit: str) -> int:
    if len(unit) == 1:
        return ord(unit)
    if unit[0] == "%":
        return int(unit[1:], 16)
    if unit[0] == "&":
        return int(unit[3:-1], 16) if unit[2] in "xX" else int(unit[2:-1])
    return int(unit[2:], 16) if len(unit) > 2 else _SHORT.get(unit[1], ord(unit[1]))


_HEADS = re.compile(b"(?=\x1f\x8b|" + b"|".join(
    re.escape(bytes([c])) + b"[" + b"".join(re.escape(bytes([f])) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20) + b"]"
    for c in range(8, 0x80, 16)) + b")", re.S)


def _from_escaped(layer: Layer) -> Iterator[Packed]:
    """Compressed data whose bytes are written as escapes, all or those that are not printable."""
    for start, unit in _ESCAPED:
        url = unit is _ESCAPED[0][1]
        if url and "%" not in layer.text or not url and "\\" not in layer.text and "&#" not in layer.text:
            continue
        at = 0
        while m := start.search(layer.text, at):
            # The bytes from here to where they end are read once for all starts among them.
            data, spaced, begins, end = bytearray(), bytearray(), array("q"), m.start()
            for u in unit.finditer(layer.text, end):
                code = _code(u.group())
                if u.start() != end or code > 0xFF:
                    break
                begins.append(end)
                end = u.end()
                data.append(code)
                spaced.append(0x20 if url and u.group() == "+" else code)  # a form writes a space as a plus sign
            begins.append(end)
            at = max(end, m.start() + 1)
            for k, n, source in _either_way(bytes(data), bytes(spaced)):
                yield Packed(source, (k, k + n), layer.origin(begins[k], begins[k + n]))


def _either_way(data: bytes, spaced: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Streams of the bytes, and of those with spaces where they read whole only so."""
    starts = [h.start() for h in _HEADS.finditer(data)]
    found = {k: (n, whole, data) for k, n, whole in _streams(data, starts)}
    if spaced != data:
        for k, n, whole in _streams(spaced, [k for k in starts if k not in found or not found[k][1]]):
            if whole or k not in found:
                found[k] = n, whole, spaced
    done = 0
    for k in sorted(found):
        n, whole, source = found[k]
        if k >= done:
            yield k, n, source
            done = k + n if whole else done


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that ``decode`` understands put in plain characters."""
    text, spans, last, changed = [], [], 0, False
    one = layer.place is not None
    for m in pattern.finditer(layer.text):
        got = decode(layer, m)
        if got is None:
            continue
        text += [layer.text[last:m.start()], got[0]]
        spans += [] if one else [layer.origin(i, i + 1) for i in range(last, m.start())] + got[1]
        last, changed = m.end(), True
    if not changed:
        return None
    text.append(layer.text[last:])
    if one:
        return Layer("".join(text), layer.place, layer.steps + 1)
    spans += [layer.origin(i, i + 1) for i in range(last, len(layer.text))]
    return Layer("".join(text), spans, layer.steps + 1)


_ESCAPE_END = frozenset("0123456789abcdefABCDEF;")
_LAST_ESCAPE = re.compile(rf"(?:%[0-9A-Fa-f]{{2}}|{_UNICODE.pattern})\Z")
_LONGEST_ESCAPE = 11
_LOOSE = re.compile("[\udc80-\udcff]+")  # bytes of URL escapes that are not ASCII, until they are put together


def _unescaped(layer: Layer) -> Layer | None:
    """All URL and Unicode escapes unwrapped to the end, whatever their depth, in one pass: as soon
    as the last characters are an escape, what it stands for takes their place and may complete
    another one."""
    text, starts, ends, changed = [], [], [], False
    for i, c in enumerate(layer.text):
        start, end = layer.origin(i, i + 1)
        while True:
            text.append(c)
            starts.append(start)
            ends.append(end)
            if c not in _ESCAPE_END:
                break
            m = _LAST_ESCAPE.search("".join(text[-_LONGEST_ESCAPE:]))
            if not m:
                break
            code = _code(m.group())
            if m.group()[0] == "%":
                c = chr(code) if code < 0x80 else chr(0xDC00 + code)
            elif code > 0x10FFFF or 0xD800 <= code < 0xE000:
                break
            else:
                c = chr(code)
            start, changed = starts[-len(m.group())], True
            for part in (text, starts, ends):
                del part[-len(m.group()):]
    if not changed:
        return None
    whole = "".join(text)
    if not _LOOSE.search(whole):
        return Layer(whole, layer.place or list(zip(starts, ends)), ESCAPE_STEPS)
    out, spans, last = [], [], 0
    for m in _LOOSE.finditer(whole):
        places = list(zip(starts[m.start():m.end()], ends[m.start():m.end()]))
        data = bytes(ord(c) - 0xDC00 for c in m.group())
        got = _characters(data, places) or (data.decode("latin-1"), places)
        out += [whole[last:m.start()], got[0]]
        spans += [*zip(starts[last:m.start()], ends[last:m.start()]), *got[1]]
        last = m.end()
    out.append(whole[last:])
    spans += zip(starts[last:], ends[last:])
    return Layer("".join(out), layer.place or spans, ESCAPE_STEPS)


def _from_url(layer: Layer, m: re.Match):
    places = [layer.origin(i, i + 3) for i in range(m.start(), m.end(), 3)]
    data = bytes.fromhex(m.group().replace("%", ""))
    return _characters(data, places) or (data.decode("latin-1"), places)


def _from_unicode(layer: Layer, m: re.Match):
    s = m.group()
    code = int(s[2:], 16) if s[0] == "\\" else int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [layer.origin(m.start(), m.end())]


def _from_base64(layer: Layer) -> Iterator[Layer | Packed]:
    """A stretch may begin behind a word, a path or another stretch, so it is decoded from each of
    its first four characters; of what comes out, each part that is text or inflates is a layer."""
    for m in _BASE64.finditer(layer.text):
        found = m.group()
        breaks = [b.span() for b in _BREAK.finditer(found)] if "\n" in found else []
        body = (_BREAK.sub("", found) if breaks else found).rstrip("=").translate(_STANDARD)
        if len(body) < MIN_BASE64:
            continue
        lines, cut = [], 0  # of each line: its first character in the body, and how far it lies from its place
        for start, end in breaks:
            cut += end - start
            lines.append((end - cut, cut))

        def place(first: int, last: int, padded: bool = False) -> Span:
            """Of characters of the body, with the padding behind the last on request."""
            at = [m.start() + i + (lines[k - 1][1] if (k := bisect_right(lines, i, key=lambda x: x[0])) else 0) for i in (first, last)]
            return layer.origin(at[0], m.end() if padded and last == len(body) - 1 else at[1] + 1)

        fresh = {0, *(i for i, _ in lines), *(p.end() for p in _DIVIDES.finditer(body))}
        for skip in range(4):
            part = body[skip:]
            if len(part) % 4 == 1:
                part = part[:-1]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            last = lambda k: min(skip + 4 * k // 3 + 1, len(body) - 1)
            starts = {p.start() for p in _PACKED.finditer(data)} | {k for i in fresh if (i - skip) % 4 == 0 and (k := (i - skip) // 4 * 3) >= 0 and _compressed(data[k:k + 3])}
            for k, n, _ in _streams(data, sorted(starts)):
                yield Packed(data, (k, k + n), place(skip + 4 * k // 3, last(k + n - 1), True))
            runs = [r.span() for r in _ASCII.finditer(data)]
            if not skip and (not runs or runs[0] != (0, len(data))):
                try:
                    if _printable(data.decode("utf-8")):
                        runs = [(0, len(data))]
                except UnicodeDecodeError:
                    pass
            for start, end in runs:
                end = _same_stretch(data, start, end, skip, lines)
                got = _characters(data[start:end], [place(skip + 4 * k // 3, last(k)) for k in range(start, end)])
                if got:
                    yield Layer(*got)


def _same_stretch(data: bytes, start: int, end: int, skip: int, lines: list[tuple[int, int]]) -> int:
    """The end of a text without the few characters that a word on the next line adds to it by
    chance: text that breaks off early in a short last line, and holds as many secrets without."""
    if not lines or end == len(data):
        return end
    first = -(-(lines[-1][0] - skip) * 3 // 4)  # of the bytes that reach into the last line
    if not start < first < end or len(data) - first >= 12 or len(scan(data[start:first].decode())) != len(scan(data[start:end].decode())):
        return end
    return first


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those of every layer until no layer brings a new one. A layer
    seen before (a cycle) is not opened again."""
    base = scan(text)
    spans, seen = set(base), {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    work: deque[Layer | Packed] = deque([Layer(text, None)])

    def opened(new: Layer) -> Iterator[Layer | Packed]:
        yield from _from_base64(new)
        yield from _from_escaped(new)
        if new.steps >= ESCAPE_STEPS:
            yield _unescaped(new)
            return
        if "%" in new.text:
            yield _replaced(new, _URL, _from_url)
        if "\\" in new.text or "&#" in new.text:
            yield _replaced(new, _UNICODE, _from_unicode)

    def first(*parts: bytes) -> bool:
        digest = hashlib.sha256(b"".join(parts)).digest()
        return digest not in seen and not seen.add(digest)

    def scanned(new: Layer) -> bool:
        if not first(new.text.encode("utf-8", "surrogatepass"), repr(new.origin(0, 1) if new.text else None).encode()):
            return False
        spans.update((kind, *new.origin(start, end)) for kind, start, end in scan(new.text))
        return True

    while work:
        layer = work.popleft()
        if isinstance(layer, Layer):
            for new in opened(layer):
                if isinstance(new, Packed) or new is not None and scanned(new):
                    work.append(new)
            continue
        whole, head = hashlib.sha256(), b""

        def read() -> Iterator[bytes]:
            nonlocal head
            for block in layer.blocks():
                whole.update(block)
                head = (head + block[:3])[:3]
                yield block

        # A part is opened at once, not kept: a packed layer may hold more than memory does.
        for part in _texts(read()):
            text_part = Layer(part, layer.place)
            if scanned(text_part):
                work.extendleft(new for new in opened(text_part) if isinstance(new, Packed) or new is not None and scanned(new))
        if _compressed(head) and first(b"packed", whole.digest(), repr(layer.place).encode()):
            work.append(Packed(layer.data, layer.part, layer.place, layer.depth + 1))
    return base, list(spans)


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column(batch.num_columns - 1):
            base, spans = find((t.as_py() or b"").decode("utf-8", "replace"))
            counts = [sum(kind == k for kind, _, _ in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per document: id columns, n_assign, n_access, n_hex, base_sha256 and spans.

    Counts and digest are of the base patterns in the text as it stands; ``spans`` adds what decoded
    layers hold, as kind:start:end in characters of the text. Inside base64 a span is exact to the
    character; inside compressed data it is the whole stretch. Compressed data is read to its end,
    all members and all layers, in parts. Null and empty texts have no spans; repeated rows are rows of their own; an
    empty table gives none. Each text is scanned where it lies, without a shuffle.
    """
    thin = docs.select(*ids_of(docs, id_cols), quoted(text_col).cast("binary").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema.fields[:-1])
    out = thin.mapInArrow(_scanned, f"{fields}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.select(*renamed(id_cols), *out.columns[len(id_cols):])
