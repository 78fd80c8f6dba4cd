"""Secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned and decoded: the layer with all its percent codes replaced,
the layer with all its Unicode escapes replaced, the bytes of its base64 runs, and what gzip, zlib or bzip2 data in
decoded bytes holds. What comes out is a new layer unless the same was seen before from the same place of this text,
until nothing new turns up. Every layer knows which characters of the original each of its characters came from, so a
secret found five layers deep is a span of the text. Decoded bytes are one character each: all patterns are ASCII, so
bytes that are no UTF-8 or no text need no special case.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import append, texts

#: Kinds in the order of equal starts. The patterns and their least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Bytes that are unpacked in one piece; larger contents are scanned as windows of so many and some more, which bounds a worker's memory.
PIECE = 1 << 20
#: Characters that a window shares with the one before it: an encoded secret that is shorter is whole in one of them.
OVERLAP = 1 << 16
#: Packed data in packed data is opened so many times: data that unpacks to ever new packed data has no end.
NESTS = 100

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_HEX = bytes(48 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_IS_BASE64 = bytes(48 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/-_") else 32 for c in range(256))
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&\#([0-9]{1,7});|&\#[xX]([0-9A-Fa-f]{1,6});", re.ASCII)
#: A run of base64, or several that only line breaks (as such or written as escapes), indents and quote marks part.
_BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:[ \t]*\r?\n[ \t>]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]+)*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+")
_BASE64_LEAST = 16
_PLAIN_BASE64 = str.maketrans("-_", "+/")
#: How gzip, zlib and bzip2 data begin.
_MAGIC = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
_MAGIC_BYTES = re.compile(_MAGIC.pattern.encode())
_BYTES = re.compile(r"[\x00-\xff]+")
#: A layer without any of these has no inner layers.
_INNER = re.compile(rf"%[0-9A-Fa-f]{{2}}|\\[ux]|&\#|[A-Za-z0-9+/_-]{{{_BASE64_LEAST}}}|{_MAGIC.pattern}")


def plain_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping per kind."""
    raw = text.encode("utf-8", "surrogatepass")
    out = []
    small = raw.translate(_SMALL)
    if any(k in small for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if b"0" * 24 in raw.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def inner_matches(text: str) -> list[tuple[int, int, int]]:
    """``plain_matches`` of a decoded layer, and assigns that begin inside an earlier one and reach beyond it.

    A layer goes on after what was encoded, and a keyword that is the value of the one before it takes none of its own value away.
    """
    out = plain_matches(text)
    small = text.encode("utf-8", "surrogatepass").translate(_SMALL)
    if any(k in small for k in _KEYWORDS):
        at, reach = 0, -1
        while m := _ASSIGN.search(text, at):
            at = max(m.start() + 1, m.end() - len("password"))  # only a keyword that ends the value reaches beyond it
            if len(m[2]) >= _ASSIGN_LEAST and m.end() > reach:
                out.append((m.start(), 0, m.end()))
                reach = m.end()
    return sorted(set(out))


class Layer:
    """A text and, for each of its characters, where in the original it starts and ends; None: the original itself.

    ``more`` of a window, or of what its last run of base64 holds, gives pieces of bytes from its start on and beyond its end.
    """

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, more: Callable | None = None, nests: int = 0) -> None:
        self.text, self.starts, self.ends, self.more, self.nests = text, starts, ends, more, nests

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])

    def key(self) -> bytes:
        """What makes a layer a new one: the same text from other places holds other spans."""
        out = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        out.update(array("q", self.starts))
        out.update(array("q", self.ends))
        return out.digest()

    def places(self, start: int, end: int) -> tuple[list[int], list[int]]:
        if self.starts is None:
            return list(range(start, end)), list(range(start + 1, end + 1))
        return self.starts[start:end], self.ends[start:end]


class _Unpacked:
    """Pieces of what gzip, zlib or bzip2 data at the start of ``pieces`` holds, of all its members, up to damage or a missing end.

    ``used`` are the bytes of whole members, ``ran_out`` says that more input could give more.
    """

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.used, self.ran_out = iter(pieces), 0, False

    def __iter__(self) -> Iterator[bytes]:
        head, taken = b"", 0
        while True:
            while len(head) < 10 and (more := next(self.pieces, None)):
                head += bytes(more)
                taken += len(more)
            if not _MAGIC_BYTES.match(head):
                return
            tool = bz2.BZ2Decompressor() if head[:3] == b"BZh" else zlib.decompressobj(47)
            try:
                while not tool.eof:
                    out = tool.decompress(head, PIECE)
                    head = getattr(tool, "unconsumed_tail", b"")
                    if out:
                        yield out
                    elif not head and not tool.eof:
                        if not (head := next(self.pieces, b"")):
                            self.ran_out = True
                            return
                        taken += len(head)
            except (zlib.error, OSError, EOFError, ValueError):
                return
            head = tool.unused_data
            self.used = taken - len(head)


def _slices(raw: memoryview) -> Iterator[memoryview]:
    return (raw[i : i + 65536] for i in range(0, len(raw), 65536))


def _skipped(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    for piece in pieces:
        if most < len(piece):
            yield piece[most:]
        most = max(0, most - len(piece))


def _run_bytes(pieces: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """Bytes of the base64 run at the start of ``pieces`` without its first ``skip`` characters, over line breaks."""
    rest, tail = b"", b""
    for piece in pieces:
        text = tail + piece
        tail = b"\\" if text.endswith(b"\\") else b""
        text = re.sub(rb"\\[rn]|[ \t\r\n>]", b"", text[: len(text) - len(tail)])
        run = re.match(rb"[A-Za-z0-9+/_-]*", text)[0]
        body = rest + run
        body, skip = body[skip:], max(0, skip - len(body))
        last = len(run) < len(text)
        cut = len(body) - (len(body) % 4 == 1) if last else len(body) // 4 * 4
        if cut:
            yield base64.b64decode(body[:cut].replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-cut % 4))
        if last:
            return
        rest = body[cut:]
    if len(rest) > 1:
        yield base64.b64decode(rest.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(rest) % 4))


def _windows(source: Callable, start: int, end: int, nests: int) -> Iterator[Layer]:
    """Layers over the pieces of ``source()``, which all come from one place."""
    text, at, fresh = "", 0, 0

    def window() -> Iterator[Layer]:
        if _INNER.search(text) or inner_matches(text):
            yield Layer(text, [start] * len(text), [end] * len(text), lambda at=at: _skipped(source(), at), nests)

    for piece in source():
        if fresh and len(text) + len(piece) > PIECE + OVERLAP:
            yield from window()
            at, text, fresh = at + max(0, len(text) - OVERLAP), text[-OVERLAP:], 0
        text += bytes(piece).decode("latin-1")
        fresh += len(piece)
    if fresh:
        yield from window()


def _replaced(layer: Layer, codes: re.Pattern, char) -> Layer | None:
    """The whole layer with each code replaced by ``char(match)``; None if there is no code, or ``char`` knows none of them."""
    text, at, parts, starts, ends = layer.text, 0, [], [], []
    for m in codes.finditer(text):
        if (new := char(m)) is None:
            continue
        for given, kept in zip(layer.places(at, m.start()), (starts, ends)):
            kept += given
        start, end = layer.origin(m.start(), m.end())
        parts += [text[at : m.start()], new]
        starts.append(start)
        ends.append(end)
        at = m.end()
    if not parts:
        return None
    for given, kept in zip(layer.places(at, len(text)), (starts, ends)):
        kept += given
    return Layer("".join([*parts, text[at:]]), starts, ends, nests=layer.nests)


def _escaped(m: re.Match) -> str | None:
    number = next(int(g, 10 if k == 2 else 16) for k, g in enumerate(m.groups()) if g)
    return chr(number) if number < 0x110000 else None


def _base64(layer: Layer):
    """Bytes of runs of base64, read from each of four characters on: a run may begin before what was encoded, as in a path."""
    for m in _BASE64_LINES.finditer(layer.text):
        lines = [(r.start() + m.start(), r.end() + m.start()) for r in _BASE64.finditer(re.sub(r"\\[rn]", "  ", m[0]))]
        if max(b - a for a, b in lines) < _BASE64_LEAST:
            continue
        # The lines as one run, and each by itself: what follows it may be no part of it.
        for group in [[x] for x in lines if x[1] - x[0] >= _BASE64_LEAST] + [lines] * (len(lines) > 1):
            body = "".join(layer.text[a:b] for a, b in group).translate(_PLAIN_BASE64)
            places = None
            for skip in range(4):
                run = body[skip:]
                run = run[: len(run) - (len(run) % 4 == 1)]
                raw = base64.b64decode(run + "=" * (-len(run) % 4))
                text = raw.decode("latin-1")
                if not (_INNER.search(text) or inner_matches(text)):
                    continue
                places = places or [list(chain.from_iterable(given)) for given in zip(*(layer.places(a, b) for a, b in group))]
                starts, ends = places
                more = None
                if layer.more and group[-1][1] == len(layer.text):
                    more = lambda at=group[0][0], skip=skip: _run_bytes(_skipped(layer.more(), at), skip)
                yield Layer(text, [starts[skip + 8 * i // 6] for i in range(len(raw))], [ends[skip + (8 * i + 7) // 6] for i in range(len(raw))], more, layer.nests)


def _packed(layer: Layer):
    """What packed data among the bytes of a layer holds; all of it comes from all the bytes of that data."""
    done, raw, first = 0, b"", 0
    for m in _MAGIC.finditer(layer.text):
        at = m.start()
        if at < done:
            continue
        if at >= first + len(raw):
            raw, first = memoryview(_BYTES.match(layer.text, at)[0].encode("latin-1")), at
        source = lambda at=at, raw=raw, first=first: iter(_Unpacked(_slices(raw[at - first :])))
        probe, size = _Unpacked(_slices(raw[at - first :])), 0
        for piece in probe:
            size += len(piece)
        if not size:
            continue
        if probe.ran_out and layer.more and first + len(raw) == len(layer.text):
            source = lambda at=at: iter(_Unpacked(_skipped(layer.more(), at)))
        done = at + probe.used if probe.used else at
        start, end = layer.origin(at, done if probe.used else first + len(raw))
        yield from _windows(source, start, end, layer.nests + 1)


def _inner(layer: Layer):
    """Layers that one more decoding of a layer gives."""
    text = layer.text
    if "%" in text and (out := _replaced(layer, _PERCENT, lambda m: chr(int(m[1], 16)))):
        yield out
    if ("\\u" in text or "\\x" in text or "&#" in text) and (out := _replaced(layer, _ESCAPE, _escaped)):
        yield out
    if b"0" * _BASE64_LEAST in text.encode("utf-8", "surrogatepass").translate(_IS_BASE64):
        yield from _base64(layer)
    if layer.starts is not None and layer.nests < NESTS:
        yield from _packed(layer)


def find_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Sorted (start, kind, end) of the fixed patterns in the text, and of these with all that its inner layers add."""
    if not text:
        return [], []
    base = plain_matches(text)
    every = set(base)
    work, seen = [_inner(Layer(text))], set()
    while work:
        if (inner := next(work[-1], None)) is None:
            work.pop()
        elif (key := inner.key()) not in seen:
            seen.add(key)
            every.update((s, kind, e) for start, kind, end in inner_matches(inner.text) for s, e in [inner.origin(start, end)])
            work.append(_inner(inner))
    return base, sorted(every)


SPAN = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base_spans (fixed patterns in the text itself) and all_spans (with those of inner layers).

    Spans are characters (code points), end exclusive, by start and then kind; a span found in several layers
    counts once. Null and empty texts have none. Columns with the new names are replaced. No shuffle.
    """

    def start():
        def batch(rows):
            found = [find_spans(t) for t in texts(rows, text)]
            return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans[i]] for spans in found] for i in (0, 1)]

        return batch

    return append(docs, f"base_spans {SPAN}, all_spans {SPAN}", start)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of secret spans in the text replaced by ``mark``; other texts stay as they are."""

    def start():
        def batch(rows):
            return [[redacted(t, mark) for t in texts(rows, text)]]

        return batch

    return append(docs, f"`{text}` string", start, needs=[text]).select(*docs.columns)


def redacted(text: str | None, mark: str) -> str | None:
    _, spans = find_spans(text)
    if not spans:
        return text
    out, at, last = [], 0, -1
    for start, _, end in spans:
        if start > last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = last
    return "".join(out) + text[at:]


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"))
