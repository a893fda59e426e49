"""Secrets in texts and in what is encoded inside them, found by a worklist of decoded layers."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curveloom.llm.common import map_batches

#: Kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of these is taken whole, so a least length in the pattern drops the same matches as a later test.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINT = re.compile(r"(?:word|passwd|secret|token|key)[\"']?\x20*[:=]", re.ASCII | re.IGNORECASE)

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on over line ends, as mail and key files wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\t ]*[A-Za-z0-9+/_-]++)+={0,2}")
LINE_ENDS = re.compile(r"\r?\n[\t ]*")
#: First bytes of compressed data: gzip, zlib, bzip2, xz (fixed values).
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00")
#: How compressed data starts in base64: the same first bytes, as far as they fix whole characters.
PACKED = re.compile(r"H4s|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|[/_]Td6WFo")
#: What a decoded run needs to show to be looked at: shorter stretches of plain characters hold no secret.
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
#: Characters of a run that show whether compressed data may start there.
PEEK = 96
#: Bytes unpacked at once; characters of a layer looked at once, and those that the next part repeats. Longer
#: layers are looked at part by part, so their length is not limited and memory does not grow with it.
CHUNK, WINDOW, OVERLAP = 1 << 20, 1 << 24, 1 << 16

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, leftmost and without overlap for each kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A decoded text; for each code point, where in the whole text it comes from (None: the whole text itself)."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def placed(self) -> Layer:
        """The layer with a place for each code point."""
        if self.starts is not None:
            return self
        places = np.arange(len(self.text) + 1, dtype=np.int32)
        return Layer(self.text, places[:-1], places[1:])

    @staticmethod
    def within(text: str, start: int, end: int) -> Layer:
        """A layer whose code points all come from one run; its places take no memory."""
        return Layer(text, np.broadcast_to(np.int32(start), len(text)), np.broadcast_to(np.int32(end), len(text)))


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of ``pattern`` decoded in place; None if nothing changes.

    ``decode`` gives the characters of a run, each with its place in the run, or None to leave it.
    """
    parts, starts, ends, at = [], [], [], 0
    for match in pattern.finditer(layer.text):
        decoded = decode(match.group())
        if decoded is None:
            continue
        layer = layer.placed()
        characters, first, last = decoded
        parts += [layer.text[at:match.start()], characters]
        starts += [layer.starts[at:match.start()], layer.starts[match.start() + np.array(first, np.int64)]]
        ends += [layer.ends[at:match.start()], layer.ends[match.start() + np.array(last, np.int64) - 1]]
        at = match.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> tuple[str, list[int], list[int]] | None:
    try:
        text = bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None
    first, last, at = [], [], 0
    for character in text:
        n = 3 * len(character.encode("utf-8"))
        first.append(at)
        last.append(at + n)
        at += n
    return text, first, last


def _escapes(run: str) -> tuple[str, list[int], list[int]] | None:
    units = [(int(m[1] or m[2] or m[4] or "0", 16) if not m[3] else int(m[3]), m.start(), m.end())
             for m in ONE_ESCAPE.finditer(run)]
    out, first, last = [], [], []
    i = 0
    while i < len(units):
        value, start, end = units[i]
        if 0xD800 <= value < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            value = 0x10000 + ((value - 0xD800) << 10) + (units[i + 1][0] - 0xDC00)
            end = units[i + 1][2]
            i += 1
        if value > 0x10FFFF or 0xD800 <= value < 0xE000:
            return None
        out.append(chr(value))
        first.append(start)
        last.append(end)
        i += 1
    return "".join(out), first, last


def _tool(data: bytes):
    """What unpacks data with these first bytes."""
    if data.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data.startswith(b"\xfd7zXZ") else zlib.decompressobj()


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Compressed bytes unpacked chunk by chunk, one member after the other, as far as they are whole."""
    tool, data = None, b""
    for more in chunks:
        data += more
        while data:
            if tool is None:
                if not data.startswith(MAGIC):
                    return
                tool = _tool(data)
            try:
                out = tool.decompress(data, CHUNK)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if out:
                yield out
            if tool.eof:
                tool, data = None, tool.unused_data
            elif hasattr(tool, "unconsumed_tail"):
                data = tool.unconsumed_tail
            else:
                data = b""
                while not tool.eof and not tool.needs_input:
                    try:
                        out = tool.decompress(b"", CHUNK)
                    except (OSError, EOFError, lzma.LZMAError, ValueError):
                        return
                    if out:
                        yield out
                if tool.eof:
                    tool, data = None, tool.unused_data


def _unwrapped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes below all layers of compression; a layer that starts like one before it is not unpacked again."""
    seen: set[bytes] = set()
    while True:
        first = next(chunks, b"")
        digest = hashlib.sha256(first).digest()
        whole = _joined(first, chunks)
        if not first.startswith(MAGIC) or digest in seen:
            return whole
        seen.add(digest)
        chunks = _inflated(whole)


def _joined(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from rest


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """Text in parts of ``WINDOW`` characters that overlap; bytes that are no text are replaced."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    parts, held, fresh = [], 0, False
    for chunk in chunks:
        text = decoder.decode(chunk)
        parts.append(text)
        held += len(text)
        fresh = True
        if held >= WINDOW:
            whole = "".join(parts)
            yield whole
            parts, fresh = [whole[-OVERLAP:]], False
            held = OVERLAP
    if fresh:
        yield "".join(parts) + decoder.decode(b"", True)


def _decoded(run: str) -> bytes:
    """The bytes of base64 characters in either alphabet; a last one that is alone is left out."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    bare = bare[:len(bare) - (len(bare) % 4 == 1)]
    return base64.b64decode(bare + "=" * (-len(bare) % 4))


def _pieces(run: str, start: int) -> Iterator[bytes]:
    """The bytes of a run from a place on, in pieces that grow, so that a false start costs little."""
    step = 4096
    while start < len(run):
        yield _decoded(run[start:start + step])
        start, step = start + step, min(2 * step, CHUNK)


def _opens(run: str) -> bool:
    """Whether compressed data starts here: the first bytes can be unpacked."""
    data = _decoded(run[:PEEK])
    if not data.startswith(MAGIC):
        return False
    try:
        _tool(data).decompress(data, CHUNK)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return False
    return True


def _texts(run: str) -> Iterator[tuple[int, str]]:
    """Texts in a run of base64 characters, each with the place in the run where it starts.

    A run that is a text as a whole is that text only. Otherwise something may be glued to its start: compressed data
    is tried wherever it can begin, plain text at all four ways to part the run.
    """
    data = _decoded(run)
    if not data.startswith(MAGIC):
        try:
            text = data.decode("utf-8")
            if text:
                yield 0, text
            return
        except UnicodeDecodeError:
            pass
    for match in PACKED.finditer(run):
        if _opens(run[match.start():match.start() + PEEK]):
            for text in _windows(_unwrapped(_pieces(run, match.start()))):
                yield match.start(), text
    for shift in range(4):
        data = _decoded(run[shift:])
        if PLAIN.search(data):
            yield shift, data.decode("utf-8", "replace")


def _below(layer: Layer) -> Iterator[Layer]:
    """The layers right below one: rewritten in place, and those in its runs."""
    for pattern, decode in ((PERCENT, _percent), (ESCAPE, _escapes)):
        found = _rewritten(layer, pattern, decode)
        if found is not None:
            yield found
    for match in BASE64.finditer(layer.text):
        for shift, text in _texts(match.group()):
            yield Layer.within(text, *layer.outer(match.start() + shift, match.end()))
    for match in WRAPPED.finditer(layer.text):
        for _, text in _texts(LINE_ENDS.sub("", match.group())):
            yield Layer.within(text, *layer.outer(match.start(), match.end()))


def decoded_layers(text: str) -> Iterator[Layer]:
    """Layers below a text, each once: unwrapping goes on until nothing new comes out.

    The worklist is a stack of layers in work, so only those above the present one are held. A layer that was
    seen at the same place before is not unwrapped again, so cycles end.
    """
    digest = lambda layer: hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
    root = Layer(text)
    seen = {(0, len(text), digest(root))}
    todo = [_below(root)]
    while todo:
        found = next(todo[-1], None)
        if found is None:
            todo.pop()
        elif found.text:
            key = (int(found.starts[0]), int(found.ends[-1]), digest(found))
            if key not in seen:
                seen.add(key)
                yield found
                todo.append(_below(found))


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and, at the place of what holds them, those in layers.

    A layer that is rewritten in place holds its text around the decoded runs again; a span there
    that only shows what the base patterns show at the same place adds nothing.
    """
    base = base_spans(text)
    found = set(base)
    for layer in decoded_layers(text):
        for start, kind, end in base_spans(layer.text):
            first, last = layer.outer(start, end)
            found.add((first, kind, last))
    return base, sorted(found)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256 and spans of every whole text.

    Spans are kind:start:end in code points of the text, end exclusive, in the order of start, kind
    and end. Null counts as empty: no spans, and the digest of the empty string. Repeated rows are judged alike, an
    empty table gives no rows. Texts of any length are searched whole, with a few arrays of four bytes a
    character only where runs are rewritten in place; layers of any length are searched in parts of ``WINDOW``.
    """
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts: list[list[int]] = [[], [], []]
        digests, listed = [], []
        for text in batch["text"].to_pylist():
            base, found = secret_spans(text or "")
            for kind, column in enumerate(counts):
                column.append(sum(s[1] == kind for s in base))
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            listed.append(_listed(found))
        return {"doc_id": batch["doc_id"], **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(listed, pa.string())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "text"], run,
                       f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
