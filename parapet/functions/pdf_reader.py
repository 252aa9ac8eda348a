"""Reading one PDF: its objects, the streams of its pages, and the text that they show.

The module is shipped to the workers with the function, so executors need no installed copy.
Only streams that pages and forms use are expanded, within budgets that are checked before
memory is used. Whatever cannot be read is named in the problem, never left out in silence.
"""

import bisect
import re
import struct
import sys
import zlib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from parapet import settings as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())])
# A token with the blanks before it; every byte that is no blank starts one.
_SYNTAX = re.compile(
    rb"[\s\x00]*+(?:<(?P<hex>[^<>]*)>|(?P<begin><<|\[)|(?P<end>>>|\])|(?P<string>\()"
    rb"|/(?P<name>[^\s\x00()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s\x00()<>\[\]{}/%]))"
    rb"|(?P<word>[^\s\x00()<>\[\]{}/%]+|[{}<>)])|(?P<skip>%[^\r\n]*|\Z))"
)
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_STRING_PART = re.compile(rb"\\(?:\r\n|[0-7]{1,3}|.)|[()]", re.S)
# fixed values: what a backslash and a letter stand for in a PDF string
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Name(str):
    pass


class _Word(bytes):
    pass


class _Ref(int):
    pass


def _string(data, at):
    """A string in brackets from `at` on, and where it ends."""
    out, depth, start = [], 0, at
    for m in _STRING_PART.finditer(data, at):
        part = m.group()
        if part == b"(":
            depth += 1
        elif part == b")":
            if depth == 0:
                return b"".join([*out, data[start:m.start()]]), m.end()
            depth -= 1
        else:
            code = part[1:]
            value = bytes([int(code, 8) & 255]) if code[:1] in b"01234567" else _ESCAPES.get(code, b"" if code[:1] in b"\r\n" else code)
            out += [data[start:m.start()], value]
            start = m.end()
    return b"".join([*out, data[start:]]), len(data)


def _hex(digits):
    try:  # the usual form: whole pairs
        return bytes.fromhex(digits.decode("latin-1"))
    except ValueError:
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _values(data, at=0):
    """(value, end) of each value at the top level; arrays are lists, dictionaries dicts.
    A dictionary's end may also close an array and the other way round: broken files are common."""
    open_ = []
    match, size = _SYNTAX.match, len(data)
    while at < size:
        m = match(data, at)
        at, kind = m.end(), m.lastgroup
        if kind == "hex":
            value = _hex(m.group("hex"))
        elif kind == "word":
            value = _Word(m.group("word"))
            if open_ and value in (b"endobj", b"stream"):
                at = m.start("word")
                break
        elif kind == "number":
            value = float(m.group("number"))
        elif kind == "name":
            value = _Name(m.group("name").decode("latin-1"))
        elif kind == "skip":
            continue
        elif kind == "begin":
            open_.append((m.group("begin"), []))
            continue
        elif kind == "end":
            if not open_:
                continue
            mark, items = open_.pop()
            value = items if mark == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, _Name)}
        else:
            value, at = _string(data, at)
        if open_:
            items = open_[-1][1]
            if kind == "word" and value == b"R" and len(items) >= 2 and isinstance(items[-2], float):
                items[-2:] = [_Ref(items[-2])]
            else:
                items.append(value)
        else:
            yield value, at
    while open_:  # never closed: what is there counts
        mark, items = open_.pop()
        value = items if mark == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, _Name)}
        if open_:
            open_[-1][1].append(value)
        else:
            yield value, at


class _File:
    """Objects by number: the last of a number counts, packed ones only where no plain one is."""

    def __init__(self, data):
        self.objects, self.streams, self.problems, self.expanded = {}, {}, [], 0
        at = 0
        while m := _OBJECT.search(data, at):
            number, at = int(m.group(1)), m.end()
            value, end = next(_values(data, at), (None, None))
            if end is None:
                self.problem("an object is damaged")
                continue
            at = end
            self.objects[number] = value
            self.streams.pop(number, None)
            s = re.compile(rb"\s*stream(\r\n|\n|\r)?").match(data, at) if isinstance(value, dict) else None
            if s:
                size = value.get("Length")
                end = s.end() + int(size) if isinstance(size, float) and not isinstance(size, _Ref) else -1
                if not re.compile(rb"\s*endstream").match(data, end if end >= 0 else len(data)):
                    end = data.find(b"endstream", s.end())
                    end = len(data) if end < 0 else end
                self.streams[number] = data[s.end():end]
                at = end
        for number in [n for n in self.streams if self.objects[n].get("Type") == "ObjStm"]:
            self._unpack(self.objects[number], self.stream(number) or b"")

    def _unpack(self, holder, data):
        first = holder.get("First")
        if not isinstance(first, float):
            return
        first = int(first)
        index = [int(v) for v, _ in _values(data[:first]) if isinstance(v, float)]
        for k in range(0, len(index) - 1, 2):
            if index[k] not in self.objects:
                end = first + index[k + 3] if k + 3 < len(index) else len(data)
                self.objects[index[k]] = next(_values(data[first + index[k + 1]:end]), (None, 0))[0]

    def get(self, value, key=None):
        """The value, or its entry, with references followed."""
        for _ in range(8):
            if not isinstance(value, _Ref):
                break
            value = self.objects.get(int(value))
        return value if key is None else self.get(value.get(key)) if isinstance(value, dict) else None

    def stream(self, number):
        """A stream's bytes, or None with a problem noted."""
        head, data = self.objects[number], self.streams.get(number)
        filters = self.get(head, "Filter")
        filters = filters if isinstance(filters, list) else [filters] if filters is not None else []
        parms = self.get(head, "DecodeParms")
        parms = [self.get(p) for p in (parms if isinstance(parms, list) else [parms])]
        if any(self.get(f) not in ("FlateDecode", "Fl") for f in filters) or any(isinstance(p, dict) and p.get("Predictor", 1.0) != 1.0 for p in parms):
            return self.problem("a stream is written in a way that is not read")
        for _ in filters:
            room = min(S.PDF_MAX_STREAM, S.PDF_MAX_INFLATED - self.expanded)
            if room <= 0:
                return self.problem(f"streams of more than {S.PDF_MAX_INFLATED >> 20} MB are not read on")
            unpacker = zlib.decompressobj()
            try:
                data = unpacker.decompress(data, room)
            except zlib.error:
                return self.problem("a stream is damaged")
            self.expanded += len(data)
            if unpacker.unconsumed_tail and not unpacker.eof and unpacker.decompress(unpacker.unconsumed_tail, 1):
                whole = room == S.PDF_MAX_STREAM
                self.problem(f"{'a stream' if whole else 'streams'} of more than "
                             f"{(S.PDF_MAX_STREAM if whole else S.PDF_MAX_INFLATED) >> 20} MB {'is' if whole else 'are'} not read on")
            elif not unpacker.eof:
                self.problem("a stream ends too soon")
        return data

    def problem(self, text):
        if text not in self.problems:
            self.problems.append(text)

    def pages(self):
        """(page, inherited resources): the page tree in order, then pages that it does not reach."""
        seen, found = set(), []
        roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        waiting = [(o.get("Pages"), None) for o in reversed(roots)]
        while waiting:
            node, resources = waiting.pop()
            key = int(node) if isinstance(node, _Ref) else id(node)
            value = self.get(node)
            if key in seen or not isinstance(value, dict):
                continue
            seen.add(key)
            resources = self.get(value, "Resources") or resources
            kids = self.get(value, "Kids")
            if isinstance(kids, list):
                waiting += [(k, resources) for k in reversed(kids)]
            elif value.get("Type", "Page") == "Page":
                found.append((value, resources))
        for number, value in self.objects.items():
            if number not in seen and isinstance(value, dict) and value.get("Type") == "Page":
                found.append((value, self.get(value, "Resources")))
        return found

    def parts(self):
        """(stream numbers, resources) of each page, then of each form; a stream counts once."""
        seen = set()
        for page, resources in self.pages():
            contents = page.get("Contents")
            if isinstance(contents, _Ref) and isinstance(self.get(contents), list):
                contents = self.get(contents)
            numbers = [int(r) for r in (contents if isinstance(contents, list) else [contents]) if isinstance(r, _Ref)]
            fresh = [n for n in dict.fromkeys(numbers) if n not in seen]
            seen.update(fresh)
            yield fresh, resources
        for number in sorted(self.streams):
            if self.objects[number].get("Subtype") == "Form" and number not in seen:
                yield [number], self.get(self.objects[number], "Resources")


# Codes that are turned into text at a time.
_CODES = 1 << 16


class _Known(dict):
    """Text of each code number of one width; a code is looked up once."""

    def __init__(self, look, width):
        self.look, self.width = look, width

    def __missing__(self, number):
        self[number] = found = self.look(number.to_bytes(self.width)) or ""
        return found


class _CharMap:
    """Texts of codes, single ones and ranges; ranges stay ranges."""

    def __init__(self, data):
        self.single, self.ranges = {}, []
        waiting = []
        for value, _ in _values(data):
            if not isinstance(value, _Word):
                waiting.append(value)
                continue
            if value == b"endbfchar":
                for code, text in zip(waiting[::2], waiting[1::2]):
                    if isinstance(code, bytes) and isinstance(text, bytes):
                        self.single[code] = text
            elif value == b"endbfrange":
                for low, high, to in zip(waiting[::3], waiting[1::3], waiting[2::3]):
                    if isinstance(low, bytes) and isinstance(high, bytes) and len(low) == len(high):
                        self.ranges.append((len(low), int.from_bytes(low), int.from_bytes(high), to))
            waiting = []
        self.ranges.sort(key=lambda r: r[:3])
        self.starts = [r[:2] for r in self.ranges]
        self.widths = sorted({len(c) for c in self.single} | {r[0] for r in self.ranges}, reverse=True)
        self.known = _Known(self.look, self.widths[0] if self.widths else 1)
        self.entries = len(self.single) + sum(len(r[3]) if isinstance(r[3], list) else 1 for r in self.ranges)

    def look(self, code):
        if code in self.single:
            return self.single[code].decode("utf-16-be", "ignore")
        number = int.from_bytes(code)
        at = bisect.bisect_right(self.starts, (len(code), number)) - 1
        if at < 0 or self.ranges[at][0] != len(code) or number > self.ranges[at][2]:
            return None
        step, to = number - self.ranges[at][1], self.ranges[at][3]
        if isinstance(to, list):
            return to[step].decode("utf-16-be", "ignore") if step < len(to) and isinstance(to[step], bytes) else ""
        if not isinstance(to, bytes) or not to:
            return ""
        end = int.from_bytes(to) + step
        return end.to_bytes(len(to)).decode("utf-16-be", "ignore") if end < 256 ** len(to) else ""

    def text(self, shown):
        if self.widths in ([1], [2]):  # the usual maps; half a code at the end shows nothing
            width, out = self.widths[0], []
            for at in range(0, len(shown), width * _CODES):
                piece = shown[at:at + width * _CODES]
                numbers = piece if width == 1 else struct.unpack(f">{len(piece) // 2}H", piece[:len(piece) // 2 * 2])
                out.append("".join(map(self.known.__getitem__, numbers)))
            return "".join(out)
        out, at = [], 0
        while at < len(shown):
            for width in self.widths:
                found = self.look(shown[at:at + width])
                if found is not None:
                    break
            else:
                found, width = "", self.widths[-1] if self.widths else 1
            out.append(found)
            at += width
        return "".join(out)


class _Fonts:
    """Decoders of a part's font names; each font object is read once a document."""

    def __init__(self, file):
        self.file, self.known, self.entries = file, {}, 0
        self.anywhere = {}
        for value in file.objects.values():
            fonts = file.get(file.get(value, "Resources"), "Font") if isinstance(value, dict) else None
            self.anywhere.update(fonts if isinstance(fonts, dict) else {})

    def decoder(self, resources, name):
        fonts = self.file.get(resources, "Font") if isinstance(resources, dict) else None
        font = fonts.get(name) if isinstance(fonts, dict) else None
        font = self.anywhere.get(name) if font is None else font
        key = int(font) if isinstance(font, _Ref) else id(font)
        if key not in self.known:
            self.known[key] = self._read(self.file.get(font))
        return self.known[key]

    def _read(self, font):
        to_unicode = font.get("ToUnicode") if isinstance(font, dict) else None
        if isinstance(to_unicode, _Ref) and int(to_unicode) in self.file.streams:
            codes = _CharMap(self.file.stream(int(to_unicode)) or b"")
            self.entries += codes.entries
            if self.entries > S.PDF_MAX_MAP_ENTRIES:
                self.file.problem("the fonts list too many characters")
            elif codes.widths:
                return codes.text
        if isinstance(font, dict) and font.get("Subtype") == "Type0":
            self.file.problem("a font does not say what its characters are")
        encoding = self.file.get(font, "Encoding") if isinstance(font, dict) else None
        encoding = self.file.get(encoding, "BaseEncoding") if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if encoding == "MacRomanEncoding" else "cp1252"
        return lambda shown: shown[2:].decode("utf-16-be", "ignore") if shown[:2] == b"\xfe\xff" else shown.decode(codec, "replace")


# Thousandths of the font size that part two words.
_WORD_GAP = 200


def _shown(data, decoder_of):
    """Text of a content stream. Where each string stands decides what parts it from the one before:
    another base line or text object is a line break, a step along the line a blank."""
    out, operands, decode = [], [], decoder_of(None)
    line, base, moved = (0.0, 0.0), None, False
    values = _values(data)

    def put(shown):
        nonlocal base, moved
        if base is not None and abs(line[1] - base) > 0.01:
            out.append("\n")
        elif moved:
            out.append(" ")
        out.append(decode(shown))
        base, moved = line[1], False

    for value, at in values:
        if not isinstance(value, _Word):
            operands.append(value)
            continue
        numbers = [v for v in operands if isinstance(v, float)] if value in (b"Td", b"TD", b"Tm") else ()
        if value == b"Tf":
            decode = decoder_of(next((v for v in operands if isinstance(v, _Name)), None))
        elif value in (b"Td", b"TD") and len(numbers) == 2:
            line, moved = (line[0] + numbers[0], line[1] + numbers[1]), base is not None
        elif value == b"Tm" and len(numbers) == 6:
            line, moved = (numbers[4], numbers[5]), base is not None
        elif value == b"BT":
            out += ["\n"] * (base is not None)
            line, base, moved = (0.0, 0.0), None, False
        elif value == b"T*":
            out.append("\n")
        elif value in (b"Tj", b"'", b'"'):
            if value != b"Tj":
                out.append("\n")
            for shown in operands[-1:]:
                if isinstance(shown, bytes):
                    put(shown)
        elif value == b"TJ":
            for shown in operands[-1] if operands and isinstance(operands[-1], list) else []:
                if isinstance(shown, bytes):
                    put(shown)
                elif isinstance(shown, float) and shown < -_WORD_GAP:
                    moved = True
        elif value == b"ID":  # the bytes of a picture in the stream
            end = re.compile(rb"\sEI\b").search(data, at)
            values = None if end is None else end.end()
            return "".join(out) + ("" if values is None else "\n" + _shown(data[values:], decoder_of))
        operands = []
    return "".join(out)


def read_document(data):
    """(text, problem): all text that is read, and what is not; no text and a reason where nothing is."""
    if b"%PDF-" not in data[:1024]:
        return "", "the file does not start like a PDF"
    if re.search(rb"/Encrypt\s", data):
        return "", "the PDF is encrypted"
    file = _File(data)
    if not file.objects:
        return "", "the PDF holds no objects"
    fonts, texts = _Fonts(file), []
    for numbers, resources in file.parts():
        streams = []
        for number in numbers:
            if number in file.streams:
                streams.append(file.stream(number) or b"")
            else:
                file.problem("a page names a stream that is missing")
        if streams:
            texts.append(_shown(b"\n".join(streams), lambda name: fonts.decoder(resources, name)))
    return "\n".join(texts), "; ".join(file.problems) or None


@F.pandas_udf(_READ)
def read_pdf(contents: pd.Series) -> pd.DataFrame:
    """Text and problem of each file; a file that cannot be taken apart has no text and says so."""
    rows = []
    for data in contents:
        try:
            rows.append((None, None) if data is None else read_document(bytes(data)))
        except (ValueError, ArithmeticError, RecursionError, AttributeError, TypeError, LookupError):
            rows.append(("", "the PDF is damaged"))
    return pd.DataFrame(rows, columns=["text", "problem"])
