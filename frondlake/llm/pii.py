"""Personal data: plain forms, and disguised ones found on a normalised copy of the text.

Four detectors (e-mail, IPv4, card, phone) read the text as it stands; these
are the *base* spans. Texts that may hold a disguise also pass a cascade of
transducers, each rewriting parts of a ``Tape``, a text whose characters
remember the source characters they came from:

1. look-alike letters, digits of other scripts and full-width forms become
   ASCII, invisible characters vanish;
2. in places shaped like a disguised address, written-out or bracketed *at*
   and *dot* become ``@`` and ``.``;
3. in runs of spelled digits, words become digits, the gaps between them vanish
   and written-out *dot* and *plus* become ``.`` and ``+``.

The detectors run again on the normalised text and their spans are mapped back
to source characters. A span is added if it isn't inside a base span of its
kind; base spans always stay. Every detector and transducer takes time linear
in the text. Positions are code points, ends are exclusive.

Rows: null and empty texts have no spans (an empty array). Repeated rows give
repeated results. Other columns pass unchanged, the added column replaces one
of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import output_schema, replace_column

KINDS = ("email", "ip", "card", "phone")
SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("base", pa.bool_())]))

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# -- fixed values: written-out signs and digits, look-alike letters ---------------
AT_WORDS = "at ät arroba arobase chiocciola klammeraffe".split()
DOT_WORDS = "dot punkt punto point".split()
DIGIT_WORDS = {
    word: str(value)
    for words in ("zero one two three four five six seven eight nine",
                  "null eins zwei drei vier fünf sechs sieben acht neun",
                  "cero uno dos tres cuatro cinco seis siete ocho nueve",
                  "zéro un deux trois quatre cinq six sept huit neuf")
    for value, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "з": "3", "б": "6",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ց": "g",
    "․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ",
    " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"


def _look_alikes() -> dict[str, str]:
    """The table above, and every single character whose compatibility form or digit value is ASCII."""
    table = dict.fromkeys(INVISIBLE, "")
    for point in range(0x80, 0x20000):
        char = chr(point)
        plain = unicodedata.normalize("NFKC", char)
        if unicodedata.decimal(char, None) is not None:
            plain = str(unicodedata.decimal(char))
        if len(plain) == 1 and "\x20" < plain < "\x7f":
            table[char] = plain
    return table | LOOK_ALIKE


ASCII_OF = _look_alikes()
ODD = re.compile("[" + "".join(map(re.escape, sorted(ASCII_OF))) + "]")
# A wider class with few ranges, quick to search; German, French and Spanish letters are outside.
MAYBE_ODD = re.compile("[\xa0\xaa\xad\xb2\xb3\xb9\xba\u0131\u0180-\U0010ffff]")

_OPEN, _SHUT = r"[ \t]{0,3}[(\[{<][ \t]{0,2}", r"[ \t]{0,2}[)\]}>][ \t]{0,3}"
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT_BOXED = rf"{_OPEN}(?:{_ATS}|@){_SHUT}"
_DOT_BOXED = rf"{_OPEN}(?:{_DOTS}|\.){_SHUT}"
_DOT_WORD = rf"[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}"
AT_SIGN = re.compile(rf"(?P<boxed>{_AT_BOXED})|[ \t]{{1,3}}(?:@|{_ATS})[ \t]{{1,3}}|@", re.IGNORECASE)
LABEL = re.compile(r"[A-Za-z0-9-]+")
DOT_SIGN = re.compile(rf"(?P<hidden>{_DOT_BOXED}|{_DOT_WORD})|\.", re.IGNORECASE)
CHAIN = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:{_DOT_BOXED}|{_DOT_WORD}|\.)[A-Za-z0-9_%+-]+)*+(?P<open>(?:{_DOT_BOXED}|{_DOT_WORD}|\.)?)", re.IGNORECASE)
REACH = 256
LONGEST_SIGN = 32  # no disguised dot is longer
BOX_CUE = re.compile(rf"[(\[{{<][ \t]{{0,2}}(?:{_ATS}|@|{_DOTS}|\.)[ \t]{{0,2}}[)\]}}>]")
DOT_CUES = tuple(f"{before}{word}{after}" for word in DOT_WORDS for before in " \t" for after in " \t")

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:(?:{_WORDS})(?![^\W_])|[0-9]+(?![^\W\d_]))"
_GAP = rf"(?:[ \t]{{0,2}}-[ \t]{{0,2}}|[ \t]{{1,3}}|[ \t]{{0,2}},[ \t]{{0,2}}|{_DOT_BOXED}|{_DOT_WORD}|\.)"
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus[ \t]{{1,3}}|\+[ \t]{{0,2}}))?{_UNIT}(?:{_GAP}{_UNIT}){{3,}}", re.IGNORECASE)
PIECE = re.compile(rf"(?P<plus>plus[ \t]{{1,3}}|\+[ \t]{{0,2}})|(?P<word>(?:{_WORDS})(?![^\W_]))|(?P<num>[0-9]+)"
                   rf"|(?P<dot>{_DOT_BOXED}|{_DOT_WORD}|\.)|(?P<gap>[ \t,-]+)", re.IGNORECASE)
LEAST_WORDS = 4
PHONE_DIGITS = (8, 15)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: the local part reaches back to the end of the previous match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def addresses(text: str):
    """Whole chains of numbers are taken from the left, four at a time."""
    for chain in DOTTED.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        parts, start = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str):
    for match in GROUPED.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str):
    for match in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in match.group()) <= PHONE_DIGITS[1]:
            yield match.span()


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the four detectors."""
    found = [(0, *span) for span in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(1, *span) for span in addresses(text)]
        found += [(2, *span) for span in cards(text)]
        if "+" in text:
            found += [(3, *span) for span in phones(text)]
    return found


class Tape:
    """A rewritten text; pieces of equal length as their source keep offsets, others point to a whole span."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.source = [0, len(text)], [(0, len(text)), (len(text), len(text))]

    def original(self, start: int, end: int) -> tuple[int, int]:
        def place(position: int) -> tuple[int, int]:
            i = bisect.bisect_right(self.at, position) - 1
            low, high = self.source[i]
            if self.at[i + 1] - self.at[i] == high - low:
                return low + position - self.at[i], low + position - self.at[i] + 1
            return low, high

        return place(start)[0], place(end - 1)[1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace disjoint ascending ranges; ranges come from one piece or become one piece."""
        if not edits:
            return self
        new = Tape("")
        texts, at, source, size, done = [], [], [], 0, 0

        def copy(start: int, end: int) -> None:
            nonlocal size
            i = bisect.bisect_right(self.at, start) - 1
            while start < end:  # one piece for each old piece in the range
                stop = min(end, self.at[i + 1])
                low, high = self.source[i]
                if self.at[i + 1] - self.at[i] == high - low:
                    low, high = low + start - self.at[i], low + stop - self.at[i]
                if stop > start:
                    texts.append(self.text[start:stop])
                    at.append(size)
                    source.append((low, high))
                    size += stop - start
                start, i = stop, i + 1

        for start, end, text in edits:
            copy(done, start)
            if text:
                texts.append(text)
                at.append(size)
                source.append(self.original(start, end))
                size += len(text)
            done = end
        copy(done, len(self.text))
        new.text = "".join(texts)
        new.at, new.source = at + [size], source + [(self.source[-1][0],) * 2]
        return new


def ascii_forms(tape: Tape) -> Tape:
    return tape.rewrite([(m.start(), m.end(), ASCII_OF[m.group()]) for m in ODD.finditer(tape.text)])


def _local_part(text: str, low: int, end: int) -> int | None:
    """Where the chain of name parts that ends at ``end`` begins, not before ``low``."""
    reach = REACH
    while True:
        start = max(low, end - reach)
        last = None
        for last in CHAIN.finditer(text, start, end):
            pass
        if last is None or last.end() != end or last["open"]:
            return None
        if last.start() > start + LONGEST_SIGN or start == low:
            return last.start()
        reach *= 2  # the chain may begin further to the left


def _domain(text: str, at: int) -> tuple[int, list[tuple[int, int]], int, int]:
    """End of the chain of labels at a place, the disguised dots in it, and how many dots of either kind."""
    label, end, edits, hidden, dots = LABEL.match(text, at), at, [], 0, 0
    while label:
        end = label.end()
        dot = DOT_SIGN.match(text, end)
        label = LABEL.match(text, dot.end()) if dot else None
        if label:
            dots += 1
            if dot["hidden"]:
                hidden += 1
                edits.append(dot.span())
    return end, edits, hidden, dots


def written_signs(tape: Tape) -> Tape:
    """Write the disguised signs of addresses: a boxed at needs a dot behind it, any other a disguised dot.

    Each at is the place a chain of any length is followed from to both sides.
    """
    edits, done, text = [], 0, tape.text
    for sign in AT_SIGN.finditer(text):
        if sign.start() < done:
            continue
        end, right, hidden, dots = _domain(text, sign.end())
        if not (dots if sign["boxed"] else hidden):
            continue
        start = _local_part(text, done, sign.start())
        if start is None:
            continue
        left = [m.span() for m in DOT_SIGN.finditer(text, start, sign.start()) if m["hidden"]]
        edits += [(*span, ".") for span in left] + ([(*sign.span(), "@")] if sign.group() != "@" else [])
        edits += [(*span, ".") for span in right]
        done = end
    return tape.rewrite(edits)


def spelled_digits(tape: Tape) -> tuple[list[Tape], list[tuple[int, int]]]:
    """The rewritten tapes, and source spans of digit runs long enough for a phone number without a plus.

    Runs without a disguised dot or plus need ``LEAST_WORDS`` digit words. Beside a numeral of a
    dotted run, a gap may also part two numbers: a second tape keeps such gaps.
    """
    edits, parted, runs = [], [], []
    for match in SPELLED.finditer(tape.text):
        pieces = list(PIECE.finditer(match.group()))
        kinds = [p.lastgroup for p in pieces]
        words = kinds.count("word")
        dotted = any(p.lastgroup == "dot" and p.group() != "." for p in pieces)
        plus = kinds[0] == "plus" and (words or (pieces[0].group() != "+" and "," not in match.group()))
        if words < LEAST_WORDS and not dotted and not plus:
            continue
        out = {"plus": lambda t: "+", "word": _digit, "num": str, "dot": lambda t: ".", "gap": lambda t: ""}
        written = [(p, out[p.lastgroup](p.group())) for p in pieces]
        for i, (p, t) in enumerate(written):
            if t != p.group():
                edits.append((match.start() + p.start(), match.start() + p.end(), t))
                if not (dotted and kinds[i] == "gap" and "num" in (kinds[i - 1], kinds[i + 1])):
                    parted.append(edits[-1])
        digits = "".join(t for _, t in written)
        if digits.isdigit() and PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
            runs.append(tape.original(*match.span()))
    return [tape.rewrite(e) for e in ([edits, parted] if len(parted) < len(edits) else [edits])], runs


def _digit(word: str) -> str:
    """Letters that only match without case, such as a dotted capital I, count as their plain ones."""
    return DIGIT_WORDS[word.casefold().replace("\u0307", "")]


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    odd = not text.isascii() and MAYBE_ODD.search(text)
    tape = ascii_forms(Tape(text)) if odd else Tape(text)
    seen = tape.text.lower()
    sign = BOX_CUE.search(seen) or any(cue in seen for cue in DOT_CUES)
    if sign:
        tape = written_signs(tape)
    tapes, runs = spelled_digits(tape)
    found = [(kind, *t.original(start, end)) for t in tapes if t.text != text for kind, start, end in plain_spans(t.text)]
    return found + [(3, *run) for run in runs]


def find_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind index, start, end, base) ordered by kind and start."""
    base = sorted(plain_spans(text))  # disjoint within a kind
    added = set(disguised_spans(text)) - set(base)
    if added and base:
        def inside(span):
            i = bisect.bisect_right(base, (span[0], span[1], len(text) + 1)) - 1
            return i >= 0 and base[i][0] == span[0] and base[i][2] >= span[2]

        added = {span for span in added if not inside(span)}
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added])


def redacted(text: str, spans, mark: str = "[{}]") -> str:
    """Overlapping spans are replaced once, by the mark of the first."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], mark.format(KINDS[kind].upper())]
        done = max(done, end)
    return "".join(out) + text[done:]


def with_spans(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Add the array ``spans`` of (kind, start, end, base), ordered by kind as in ``KINDS``, then start."""
    schema = output_schema(docs, {spans: SPAN_TYPE})

    def run(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in find_spans(t or "")]
                     for t in batch.column(text).to_pylist()]
            yield replace_column(batch, {spans: pa.array(found, ARROW_SPANS)})

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[{}]") -> DataFrame:
    """Replace personal data in ``text`` by marks such as ``[EMAIL]``; keeps the order of columns.

    ``length`` names a column that gets the new number of code points. Null texts stay null.
    """
    def run(batches):
        for batch in batches:
            values = [t and redacted(t, find_spans(t), mark) for t in batch.column(text).to_pylist()]
            names, columns = list(batch.schema.names), list(batch.columns)
            columns[names.index(text)] = pa.array(values, pa.string())
            if length:
                kind = batch.schema.field(length).type
                columns[names.index(length)] = pa.array([None if t is None else len(t) for t in values], kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def spelled_out(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
