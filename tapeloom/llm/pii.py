"""Personal data: exact base patterns, and disguised identifiers found by offset-preserving normalisation.

A transducer reads the source from left to right, writes a normalised text and, for every character it writes, the
source span that it came from. Look-alike letters and full-width forms become ASCII, spelled digits become digits, and
"at" / "dot" disguises become their signs. Identifiers are found in the normalised text by the same patterns and then
mapped back to the source characters.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tokens import texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at every @ the run of local characters before it, no further back than the last match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four dotted numbers: every run of dotted numbers is read once and cut into fours."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text by kind, then start. Matches that fail their check are dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b in addresses(text)] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = dict(zip("АВЕЅКМНОРСТХІЈаеіјорсухѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρτυ", "ABESKMHOPCTXIJaeijopcyxsdqwhlABEZHIKMNOPTYXoaivptu", strict=True))
# Digits spelled out, by language of the corpus.
_DIGITS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
# Words and bracketed forms that stand for signs.
_SIGNS = {"at": "@", "arroba": "@", "arobase": "@", "klammeraffe": "@", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "plus": "+", "dash": "-", "hyphen": "-", "underscore": "_", "más": "+", "minus": "-", "bindestrich": "-", "tiret": "-", "guion": "-"}
_NUMBERISH = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8", "Z": "2"}
_ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_DASHES = "‐‑‒–—−﹣－"
_SPACES = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
_DOTS = "․。．｡·"

_BRACKETED = re.compile(r"\s{0,3}[\[({<]\s{0,2}(at|@|dot|\.|a|d|punkt|point|punto|arroba|plus|\+)\s{0,2}[\])}>]\s{0,3}", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPELLED = "|".join(sorted(_DIGITS, key=len, reverse=True))
# All places where normalise() can depart from the text, one pattern for each of its rules; the text between is copied.
# Beyond 16 bits all characters are taken, because classes of such ones are slow.
_ODD = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x80, 0x10000)) if c in _LOOKALIKES or c in _ZERO_WIDTH + _DASHES + _SPACES or c in _DOTS and c != "·" or c > "˿" and (k := unicodedata.normalize("NFKC", c)) != c and len(k) == 1 and k.isascii())) + "\U00010000-\U0010ffff]")
_BRACKET = re.compile(r"[\[({<]\s{0,2}(?:at|@|dot|\.|a|d|punkt|point|punto|arroba|plus|\+)\s{0,2}[\])}>]", re.I)
_LOOSE_AT = re.compile(r"@(?=\s|\Z)")
_ANY_DIGIT = "".join(c for c in map(chr, range(0x10000)) if c.isdigit()) + "\U00010000-\U0010ffff"
_MIXED = re.compile(rf"[{_ANY_DIGIT}][OolI|SBZ]{{1,7}}(?=[{_ANY_DIGIT}])")
_SPOKEN = re.compile(r"\b(?:" + "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in {*_DIGITS, *_SIGNS} if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in {*_DIGITS, *_SIGNS}})) + r")\b")


def changes(text: str) -> list[tuple[int, int]]:
    """The places, in order, of everything that any rule of normalise() may rewrite; some may overlap."""
    low = text
    out = []
    if not text.isascii():
        out += [m.span() for m in _ODD.finditer(text)]
        low = text.translate(_TABLE) if out else text
    out += [m.span() for m in _BRACKET.finditer(text)]
    out += [m.span() for m in _LOOSE_AT.finditer(text)] if "@" in text else []
    out += [m.span() for m in _MIXED.finditer(text)]
    same = low.lower()
    if len(same) != len(low):  # a letter of two in lower case is in none of the words
        same = "".join(c.lower() if len(c.lower()) == 1 else c for c in low)
    for m in _SPOKEN.finditer(same.replace("_", " ")):
        if m.group() in _DIGITS or _disguised(m.group(), text, *m.span(), True):
            out.append(m.span())
    out.sort()
    return out


def normalise(text: str, places: list[tuple[int, int]] | None = None) -> tuple[str, list[int], list[int]]:
    """(normalised, starts, ends): character i of the result was made of text[starts[i]:ends[i]]. places: its changes()."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def put(s: str, a: int, b: int) -> None:
        for c in s:
            out.append(c), starts.append(a), ends.append(b)

    def solid(i: int) -> str:
        return text[i] if 0 <= i < len(text) else " "

    def squeeze() -> None:
        """Take back white space that stands before a sign."""
        while out and out[-1].isspace():
            out.pop(), starts.pop(), ends.pop()

    i, n, digits = 0, len(text), False  # digits: the last thing written was a spelled digit
    glue = False  # the last thing written was a sign made of a word, which takes in white space after it
    ahead, busy = iter(changes(text) if places is None else places), 0
    while i < n:
        while i >= busy and not digits and not glue:
            a, b = next(ahead, (n, n))
            j = max(i, a - 3) if a < n else n  # a bracket takes in up to three spaces before it
            out += text[i:j]
            starts += range(i, j)
            ends += range(i + 1, j + 1)
            i, busy = j, max(busy, b)
            if i >= n:
                return "".join(out), starts, ends
        c = text[i]
        m = _BRACKETED.match(text, i) if c in " \t\n[({<" else None
        if m:
            word = m.group(1).lower()
            sign = {"a": "@", "d": "."}.get(word, _SIGNS.get(word, word))
            if out and starts:
                put(sign, m.start(), m.end())
                i, glue, digits = m.end(), True, False
                continue
        if c in _ZERO_WIDTH:
            i += 1
            continue
        m = _WORD.match(text, i) if c.isalpha() and not solid(i - 1).isalnum() else None
        if m:
            word = m.group().translate(_TABLE).lower()
            free = not solid(m.end()).isalnum()
            if free and word in _DIGITS:
                if digits or (out and out[-1].isspace() and _joined(out, starts, text)):
                    squeeze()
                put(_DIGITS[word], m.start(), m.end())
                i, digits, glue = m.end(), True, False
                continue
            if free and word in _SIGNS and solid(i - 1).isspace() and solid(m.end()).isspace() and _disguised(word, text, m.start(), m.end(), digits):
                squeeze()
                put(_SIGNS[word], m.start(), m.end())
                i, glue, digits = m.end(), True, False
                continue
        if c.isspace() and glue:
            i += 1
            continue
        if c.isspace() or c in ",-":
            nxt = _WORD.match(text, i + 1)
            if digits and nxt and nxt.group().lower() in _DIGITS:
                i += 1  # between two spelled digits
                continue
        else:
            digits = False
        glue = False
        if c in _NUMBERISH and _between_digits(text, i):
            c = _NUMBERISH[c]
        elif c in _LOOKALIKES:
            c = _LOOKALIKES[c]
        elif c in _DASHES:
            c = "-"
        elif c in _SPACES:
            c = " "
        elif c in _DOTS and c != "·":
            c = "."
        elif c > "\u02ff":
            k = unicodedata.normalize("NFKC", c)
            c = k if len(k) == 1 and k.isascii() else c
        if c == "@" and out and out[-1] == " " and solid(i + 1).isspace():
            squeeze()
            glue = True
        put(c, i, i + 1)
        i += 1
    return "".join(out), starts, ends


_TABLE = str.maketrans(_LOOKALIKES)


def _joined(out: list[str], starts: list[int], text: str) -> bool:
    """What precedes the white space is a sign of a phone number or a digit, so that a spelled digit goes on with it."""
    k = len(out) - 1
    while k >= 0 and out[k].isspace():
        k -= 1
    return k >= 0 and out[k] == "+"


def _between_digits(text: str, i: int) -> bool:
    a, b = i - 1, i + 1
    while a >= 0 and text[a] in _NUMBERISH and i - a < 4:
        a -= 1
    while b < len(text) and text[b] in _NUMBERISH and b - i < 4:
        b += 1
    return a >= 0 and b < len(text) and text[a].isdigit() and text[b].isdigit()


_HOST = re.compile(r"\s+[\w-]+(?:\.[\w-]+)*(?:\s+(?:dot|punkt|point|punto)\s+|\s*[\[({<]\s*(?:dot|\.|d|punkt|point|punto)\s*[\])}>]\s*|\.)[\w-]+", re.I)
_NEXT = re.compile(r"\s+([\w-]+)")
_LAST = re.compile(r"[\w.%+\])}>-]+\s*$")
_NUMBER = re.compile(rf"\s+(?:[0-9]|(?:{_SPELLED})\b)", re.I)


def _disguised(word: str, text: str, a: int, b: int, digits: bool) -> bool:
    """Whether a word that can stand for a sign does so here: "at" only before a host with a dot of some kind."""
    sign = _SIGNS[word]
    if sign == "@":
        return _HOST.match(text, b) is not None and _LAST.search(text, max(0, a - 40), a) is not None
    if sign == ".":
        return _NEXT.match(text, b) is not None and _LAST.search(text, max(0, a - 40), a) is not None
    return _NUMBER.match(text, b) is not None and (sign == "+" or digits or solid_digit(text, a))


def solid_digit(text: str, a: int) -> bool:
    return text[max(0, a - 2) : a].strip()[-1:].isdigit()


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all): spans of a whole text. To the base spans come disguised ones that lie in no base span of their kind."""
    base = base_spans(text)
    places = changes(text)
    if not places:
        return base, base
    more = []
    changed, starts, ends = normalise(text, places)
    if changed != text:
        known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # in order, and apart from each other
        for kind, a, b in base_spans(changed):
            s, e = starts[a], ends[b - 1]
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            at = bisect.bisect_right(known[kind], (s, len(text))) - 1
            if at < 0 or known[kind][at][1] < e:
                more.append((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2])) if more else base


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets. Overlapping spans are replaced as one, by the kind of the
    first, then the longest, of them."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def detect(docs: DataFrame, text: str = "text", spans_col: str = "pii", base_col: str | None = None, redacted: str | None = None) -> DataFrame:
    """docs with an array of (kind, start, end): code points of the source, end exclusive, by kind and start.

    base_col: a second array with the base spans alone. redacted: a column for the text with its spans replaced. Null and
    empty texts have no spans, and a null text stays null when redacted. Rows, their number and all other columns are
    kept as they are; columns of the same names as the new ones are replaced. Nothing is shuffled.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    new = [T.StructField(n, kind) for n, kind in ((spans_col, span), (base_col, span), (redacted, T.StringType())) if n]
    keep = [f for f in docs.schema.fields if f.name not in {f.name for f in new}]
    kept, names = [i for i, f in enumerate(docs.schema.fields) if f in keep], [f.name for f in [*keep, *new]]
    at = docs.schema.names.index(text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        for b in batches:
            spans, bases, clean = [], [], []
            for _, x in texts(b.select([at]), text):
                base, every = find(x or "")
                spans.append(as_rows(every)), bases.append(as_rows(base))
                if redacted:
                    clean.append(redact(x, every) if x and every else x)
            cols = [pa.array(spans, arrow)] + [pa.array(bases, arrow)] * bool(base_col) + [pa.array(clean, pa.string())] * bool(redacted)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + cols, names=names)

    return docs.mapInArrow(run, T.StructType([*keep, *new]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def spans_text(column):
    """An array of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
