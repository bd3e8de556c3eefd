"""Personal data, plain and disguised, with spans in the source text.

Two transducers normalise a text and keep, for each character they emit, the source
characters it stands for. The first folds homoglyphs, full-width and other
compatibility forms and drops invisible characters; the second rewrites ``at`` and
``dot`` disguises, spelled digits, a spelled plus, and letters O and l between
digits. The detectors run on the source and on the normalised text; a match of the
latter counts if it covers something that was rewritten, and is mapped back.

Edge cases: a null or empty text has no spans. Spans count code points, the end is
exclusive. All scans take time in proportion to the text, also for long runs of one
character. Repeated rows are searched row by row. Extra columns are carried along
by :func:`masked`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds. The e-mail's local part is taken from its "@" leftwards.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile("[0-9]+")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x",
    "ԝ": "w", "ν": "v", "ο": "o", "ρ": "p", "α": "a", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ɡ": "g", "ı": "i", "ӏ": "l",
    "м": "m", "т": "t", "к": "k", "п": "n", "г": "r", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "\u2024": ".", "\u00b7": ".",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff"
_KEPT = re.compile(r"[A-Za-z0-9@.+()\-]")


def _folds() -> dict[str, str]:
    """What each look-alike character becomes; compatibility forms and other digits by rule."""
    found = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if unicodedata.category(char) == "Nd":
            plain = str(unicodedata.digit(char))
        if len(plain) == 1 and plain != char and _KEPT.fullmatch(plain):
            found[char] = plain
    return found | HOMOGLYPHS | dict.fromkeys(_INVISIBLE, "")


FOLDS = _folds()
_FOLDED = frozenset(FOLDS)

# Names of the digits in four languages.
NUMERALS = (
    "zero oh cero zéro null",
    "one uno un eins",
    "two dos deux zwei",
    "three tres trois drei",
    "four cuatro quatre vier",
    "five cinco cinq fünf",
    "six seis sechs",
    "seven siete sept sieben",
    "eight ocho huit acht",
    "nine nueve neuf neun",
)
DIGITS = {name: str(value) for value, names in enumerate(NUMERALS) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_DIGIT_WORD = rf"(?:\b{_NAME}\b|[0-9])"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punto|punkt|point|\.)\s*[\])}>]\s*|\s+dot\s+)"
_AT = r"\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*"
_REWRITE = re.compile(
    rf"(?P<at>{_AT}|(?<=[A-Za-z0-9_%+-])(?:\s+(?:at|arroba|arobase)\s+|\s+@\s*|\s*@\s+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|{_DOT})))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus\s+(?={_DIGIT_WORD}))"
    rf"|(?P<digits>\b{_NAME}\b(?:[\s,-]{{1,2}}(?:\b{_NAME}\b|[0-9](?![0-9])))*)"
    r"|(?P<o>(?<=[0-9])[Oo](?=[0-9Oo]))|(?P<l>(?<=[0-9])[lI](?=[0-9lI]))",
    re.IGNORECASE,
)
_PART = re.compile(rf"\b{_NAME}\b|[0-9]", re.IGNORECASE)
_SPLIT = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_AT_WORDS = (b"at", b"arroba", b"arobase")
_DIGIT_WORDS = frozenset(w.encode() for w in DIGITS if w.isascii())
# What the split at other bytes does not show, with the one letter left that matches "i" but for its case.
_OTHER_WORDS = tuple(w for w in DIGITS if not w.isascii()) + ("İ".lower(),)
# On lower-case text, only looked for where the word stands: "plus" is a common word.
_PLUS = re.compile(rf"plus\s+{_DIGIT_WORD}")
# On lower-case text: a plain "at" or a spaced "@" before what may be a domain.
_PLAIN_AT = re.compile(r"a(?:t|rroba|robase)\s+[a-z0-9-]+(?:\.[a-z0-9]|\s*[\[({<]|\s+dot\s)")
_SPACED = re.compile(r"@\s|\s@")
_BRACKET = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|@|dot|punto|punkt|point|\.)\s*[\])}>]", re.IGNORECASE)
_BETWEEN = re.compile(r"[0-9][OoLlIi][0-9OoLlIi]")


def _luhn(digits: str) -> bool:
    own = [int(c) for c in digits[-1::-2]]
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(own) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = [p.span() for p in _RUN.finditer(text, *m.span())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(text[a:b].lstrip("0")) < 4 and int(text[a:b]) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def detect(text: str) -> list[tuple[str, int, int]]:
    """The plain matches, by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", a, b) for a, b in _ips(text)]
    cards = (m for m in _CARD.finditer(text) if m.end() - m.start() >= 13)
    found += [("card", *m.span()) for m in cards if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _disguised(text: str) -> bool:
    """Whether the second transducer may have something to rewrite; true whenever it has."""
    words = text.encode().translate(_SPLIT).split()
    if b"dot" in words or not _DIGIT_WORDS.isdisjoint(words):
        return True
    if _BRACKET.search(text) or _BETWEEN.search(text) or ("@" in text and _SPACED.search(text)):
        return True
    if not text.isascii() and any(w in text.lower() for w in _OTHER_WORDS):
        return True
    if b"plus" in words and _PLUS.search(text.lower()):
        return True
    return any(w in words for w in _AT_WORDS) and bool(_PLAIN_AT.search(text.lower()))


class Normal:
    """A rewritten text; ``first`` and ``last`` give each character's source span."""

    def __init__(self, text: str):
        self.text, self.first, self.last, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def rewrite(self, pattern: re.Pattern, replace) -> None:
        out, first, last, changed, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            out += [self.text[at : m.start()], new]
            first += self.first[at : m.start()]
            last += self.last[at : m.start()]
            changed += self.changed[at : m.start()] if self.changed else [False] * (m.start() - at)
            for _ in new:
                first.append(self.first[m.start()]), last.append(self.last[m.end() - 1])
                changed.append(True)
            if not new and changed:
                changed[-1] = True
            at = m.end()
        if not out:
            return
        first += self.first[at:]
        last += self.last[at:]
        changed += self.changed[at:] if self.changed else [False] * (len(self.text) - at)
        self.text, self.first, self.last, self.changed = "".join(out) + self.text[at:], first, last, changed


def _rewritten(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "digits":
        return "".join(DIGITS.get(p.lower(), p) for p in _PART.findall(m[0]))
    return {"at": "@", "dot": ".", "plus": "+", "o": "0", "l": "1"}[kind]


def normalise(text: str) -> Normal:
    normal = Normal(text)
    if not text.isascii() and (found := _FOLDED.intersection(set(text))):
        normal.rewrite(re.compile("[" + "".join(map(re.escape, sorted(found))) + "]"), lambda m: FOLDS[m[0]])
    if _disguised(normal.text):
        normal.rewrite(_REWRITE, _rewritten)
    return normal


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans, and those that only the normalised text shows."""
    text = text or ""
    base = detect(text)
    normal = normalise(text)
    if normal.changed is None:
        return base, []
    # Plain spans of one kind are in order and apart, so one of them at most covers a place.
    starts, ends = ({k: [s[i] for s in base if s[0] == k] for k in KINDS} for i in (1, 2))
    more = []
    for kind, a, b in detect(normal.text):
        start, end = normal.first[a], normal.last[b - 1]
        at = bisect_right(starts[kind], start) - 1
        if any(normal.changed[a:b]) and (at < 0 or end > ends[kind][at]):
            more.append((kind, start, end))
    return base, more


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts of plain spans by kind, their digest, and all spans as text, for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, more = find(text.as_py())
                counts = [sum(k == kind for k, *_ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    return docs.select("doc_id", "text").mapInArrow(of, schema)


def mask(text: str) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, as ``<EMAIL>``."""
    base, more = find(text)
    out, at = [], 0
    for kind, start, end in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(mask, na_action="ignore")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; ``n_chars``, if there is one, is counted anew."""
    found = docs.withColumn("text", _masked("text"))
    if "n_chars" not in docs.columns:
        return found
    count = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return found.withColumn("n_chars", count).select(docs.columns)
