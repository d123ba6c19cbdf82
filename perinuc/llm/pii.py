"""Personal data with spans in the source text, also where it is disguised.

Plain identifiers are found in the text as it stands.  For disguised ones a transducer rewrites the text: look-alike
letters, digits and signs become ASCII, invisible characters go, runs of spelled digits become digits, and ``at`` and
``dot`` in brackets, or spelled out between the parts of an address, become signs.  The rewriting keeps, for every
character that it puts out, where its source begins and ends, so identifiers of the rewritten text map back to spans of
the source.  A span found this way is added unless it lies within a plain one of its kind; plain spans always stay, also
where they are a fragment of an added one.

Null texts count as empty.  Spans count code points, end exclusive.  All searches are linear in the text.  Repeated rows
give the same spans, an empty table gives an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import own, spare

KINDS = ("email", "ip", "card", "phone")

# fixed values: the plain forms. Searches start at signs, or at the first digit of a run, where any match must begin.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# fixed values: spelled digits and the words that stand for signs
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
PLUS_WORD = "plus"
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαι",
        "ABEKMHOPCTXaeopcyxijsdqwhABEZHIKMNOPTYXoai",
    )
)
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "﹒": ".", "＋": "+", "﹢": "+", "（": "(", "）": ")"}
DASHES = "‐‑‒–—−﹣－"
BLANKS = "\xa0     　"
HIDDEN = "­​‌‍⁠﻿"
# fixed values: last labels that an address with both "at" and "dot" as bare words may end in, so that prose stays prose:
# all countries but those that are common words (am as by do my so to), and common others
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name io ai app dev co me tv eu de fr es it nl be at ch uk ie us ca au nz in jp "
    "cn br mx ar se no dk fi pl pt gr cz hu ro ru ua tr za example test invalid "
    "ac ad ae af ag al ao aq aw ax az ba bb bd bf bg bh bi bj bm bn bo bs bt bw bz cc cd cf cg ci ck cl cm cr cu cv cw cx "
    "cy dj dm dz ec ee eg er et fj fk fm fo ga gd ge gf gg gh gi gl gm gn gp gq gs gt gu gw gy hk hm hn hr ht id il im iq "
    "ir is je jm jo ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq "
    "mr ms mt mu mv mw mz na nc ne nf ng ni np nr nu om pa pe pf pg ph pk pm pn pr ps pw py qa re rs rw sa sb sc sd sg sh "
    "si sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn tt tw tz ug uy uz va vc ve vg vi vn vu wf ws ye "
    "yt zm zw xyz online site shop store tech cloud blog club agency email mobi jobs travel museum aero coop asia cat tel "
    "pro wiki xxx live space website news media digital studio design systems solutions page link".split()
)
# spelled digits in a row that count as a number
SPELLED_RUN = 3

_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:{PLUS_WORD}[ -]+)?{_DIGIT_WORD}(?:[ ,.-]{{0,2}}(?<![A-Za-z]){_DIGIT_WORD}|[ ,-]{{1,2}}{_DIGIT_WORD}){{{SPELLED_RUN - 1},}}(?![A-Za-z0-9])",
    re.IGNORECASE,
)
# fewer spelled digits count beside digits or a plus
_SHORT = re.compile(
    rf"(?<![A-Za-z])(?:{PLUS_WORD}[ -]+)?{_DIGIT_WORD}(?:[ ,.-]{{1,2}}{_DIGIT_WORD}){{0,{SPELLED_RUN - 2}}}(?![A-Za-z])", re.IGNORECASE
)
_BEFORE = re.compile(r"(?:[0-9][ ().-]{0,2}|\+[ ]{0,2})\Z")
_AFTER = re.compile(r"[ ().-]{0,2}[0-9]")
_PROSE = re.compile(r"[ ]+[A-Za-z]")
_WORD = re.compile(r"[A-Za-z]+")
_BRACKET_AT = re.compile(r"[ ]{0,2}[\[({<][ ]{0,2}(?:at|@)[ ]{0,2}[\])}>][ ]{0,2}", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"[ ]{0,2}[\[({<][ ]{0,2}(?:dot|\.)[ ]{0,2}[\])}>][ ]{0,2}", re.IGNORECASE)
_SPOKEN_DOT = re.compile(r"[ ]+dot[ ]+", re.IGNORECASE)
_SPOKEN_AT = re.compile(r"[ ]+at[ ]+", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*+")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)  # no later match can reach back over this sign
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the text as it stands, from left to right."""
    digits = DIGIT.search(text) is not None
    return {
        "email": list(_emails(text)) if "@" in text else [],
        "ip": list(_ips(text)) if digits and "." in text else [],
        "card": list(_cards(text)) if digits else [],
        "phone": list(_phones(text)) if digits and "+" in text else [],
    }


def _table() -> dict[int, str | None]:
    """What single characters become: look-alikes, signs, digits of other scripts, full-width letters."""
    table: dict[int, str | None] = {ord(k): v for k, v in (LOOKALIKES | SIGNS).items()}
    table |= {ord(c): "-" for c in DASHES} | {ord(c): " " for c in BLANKS} | {ord(c): None for c in HIDDEN}
    for c in range(0x80, 0x1FBFA):
        if unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.decimal(chr(c)))
    for first in (0xFF21, 0xFF41):  # full-width letters
        table |= {first + i: chr(0x41 + i + (0x20 if first == 0xFF41 else 0)) for i in range(26)}
    return table


TABLE = _table()
_CHARACTERS = re.compile("[" + "".join(map(re.escape, map(chr, sorted(TABLE)))) + "]")


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int, int, bool]] | None = None  # text from, to; source from, to; one to one

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint spans of the present text, in order; an edit's output stands for its whole span."""
        if not edits:
            return
        out, pieces, at, size = [], [], 0, 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            if at < start:
                out.append(self.text[at:start])
                pieces += self._source(at, start, size)
                size += start - at
            if new:
                out.append(new)
                pieces.append((size, size + len(new), *self.span(start, end), False))
                size += len(new)
            at = end
        self.text, self.pieces = "".join(out), pieces
        self.starts = [p[0] for p in pieces]

    def _source(self, start: int, end: int, to: int) -> list[tuple[int, int, int, int, bool]]:
        """The pieces of an unchanged stretch, moved to its new place."""
        if self.pieces is None:
            return [(to, to + end - start, start, end, True)]
        found = []
        for a, b, s, e, exact in self.pieces[self._piece(start) :]:
            if a >= end:
                break
            lo, hi = max(a, start), min(b, end)
            found.append((to + lo - start, to + hi - start, *((s + lo - a, s + hi - a) if exact else (s, e)), exact))
        return found

    def _piece(self, at: int) -> int:
        from bisect import bisect_right

        return max(0, bisect_right(self.starts, at) - 1)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of ``[start, end)``."""
        if self.pieces is None:
            return start, end
        a, _, s, _, exact = self.pieces[self._piece(start)]
        b, _, t, e, exact_end = self.pieces[self._piece(end - 1)]
        return (s + start - a if exact else s), (t + end - b if exact_end else e)


def _character_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), TABLE[ord(m.group())] or "") for m in _CHARACTERS.finditer(text)]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        edits += _digits(text, *run.span())
    return edits


def _short_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits amid a number; a single last one, as in ``555 0199 one of us``, only where no word follows."""
    edits = []
    for run in _SHORT.finditer(text):
        start, end = run.span()
        before = _BEFORE.search(text[max(0, start - 3) : start])
        plus = before is not None and before.group()[0] == "+"
        spoken = run.group()[: len(PLUS_WORD)].lower() == PLUS_WORD
        after = _AFTER.match(text, end) is not None
        if after or plus or spoken or before and (len(_WORD.findall(run.group())) > 1 or not _PROSE.match(text, end)):
            found = _digits(text, start, end)
            if plus:  # a plus stands next to its number
                found[0] = (start - len(before.group()) + 1, *found[0][1:])
            edits += found
    return edits


def _digits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    edits = []
    words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text, start, end)]
    for k, (start, end, word) in enumerate(words):
        if word == PLUS_WORD:
            edits.append((start, words[k + 1][0], "+"))
        else:  # separators between spelled digits go with the digit before them
            edits.append((start, words[k + 1][0] if k + 1 < len(words) else end, SPELLED[word]))
    return edits


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs in brackets, and a bare `` at `` before the label of a bracketed dot."""
    marks = [(m, "@") for m in _BRACKET_AT.finditer(text)] + [(m, ".") for m in _BRACKET_DOT.finditer(text)]
    edits, done = [], 0
    for m, sign in sorted(marks, key=lambda x: x[0].start()):
        before = text[m.start() - 1 : m.start()]
        if m.start() >= done and before.isalnum() and text[m.end() : m.end() + 1].isalnum():
            if sign == ".":
                start = _label_start(text, done, m.start())
                at = _at_before(text, done, start) if start < m.start() else None
                if at:
                    edits.append((*at, "@"))
            edits.append((*m.span(), sign))
            done = m.end()
    return edits


def _label_start(text: str, least: int, at: int) -> int:
    while at > least and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "-."):
        at -= 1
    return at


def _at_before(text: str, least: int, end: int) -> tuple[int, int] | None:
    """The bare word that ends at ``end`` and stands behind a local part."""
    at = [m.span() for m in _SPOKEN_AT.finditer(text, max(least, end - 16), end) if m.end() == end]
    return at[-1] if at and at[-1][0] and text[at[-1][0] - 1] in LOCAL else None


def _ends_address(label: str, before: str, signed: bool) -> bool:
    """Whether an address may end in ``label``; behind a sign any name does, unless it is whole without."""
    last = label.rpartition(".")[2].lower()
    if last.isdigit() or last in LAST_LABELS:
        return True
    return signed and _NAME.fullmatch(last) is not None and ("." in label or before.rpartition(".")[2].lower() not in LAST_LABELS)


def _spoken_edits(text: str) -> list[tuple[int, int, str]]:
    """`` dot `` between labels, and the `` at `` before them; a sign beside counts for either word."""
    edits, done, signed = [], 0, False
    for dot in _SPOKEN_DOT.finditer(text):
        label = _LABEL.match(text, dot.end())
        if dot.start() < done or dot.start() == 0 or not label:
            continue
        start = _label_start(text, done, dot.start())  # the label before the word
        if start == dot.start():
            continue
        chained = bool(edits) and edits[-1][1] == start and edits[-1][2] == "."
        sign = start > 1 and text[start - 1] == "@" and text[start - 2] in LOCAL
        signed = sign or chained and signed
        last = not _SPOKEN_DOT.match(text, label.end())
        if last and not _ends_address(label.group(), text[start : dot.start()], signed):
            continue
        number = text[start : dot.start()].replace(".", "").isdigit() and text[dot.end()].isdigit()
        known = start > 0 and text[start - 1] == "@" or chained
        at = _at_before(text, done, start)
        if at:
            edits.append((*at, "@"))
        elif not (known or number):
            continue
        edits.append((*dot.span(), "."))
        done = dot.end()
    return edits


def rewritten(text: str) -> Rewritten | None:
    """The text without disguises, or None where it has none."""
    out = Rewritten(text)
    if not text.isascii():
        out.apply(_character_edits(out.text))
    low = out.text.lower()
    if sum(word in low for word in SPELLED) > 1 or any(w + sep + w in low for w in SPELLED for sep in (" ", "-")):
        out.apply(_spelled_edits(out.text))
    if DIGIT.search(out.text) and any(word in low for word in SPELLED):
        out.apply(_short_edits(out.text))
    if any(b in out.text for b in "[({<"):
        out.apply(_bracket_edits(out.text))
    if " dot " in low:
        out.apply(_spoken_edits(out.text))
    return out if out.pieces is not None else None


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans, each by start and then kind."""
    base = plain(text)
    every = {kind: list(spans) for kind, spans in base.items()}
    shown = rewritten(text)
    if shown is not None:
        for kind, spans in plain(shown.text).items():
            held = sorted(base[kind])
            k = 0
            for start, end in sorted(shown.span(a, b) for a, b in spans):
                while k + 1 < len(held) and held[k + 1][0] <= start:
                    k += 1
                if not (held and held[k][0] <= start and end <= held[k][1]):
                    every[kind].append((start, end))

    def listed(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        return sorted(
            ((kind, a, b) for kind in KINDS for a, b in spans[kind]), key=lambda x: (x[1], KINDS.index(x[0]), x[2])
        )

    return listed(base), listed(every)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, plain spans per kind, their digest, all spans, and how many were disguised."""
    rows = docs.select(own(docs, doc_id).alias("doc_id"), own(docs, text).cast("string").alias("text"))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for t in part.column(1).to_pylist():
                    base, every = find(t or "")
                    per_kind = [sum(s[0] == k for s in base) for k in KINDS]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    found.append((*per_kind, digest, _joined(every), len(every) - len(base)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names
                )

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, schema + ", base_sha256 string, spans string, n_disguised long")


def masked(docs: DataFrame, text: str = "text", mask: str = "█") -> DataFrame:
    """``docs`` with every span of its text covered, character by character."""

    @F.udf("string", useArrow=True)
    def cover(t: str | None) -> str | None:
        if t is None:
            return None
        out, done = [], 0
        for _, a, b in find(t)[1]:
            a = max(a, done)
            if a < b:
                out += [t[done:a], mask * (b - a)]
                done = b
        return "".join([*out, t[done:]])

    name = spare(docs, "covered")
    covered = docs.withColumn(name, cover(own(docs, text)))
    return covered.select(*[F.col(name).alias(c) if c == text else own(docs, c) for c in docs.columns])
