"""Text cleaning as Spark columns.

Every public function maps a text ``Column`` to a ``Column`` and stays inside
the JVM (the one exception, ``nfc_newlines``, is an Arrow function because
Spark SQL has no Unicode normalisation).

Character classes are written out so that Java's regex engine treats white
space, word characters and digits exactly as Python's ``re`` does on ``str``.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------
# Python white space, word characters and digits, as Java class bodies.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
STATUS_WORDS = "present|current|now"

# Resume section titles, in the order in which they are removed.
SECTION_TITLES = (
    ("profile", "summary", "professional summary", "about me", "bio",
     "introduction", "overview", "executive summary"),
    ("technical skills", "skills", "core competencies", "tech stack",
     "toolbox", "expertise", "proficiencies", "capabilities"),
    ("soft skills", "interpersonal skills"),
    ("projects", "portfolio", "featured work", "case studies",
     "side projects", "key projects", "selected projects",
     "notable projects"),
    ("work experience", "professional experience", "employment history",
     "career history", "work history", "relevant experience"),
    ("education", "academic background", "formal education", "degrees",
     "schooling", "coursework"),
    ("certifications", "certificates", "credentials", "badges", "licenses",
     "continuing education"),
    ("achievements", "awards", "honors", "recognition", "accomplishments"),
    ("languages", "spoken languages", "human languages"),
    ("volunteer", "community involvement", "open source contributions",
     "community work"),
    ("additional projects", "other projects", "miscellaneous"),
    ("references", "publications", "conferences", "speaking", "hobbies",
     "interests", "memberships"),
)

BULLETS = "•·▪▫◦‣⁃➢➣►▶❯❭›●○◆◇□■→⇒⇨⟶➔✓✔–—【】《》"
SHORT_WORDS = ("c", "go", "r", "c#", "f#")
CHUNK_WORDS = 150
# ---- end of fixed values ------------------------------------------------

_S, _NS = f"[{WS}]", f"[^{WS}]"
_W = f"[{WORD}]"
_HANDLE = f"[{WORD}-]"
_D = r"\p{Nd}"
_START, _END = f"(?<!{_W})", f"(?!{_W})"
# The digit (or letter) is looked for before the costlier look-behind.
_FIRST_DIGIT = f"{_D}(?<!{_W}{_D})"
_DIGIT_START = f"(?={_D}){_START}"
_LETTER_START = rf"(?iu)(?=\p{{L}}){_START}"

# An address always covers its whole blank-delimited word, so the match may be
# tied to the start of that word: linear instead of quadratic on long words.
_EMAIL = rf"(?<!{_NS}){_NS}[^@{WS}]*+@{_NS}+\.{_NS}+"
_IDENTIFIERS = (
    _EMAIL,
    rf"https?://{_NS}+|www\.{_NS}+",
    rf"github\.com/{_HANDLE}+/?{_HANDLE}*/?",
    rf"linkedin\.com/in/{_HANDLE}+",
    rf"@{_HANDLE}+",
    rf"\+?{_D}{{1,3}}[-.{WS}]?\(?{_D}{{2,4}}\)?[-.{WS}]?{_D}{{3,4}}[-.{WS}]?{_D}{{3,4}}",
    rf"{_FIRST_DIGIT}{_D}{{9,14}}{_END}",
)
_MONTH_DAY = rf"(?:{MONTHS})[a-z]*{_S}+{_D}{{1,2}},?{_S}+{_D}{{4}}"
_DATES = (
    rf"{_DIGIT_START}(?:19|20){_D}{{2}}{_END}",
    rf"{_FIRST_DIGIT}{_D}?[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}{_END}",
    rf"{_LETTER_START}(?:{_MONTH_DAY}){_END}",
)
_STATUS = rf"{_LETTER_START}(?:{STATUS_WORDS}){_END}"
_ZIP = rf"{_FIRST_DIGIT}{_D}{{4}}(?:-{_D}{{4}})?{_END}"


def _title_alternation() -> str:
    """All section titles as one alternation with the effect of removing the
    groups one after the other.

    A title that holds a word removed by an earlier group can never be seen
    whole, so it is left out; ``community work`` must yield when its second
    word starts a title of an earlier group.
    """
    seen_words: set[str] = set()
    live: list[str] = []
    for group in SECTION_TITLES:
        live += [t for t in group if not seen_words & set(t.split())]
        seen_words |= {t for t in group if " " not in t}
    firsts: dict[str, list[str]] = {}
    for title in live:
        head, _, rest = title.partition(" ")
        if rest:
            firsts.setdefault(head, []).append(rest)
    order = {t: i for i, group in enumerate(SECTION_TITLES) for t in group}
    by_letter: dict[str, list[str]] = {}
    for title in live:
        last = title.rsplit(" ", 1)[-1]
        blockers = [
            rest for rest in firsts.get(last, ())
            if order[f"{last} {rest}"] < order[title]
        ]
        tail = f"(?! (?:{'|'.join(blockers)}){_END})" if blockers else ""
        by_letter.setdefault(title[0], []).append(title[1:] + tail)
    # Grouped by first letter, so that most words fail after a few tests.
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))


_TITLES = _title_alternation()
_HEADERS = rf"{_LETTER_START}(?:{_TITLES}){_END}"
# On lower-cased text only these letters differ from their case-folded form.
_FOLDED = str.maketrans({"s": "[s\u017f]", "i": "[i\u0131]"})
_LOWER_WORDS = (
    rf"(?<![a-z])(?=[a-z\u017f\u0131]){_START}"
    rf"(?:{f'{_TITLES}|{STATUS_WORDS}'.translate(_FOLDED)}|{_MONTH_DAY}){_END}"
)

# The look-ahead lets ordinary characters fail on one cheap test.
_ARTIFACTS = (
    r"(?=[=*_`#-\u0100-\x{10ffff}])"
    r"(?:={3,}|-{3,}|\*+|_{2,}|─{3,}|━{3,}|•{3,}|◦{3,}|`+|#+|"
    f"[{BULLETS}])"
).replace("#-", "#\\-")
# What may stay: ASCII letters, digits, white space and . , ! ? : ; - '
# Written as the characters to blank out, one by one up to U+00FF: the regex
# engine then tests one bit map instead of a chain of ranges.
_KEEP = frozenset(string.ascii_letters + string.digits + WS_CHARS + ".,!?:;'-")
_DROPPED = (
    "".join(f"\\x{i:02x}" for i in range(256) if i > 127 or chr(i) not in _KEEP)
    + r"\u0100-\x{10ffff}"
)
_NOT_KEPT = f"[{_DROPPED}]+"
# The same with white space: any run of it but a single blank.
_OTHER_WS = r"\t\x0a\x0b\x0c\r\x1c\x1d\x1e\x1f"
_GAPS = rf"[ {_OTHER_WS}{_DROPPED}](?:[ {_OTHER_WS}{_DROPPED}]+|(?<! ))"
_ASCII_S = r"[\t-\r\x1c-\x20]"
_TIGHTEN = (("'", "'"), ("-", "-"), (".", ". "), (",", ", "), ("?", "? "), ("!", "! "))
_NUMBER = r"[0-9](?<![A-Za-z0-9_].)[0-9]*(?:\.[0-9]+)?(?![A-Za-z0-9_])"


def _blank_out(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(" "))
    return text


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _if_holds(text: Column, test: Callable[[Column], Column], *patterns: str) -> Column:
    """Run the passes only over texts that can match; the test is far cheaper."""
    return _bound(text, lambda t: F.when(test(t), _blank_out(t, *patterns)).otherwise(t))


def py_strip(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """Blank-delimited words, without empty ones."""
    return F.filter(F.split(text, f"{_S}+"), lambda w: w != "")


def _without_identifiers(text: Column, *dates: str) -> Column:
    """Lower-cased text without addresses, links, handles, numbers and dates."""
    email, link, github, linkedin, handle, *numbers = _IDENTIFIERS

    def has_at(t: Column) -> Column:
        return t.contains("@")

    text = _if_holds(F.lower(text), has_at, email)
    text = _if_holds(text, lambda t: t.contains("http") | t.contains("www."), link)
    text = _if_holds(text, lambda t: t.contains(".com/"), github, linkedin)
    text = _if_holds(text, has_at, handle)
    return _if_holds(text, lambda t: t.rlike(_D), *numbers, *dates, _ZIP)


def pii_strip(text: Column) -> Column:
    """Lower-case, then blank out addresses, links, handles, phone numbers,
    dates, postal codes and status words. The status words, which share no
    characters with a postal code, come last."""
    return _blank_out(_without_identifiers(text, *_DATES), _STATUS)


def section_header_strip(text: Column) -> Column:
    """Blank out section titles wherever they occur as whole words."""
    return _blank_out(text, _HEADERS)


def format_artifact_strip(text: Column) -> Column:
    """Blank out separator runs, bullets, arrows, dashes and markdown marks."""
    return _blank_out(text, _ARTIFACTS)


def ascii_punct_normalise(text: Column) -> Column:
    """Keep ASCII text and sentence punctuation, tighten the blanks around the
    punctuation, drop standalone numbers, collapse white space."""
    text = _blank_out(text, _NOT_KEPT)
    for mark, into in _TIGHTEN:
        text = F.regexp_replace(
            text, F.lit(rf"(?<!{_ASCII_S}){_ASCII_S}++\Q{mark}\E{_ASCII_S}+"), F.lit(into)
        )
    return py_strip(_blank_out(text, _NUMBER, f"{_ASCII_S}+"))


def _long_words(words_: Column) -> Column:
    short = [w for w in SHORT_WORDS if len(w) == 1]
    return F.array_join(F.filter(words_, lambda w: (F.length(w) > 1) | w.isin(*short)), " ")


def short_token_filter(text: Column) -> Column:
    """Drop one-character words other than the short technical names."""
    return _long_words(F.split(text, f"{_S}+"))


def clean_text(text: Column) -> Column:
    """The whole chain: the five stages above with one result, in fewer passes.

    The length of white-space runs is lost in the end, which lets stages share
    a pass. Month dates, status words and section titles go together: none can
    form or break another, nor a postal code. Of the formatting marks only dash
    runs survive the ASCII stage's own character class. With every gap a single
    blank, tightening is a literal replacement.
    """
    year, numeric_date, _ = _DATES
    text = _without_identifiers(text, year, numeric_date)
    text = _blank_out(text, _LOWER_WORDS, "-{3,}", _GAPS)
    for mark, into in _TIGHTEN:
        text = F.replace(text, F.lit(f" {mark} "), F.lit(into))
    return _long_words(F.split(_blank_out(text, _NUMBER), " "))


def chunk_words(text: Column, max_words: int = CHUNK_WORDS) -> Column:
    """Array of consecutive blocks of ``max_words`` words; no words, no block."""
    size = F.lit(int(max_words))

    def blocks(w: Column) -> Column:
        last = F.floor((F.size(w) - 1) / size).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(w, i * size + 1, size), " "),
        )
        return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.when(text.isNotNull(), _bound(words(text), blocks))


@cache
def changeable(gap: int = 64) -> str:
    """Java pattern of a character without which a text is in normal form: those that
    are not it themselves, marks that may have to change places, and the second
    parts of compositions. Up to ``gap`` characters between two such ones belong to it
    too, which makes the class short; one comparison passes over all below the first."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    second = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals
    for c in points:
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    found = [c for c in points if c in second or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and c <= runs[-1][1] + 1 + gap:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return f"(?=[\\x{{{found[0]:X}}}-\\x{{10FFFF}}])[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def nfc_newlines(text: Column) -> Column:
    """Unicode NFC with CRLF and CR turned into LF. Only texts with a character that
    may change leave for Python; the others go as null and stay as they are."""
    normal = F.coalesce(_nfc(F.when(F.regexp_like(text, F.lit(changeable())), text)), text)
    return F.regexp_replace(normal, F.lit("\r\n?"), F.lit("\n"))
