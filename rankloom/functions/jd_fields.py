"""Labelled fields of a job description as Spark columns.

Each field has a list of patterns; the first one whose first hit gives a
valid value wins. ``coalesce`` stops at the first value, so later patterns run
only on the texts that need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.cleaning import py_strip

# ---- fixed values -------------------------------------------------------
# (flags, pattern); group 1 is the value. i: ignore case, m: line anchors.
TITLE_PATTERNS = (
    ("im", r"^\s*\[?(?:Job\s*Title|Position\s*Title|Position|Role|Title)\]?\s*[:\-\.]+\s*(.+)"),
    ("i", r"\*{1,2}(?:Job\s*Title|Position|Role|Title)\*{1,2}\s*[:\-]\s*(.+)"),
    ("m", r"^([A-Z][^\n|]{3,79}?)\s*\|"),
    ("m", r"^\s*(?:We(?:'re|\s+are)\s+(?:Hiring|Looking\s+For)[:\s]+)?([A-Z][A-Za-z0-9 /&\-\(\)–,]{2,80}?)\s*$"),
    ("i", r"(?:We(?:'re|\s+are)\s+(?:Hiring|Looking\s+For)[:\s]+)([A-Z][A-Za-z0-9 /&\-\(\)–,]{2,80})"),
    ("i", r"looking\s+for\s+(?:a\s+|an\s+)?([A-Z][A-Za-z0-9 /&\-]{2,80}?)(?:[!,.]|$)"),
)
EXPERIENCE_PATTERNS = (
    ("i", r"(?:minimum\s+of?\s*)?(\d+\+?\s*(?:to|\-|–)\s*\d+\s*years?(?:\s+of)?(?:\s+relevant)?(?:\s+work)?\s*(?:experience|exp\.?))"),
    ("i", r"(?:minimum\s+of?\s*)?(\d+\+\s*years?(?:\s+of)?(?:\s+relevant)?(?:\s+work)?\s*(?:experience|exp\.?))"),
    ("i", r"(\d+\s*years?(?:\s+of)?(?:\s+relevant)?(?:\s+work)?\s*(?:experience|exp\.?))"),
    ("im", r"(?:Min(?:imum)?\.?\s*Experience|Experience\s*Required)\s*[:\-\.]+\s*(.+?)(?:\||$)"),
    ("i", r"Experience\s*[:\-\.]+\s*(\d+\s*(?:to|\-|–)\s*\d+\s*Years?[^\n]*)"),
    ("i", r"(?:at\s+least|over|more\s+than)\s+(\d+\+?\s*years?\s*(?:of\s*)?(?:experience|exp\.?))"),
    ("i", r"\((\d+\+?\s*(?:to|\-|–)?\s*\d*\s*years?\s*(?:of\s*)?(?:experience|exp\.?)[^)]*)\)"),
    ("i", r"spent\s+(?:at\s+least\s+)?(\d+\+?\s*years?)"),
)
SALARY_PATTERNS = (
    ("i", r"(?:salary|compensation|pay(?:\s+range)?|remuneration|annual\s+compensation|salary\s+band|salary\s+range|compensation\s+package)\s*[:\-\.]*\s*((?:USD|GBP|EUR|AUD|CAD)?\s*(?:\$|£|€|₹)?[\d,]+(?:K|k)?\s*(?:to|\-|–)\s*(?:\$|£|€|₹)?[\d,]+(?:K|k)?(?:\s*(?:per\s+(?:annum|year|month|hour)|p\.a\.|annually|\/yr|\/year|\/hr|\/hour))?(?:[^\n]*(?:DOE|DOQ|commensurate|competitive|depending\s+on\s+experience))?)"),
    ("i", r"((?:USD|GBP|EUR|AUD|CAD)?\s*(?:\$|£|€|₹)[\d,]+(?:K|k)?\s*(?:to|\-|–)\s*(?:\$|£|€|₹)?[\d,]+(?:K|k)?(?:\s*(?:per\s+(?:annum|year|month|hour)|p\.a\.|annually|\/yr|\/year|\/hr|\/hour))?)"),
    ("i", r"((?:USD|GBP|EUR)?\s*(?:\$|£|€)[\d,]{4,}(?:K|k)?\s*(?:per\s+(?:annum|year|month)|p\.a\.|annually|\/yr|\/year))"),
    ("i", r"(?:salary|compensation|pay)\s*[:\-]?\s*((?:DOE|DOQ|Competitive|Commensurate\s+with\s+experience|Depends?\s+on\s+(?:experience|qualifications)|Negotiable|TBD|Open))"),
    ("i", r"\|\s*((?:\$|£|€)[\d,]+(?:K|k)?\s*(?:\-|–)\s*(?:\$|£|€)?[\d,]+(?:K|k)?)\s*\|"),
    ("i", r"\(((?:\$|£|€)[\d,]+(?:K|k)?(?:\s*(?:\-|–)\s*(?:\$|£|€)?[\d,]+(?:K|k)?)?(?:\/yr|\/year|\/hr|\/hour|p\.a\.)?)\)"),
)
SALARY_VALUE = ("i", r"\d|DOE|DOQ|Competitive|Commensurate|Negotiable")
LOCATION_PATTERNS = (
    ("i", r"(?:(?:work\s+)?location|job\s+location|office\s+location|based(?:\s+in)?|primary\s+office|place\s+of\s+work)\s*[:\-\.]+\s*(.+?)(?:\n|$)"),
    ("", r"📍\s*(.+?)(?:\s*\||\n|$)"),
    ("i", r"(?:work\s+)?location\s*\.{2,}\s*(.+?)(?:\n|$)"),
    ("m", r"(?:^|\|)\s*((?:Remote(?:\s*[–\-]\s*\w+)?|Hybrid|On[\-\s]?[Ss]ite)(?:\s*[\(\[/][^\)\]|]{1,60}[\)\]])?)\s*(?:\||$)"),
    ("", r"\b([A-Z][a-zA-Z\s]+,\s*(?:[A-Z]{2}|[A-Z][a-z]+))(?:\s*[\(/](?:Hybrid|On[\-\s]?site|Remote)[^\)]*[\)])?"),
    ("i", r"\b((?:Fully\s+)?Remote(?:\s*[–\-/]\s*[A-Za-z/ ]{2,40})?(?:\s*\([^)]{1,60}\))?)"),
    ("", r"based\s+(?:out\s+of\s+|in\s+)([A-Z][a-zA-Z\s,]+?)(?=\s+with|\s+and|\.|,\s+[a-z])"),
)
BODY_HEADER = ("im", r"(?:^|\n)\s*(?:Job\s*(?:Description|Summary|Overview|Details?)|About\s+(?:the\s+)?(?:Role|Opportunity|Position|Company|us)|Role\s+(?:Overview|Description|Summary)|Position\s+(?:Summary|Description|Overview)|Overview|The\s+Role|Responsibilities(?:\s+(?:Include|Overview))?|What\s+You(?:'ll| will)\s+Do|Key\s+(?:Responsibilities|Duties)|Scope\s+of\s+Work|About\s+This\s+(?:Role|Position)|Job\s+Purpose|Purpose\s+of\s+(?:the\s+)?(?:Role|Position))\s*[:\-]?\s*\n")
METADATA_LINE = ("i", r"^\s*(?:\[?(?:Job\s*Title|Position(?:\s*Title)?|Role|Title|Location|Work\s+Location|Salary(?:\s+(?:Range|Band))?|Compensation|Pay(?:\s+Range)?|Experience(?:\s+(?:Required|Level))?|Min(?:imum)?\.?\s*Experience|Employment\s+Type|Job\s+(?:Code|Type|Grade)|Department|Team|Duration|Reporting\s+To|Business\s+Unit|Grade\s+Level)\]?\s*(?:[:\-\.]+|\.*)\s*.+|(?:\|[^\|]+){2,}\|?)\s*$")
# Line ends as Python's str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# ---- end of fixed values ------------------------------------------------


def _java(flags: str, pattern: str) -> str:
    """Java form: only LF ends a line (d), Unicode classes (U)."""
    return f"(?dU{flags}){pattern}"


def _hits(text: Column, patterns) -> list[Column]:
    return [
        py_strip(F.regexp_extract(text, _java(flags, pattern), 1))
        for flags, pattern in patterns
    ]


def _only_if(value: Column, pattern: str) -> Column:
    """The value when the pattern is found in it, else NULL."""
    whole = F.regexp_extract(value, rf"(?s)^(?=.*?(?:{pattern})).*$", 0)
    return F.nullif(whole, F.lit(""))


def _without_tail(value: Column, pattern: str) -> Column:
    return py_strip(F.regexp_replace(value, F.lit(pattern), F.lit("")))


def jd_title(text: Column) -> Column:
    def first_line(hit: Column) -> Column:
        return py_strip(F.element_at(F.split(hit, LINE_END, 2), 1))

    def usable(line: Column) -> Column:
        # Three characters, one of them neither a symbol nor a digit.
        return _only_if(_only_if(line, r"^.{3}"), r"(?U)[\w&&[^\d]]")

    lines = [usable(first_line(hit)) for hit in _hits(text, TITLE_PATTERNS)]
    return _without_tail(F.coalesce(*lines), r"[!.,;:]+$")


def jd_experience(text: Column) -> Column:
    return F.coalesce(*[F.nullif(hit, F.lit("")) for hit in _hits(text, EXPERIENCE_PATTERNS)])


def jd_salary(text: Column) -> Column:
    wanted = _java(*SALARY_VALUE)
    return F.coalesce(*[_only_if(hit, wanted) for hit in _hits(text, SALARY_PATTERNS)])


def jd_location(text: Column) -> Column:
    def cleaned(hit: Column) -> Column:
        hit = _without_tail(hit, r"(?d)[\n\r|]+.*$")
        return _only_if(_without_tail(hit, r"[.,;]+$"), r"^.{3}")

    return F.coalesce(*[cleaned(hit) for hit in _hits(text, LOCATION_PATTERNS)])


def jd_body(text: Column) -> Column:
    """Text after the first section header; else the text from the first line
    that is neither blank nor metadata; else the whole text."""
    header = _java(*BODY_HEADER)
    after_header = F.regexp_extract(text, header + r"([\s\S]*)", 1)
    # The repeated group made possessive, to the same effect: it then loops
    # instead of recursing, so that a line may hold any number of bars.
    metadata = _java(*METADATA_LINE).replace(r"(?:\|[^\|]+){2,}", r"(?:\|[^\|]++){2,}+")

    def from_prose(lines: Column) -> Column:
        prose = F.transform(
            lines,
            lambda line, i: F.when(
                ~line.rlike(metadata) & (F.length(py_strip(line)) > 0), i + 1
            ),
        )
        start = F.coalesce(F.array_min(prose), F.lit(1))
        return F.array_join(F.slice(lines, start, F.size(lines)), "\n")

    # One-element transform: binds the line list once for its several uses.
    rest = F.element_at(F.transform(F.array(F.split(text, LINE_END)), from_prose), 1)
    return py_strip(F.when(text.rlike(header), after_header).otherwise(rest))


def jd_fields(text: Column) -> Column:
    """All fields in one struct, one pass over the text column."""
    return F.struct(
        jd_title(text).alias("title"),
        jd_experience(text).alias("experience"),
        jd_salary(text).alias("salary"),
        jd_location(text).alias("location"),
        jd_body(text).alias("description_body"),
    )
