"""URL rules as patterns, indexed by their rarest literal token.

A rule names the tokens (runs of letters and digits) that every URL it matches
must hold whole. How often those tokens occur among the URLs is counted once, and
each rule is filed under its rarest. A URL's own tokens fetch the candidates, and
only these run their regular expression. Rules without a literal token are tried
on every URL.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import mapped, once

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched from the start of host and path together.

    ``weight`` ranks the rules that fit (the highest wins); rules without a
    ``name`` only decide where no named one fits.
    """

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None
    weight: tuple[int, int] = (0, 0)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``; the
    longest rule wins, of equally long ones that of the longer host."""
    # The last token of a path that ends within a name may go on in the URL.
    literal = path if not TOKEN.search(path[-1:].lower()) else re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = TOKEN.findall(f"{host} {literal}".lower())
    return Rule(
        rf"(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})" if path.startswith("/") else
        rf"(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}",
        tuple(tokens), verdict, host + path, (len(host + path), len(host)),
    )


def name_rule(verdict: str, words: str) -> Rule:
    """Fits hosts that have these words, joined by hyphens, as a whole label."""
    return Rule(rf"(?:[^/]*\.)?{re.escape(words)}(?=[./]|\Z)", tuple(TOKEN.findall(words)), verdict)


def host_and_path(url: str | None) -> tuple[str, str]:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; then up
    to ``? #`` or the end. Both empty for null and where there is no ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class Index:
    """The rules by their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            compiled = (rule, re.compile(rule.pattern, re.DOTALL))
            if rule.tokens:
                self.filed[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(compiled)
            else:
                self.always.append(compiled)

    def fitting(self, host: str, path: str) -> list[Rule]:
        subject = host + path
        candidates = list(self.always)
        for token in set(TOKEN.findall(subject.lower())):
            candidates += self.filed.get(token, ())
        return [rule for rule, pattern in candidates if pattern.match(subject)]

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The name of the rule that wins, if any, and the verdict: a named rule's,
        else block if any other fits that blocks."""
        fitting = self.fitting(host, path)
        named = [r for r in fitting if r.name is not None]
        if named:
            best = max(named, key=lambda r: (r.weight, r.name))
            return best.name, best.verdict
        return None, "block" if any(r.verdict == "block" for r in fitting) else "allow"


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs, over all rows; as
    many rows as the rules have tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.regexp_extract_all(F.lower(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0))
    held: Column = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    found = pages.select(F.explode(held).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return dict(found.collect())


def judged(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row, without a shuffle.

    Null URLs and those without ``://`` have empty host and path and are allowed
    unless a rule fits the empty text. Repeated rows stay; other columns are not
    looked at; no rows give no rows.
    """
    counts = token_counts(pages, rules, url)
    shared = pages.sparkSession.sparkContext.broadcast((tuple(rules), counts))  # as large as the rules
    key = uuid.uuid4().hex

    def batch(rows: pa.RecordBatch) -> dict:
        index = once(key, lambda: Index(*shared.value))
        places = [host_and_path(u) for u in rows.column("url").to_pylist()]
        verdicts = [index.judge(*p) for p in places]
        return {
            "page_id": rows.column("page_id"),
            "host": [p[0] for p in places], "path": [p[1] for p in places],
            "rule": [v[0] for v in verdicts], "verdict": [v[1] for v in verdicts],
        }

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    return mapped(narrow, "page_id long, host string, path string, rule string, verdict string", batch)
