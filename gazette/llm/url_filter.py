"""Weighted URL vocabulary.

One Aho-Corasick pass over a URL finds all terms of a strict and a soft vocabulary; a hit counts only where
no letter or digit touches it.  One strict hit or enough distinct soft hits reject a URL.  Host and path
rules, looked up by the host's suffixes, take precedence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())

#: Words that by themselves mark adult, gambling or malware addresses, and words that do so in company.
STRICT = {"porn": 1.0, "porno": 1.0, "xxx": 1.0, "xvideos": 1.0, "hentai": 1.0, "milf": 1.0, "warez": 1.0, "keygen": 1.0}
SOFT = {"adult": 0.5, "babes": 0.5, "bet": 0.4, "casino": 0.6, "cams": 0.5, "crack": 0.4, "dating": 0.4, "escort": 0.6,
        "free": 0.2, "girls": 0.4, "hot": 0.3, "jackpot": 0.5, "nude": 0.6, "poker": 0.5, "sex": 0.7, "sexy": 0.6,
        "slots": 0.5, "torrent": 0.4, "viagra": 0.7, "webcam": 0.4}


@dataclass(frozen=True)
class Vocabulary:
    """Terms with their weights.  ``soft_terms`` distinct soft hits reject."""

    strict: dict[str, float] = field(default_factory=lambda: STRICT)
    soft: dict[str, float] = field(default_factory=lambda: SOFT)
    soft_terms: int = 2


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host with A-Z lower-cased, path, what is scanned for terms)."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", head.translate(LOWER)
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop], rest.translate(LOWER)


class Judge:
    def __init__(self, vocabulary: Vocabulary, rules: list[Rule]):
        import ahocorasick

        self.vocabulary, self.found = vocabulary, ahocorasick.Automaton()
        for kind, terms in (("soft", vocabulary.soft), ("strict", vocabulary.strict)):
            for term, weight in terms.items():
                self.found.add_word(term.translate(LOWER), (kind, term.translate(LOWER), weight))
        if len(self.found):
            self.found.make_automaton()
        self.rules: dict[str, list[Rule]] = {}
        for rule in rules:
            self.rules.setdefault(rule.host, []).append(rule)

    def rule(self, host: str, path: str) -> Rule | None:
        fits, labels = [], host.split(".")
        for k in range(len(labels)):
            fits += [r for r in self.rules.get(".".join(labels[k:]), ()) if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(str(r)), len(r.host)), default=None)

    def hits(self, scanned: str) -> dict[str, tuple[str, float]]:
        out = {}
        for end, (kind, term, weight) in self.found.iter(scanned) if len(self.found) else ():
            before, after = scanned[end - len(term):end - len(term) + 1] if end >= len(term) else "", scanned[end + 1:end + 2]
            if not before.isalnum() and not after.isalnum():
                out[term] = kind, weight
        return out

    def __call__(self, url: str | None) -> tuple:
        host, path, scanned = split_url(url)
        rule, hits = self.rule(host, path), self.hits(scanned)
        strict = sum(kind == "strict" for kind, _ in hits.values())
        soft = len(hits) - strict
        said = "block" if strict or soft >= self.vocabulary.soft_terms else "allow"
        return (host, path, str(rule) if rule else None, rule.action if rule else said, strict, soft,
                round(sum(w for _, w in hits.values()), 6))


def judge_urls(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: list[Rule] | tuple = (),
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(<id_col>, host, path, rule, verdict, strict_hits, soft_hits, weight), one row per row of ``pages``: distinct
    terms hit and the sum of their weights.  A rule's action is the verdict; without one the hits decide.

    A null URL or one without ``://`` has an empty host and path; a null one has no hits.  No rows give no
    rows.  Other columns are ignored."""
    kind = "host string, path string, rule string, verdict string, strict_hits long, soft_hits long, weight double"
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(vocabulary, list(rules))
        for urls in batches:
            yield pd.DataFrame([judge(u) for u in urls], columns=names)

    rows = pages.select(pages[id_col].alias(id_col), judged(pages[url_col].cast("string")).alias("judged"))
    return rows.select(rows[0], "judged.*")
