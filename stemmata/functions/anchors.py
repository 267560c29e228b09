"""Anchors: the exact things that a line pins down.

Kinds of tokens stand in one ordered table. Each takes its matches out of the line, replaced by as many spaces, before
the next looks at it; so a number inside an address is never a count of its own. Runs as an Arrow function over
distinct lines, since a per-match run of spaces has no built-in form.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The shapes of tokens, and the words that are no units or make weak counts.
URL = r"https?://\S+"
MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
ID = r"\b(?=[A-Za-z0-9_-]*\d)(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{12,}\b"
TICKET = r"(?<![\w&#])#(\d{3,})\b"
OLD_TICKET = r"#\d{4,}\b"
QUOTED = r"[“\"]([^”\"]{3,80})[”\"]"
FRACTION = r"(?<![\w/])(\d{1,4})/(\d{1,4})(?![\w/])(?:\s+([A-Za-z]{3,}))?"
MONEY = r"[$€£]\s?\d[\d,]*(?:\.\d+)?\s?[kKmM]?\b"
COUNT = r"(?<![\w.#-])(\d[\d,]*(?:\.\d+)?)\s?(?:-\s?)?(%|[A-Za-z]{2,}(?!\w))?(?![\w])"
NOISE = (
    r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp]\.?[Mm]\.?)?"
    r"|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
    r"|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?(?:\s+\d{4})?"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?\b"
    r"|\b(?:19|20)\d{2}\b"
    r"|\b(?:Claude|Gemini|GPT|Grok|Kimi|GLM|DeepSeek|Qwen|Llama|Muse|o)[\s-]?\d+(?:\.\d+)?(?:[\s-]?(?:Sonnet|Opus|Haiku|Pro|Flash|Lite|mini|Terra|Sol|Luna|Astra|Fable|Spark|V\d[\w.-]*))*"
    r"|\b\d+(?:\.\d+)?\s(?:Sonnet|Opus|Haiku|Pro|Flash)\b"
    r"|\b(?:Sonnet|Opus|Haiku|Fable|Pro|Flash|Gemini|GPT|Grok|Kimi|GLM|DeepSeek|Qwen|Terra|Sol|Luna|Astra)[\s-]?V?\d+(?:\.\d+)*\b"
)
NOT_UNITS = frozenset("and or to of the at in on for by am pm is was are per from with x vs a an pt utc et min mins sec secs h hr hrs more less near new total other adding added confirmed additional remaining left extra each out up down again times than into after before so".split())
WEAK_UNITS = frozenset("st nd rd th % second minute hour day week month year time step attempt try click row column line page tab px pixel".split())
#: Units of everyday bookkeeping, and the kinds of claims that can be checked.
GENERIC_UNITS = frozenset("file commit para paragraph part line turn statu status ok open unique but while no merged session step item issue pr link page word char character byte kb mb gb ms insertion deletion change section chapter ch language lang agent model message comment reply hex column field key token pixel slot level hp xp".split())
CHECKABLE = ("exists", "count", "done", "broken", "identity", "instruction-to-self")


def singular(word: str) -> str:
    """A unit in the singular, by its ending."""
    w = word.lower()
    for ending, least, new in (("ies", 5, "y"), ("sses", 4, "ss")):
        if w.endswith(ending) and len(w) >= least:
            return w[: -len(ending)] + new
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


def _unit(word: str | None) -> str | None:
    return singular(word) if word and word.lower() not in NOT_UNITS else None


def _whole(m: re.Match) -> str:
    return m[0].rstrip(".,;:)]'\"").lower()


def _name(m: re.Match) -> str:
    name = m[1].strip().lower()
    telling = " " in name or re.search(r"\d", name) or len(name) >= 10
    return name if telling and any(map(str.isalnum, name)) else ""


def _share(m: re.Match) -> str:
    part, whole = int(m[1]), int(m[2])
    unit = _unit(m[3])
    return "" if part != whole and whole <= 31 else f"{part}/{whole}" + (f" {unit}" if unit else "")


def _count(m: re.Match) -> str:
    number, unit = m[1].rstrip(".,"), _unit(m[2])
    if unit:
        return ("#" if unit in WEAK_UNITS else "") + f"{number} {unit}"
    return f"#{number}" if sum(c != "," for c in number) >= 2 else ""


def _table(ticket: tuple) -> list[tuple]:
    kinds = [(URL, _whole, 0), (MAIL, _whole, 0), (ID, _whole, 0), ticket, (QUOTED, _name, 0), (FRACTION, _share, 0), (NOISE, lambda m: "", re.I), (MONEY, lambda m: "".join(m[0].split()).lower(), 0), (COUNT, _count, 0)]
    return [(re.compile(p, flags), value) for p, value, flags in kinds]


KINDS = _table((TICKET, lambda m: f"no.{m[1]}", 0))
OLD_KINDS = _table((OLD_TICKET, lambda m: m[0].lower(), 0))


def anchors(line: str, legacy: bool = False) -> list[str]:
    """The sorted distinct anchors of a line; weak ones start with #. legacy: the older, weak form of ticket numbers."""
    found: set[str] = set()
    for pattern, value in OLD_KINDS if legacy else KINDS:
        pieces, at = [], 0
        for m in pattern.finditer(line):
            found.add(value(m))
            pieces += [line[at : m.start()], " " * (m.end() - m.start())]
            at = m.end()
        line = "".join(pieces) + line[at:]
    return sorted(found - {""})


@F.pandas_udf(ArrayType(StringType()))
def anchors_udf(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: anchors(x) if x else [])


@F.pandas_udf(ArrayType(StringType()))
def legacy_anchors_udf(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: anchors(x, legacy=True) if x else [])


def strong(anchor: Column, own_mail: str | None = None) -> Column:
    """Whether an anchor can make a line new by itself. own_mail: the mail domain of the agents, whose addresses are no facts."""
    out = ~anchor.startswith("#")
    return out & ~anchor.endswith("@" + own_mail.lower()) if own_mail else out


def search_terms(anchor: Column) -> Column:
    """What to look for in evidence for an anchor."""
    number = F.regexp_extract(anchor, r"^(\d[\d,.]*) (\S+)$", 1)
    return (
        F.when(anchor.startswith("no."), F.array(F.concat(F.lit("#"), F.substring(anchor, 4, 1 << 20))))
        .when(anchor.startswith("#"), F.array(F.substring_index(F.substring(anchor, 2, 1 << 20), " ", 1)))
        .when(number != "", F.array(anchor, number))
        .otherwise(F.array(anchor))
    )


def as_pattern(anchor: Column) -> Column:
    """A regular expression that finds an anchor again, as a word of its own, with either number of its unit."""
    escaped = F.regexp_replace(anchor, r"([\\.^$|?*+(){}\[\]])", r"\\$1")
    ticket = F.concat(F.lit("#"), F.substring(anchor, 4, 1 << 20), F.lit(r"\b"))
    counted = F.regexp_extract(anchor, r"^#?(\d[\d,.]*) (\S+)$", 1)
    unit = F.regexp_replace(F.regexp_extract(anchor, r"^#?(\d[\d,.]*) (\S+)$", 2), "y$", "(?:y|ies)")
    return F.when(anchor.startswith("no."), ticket).when(counted != "", F.concat(F.lit(r"(?<![\w.])"), F.regexp_replace(counted, r"\.", r"\\."), F.lit(r"[\s-]*"), unit, F.lit(r"(?:s|es)?\b"))).otherwise(escaped)


def specific(anchor: Column, generic: frozenset[str] = GENERIC_UNITS) -> Column:
    """Whether an anchor tells facts apart: no everyday counts, no counts of 0 or 1, no small fractions."""
    unit = F.regexp_extract(anchor, r"^\d[\d,.]* (\S+)$", 1)
    below = F.regexp_extract(anchor, r"^\d+/(\d+)", 1)
    return F.when(unit != "", ~unit.isin(*sorted(generic)) & ~anchor.rlike("^[01] ")).when(below != "", below.cast("long") >= 3).otherwise(True)


def numeric(anchor: Column) -> Column:
    """Whether an anchor is a count, an amount of money or a score, and not of nothing."""
    return anchor.rlike(r"(?U)^(?:\$[\d,.]+[km]?|\d[\d,.]*\s\S+|\d+/\d+(?:\s\S+)?)$") & ~anchor.startswith("0/0") & ~anchor.startswith("0 ")


def checkable(kind: Column) -> Column:
    """Whether a claim of this kind can be checked against what happened."""
    return kind.isin(*CHECKABLE)
