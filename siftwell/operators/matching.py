"""Relevance matching: vocabularies, the candidate net, and proximity-aware matches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.entities import mentions
from siftwell.functions.text import folded_case, has_any_term, quote, reason, term_hits, text_of

#: The default vocabularies, in the order that reasons name them.
HIRING_TERMS = (
    "hiring", "we're hiring", "we are hiring", "now hiring", "looking for", "seeking", "recruiting", "join our team",
    "join us", "apply now", "apply", "open role", "open position", "opening", "openings", "vacancy", "drop your resume",
    "share your resume", "dm me", "send your cv", "applications open", "we're looking", "we are looking",
)
ROLE_TERMS = ("intern", "interns", "internship", "internships", "trainee", "apprentice")
DOMAIN_TERMS = (
    "ai", "a.i.", "ml", "ai/ml", "machine learning", "artificial intelligence", "deep learning", "nlp",
    "natural language processing", "llm", "llms", "computer vision", "genai", "gen ai", "generative ai", "data science",
    "data scientist", "data engineer", "software", "software engineer", "software engineering", "backend", "frontend",
    "full stack", "fullstack", "neural network", "transformers", "pytorch", "tensorflow",
)
OFFER_CUES = (
    "we're hiring", "we are hiring", "now hiring", "hiring:", "apply now", "apply", "applications open", "open role",
    "open position", "role:", "position", "join our team", "join us", "dm me", "dm", "send your cv", "send your resume",
    "drop your resume", "share your resume", "looking for", "we are looking", "we're looking",
)
#: Cues that only count before the role they speak of.
FORWARD_CUES = frozenset({"looking for", "seeking", "we're looking", "we are looking", "recruiting"})
#: Phrases in which a role is told about, not offered.
NARRATIVE = (
    r"\bas an intern\b|\bmy (?:first|second|third|\d+(?:st|nd|rd|th))? ?(?:real )?task as an intern\b"
    r"|\b(?:my|our|college|campus)\s+internship\b"
    r"|\binternship\s+(?:program|module|course|coordinator|journey|story|diary|experience)\b"
    r"|\bintern(?:s)?\s+(?:program|module|course)\b|\bstudent intern\b|\bformer intern\b|\bex-?intern\b"
)
#: Phrases in which somebody tells of what is over, and the words that may stand between a cue and a role.
CELEBRATION = (
    r"\b(?:completed|finished|wrapped up)\s+(?:my|our|an?)\s*internship\b|\b(?:internship|intern)\s+(?:journey|story|experience|diary)\b"
    r"|\b(?:offer accepted|excited to (?:share|announce).{0,60}\b(?:joined|intern))\b"
)
NEAR_WORDS = 15


@dataclass(frozen=True)
class Vocabulary:
    """Three groups of terms; ``mode`` is ``all`` or ``loose`` (hiring and one of the others)."""

    hiring: Sequence[str] = HIRING_TERMS
    role: Sequence[str] = ROLE_TERMS
    domain: Sequence[str] = DOMAIN_TERMS
    mode: str = "all"
    groups: tuple[str, ...] = field(default=("hiring", "role", "domain"), repr=False)

    def __post_init__(self) -> None:
        if self.mode not in ("all", "loose"):
            raise ValueError(f"unknown match mode {self.mode!r}")


def match_terms(df: DataFrame, text: str = "post_text", vocabulary: Vocabulary = Vocabulary(), *, prefix: str = "") -> DataFrame:
    """Add ``matched`` and ``reasons``.

    The match is a condition of its own, which looks no further than it has to; the hits
    are listed only where the reasons are used.
    """
    own = text_of(text)
    out = df.withColumn("_low", folded_case(own))
    low, terms = F.col("_low"), {g: getattr(vocabulary, g) for g in vocabulary.groups}
    some = {g: has_any_term(own, terms[g], low) for g in vocabulary.groups}
    rule = some["role"] & some["hiring"] & some["domain"] if vocabulary.mode == "all" else some["hiring"] & (some["role"] | some["domain"])
    reasons = F.when(own == "", F.array(F.lit("no post text"))).otherwise(F.array(*(reason(g, term_hits(own, terms[g], low)) for g in vocabulary.groups)))
    return out.withColumns({f"{prefix}matched": rule, f"{prefix}reasons": reasons}).drop("_low")


def candidate_net(df: DataFrame, company: Column, haystack: Column, text: str = "post_text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """The broad net: the company is mentioned, a hiring or role term stands in the text, and nothing is celebrated."""
    own = text_of(text)
    out = df.withColumns({"_h": term_hits(own, vocabulary.hiring), "_r": term_hits(own, vocabulary.role), "_m": mentions(haystack, company)})
    party = own.rlike(f"(?iUs){CELEBRATION}")
    named = F.concat(F.lit("company:"), F.when(F.col("_m"), company).otherwise(F.lit("none")))
    both = F.concat("_h", "_r")
    blank = F.trim(own) == ""
    reasons = (
        F.when(blank, F.array(F.lit("company:none"), F.lit("candidate_terms:none")))
        .when(party, F.array(named, reason("candidate_terms", both), F.lit("celebration:obvious")))
        .otherwise(F.array(named, reason("hiring", F.col("_h")), reason("role", F.col("_r"))))
    )
    return out.withColumns({"matched": ~blank & ~party & F.col("_m") & (F.size(both) > 0), "reasons": reasons}).drop("_h", "_r", "_m")


# ------------------------------------------------------------------ proximity

_WORD = re.compile(r"\w+(?:['’./]\w+)*")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_NARRATIVE = re.compile(NARRATIVE, re.IGNORECASE)


class _Places:
    """Where the terms of one vocabulary group stand in a text, the longest terms first."""

    def __init__(self, terms: Sequence[str]):
        usable = [t for t in terms if t.strip()]
        self.patterns = [(t, re.compile(rf"(?<!\w){quote(t)}(?!\w)", re.IGNORECASE)) for t in sorted(usable, key=len, reverse=True)]
        self.any = re.compile("|".join(p.pattern for _, p in self.patterns), re.IGNORECASE) if self.patterns else None

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        if self.any is None or not self.any.search(text):
            return []
        return [(m.start(), m.end(), term) for term, p in self.patterns for m in p.finditer(text)]


class _Nearness:
    """Whether two spans share a sentence or have few words between them."""

    def __init__(self, text: str, words: int):
        self.text, self.words = text, words
        self.starts, self.ends = [], []
        at = 0
        for m in [*_BREAK.finditer(text), None]:
            end = m.start() if m else len(text)
            if text[at:end].strip():
                self.starts.append(at)
                self.ends.append(end)
            at = m.end() if m else at
        if not self.starts:
            self.starts, self.ends = [0], [len(text)]

    def sentence(self, place: int) -> int:
        k = bisect.bisect_right(self.starts, place) - 1
        return k if k >= 0 and place < self.ends[k] else -1

    def __call__(self, a: tuple, b: tuple) -> bool:
        s = self.sentence(a[0])
        if s >= 0 and s == self.sentence(b[0]):
            return True
        first, second = sorted((a[:2], b[:2]))
        return first[1] > second[0] or len(_WORD.findall(self.text, first[1], second[0])) <= self.words


def _strong(text: str, company: str, mentioned: bool, groups: dict[str, _Places], words: int) -> tuple[bool, list[str]]:
    if not text.strip():
        return False, [f"{g}:none" for g in ("company", "hiring", "role", "domain", "proximity")]
    found = {g: places(text) for g, places in groups.items()}
    told = [m.span() for m in _NARRATIVE.finditer(text)]
    offered = [r for r in found["role"] if not any(r[0] < e and r[1] > s for s, e in told)]
    near = _Nearness(text, words)

    def counts(cue: tuple, role: tuple) -> bool:
        return near(cue, role) and not (cue[2].lower() in FORWARD_CUES and role[0] < cue[0])

    pair = next(((h[2], r[2]) for h in found["hiring"] for r in offered if counts(h, r)), None)
    offer = None
    for r in offered:
        cue = next((c[2] for c in found["cue"] if counts(c, r)), None)
        topic = next((d[2] for d in found["domain"] if near(r, d)), None) if cue else None
        if cue and topic:
            offer = (cue, r[2], topic)
            break
    bag = lambda g: ", ".join(sorted({t for *_, t in found[g]})[:3]) or "none"
    reasons = [f"company:{company if mentioned else 'none'}"]
    reasons += [f"hiring:{pair[0]}", f"role:{pair[1]}"] if pair else [f"hiring:{bag('hiring')}", f"role:{bag('role')}"]
    if offer:
        reasons += [f"domain:{offer[2]}", f"proximity:hire+intern≤{words}w; offer:{'~'.join(offer)}"]
    else:
        if found["role"] and not offered:
            why = "intern only in narrative/program phrasing"
        elif pair:
            why = "no job-offer cue near intern+domain"
        elif found["hiring"] and found["role"]:
            why = f"hiring/intern >{words}w apart (or different sentences)"
        else:
            why = "none"
        reasons += [f"domain:{bag('domain')}", f"proximity:{why}"]
    return bool(mentioned and pair and offer), reasons


def strong_match(df: DataFrame, company: Column, haystack: Column, text: str = "post_text", vocabulary: Vocabulary = Vocabulary(), *, cues: Sequence[str] = OFFER_CUES, words: int = NEAR_WORDS) -> DataFrame:
    """Proximity-aware match: hiring and role near each other, and a cue and a topic near one role that is offered.

    Spans, sentences and distances need an ordered search over several span lists, so
    this part is an Arrow-batched UDF; the company mention stays a native expression.
    Adds ``matched`` and ``reasons``.
    """

    @F.pandas_udf("struct<matched:boolean,reasons:array<string>>")
    def decide(texts: pd.Series, companies: pd.Series, named: pd.Series) -> pd.DataFrame:
        groups = {"hiring": _Places(vocabulary.hiring), "role": _Places(vocabulary.role), "domain": _Places(vocabulary.domain), "cue": _Places(cues)}
        made = [_strong(t, c, bool(m), groups, words) for t, c, m in zip(texts, companies, named, strict=True)]
        return pd.DataFrame({"matched": [m for m, _ in made], "reasons": [r for _, r in made]})

    out = df.withColumn("_s", decide(text_of(text), company, mentions(haystack, company)))
    return out.withColumns({"matched": F.col("_s.matched"), "reasons": F.col("_s.reasons")}).drop("_s")


# -------------------------------------------------------------------- funding

#: Phrases in which a text speaks of funding.
FUNDING = (
    r"(?i:\bpre[-\s]?seed\b)", r"(?i:\bseed[-\s]?(?:funded|stage|round)\b)", r"(?i:\bseries\s+[a-j]\b)", r"(?i:\by[-\s]?combinator\b)",
    r"(?i:\byc\s?[swf]\d{2}\b)", r"(?i:\b(?:vc|venture)[-\s]?backed\b)",
    r"\bbacked by\s+[A-Z][\w&]*(?:[\s,]+(?:and\s+)?[A-Z][\w&]*){0,3}",
    r"(?i:\braised\s+(?:\$|usd|inr|₹|rs\.?)\s?[\d.,]+\s?(?:k|m|mn|bn|cr|crore|million|billion)?\b)",
    r"(?i:\bfunded\s+startup\b)", r"(?i:\b(?:unicorn|soonicorn)\b)",
)
_FUNDING_HINT = r"(?i)seed|series|combinator|yc|backed|raised|funded|corn"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _funding(texts: pd.Series) -> pd.Series:
    patterns = [re.compile(p) for p in FUNDING]

    def phrases(text: str) -> list[str]:
        spans = sorted({(m.start(), -m.end()) for p in patterns for m in p.finditer(text)})
        out: dict[str, str] = {}
        free = 0
        for start, end in spans:
            phrase = " ".join(text[start:-end].split()).strip(" .,;:")
            if start >= free and phrase and phrase.lower() not in out:
                out[phrase.lower()] = phrase
                free = -end
        return list(out.values())

    return texts.map(phrases)


def funding_mentions(text: Column) -> Column:
    """Funding phrases as written: overlapping ones resolved to the earliest, then longest; each said once.

    A native test spares texts without any of the words the trip to Python.
    """
    own = F.coalesce(text, F.lit(""))
    return _funding(F.when(own.rlike(_FUNDING_HINT), own).otherwise(F.lit("")))
