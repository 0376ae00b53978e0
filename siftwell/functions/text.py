"""Text rules as Column expressions: vocabulary hits, snippets, cleaning, counts.

All patterns are Unicode-aware (``(?iuU)``): without the flags an accented letter
would end a word.  Text that is null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignore case, Unicode case folding, Unicode character classes.
UNI = "(?iuU)"
_EMPTY = "cast(array() as array<string>)"


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def no_strings() -> Column:
    return F.expr(_EMPTY)


def quote(term: str) -> str:
    """A literal for a regular expression, with any run of white space inside it."""
    parts = term.strip().lower().split()
    return r"\s+".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in p) for p in parts)


def term_pattern(term: str) -> str:
    """Whole-word pattern for a term.

    The look-behind stands after the first character, so that a search compares one
    character at most places and looks back only where a term may begin.
    """
    body = quote(term)
    first = 2 if body.startswith("\\") else 1
    head = body[:first]
    return rf"{UNI}{head}(?<!\w{head}){body[first:]}(?!\w)"


def folded_case(text: Column) -> Column:
    """Lower case, with the two letters that a pattern ignoring case equates with ASCII ones made so."""
    return F.translate(F.lower(text), "ſı", "si")


def quoted(term: Column) -> Column:
    """:func:`quote` for a column of terms."""
    literal = F.regexp_replace(F.lower(F.trim(term)), r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.regexp_replace(literal, r"\s+", r"\\s+")


def has_term(text: Column, term: Column) -> Column:
    """Whether ``text`` has the column's term as whole words; an empty term is nowhere."""
    pattern = F.concat(F.lit(rf"{UNI}(?<!\w)(?:"), quoted(term), F.lit(r")(?!\w)"))
    return (F.trim(term) != "") & F.rlike(text, pattern)


def _hit(text: Column, low: Column, term: str) -> Column:
    """A term's longest word is looked for as plain bytes first; only texts that have it are searched with the pattern."""
    return low.contains(max(term.lower().split(), key=len)) & text.rlike(term_pattern(term))


def term_hits(text: Column, terms: Sequence[str], low: Column | None = None) -> Column:
    """The terms found, in vocabulary order; ``low`` is :func:`folded_case` of the text where it is at hand."""
    terms = [t for t in dict.fromkeys(terms) if t.strip()]
    if not terms:
        return no_strings()
    low = folded_case(text) if low is None else low
    # nulls go by a set difference, which stays in generated code
    return F.array_except(F.array(*(F.when(_hit(text, low, t), F.lit(t)) for t in terms)), F.array(F.lit(None).cast("string")))


def has_any_term(text: Column, terms: Sequence[str], low: Column | None = None) -> Column:
    """Whether any term is found: one condition, which stops at the first that is."""
    terms = [t for t in dict.fromkeys(terms) if t.strip()]
    low = folded_case(text) if low is None else low
    out = F.lit(False)
    for t in reversed(terms):
        out = _hit(text, low, t) | out
    return out


def sentences(text: Column) -> Column:
    """Non-blank sentences; a text without any is its own only sentence."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, most: int = 240) -> Column:
    """One line of at most ``most`` characters, ended by an ellipsis where it was cut."""
    line = collapsed(text)
    return F.when(F.char_length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


_EDGE = " ·\\-–—"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` reckoned once a row, however often ``use`` reads it and lambdas repeat it."""
    return F.transform(F.array(value), use)[0]


def without_doubling(raw: Column) -> Column:
    """Distinct lines on one line, edge marks stripped, and a phrase that is said twice said once."""
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapsed), lambda s: s != "")
    line = F.regexp_replace(F.array_join(F.array_distinct(lines), " "), f"^[{_EDGE}]+|[{_EDGE}]+$", "")

    def once(words: Column) -> Column:
        half = F.floor(F.size(words) / 2).cast("int")
        first = F.slice(words, F.lit(1), F.greatest(half, F.lit(0)))
        twice = (F.size(words) > 0) & (F.size(words) % 2 == 0) & (first == F.slice(words, half + 1, F.greatest(half, F.lit(0))))
        return F.when(twice, F.array_join(first, " "))

    words = lambda line: F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    return bound(line, lambda own: F.trim(F.coalesce(bound(words(own), once), own)))


def clean_name(raw: Column) -> Column:
    """A person's name without what follows a bullet and without connection degrees at its end."""
    name = F.trim(F.substring_index(without_doubling(raw), "•", 1))
    ends = r"(?iU)(?:\s*\b\d+(?:st|nd|rd|th)\b\s*\+?\s*[ ·\-–—•]*)+$"
    return F.regexp_replace(F.regexp_replace(name, ends, ""), f"^[{_EDGE}•]+|[{_EDGE}•]+$", "")


def is_more_label(label: Column) -> Column:
    return label.rlike(r"(?i)^\s*(?:…|\.{2,3})?\s*(?:see\s+)?more\s*$")


def is_truncated(text: Column) -> Column:
    return text.rlike(r"(?i)(?:…|\.{3})\s*(?:more)?\s*$")


#: Words that a text search leaves out.
SEARCH_STOP = ("the", "and", "for", "are", "you", "your", "our", "with", "this", "that", "hiring", "looking", "intern", "internship", "apply", "join")


def search_tokens(text: Column, most: int = 6) -> Column:
    """The first telling words of three letters or more; if none tells, the first words."""
    words = F.regexp_extract_all(F.replace(text, F.lit("*"), F.lit(" ")), F.lit(r"(?U)[\w']{3,}"), F.lit(0))
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*SEARCH_STOP))
    return F.when(F.size(telling) > 0, F.slice(telling, 1, most)).otherwise(F.slice(words, 1, most))


def hashtags(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)(?:^|\s)#\w+"))


def without_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)#(?<!\w#)\w+", "")


def company_line(text: Column) -> Column:
    """The value of a leading ``Company:`` line."""
    return F.trim(F.regexp_extract(text, r"(?iU)(?:^|\n)\s*Company:\s*([^\n|]+)", 1))


def follower_count(text: Column) -> Column:
    """Followers named in a headline (``31k+ LinkedIn``, ``1,234 followers``), null without any."""
    with_word = r"(?i)(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([km])?\+?\s+(?:linkedin\s+)?followers?\b"
    with_site = r"(?i)(\d+(?:\.\d+)?)\s*([km])\+?(?:\s*\+)?(?:\s*linkedin)\b"
    first = F.regexp_extract(text, with_word, 1)
    use = first != ""
    raw = F.replace(F.when(use, first).otherwise(F.regexp_extract(text, with_site, 1)), F.lit(","), F.lit(""))
    unit = F.lower(F.when(use, F.regexp_extract(text, with_word, 2)).otherwise(F.regexp_extract(text, with_site, 2)))
    factor = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)
    return F.when(raw != "", (raw.try_cast("double") * factor).cast("long"))


def format_followers(count: Column) -> Column:
    """``1.2k``, ``3m``: whole numbers without a fraction, halves to even."""

    def short(unit: int, name: str) -> Column:
        value = count / unit
        return F.when(count % unit == 0, F.concat((count / unit).cast("long").cast("string"), F.lit(name))).otherwise(F.concat(F.format_string("%.1f", value), F.lit(name)))

    return F.when(count >= 1_000_000, short(1_000_000, "m")).when(count >= 1_000, short(1_000, "k")).otherwise(count.cast("string"))


def is_verified(text: Column) -> Column:
    return text.rlike(r"(?iU)\bverified\b|\bverification badge\b")


def engagement(text: Column) -> Column:
    """Largest count for likes, comments and reposts; an empty map where none is shown."""

    def most(label: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?iU)([\d,]+)\s*(?:{label})\b"), F.lit(1))
        return F.coalesce(F.array_max(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("long"))), F.lit(0).cast("long"))

    some = text.rlike(r"(?iU)[\d,]*\d[\d,]*\s*(?:reactions?|likes?|comments?|reposts?|shares?)\b")
    counts = F.create_map(F.lit("likes"), most("reactions?|likes?"), F.lit("comments"), most("comments?"), F.lit("reposts"), most("reposts?|shares?"))
    return F.when(some, counts).otherwise(F.expr("cast(map() as map<string,bigint>)"))


def escape_markdown(value: Column) -> Column:
    return F.trim(F.replace(F.replace(text_of(value), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def header_label(field: str) -> str:
    return field.replace("_", " ").title()


def strip_fences(text: Column) -> Column:
    """A reply without its Markdown code fence."""
    own = F.trim(text)
    return F.trim(F.when(own.startswith("```"), F.regexp_replace(F.regexp_replace(own, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(own))


def reason(label: str, hits: Column, shown: int = 3) -> Column:
    """``label:a, b, c``, or ``label:none``."""
    return F.concat(F.lit(label + ":"), F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, shown), ", ")).otherwise(F.lit("none")))


def prompt_head(text: Column, most: int = 30_000) -> Column:
    return F.substring(text, 1, most)


def identity_key(url: Column, poster: Column, text: Column) -> Column:
    """A post's identity: its permalink, else its poster with a digest of the folded text."""
    digest = F.substring(F.sha2(F.lower(collapsed(text)), 256), 1, 16)
    search = url.rlike(r"^[^?#]*/search/results/content(?:/|$|[?#])")
    return F.when((url != "") & ~search, F.lower(F.regexp_replace(url, "/+$", ""))).otherwise(F.concat(F.lit("text:"), F.lower(F.trim(poster)), F.lit(":"), digest))
