"""Personal data by pattern, checksum and context (operator 3), in Spark SQL functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97
for IBANs, ranges for addresses, digit counts for phones), and words near a span
raise or lower its score.  Positions come from the gaps between matches: the n-th
match starts after the first n gaps and n-1 matches, so no position search is needed.

The patterns use possessive loops and start only where a match may start, which
keeps every scan linear in the text, however long a run of digits or letters is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap test that a text must pass before the pattern runs
    score: float
    context: str
    base: bool = True
    boost: float = 0.2
    valid: object = field(default=None, compare=False)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return (F.length(d) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97(value: Column) -> Column:
    """Whether ``value`` (spaces ignored) has the IBAN remainder of 1."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(v, F.lit(5)), F.left(v, F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _card_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(13, 19) & luhn(v)


def _ip_ok(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255))


def _phone_ok(v: Column) -> Column:
    return F.length(_digits(v)).between(9, 15)


#: Characters of an IBAN behind its country and check digits, and the countries that use so many.
_IBAN = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST",
    22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA",
    26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}


def _iban_pattern() -> str:
    """The country gives the length, so what follows an IBAN is left alone.

    Countries without a known length take the longest run, which stops before a known country.
    """
    known = "(?:" + "|".join(" ".join(_IBAN.values()).split()) + ")[0-9]{2}"
    fixed = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in _IBAN.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{fixed}|(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?! {known}) ?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.8, r"(?i)mail|contact|write|@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"(?i)\bip\b|host|server|address|login", valid=_ip_ok),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", 0.7, r"(?i)card|visa|credit|amex|master|pay", valid=_card_ok),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"(?i)tel|phone|call|mobile|fax|whatsapp", valid=_phone_ok),
    Kind("iban", _iban_pattern(), r"[A-Z]{2}[0-9]{2}", 0.8, r"(?i)iban|bank|account|konto|cuenta", base=False, valid=mod97),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.35, r"(?i)ssn|social|security", base=False),
    Kind("secret", r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api[_-]?key)\s{0,8}[=:]\s{0,8}[\x22'][A-Za-z0-9_/+=.-]{16,}+[\x22']", r"(?i)token|secret|passw|api", 0.7, r"(?i)auth|key|bearer|export|env", base=False),
)


def _proposed(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The matches and the gaps around them."""
    has = text.rlike(kind.needs)
    none = F.expr("cast(array() as array<string>)")
    return (
        F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none),
        F.when(has, F.split(text, kind.pattern)).otherwise(F.array(F.lit(""))),
    )


def _is_valid(kind: Kind, value: Column) -> Column:
    return kind.valid(value) if kind.valid else F.lit(True)


def _matched(found: Column, gaps: Column, use: Callable[[Column], Column]) -> Column:
    """``use(m)`` with ``m.found`` and ``m.gaps`` reckoned once a row: read inside a lambda, the patterns themselves would run again for every match."""
    return F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), use)[0]


def _verdict(kind: Kind, value: Column, before: Column, after: Column, least: float, window: int) -> tuple[Column, Column]:
    """Whether a match counts, and its score by the words around it."""
    near = F.concat(F.right(before, F.lit(window)), F.lit(" "), F.left(after, F.lit(window)))
    score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), kind.boost).otherwise(0.0))
    return _is_valid(kind, value) & (F.lit(kind.base) | (score >= least)), score


def _spans_of(kind: Kind, found: Column, gaps: Column, least: float, window: int) -> Column:
    empty = F.expr(f"cast(array() as {SPAN})")

    def spans(m: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            value, before, after = F.get(m["found"], i), F.get(m["gaps"], i), F.get(m["gaps"], i + 1)
            start = acc["pos"] + F.char_length(before)
            end = start + F.char_length(value)
            keep, score = _verdict(kind, value, before, after, least, window)
            span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
            return F.struct(end.alias("pos"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        begin = F.struct(F.lit(0).cast("long").alias("pos"), empty.alias("spans"))
        n = F.size(m["found"])
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), begin, step, lambda acc: acc["spans"])).otherwise(empty)

    return _matched(found, gaps, spans)


def find_pii(docs: DataFrame, *, text: str = "text", least: float = 0.5, window: int = 48) -> DataFrame:
    """Add ``pii array<struct<kind,start,end,score>>``: by kind in the order of ``KINDS``, then by start.

    Base kinds are kept whenever they validate; the others only with a score of
    ``least``.  Offsets are code points, ends exclusive; kinds may overlap.  Null and
    empty texts have no spans; other columns pass through untouched (an own ``pii`` is
    replaced); every input row gives one output row (an empty table an empty one, repeated
    rows repeated results).  Each pattern runs over a text once to list its matches and once to cut it.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("pii", F.concat(*(_spans_of(k, *_proposed(own, k), least, window) for k in KINDS)))


def mask_pii(docs: DataFrame, *, text: str = "text", least: float = 0.5, window: int = 48) -> DataFrame:
    """Replace every confirmed span by ``[KIND]``, one kind after another.

    Null stays null, an empty text empty; rows, repeated ones too, and other columns stay; an empty table gives an empty one.
    """
    own = F.col(text)
    for k in KINDS:
        docs = docs.withColumn(text, F.when(own.rlike(k.needs), _matched(*_proposed(own, k), _masked(k, least, window))).otherwise(own))
    return docs


def _masked(kind: Kind, least: float, window: int) -> Callable[[Column], Column]:
    """The text put together again, with a mask for every match that is confirmed."""

    def text(m: Column) -> Column:
        def put(i: Column) -> Column:
            value, before, after = F.get(m["found"], i), F.get(m["gaps"], i), F.get(m["gaps"], i + 1)
            keep, _ = _verdict(kind, value, before, after, least, window)
            return F.concat(before, F.when(keep, F.lit(f"[{kind.name.upper()}]")).otherwise(value))

        n = F.size(m["found"])
        filled = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), put), "")).otherwise(F.lit(""))
        return F.concat(filled, F.element_at(m["gaps"], -1))

    return text


def span_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


BASE_KINDS = tuple(k.name for k in KINDS if k.base)
