"""Search texts for entities: structured queries, variations, and a check on pasted prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 7
_ROLE = "(intern OR internship)"
_HIRING = "(hiring OR \"we're hiring\" OR openings)"


def structured_query(company: Column, role: str = "intern") -> Column:
    name = F.concat(F.lit('"'), F.trim(company), F.lit('"'))
    role = role.strip() or "intern"
    middle = f" {_ROLE} {_HIRING}" if role.lower() in ("intern", "internship", "intern or internship") else f" ({role}) {_ROLE} {_HIRING}"
    return F.concat(name, F.lit(middle))


def variations(company: Column, role: str = "intern", most: int = MOST) -> Column:
    """Up to ``most`` different queries for one company; none for a blank name."""
    role = role.strip() or "intern"
    tails = [
        "intern", f"{_ROLE} {_HIRING}", f"(SDE OR backend OR software) {_ROLE}", f'(ML OR data OR "machine learning") {_ROLE} hiring',
        "intern hiring", f'"we\'re hiring" {_ROLE}', f"{_ROLE} openings",
    ]
    if role.lower() not in ("intern", "internship"):
        tails.insert(1, f"({role}) {_ROLE} {_HIRING}")
    kept = list({t.lower(): t for t in reversed(tails)}.values())[::-1][: max(1, most)]
    made = F.array(*(F.concat(F.lit('"'), F.trim(company), F.lit(f'" {t}')) for t in kept))
    return F.when(F.trim(company) != "", made).otherwise(F.expr("cast(array() as array<string>)"))


def is_prose(query: Column) -> Column:
    """Whether a query looks like pasted text: several lines, too long, too many words or sentences."""
    own = F.trim(query)
    words = F.size(F.filter(F.split(own, r"(?U)\s+"), lambda w: w != ""))
    dots = F.length(own) - F.length(F.replace(own, F.lit("."), F.lit("")))
    return (own != "") & (own.contains("\n") | (F.char_length(own) > 160) | (words > 22) | ((dots >= 2) & (F.char_length(own) > 80)))


def sanitised(queries: Column, company: Column, role: str = "intern", most: int = MOST) -> Column:
    """User queries with ``{company}`` filled in, without prose and repeats; the defaults where none is left."""
    filled = F.filter(F.transform(queries, lambda q: F.trim(F.replace(q, F.lit("{company}"), company))), lambda q: (q != "") & ~is_prose(q))
    low = F.transform(filled, F.lower)
    own = F.slice(F.filter(filled, lambda q, i: F.array_position(low, F.lower(q)) == i + 1), 1, max(1, most))
    return F.when(F.size(own) > 0, own).otherwise(variations(company, role, most))


def explode_variations(companies: DataFrame, name: str, role: str = "intern", most: int = MOST) -> DataFrame:
    """One row for each company and query, numbered."""
    return companies.select("*", F.posexplode(variations(F.col(name), role, most)).alias("query_no", "query"))
