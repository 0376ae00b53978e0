"""Company names: folding, mentions, allowlists, employers in headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import has_term, text_of

#: Words that end a company's name without telling it apart.
SUFFIXES = (
    "inc", "llc", "ltd", "limited", "pvt", "private", "plc", "corp",
    "corporation", "co", "company", "technologies", "technology", "tech",
    "labs", "lab", "solutions", "systems", "software", "services", "global",
    "india", "group", "holdings", "ventures", "studio", "studios", "ai",
)


def folded(text: Column) -> Column:
    """Lower-case ASCII words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def fold_company(name: Column) -> Column:
    """A name folded and without its suffix words; one word always stays."""
    return F.regexp_replace(folded(name), rf"^(\S+(?: \S+)*?)(?: (?:{'|'.join(SUFFIXES)}))+$", "$1")


def word_contains(longer: Column, shorter: Column) -> Column:
    """Whether the words of ``shorter`` stand in ``longer``."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (shorter != "") & F.contains(pad(longer), pad(shorter))


def same_company(a: Column, b: Column) -> Column:
    """Whether two folded names are equal or one's words contain the other's."""
    return (a != "") & (b != "") & (word_contains(a, b) | word_contains(b, a))


def mentions(text: Column, company: Column) -> Column:
    """Whether ``text`` names ``company``: as written, by its folded core, or folded on both sides."""
    core = fold_company(company)
    other = (core != "") & (core != F.lower(F.trim(company)))
    return (text != "") & (company != "") & (has_term(text, company) | (other & has_term(text, core)) | word_contains(folded(text), core))


def employer(headline: Column) -> Column:
    """The employer in a headline (``SWE @ Acme``, ``Engineer at Acme Labs``), empty for students."""
    own = F.trim(text_of(headline))
    student = r"(?iU)\b(?:student|undergraduate|university|college|b\.?tech|m\.?tech|bachelor|master|class of|bits)\b"
    found = F.regexp_extract(own, r"(?U)(?:@|\bat\b)\s*([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})", 1)
    return F.when(own.rlike(student), F.lit("")).otherwise(F.regexp_replace(found, r"^[ |,·]+|[ |,·]+$", ""))


def affiliated(headline: Column, target: Column) -> Column:
    """Whether the headline's employer is the target company."""
    return same_company(fold_company(employer(headline)), fold_company(text_of(target)))


def allowlist_semi_join(rows: DataFrame, company: str, allowed: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose company is equal to, contains, or is contained in an allowed name, as words.

    Containment of whole words is turned into equality: one side's name is matched
    against every run of words of the other, so both directions are hash joins over
    runs of words (a name has few) and no pair of names is ever compared.
    """
    runs = lambda c: F.expr(
        f"array_distinct(flatten(transform(sequence(1, size({c})), i -> transform(sequence(i, size({c})), j -> array_join(slice({c}, i, j - i + 1), ' ')))))"
    )
    keyed = rows.withColumn("_fold", fold_company(text_of(company)))
    lists = allowed.select(fold_company(text_of(name)).alias("_a")).where("_a <> ''").distinct()
    names = keyed.select("_fold").where("_fold <> ''").distinct()
    inside = names.withColumn("_w", F.split("_fold", " ")).select("_fold", F.explode(runs("_w")).alias("_a")).join(lists, "_a", "left_semi").select("_fold")
    around = lists.withColumn("_w", F.split("_a", " ")).select(F.explode(runs("_w")).alias("_fold")).join(names, "_fold", "left_semi")
    return keyed.join(inside.unionByName(around).distinct(), "_fold", "left_semi").drop("_fold")
