"""What stored pages are made of: counts of elements, marked cards, and the names that occur most.

All names are counted; a name is added up within its partition before it is shuffled, so that a
name which stands on every page is no hot task, and each scope keeps its first rows before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import bound
from siftwell.sources.tree import inner_text, nodes_of

#: Attributes that may carry the name of a post, what such a name holds, and parts of class names that belong to feeds.
CARRIERS = ("data-urn", "data-id", "data-entity-urn", "data-activity-urn", "data-chameleon-result-urn", "data-finite-scroll-hotkey-item")
CARRIED = r"(?i)activity|ugcPost|share"
FEED_CLASS = r"(?i)feed|update|post|search-result|occludable|entity|actor|commentary|scaffold"
HIRING = r"(?i)hiring|intern"
#: Names shown of each scope.
MOST = {"carrier_class": 25, "carrier_attribute": 25, "class": 40}


def carried(n: Column) -> Column:
    """The first attribute of an element that names a post, as ``name=value``; null without one."""
    return F.coalesce(*(F.when(n["attrs"][a].rlike(CARRIED), F.concat(F.lit(f"{a}="), n["attrs"][a])) for a in CARRIERS))


def _classes(n: Column) -> Column:
    return F.filter(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), lambda c: c != "")


def _elements(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: ~n["tag"].startswith("#"))


def _is_leaf_that_says(nodes: Column, pattern: str) -> Column:
    """Elements without elements in them whose text matches.

    Nodes stand in document order, so an element is a leaf unless the element after it in
    the list stands inside it; its texts are the slice of its interval.
    """

    def counted(all_: Column) -> Column:
        elements = _elements(all_)
        inner = lambda n: F.slice(all_, n["at"] + 1, n["end"] - n["at"])
        text = lambda n: F.array_join(F.transform(F.filter(inner(n), lambda d: d["tag"].isin("#text", "#data")), lambda d: d["text"]), "")
        next_at = lambda e: F.concat(F.transform(F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), lambda x: x["at"]), F.array(F.lit(2**31 - 1)))
        pairs = bound(elements, lambda e: F.zip_with(e, next_at(e), lambda n, after: F.when(after >= n["end"], n)))
        return F.size(F.filter(pairs, lambda n: n.isNotNull() & text(n).rlike(pattern)))

    return bound(nodes, counted)


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``n_elements, n_carriers, n_hiring, body_chars``; null and empty pages count nothing."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html]
    read = pages.select(*rest, nodes_of(F.col(html)).alias("_nodes"))
    nodes = F.col("_nodes")
    return read.select(
        *rest,
        F.size(_elements(nodes)).alias("n_elements"),
        F.size(F.filter(nodes, lambda n: carried(n).isNotNull())).alias("n_carriers"),
        _is_leaf_that_says(nodes, HIRING).alias("n_hiring"),
        F.char_length(F.trim(F.regexp_replace(inner_text(nodes), r"\s+", " "))).alias("body_chars"),
    )


def name_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``scope, name, n`` over all pages: classes and attributes of the elements that carry a post, and all feed-like classes."""
    named = lambda scope, names: F.transform(names, lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("name")))
    own = lambda n: F.concat(
        F.when(carried(n).isNotNull(), F.concat(named("carrier_class", _classes(n)), named("carrier_attribute", F.map_keys(n["attrs"])))).otherwise(F.array().cast("array<struct<scope:string,name:string>>")),
        named("class", F.filter(_classes(n), lambda c: c.rlike(FEED_CLASS))),
    )
    rows = pages.select(nodes_of(F.col(html)).alias("_nodes")).select(F.explode(F.flatten(F.transform(_elements(F.col("_nodes")), own))).alias("_e"))
    return rows.groupBy("_e.scope", "_e.name").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, most: dict[str, int] = MOST) -> DataFrame:
    """The first names of each scope by count, ties by name; all scopes are ranked in one pass, so that the pages behind the counts are read once."""
    limit = F.coalesce(*(F.when(F.col("scope") == scope, n) for scope, n in most.items()))
    w = Window.partitionBy("scope").orderBy(F.desc("n"), "name")
    ranked = counts.where(F.col("scope").isin(*most)).withColumn("_n", F.row_number().over(w))
    return ranked.where((F.col("_n") <= max(most.values())) & (F.col("_n") <= limit)).drop("_n")
