"""Whole flows: keyword posts, the company walk, and the two verdict gates, each as one lazy plan.

A flow returns every input row with the stage it ended in; filters on ``stage`` give the
kept rows, and :mod:`siftwell.operators.funnel` counts the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.dates import humanised, is_recent
from siftwell.functions.entities import affiliated, employer, fold_company, folded
from siftwell.functions.text import follower_count, format_followers, identity_key, reason, snippet, term_hits, text_of
from siftwell.functions.urls import clean_permalink, link_domains, permalink_cache_key, permalink_of
from siftwell.operators.funnel import batch_numbers, first_stage, keep_first, limit_per_key
from siftwell.operators.history import poster_profiles, screen_posters
from siftwell.operators.matching import CELEBRATION, Vocabulary, funding_mentions, match_terms, strong_match
from siftwell.operators.provenance import KEPT_TYPES, first_party, link_and_source_gate
from siftwell.operators.verdicts import FLAGS, drop_reason, is_seeking, join_verdicts, kept_rank, semantic_keep, verdict_source_type


def haystack(*columns: str) -> Column:
    """Where a company may be named: text, company, poster and headline."""
    return F.concat_ws(" ", *(F.nullif(text_of(c), F.lit("")) for c in columns or ("post_text", "company", "poster", "poster_headline")))


#: Bytes of folded names, and names, that an automaton is built from; more are joined by their first words.
AUTOMATON_BYTES, AUTOMATON_NAMES = 16 << 20, 200_000


def _wide(text: Column) -> Column:
    """Folded by Unicode words, for names without ASCII letters."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def _named_in(names: list[tuple[bool, str, str]]) -> Callable[[Column, Column], Column]:
    """``array<string>`` of the names whose words stand in a text (its ASCII and its Unicode folding): one pass of an Aho-Corasick automaton."""
    held: list[dict[str, list[str]]] = [{}, {}]
    for wide, core, name in names:
        held[wide].setdefault(f" {core} ", []).append(name)

    def automaton(cores: dict[str, list[str]]):
        import ahocorasick

        made = ahocorasick.Automaton()
        for core, own in cores.items():
            made.add_word(core, own)
        if cores:
            made.make_automaton()
        return made if cores else None

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = [automaton(cores) for cores in held]
        for batch in batches:
            rows = []
            for texts in zip(*batch, strict=True):
                rows.append(sorted({n for a, t in zip(made, texts, strict=True) if a is not None and t for _, own in a.iter(f" {t} ") for n in own}))
            yield pd.Series(rows, dtype=object)

    return find


def _by_first_word(texts: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """The same for any number of names: every place of a text meets the names that begin with its word, and the words behind it are compared."""
    longest = names.agg(F.coalesce(F.max(F.size(F.split("_core", " "))), F.lit(1))).first()[0]
    places = texts.select(key, F.explode(F.array(F.struct(F.lit(False).alias("w"), F.split("_ascii", " ").alias("t")), F.struct(F.lit(True).alias("w"), F.split("_wide", " ").alias("t")))).alias("b"))
    places = places.select(key, F.col("b.w").alias("_wide"), F.posexplode("b.t").alias("_at", "_word"), F.col("b.t").alias("_t")).where("_word <> ''")
    places = places.select(key, "_wide", "_word", F.concat(F.array_join(F.slice("_t", F.col("_at") + 1, longest), " "), F.lit(" ")).alias("_run")).distinct()
    first = names.withColumn("_word", F.substring_index("_core", " ", 1))
    return places.join(first, ["_wide", "_word"]).where(F.startswith("_run", F.concat("_core", F.lit(" ")))).select(key, name)


def mention_join(posts: DataFrame, key: str, text: Column, companies: DataFrame, name: str = "target", *, fold: Callable[[Column], Column] = fold_company, most_bytes: int = AUTOMATON_BYTES, most_names: int = AUTOMATON_NAMES) -> DataFrame:
    """``key, target`` for every post and company that it mentions, once each.

    A name is mentioned exactly where the words of its core, ``fold`` of it, stand in the
    folded text: without a company's suffix words, or with ``folded`` all of its words.  The names' size is measured first: up to the bounds an automaton of all names
    goes to the executors and reads each text once, without a shuffle of texts; beyond,
    names are dealt by their first word.  Null texts and names mention nothing; names
    without ASCII letters are folded by Unicode words; repeated rows count once.
    """
    core = fold(F.col(name))
    names = companies.where(F.col(name).isNotNull()).select(name).distinct().withColumns({"_wide": core == "", "_core": F.when(core != "", core).otherwise(_wide(F.col(name)))}).where("_core <> ''")
    count, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_core") + F.octet_length(name)), F.lit(0))).first()
    texts = posts.select(key, folded(F.coalesce(text, F.lit(""))).alias("_ascii"), _wide(F.coalesce(text, F.lit(""))).alias("_wide"))
    if count > most_names or size > most_bytes:
        return _by_first_word(texts, key, names, name).distinct()
    found = _named_in([(r["_wide"], r["_core"], r[name]) for r in names.collect()])
    wide = F.col("_wide") if count and names.where("_wide").limit(1).count() else F.lit("")
    return texts.select(key, F.explode(found(F.col("_ascii"), wide)).alias(name)).distinct()


def label_companies(posts: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``company_class, class_confidence`` by company, else poster name, ignoring case; unknown ones are blank."""
    own = F.lower(F.trim(F.when(F.trim("company") != "", F.col("company")).otherwise(F.col("poster"))))
    facts = classes.groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min_by("category", "name").alias("_cat"), F.min_by("confidence", "name").alias("class_confidence"))
    return posts.drop("company_class", "class_confidence").withColumn("_n", own).join(facts, "_n", "left").withColumn("company_class", text_of("_cat")).drop("_n", "_cat")


def is_startup(company_class: Column) -> Column:
    return company_class == "funded_startup"


#: Fixed value: a post's path in the markup that the server sent.
_UPDATE_PATH = r"/feed/update/(urn:li:(?:share|activity|ugcPost):\d+)/"


def assign_strays(posts: DataFrame, pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``posts`` with the permalink that only one of them can have: a page with exactly one post without a URL whose markup names exactly one.

    ``stray`` says which were filled.  Both counts are one partial aggregate by page; only
    posts without a URL are joined, so resolved posts of a large page don't move.  Null keys
    match no page; pages without posts and posts without pages change nothing.
    """
    none = F.coalesce("post_url", F.lit("")) == ""
    urns = F.regexp_extract_all(html, F.lit(_UPDATE_PATH), F.lit(1))
    named = pages.select(key, F.lit(0).alias("_open"), F.size(urns).alias("_urns"), F.try_element_at(urns, F.lit(1)).alias("_urn"))
    counted = posts.where(none).select(key, F.lit(1).alias("_open"), F.lit(0).alias("_urns"), F.lit(None).cast("string").alias("_urn")).unionByName(named)
    sure = counted.groupBy(key).agg(F.sum("_open").alias("_open"), F.sum("_urns").alias("_urns"), F.max("_urn").alias("_urn")).where("_open = 1 and _urns = 1").select(key, "_urn")
    url = F.when(F.col("_urn").isNotNull(), F.concat(F.lit("https://www.linkedin.com/feed/update/"), "_urn", F.lit("/"))).otherwise(F.coalesce("post_url", F.lit("")))
    filled = posts.where(none).join(sure, key, "left").withColumns({"post_url": url, "stray": F.col("_urn").isNotNull()})
    return posts.where(~none).withColumn("stray", F.lit(False)).unionByName(filled.drop("_urn"))


def fill_permalinks(posts: DataFrame, cache: DataFrame | None = None, budget: int | None = None, order: str = "seq") -> DataFrame:
    """Set ``post_url`` and ``url_reason``: already exact, from an anchor, from the cache ``(cache_key, permalink)``, or none.

    With a ``budget``, only the first rows that lack a link are filled; the rest say so.
    """
    exact, anchor = clean_permalink(text_of("post_url")), permalink_of(F.col("outbound_links"))
    step = posts.withColumns({"_exact": exact, "_anchor": anchor, "cache_key": permalink_cache_key(text_of("activity_urn"), text_of("post_url"), text_of("poster"), text_of("post_text"))})
    step = step.join(cache.groupBy("cache_key").agg(F.min("permalink").alias("_cached")), "cache_key", "left") if cache is not None else step.withColumn("_cached", F.lit(None).cast("string"))
    if budget is not None:
        open_ = step.where("_exact = ''").select(order)
        tried = limit_per_key(open_.withColumn("_g", F.lit(0)), ["_g"], [F.col(order)], budget).select(order, F.lit(True).alias("_tried"))
        step = step.join(tried, order, "left")
    else:
        step = step.withColumn("_tried", F.lit(True))
    may = F.coalesce("_tried", F.lit(False))
    why = F.when(F.col("_exact") != "", "exact").when(~may, "budget").when(F.col("_anchor") != "", "anchor").when(text_of("_cached") != "", "cache").otherwise("no_permalink")
    url = F.when(why == "exact", F.col("_exact")).when(why == "anchor", F.col("_anchor")).when(why == "cache", F.col("_cached")).otherwise("")
    return step.withColumns({"url_reason": why, "_url": url}).withColumn("post_url", F.col("_url")).drop("_exact", "_anchor", "_cached", "_tried", "_url", "cache_key")


def keyword_posts(posts: DataFrame, vocabulary: Vocabulary = Vocabulary(), *, max_age: float = 30, keep_undated: bool = False, order: str = "seq") -> DataFrame:
    """The keyword flow: unseen once, recent, matching, clean sources.  Adds ``stage``, ``why_matched`` and ``funding_signal``."""
    key = identity_key(text_of("post_url"), text_of("poster"), text_of("post_text"))
    once = keep_first(posts.withColumn("_key", key), ["_key"], [order]).drop("_key")
    judged = link_and_source_gate(match_terms(once, "post_text", vocabulary), "company", require_opening=False)
    stage = first_stage([
        ("undated", F.col("days_old").isNull() & F.lit(not keep_undated)),
        ("too_old", ~is_recent(F.col("days_old"), max_age, keep_undated)),
        ("not_hiring", ~F.col("matched")),
        ("source", F.col("reject_reason") != ""),
    ])
    age = F.when(F.col("days_old").isNull(), "recency:undated(kept)").otherwise(F.concat(F.lit("recency:"), humanised(F.col("days_old"))))
    return judged.withColumns({"stage": stage, "why_matched": F.array_join(F.concat(F.array(age), F.col("reasons"), F.col("source_reasons")), "; "), "funding_signal": F.array_join(funding_mentions(F.col("post_text")), "; ")})


def company_walk(posts: DataFrame, companies: DataFrame, vocabulary: Vocabulary = Vocabulary(), *, max_age: float = 30, keep_undated: bool = False, strict: bool = True, limit: int | None = None, order: str = "seq") -> DataFrame:
    """The company flow: every (post, target) that may count, with ``stage``, ``reasons`` and ``why_matched``.

    A post counts once per company, before anything is filtered.  ``strict`` asks for a
    proximity match and a first-party opening, otherwise the broad net is enough.
    """
    key = identity_key(text_of("post_url"), text_of("poster"), text_of("post_text"))
    pairs = mention_join(posts, order, haystack(), companies)
    seen = keep_first(posts.join(pairs, order).withColumn("_key", key), ["target", "_key"], [order]).drop("_key")
    links = F.col("outbound_links")
    if strict:
        judged = first_party(strong_match(seen, F.col("target"), haystack(), "post_text", vocabulary), F.col("target"), F.col("poster"), F.col("poster_headline"), F.col("post_text"), links)
    else:
        party = F.col("post_text").rlike(f"(?iUs){CELEBRATION}")
        net = seen.withColumns({"_h": term_hits(F.col("post_text"), vocabulary.hiring), "_r": term_hits(F.col("post_text"), vocabulary.role)})
        net = net.withColumns({"matched": ~party & (F.size(F.concat("_h", "_r")) > 0), "reasons": F.array(F.concat(F.lit("company:"), F.col("target")), reason("hiring", F.col("_h")), reason("role", F.col("_r")))}).drop("_h", "_r")
        judged = first_party(net, F.col("target"), F.col("poster"), F.col("poster_headline"), F.col("post_text"), links, strict=False).withColumn("keep", F.lit(True))
    stage = first_stage([
        ("too_old", ~is_recent(F.col("days_old"), max_age, keep_undated)),
        ("prefilter", ~F.col("matched")),
        ("source", ~F.col("keep")),
    ])
    out = judged.withColumns({"stage": stage, "snippet": snippet(text_of("post_text")), "poster_employer": employer(F.col("poster_headline")), "author_affiliation_matches_target": affiliated(F.col("poster_headline"), F.col("target"))})
    out = out.withColumn("why_matched", F.concat_ws("; ", F.concat(F.lit("recency:"), humanised(F.col("days_old"))), F.array_join("reasons", "; "), F.col("keep_reason")))
    if limit is not None:
        kept = limit_per_key(out.where("stage = 'kept'").select("target", order), ["target"], [F.col(order)], limit).withColumn("_in", F.lit(True))
        out = out.join(kept, ["target", order], "left").withColumn("stage", F.when((F.col("stage") == "kept") & F.col("_in").isNull(), "over_limit").otherwise(F.col("stage"))).drop("_in")
    return out


def semantic_gate(posts: DataFrame, verdicts: DataFrame, history: DataFrame | None = None, *, size: int = 5, order: str = "seq") -> DataFrame:
    """Verdicts applied: ``stage`` is kept or the reason of the drop.

    Candidate-seeking copy and blocked posters go first and are not batched;
    ``verdicts`` has ``company, batch, id``, the four flags, ``intent`` and ``reason``; a
    record without one is dropped.  :func:`gate_batches` gives the batches to judge.
    """
    screened = _screened(posts, history)
    batched = batch_numbers(screened.where("_early = ''"), ["company"], [order], max(1, min(5, size)))
    early = screened.where("_early <> ''").withColumns({"batch": F.lit(None).cast("long"), "id": F.lit(None).cast("int")})
    judged = join_verdicts(batched.unionByName(early), verdicts.withColumnRenamed("reason", "verdict_reason"))
    v = {k: F.coalesce(F.col(k), F.lit(False)) for k in FLAGS} | {"intent": text_of("intent")}
    rest = [text_of("post_text"), F.coalesce("link_categories", F.expr("cast(array() as array<string>)")), text_of("link_class"), text_of("poster_employer"), F.coalesce("author_affiliation_matches_target", F.lit(False))]
    stage = F.when(F.col("_early") != "", F.col("_early")).when(~F.col("judged"), "gate:invalid_json").when(semantic_keep(v, *rest), "kept").otherwise(drop_reason(v, *rest))
    decision = F.concat(F.lit("semantic:company_hiring; author_is_hirer:"), v["author_is_hirer"].cast("string"), F.lit("; offer_not_request:"), v["is_offer_not_request"].cast("string"), F.lit("; cta_is_application:"), v["cta_is_application"].cast("string"), F.lit("; role_named:"), v["role_named"].cast("string"))
    out = judged.withColumns({"stage": stage, "gate_reason": text_of("verdict_reason")})
    return out.withColumns({"why_matched": F.when(F.col("stage") == "kept", F.concat_ws("; ", F.nullif(text_of("why_matched"), F.lit("")), decision)).otherwise(text_of("why_matched")), "source_type": verdict_source_type(text_of("source_type"), v["author_is_hirer"], rest[-1], text_of("poster_headline"))}).drop("_early", "verdict_reason")


def _screened(posts: DataFrame, history: DataFrame | None) -> DataFrame:
    rows = screen_posters(posts, poster_profiles(history)) if history is not None else posts.withColumns({"poster_blocked": F.lit(False), "profile_prior": F.lit("")})
    seeking = is_seeking(snippet(text_of("post_text")), text_of("post_text"), text_of("role"))
    return rows.withColumn("_early", F.when(seeking, "gate:candidate_seeking").when(F.col("poster_blocked"), "gate:blocked_profile").otherwise(""))


def gate_batches(posts: DataFrame, history: DataFrame | None = None, *, size: int = 5, order: str = "seq") -> DataFrame:
    """The records to judge, with ``company, batch, id``, as :func:`semantic_gate` will number them."""
    return batch_numbers(_screened(posts, history).where("_early = ''"), ["company"], [order], max(1, min(5, size))).drop("_early")


def history_rows(gated: DataFrame, as_of: str) -> DataFrame:
    """History rows of a gated batch."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return gated.select(
        F.lit(as_of).alias("timestamp"), *(text_of(c).alias(c) for c in ("company", "poster", "poster_employer", "post_url")), F.coalesce(F.nullif(text_of("intent"), F.lit("")), F.lit("other")).alias("intent"),
        text_of("link_class").alias("link_class"), link_domains(F.col("outbound_links")).alias("link_domains"), (F.col("stage") == "kept").alias("kept"), text_of("gate_reason").alias("gate_reason"), *(flag(c) for c in FLAGS),
    )


def relevance_gate(posts: DataFrame, verdicts: DataFrame, *, order: str = "seq") -> DataFrame:
    """Kept records by rank of their source type; ``verdicts`` is ``seq, keep, reason, source_type``; a missing one drops."""
    v = verdicts.select(order, F.col("keep").alias("_k"), F.col("reason").alias("_r"), F.col("source_type").alias("_t"))
    kept = posts.join(v, order).where(F.col("_k") & F.col("_t").isin(*KEPT_TYPES))
    followers = follower_count(F.concat_ws("\n", text_of("poster"), text_of("poster_headline"), text_of("post_text")))
    note = F.concat_ws(
        "; ",
        F.concat(F.lit("gate:keep,source:"), F.col("_t")),
        F.when(text_of("poster") != "", F.concat(F.lit("poster:"), text_of("poster"))),
        F.concat(F.lit("followers:"), format_followers(followers)),
    )
    note = F.concat(note, F.when(text_of("_r") != "", F.concat(F.lit(" ("), F.col("_r"), F.lit(")"))).otherwise(F.lit("")))
    out = kept.withColumns({"why_matched": F.concat_ws("; ", F.nullif(text_of("why_matched"), F.lit("")), note), "source_type": F.col("_t"), "gate_reason": text_of("_r"), "rank": kept_rank(F.col("_t"))})
    return out.drop("_k", "_r", "_t").orderBy("rank", order)
