"""Posts, listings and links from stored HTML (``page_id, url, html``), over the page's tree.

Markup is renamed often, so every field has rules that are tried in order; where no container
is known, the outermost elements that carry a post's mark are the cards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.dates import humanised, iso_age_days, relative_age
from siftwell.functions.entities import employer
from siftwell.functions.text import bound, clean_name, company_line, engagement, follower_count, is_more_label, is_verified, without_doubling
from siftwell.functions.urls import absolute_post_url, activity_id, clean_link, is_exact_post, is_search_page, job_link, unwrapped, urls_in_text
from siftwell.sources.tree import NODE, Rule, all_of, below, first_of_rule, inner_text, inside, is_a, meets, nearest_around, nodes_of, outermost, text_content


def _by(css_class: str, *tags: str, within: Rule | None = None, **attrs: str) -> Rule:
    return Rule(tags, css_class, tuple((k.replace("_", "-"), "=", v) for k, v in attrs.items()), within)


# The site's markup, in the order in which the rules are tried.
BODY_BOX = Rule(attrs=(("data-testid", "=", "expandable-text-box"),))
POST_CARDS = (
    Rule(attrs=(("role", "=", "listitem"), ("componentkey", "*", "FLAGSHIP_SEARCH"))),
    Rule(attrs=(("role", "=", "listitem"),), holds=BODY_BOX),
    Rule(attrs=(("role", "=", "listitem"), ("componentkey", "*", "SearchResult"))),
    Rule(attrs=(("role", "=", "listitem"), ("componentkey", "*", "Update"))),
    Rule(attrs=(("data-view-name", "=", "feed-full-update"),)),
    Rule(attrs=(("data-view-name", "=", "search-entity-result"),)),
    Rule(attrs=(("data-finite-scroll-hotkey-item", "", ""),)),
    _by("feed-shared-update-v2", "div"),
    _by("fie-impression-container", "div"),
    _by("reusable-search__result-container", "li"),
    Rule(("div",), attrs=(("data-urn", "*", "activity"),)),
    _by("update-components-actor", "div"),
)
URN_ATTRIBUTES = ("data-urn", "data-id", "data-entity-urn", "data-activity-urn", "data-chameleon-result-urn", "data-finite-scroll-hotkey-item")
CARD_KEYS = "FLAGSHIP_SEARCH|SearchResult|Update|feed-full-update|search-entity"
_HIDDEN = lambda css_class: Rule(("span",), attrs=(("aria-hidden", "=", "true"),), within=_by(css_class))
POSTER = (Rule(("span",), attrs=(("aria-hidden", "=", "true"),), within=_by("update-components-actor__title", "span")), _by("update-components-actor__title"), _by("update-components-actor__name"), _by("feed-shared-actor__name"))
AGE_LINE = (_HIDDEN("update-components-actor__sub-description"), _by("update-components-actor__sub-description"), _by("feed-shared-actor__sub-description"))
BODY = (BODY_BOX, _by("update-components-text"), _by("feed-shared-inline-show-more-text"), _by("update-components-update-v2__commentary"), _by("feed-shared-update-v2__description"))
ATTACHED = (_by("update-components-entity"), _by("update-components-job-card"), _by("update-components-article"), _by("feed-shared-mini-job"))
ATTACHED_TITLE = (_HIDDEN("update-components-entity__title"), _by("update-components-entity__title"), _by("update-components-article__title"))
ATTACHED_COMPANY = (_HIDDEN("update-components-entity__subtitle"), _by("update-components-entity__subtitle"), _by("update-components-article__subtitle"))
ATTACHED_PLACE = (_HIDDEN("update-components-entity__secondary-subtitle"), _by("update-components-entity__secondary-subtitle"), _by("update-components-entity__caption"))
AGE_ANCHORS = (_by("update-components-actor__sub-description"), _by("feed-shared-actor__sub-description"), _by("update-components-actor__meta"))
AUTHOR_ANCHORS = tuple(Rule(("a",), attrs=(("href", "", ""),), within=_by(c)) for c in ("update-components-actor__title", "feed-shared-actor__title")) + (
    Rule(("a",), "update-components-actor__meta-link", (("href", "", ""),)),
    Rule(("a",), attrs=(("href", "", ""),), within=_by("update-components-actor__image")),
)
NAMED_BY = (Rule(attrs=(("aria-label", "*i", "control menu for post by"),)), Rule(attrs=(("aria-label", "*i", "'s profile"),)), Rule(attrs=(("aria-label", "*i", "’s profile"),)))
JOB_CARDS = (_by("job-card-container", "div"), _by("scaffold-layout__list-item", "li"), _by("jobs-search-results__list-item", "li"), Rule(("div",), attrs=(("data-job-id", "", ""),)), Rule(("li",), attrs=(("data-occludable-job-id", "", ""),)))
JOB_LINK = Rule(("a",), attrs=(("href", "*", "/jobs/view/"),))
JOB_TITLE = (_by("job-card-container__link", "a"), _by("job-card-list__title--link", "a"), _by("job-card-list__title", "a"), _by("job-card-list__title"), _by("artdeco-entity-lockup__title"), JOB_LINK)
JOB_COMPANY = (_by("artdeco-entity-lockup__subtitle"), _by("job-card-container__primary-description"), _by("job-card-container__company-name"), Rule(("span",), within=Rule(attrs=(("class", "*", "subtitle"),))))
JOB_PLACE = (_by("", "li", within=_by("job-card-container__metadata-wrapper")), _by("", "span", within=_by("", "li", within=_by("job-card-container__metadata-wrapper", "ul"))), _by("", "li", within=_by("artdeco-entity-lockup__caption")), _by("artdeco-entity-lockup__caption"), _by("job-card-container__metadata-item"))
EMPTY_STATES = (Rule(attrs=(("data-testid", "=", "search-no-results"),)), _by("search-no-results"), _by("search-reusable-search-no-results"))
#: What a page without results says: searches for posts, listings.
EMPTY_MARKS = ("No results found", "No matching jobs found")
EMPTY_POSTS = ("No results found", "No matching results", "We didn’t find any results", "We didn't find any results")

ANCHOR = Rule(("a",), attrs=(("href", "", ""),))
_TIME = r"(?i)^\s*\d+\s*(s|m|h|d|w|mo|yr|sec|min|hour|day|week|month|year)"


def attribute(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'(?i)\b{name}="([^"]*)"', 1)


def says_no_results(html: Column, marks: Sequence[str] = EMPTY_MARKS) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.lower(html), F.lower(m)))


def is_empty_state(nodes: Column, marks: Sequence[str] = EMPTY_POSTS) -> Column:
    """Whether a page of posts says that nothing was found, by an element or in words."""
    return F.exists(nodes, lambda n: F.reduce(F.array(*(is_a(n, r, nodes) for r in EMPTY_STATES)), F.lit(False), lambda a, b: a | b)) | says_no_results(inner_text(nodes), marks)


def longest(texts: Column) -> Column:
    """The longest of an array of texts; the earlier one of equals."""
    return F.reduce(texts, F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a))


# ---------------------------------------------------------------------- cards


def _carries_post(n: Column, nodes: Column) -> Column:
    keys = F.concat_ws(" ", F.coalesce(n["attrs"]["componentkey"], F.lit("")), F.coalesce(n["attrs"]["data-view-name"], F.lit("")))
    urn = F.coalesce(n["attrs"][URN_ATTRIBUTES[0]], F.lit(""))
    marked = urn.rlike("(?i)activity|ugcPost|share")
    for name in URN_ATTRIBUTES[1:]:
        marked = marked | F.coalesce(n["attrs"][name], F.lit("")).rlike("(?i)activity|ugcPost|share")
    return ~n["tag"].startswith("#") & (keys.rlike(f"(?i){CARD_KEYS}") | marked | is_a(n, POST_CARDS[1], nodes))


def _exploded(pages: DataFrame, found: Column) -> DataFrame:
    rest = [c for c in pages.columns if c != "nodes"]
    out = pages.withColumn("_found", found).where(F.size("_found") > 0)
    out = out.select(*(F.col(f"`{c}`") for c in rest), "nodes", F.posexplode("_found").alias("card_index", "_card"))
    return out.select(*(F.col(f"`{c}`") for c in rest), "card_index", F.slice("nodes", F.col("_card.at") + 1, F.col("_card.end") - F.col("_card.at")).alias("card"))


def post_cards(pages: DataFrame, html: str = "html", rules: Sequence[Rule] = POST_CARDS) -> DataFrame:
    """One row a post card, ``card_index, card`` beside the page's columns: the container rule with the most matches counts, the earlier of equals.

    Where none matches, the outermost elements that carry a post's mark are the cards.
    """
    read = _with_nodes(pages, html)
    n = F.col("nodes")
    counts = F.array(*(F.struct(F.size(all_of(n, r)).alias("n"), F.lit(-k).alias("k")) for k, r in enumerate(rules)))
    chosen = read.withColumn("_best", F.array_max(counts))
    by_rule = F.coalesce(*(F.when(F.col("_best.k") == -k, all_of(n, r)) for k, r in enumerate(rules)))
    found = F.when(F.col("_best.n") > 0, by_rule).otherwise(outermost(F.filter(n, lambda x: _carries_post(x, n))))
    out = chosen.withColumn("_cards", found).drop("_best")
    return _exploded(out, F.col("_cards")).drop("_cards")


def job_cards(pages: DataFrame, html: str = "html", rules: Sequence[Rule] = JOB_CARDS) -> DataFrame:
    """One row a listing card: the first container rule with a match counts."""
    n = F.col("nodes")
    found = [all_of(n, r) for r in rules]
    return _exploded(_with_nodes(pages, html), F.coalesce(*(F.when(F.size(f) > 0, f) for f in found), F.array().cast(f"array<{NODE}>")))


def _with_nodes(pages: DataFrame, html: str) -> DataFrame:
    return pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in (html, "nodes")), nodes_of(F.col(html)).alias("nodes"))


# --------------------------------------------------------------------- fields


def _proper(card: Column) -> Column:
    """The nodes of a card without the card itself."""
    return F.slice(card, F.lit(2), F.greatest(F.size(card) - 1, F.lit(0)))


def _firsts(card: Column, rules: Sequence[Rule]) -> Column:
    """The first match of every rule, in the rules' order."""
    return F.array_compact(F.array(*(F.try_element_at(F.filter(_proper(card), meets(r, card)), F.lit(1)) for r in rules)))


def first_text(card: Column, rules: Sequence[Rule]) -> Column:
    """The text of the first rule whose element has any; empty without."""
    texts = F.transform(_firsts(card, rules), lambda n: without_doubling(inner_text(below(card, n))))
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1)), F.lit(""))


def body_text(card: Column, rules: Sequence[Rule] = BODY) -> Column:
    """The longest text of all rules, as rendered or as written."""
    texts = F.flatten(F.transform(_firsts(card, rules), lambda n: bound(below(card, n), lambda b: F.array(inner_text(b), text_content(b)))))
    return longest(F.transform(texts, without_doubling))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def header_text(card: Column) -> Column:
    """The texts before the first text of the body box, which hold name and headline; all texts where the box has none."""
    texts = F.filter(card, lambda n: n["tag"].isin("#text", "#data"))
    box = first_of_rule(card, BODY_BOX)
    start = F.coalesce(F.array_min(F.transform(F.filter(texts, lambda t: (t["at"] > box["at"]) & (t["at"] < box["end"])), lambda t: t["at"])), F.lit(2**31 - 1))
    before = bound(start, lambda s: F.filter(F.transform(F.filter(texts, lambda t: t["at"] < s), lambda t: _trimmed(t["text"])), lambda t: t != ""))
    return F.array_join(before, " ")


def stamp_text(card: Column) -> Column:
    """The text beside the visibility icon: all that its nearest span, paragraph or division holds."""
    icon = first_of_rule(card, Rule(("svg",), attrs=(("aria-label", "^i", "visibility"),)))
    host = bound(icon, lambda i: nearest_around(card, i, Rule(("span", "p", "div"))))
    return F.coalesce(F.when(host.isNotNull(), _trimmed(text_content(bound(host, lambda h: below(card, h))))), F.lit(""))


def poster_name(card: Column) -> Column:
    """The name in an accessibility label: the post's menu first, then profile links."""
    labels = F.transform(_firsts(card, NAMED_BY), lambda n: n["attrs"]["aria-label"])
    menu, profile = (lambda t: F.regexp_extract(t, r"(?i)Open control menu for post by\s+(.+)", 1)), (lambda t: F.regexp_extract(t, r"View\s+(.+?)[’']s profile", 1))
    names = F.filter(F.transform(labels, lambda t: F.when(menu(t) != "", menu(t)).otherwise(profile(t))), lambda t: t != "")
    return clean_name(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("")))


def all_hrefs(card: Column) -> Column:
    return F.filter(F.transform(all_of(card, ANCHOR), lambda a: F.trim(a["attrs"]["href"])), lambda h: h != "")


def actor_hrefs(card: Column, most: int = 6) -> Column:
    """Company links, then profile links, ``most`` of each, without queries."""
    of = lambda mark: F.slice(F.filter(all_hrefs(card), lambda h: h.contains(mark)), 1, most)
    return F.transform(F.concat(of("/company/"), of("/in/")), clean_link)


def post_anchor_hrefs(card: Column) -> Column:
    """Hrefs that may name the post: of the age line, around the time, of the author, post links, links that say an age.  Those in the body don't count."""
    box = first_of_rule(card, BODY_BOX)

    def chosen(body: Column) -> Column:
        anchors = F.filter(all_of(card, ANCHOR), lambda a: body.isNull() | ~((a["at"] > body["at"]) & (a["at"] < body["end"])))
        held = lambda r: lambda a: F.exists(card, lambda p: inside(a, p) & is_a(p, r, card))
        under = F.flatten(F.array(*(F.filter(anchors, held(r)) for r in AGE_ANCHORS)))
        time = first_of_rule(card, Rule(("time",)))
        around = F.array_compact(F.array(bound(time, lambda t: nearest_around(card, t, ANCHOR))))
        author = F.flatten(F.array(*(F.filter(anchors, meets(r, card)) for r in AUTHOR_ANCHORS)))
        low = lambda a: F.lower(a["attrs"]["href"])
        posts = F.filter(anchors, lambda a: ~low(a).contains("/search/results/") & (low(a).contains("/feed/update/") | low(a).contains("urn:li:activity") | (low(a).contains("/posts/") & low(a).contains("activity"))))
        profile = lambda a: low(a).contains("/in/") | F.regexp_replace(low(a), r"\?.*$", "").rlike(r"/company/[^/]+/?$")
        said = F.filter(anchors, lambda a: ~profile(a) & ~a["attrs"]["href"].contains("/search/results/") & inner_text(below(card, a)).rlike(_TIME))
        return F.array_distinct(F.filter(F.transform(F.concat(under, around, author, posts, said), lambda a: F.trim(a["attrs"]["href"])), lambda h: h != ""))

    return bound(box, chosen)


def _reckoned(df: DataFrame, rest: Sequence[Column], *columns: Column | str) -> DataFrame:
    """``rest`` and the columns, each reckoned once: filters and projections behind a generator don't repeat what it holds."""
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_one")).select(*rest, "_one.*")


def post_fields(cards: DataFrame, as_of: Column, card: str = "card") -> DataFrame:
    """The record of each post card, beside the other columns; cards without a poster and a text are dropped.

    A company is that of an attached listing, else of a ``Company:`` line, else the poster where a
    company page posted, else the employer in the headline; ``reasons`` says which.
    """
    c = F.col(card)
    rest = [F.col(f"`{n}`") for n in cards.columns if n != card]
    raw = _reckoned(cards, rest, card, poster_name(c).alias("_named"), first_text(c, POSTER).alias("_shown"), stamp_text(c).alias("_stamp"), first_text(c, AGE_LINE).alias("_line"), header_text(c).alias("poster_headline"), body_text(c).alias("_body"), inner_text(_proper(c)).alias("_all"))
    lines = F.filter(F.transform(F.split(F.col("_all"), r"\r\n|[\n\r]"), _trimmed), lambda t: t != "")
    name = F.coalesce(F.nullif(F.col("_named"), F.lit("")), F.nullif(clean_name(F.col("_shown")), F.lit("")), F.lit(""))
    age_line = F.coalesce(F.nullif(F.col("_stamp"), F.lit("")), F.nullif(F.col("_line"), F.lit("")), F.col("poster_headline"))
    lacks = (F.col("_name") == "") | (F.col("_body") == "")
    filled = raw.withColumns({"_name": name, "_age": age_line, "_lines": lines}).withColumns(
        {
            "poster": F.when((F.col("_name") == "") & (F.size("_lines") > 0), clean_name(F.col("_lines")[0])).otherwise(F.col("_name")),
            "post_text": F.when(F.col("_body") == "", F.array_join("_lines", " ")).otherwise(F.col("_body")),
            "_age": F.when(lacks & (F.col("_age") == ""), F.array_join(F.slice("_lines", 1, 3), " ")).otherwise(F.col("_age")),
        }
    )
    filled = filled.where((F.col("poster") != "") | (F.col("post_text") != ""))
    time = first_of_rule(c, Rule(("time",)))
    attached = F.transform(_firsts(c, ATTACHED), lambda n: bound(below(c, n), lambda e: F.struct(first_text(e, ATTACHED_TITLE).alias("role"), first_text(e, ATTACHED_COMPANY).alias("company"), first_text(e, ATTACHED_PLACE).alias("location"))))
    made = {
        "_attached": attached,
        "_hrefs": all_hrefs(c),
        "_actors": actor_hrefs(c),
        "_urls": F.filter(post_anchor_hrefs(c), lambda u: (activity_id(u) != "") & is_exact_post(absolute_post_url(u))),
        "days_old": F.coalesce(iso_age_days(time["attrs"]["datetime"], as_of), relative_age(bound(time, lambda t: inner_text(below(c, t)))), relative_age(F.col("_age"))),
        "engagement": engagement(F.col("_all")),
    }
    links = _reckoned(filled, rest, "_age", "poster", "post_text", "poster_headline", *(made[n].alias(n) for n in made))
    own = F.coalesce(F.try_element_at(F.filter("_attached", lambda a: (a["role"] != "") | (a["company"] != "")), F.lit(1)), F.try_element_at("_attached", F.lit(-1)))
    url = F.coalesce(absolute_post_url(F.try_element_at("_urls", F.lit(1))), F.lit(""))
    told = links.withColumns({"_own": own, "_line_company": company_line(F.col("post_text")), "_employer": employer(F.col("poster_headline"))})
    source = (
        F.when(F.coalesce(F.col("_own.company"), F.lit("")) != "", "job-card")
        .when(F.col("_line_company") != "", "post-body")
        .when(F.exists("_actors", lambda h: h.contains("/company/")), "company-page")
        .when(F.col("_employer") != "", "poster-headline")
        .otherwise("")
    )
    told = told.withColumn("_source", source)
    company = F.when(F.col("_source") == "job-card", F.col("_own.company")).when(F.col("_source") == "post-body", F.col("_line_company")).when(F.col("_source") == "company-page", F.col("poster")).otherwise(F.col("_employer"))
    said = F.concat_ws("\n", "poster_headline", "poster")
    outbound = F.array_distinct(F.concat(F.transform("_hrefs", lambda h: clean_link(unwrapped(h))), urls_in_text(F.col("post_text"))))
    return told.select(
        *rest,
        "poster",
        company.alias("company"),
        F.coalesce("_own.role", F.lit("")).alias("role"),
        F.coalesce("_own.location", F.lit("")).alias("location"),
        F.when(F.col("days_old").isNotNull(), humanised(F.col("days_old"))).otherwise(F.coalesce(F.nullif(F.substring("_age", 1, 40), F.lit("")), F.lit("unknown"))).alias("post_date"),
        job_link(F.col("_hrefs")).alias("job_link"),
        F.when(is_search_page(url), F.lit("")).otherwise(url).alias("post_url"),
        "post_text",
        F.coalesce(F.concat(F.lit("urn:li:activity:"), F.nullif(activity_id(F.try_element_at("_urls", F.lit(1))), F.lit(""))), F.lit("")).alias("activity_urn"),
        outbound.alias("outbound_links"),
        "poster_headline",
        follower_count(said).alias("follower_count"),
        is_verified(said).alias("poster_verified"),
        "engagement",
        "days_old",
        F.coalesce(F.try_element_at("_actors", F.lit(1)), F.lit("")).alias("actor_url"),
        F.array_compact(F.array(F.when(F.col("_source") != "", F.concat(F.lit("company:"), "_source")), F.when(url != "", F.lit("post_url:exact")))).alias("reasons"),
    )


def job_fields(cards: DataFrame, card: str = "card") -> DataFrame:
    """Fields of a listing card; cards without a title and a link are dropped, a missing title or company is said to be unknown."""
    c = F.col(card)
    link = clean_link(F.coalesce(F.try_element_at(F.filter(all_hrefs(c), lambda h: h.contains("/jobs/view/")), F.lit(1)), F.lit("")))
    out = cards.select(*(F.col(f"`{n}`") for n in cards.columns if n != card), first_text(c, JOB_TITLE).alias("title"), first_text(c, JOB_COMPANY).alias("company"), first_text(c, JOB_PLACE).alias("location"), link.alias("link"))
    named = lambda name: F.when(F.col(name) == "", f"(unknown {name})").otherwise(F.col(name))
    return out.where((F.col("title") != "") | (F.col("link") != "")).withColumns({"title": named("title"), "company": named("company")})


def more_buttons(nodes: Column) -> Column:
    """Labels of buttons that would show more of a text."""
    return F.filter(F.transform(all_of(nodes, Rule(("button",))), lambda b: inner_text(below(nodes, b))), is_more_label)
