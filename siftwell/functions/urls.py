"""URLs: extraction, hosts, link classes, permalinks.  All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.entities import fold_company
from siftwell.functions.text import no_strings

SITE = "https://www.linkedin.com"

#: Hosts of application systems.
ATS_HOSTS = (
    "greenhouse.io", "boards.greenhouse.io", "job-boards.greenhouse.io", "lever.co", "jobs.lever.co", "ashbyhq.com",
    "jobs.ashbyhq.com", "myworkdayjobs.com", "workday.com", "smartrecruiters.com", "jobs.smartrecruiters.com",
    "jobvite.com", "jobs.jobvite.com", "icims.com", "wellfound.com", "angel.co",
)
#: Hosts of chats and link hubs, never a place to apply.
JUNK_HOSTS = (
    "chat.whatsapp.com", "wa.me", "api.whatsapp.com", "whatsapp.com", "t.me", "telegram.me", "telegram.org",
    "discord.gg", "discord.com", "jobscans.in", "linktr.ee", "bio.link",
)
#: Hosts by category.
CHAT_HOSTS = ("chat.whatsapp.com", "wa.me", "api.whatsapp.com", "whatsapp.com", "t.me", "telegram.me", "telegram.org", "discord.gg", "discord.com")
HUB_HOSTS = ("linktr.ee", "bio.link", "jobscans.in")
PORTFOLIO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "behance.net", "dribbble.com")
REDIRECT_HOSTS = ("lnkd.in", "bit.ly", "t.co", "tinyurl.com", "ow.ly", "buff.ly")

_CAREERS_PATH = r"(?i)/(?:careers?|jobs?|job-openings?|openings?|internships?|join-us|joinus)(?:/|$)"
_JOBS_PATH = r"(?i)/jobs/(?:view|collections)/"
_GROUP_PATH = r"(?i)/groups?/"


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty without one."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    return F.regexp_replace(F.lower(found), r"^\[|\]$|\.+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def host_in(h: Column, suffixes: Sequence[str]) -> Column:
    """Whether a host is one of the suffixes or below one."""
    alternatives = "|".join(s.replace(".", r"\.") for s in suffixes)
    return h.rlike(rf"^(?:.*\.)?(?:{alternatives})$")


def normalised_href(href: Column) -> Column:
    """An absolute URL, or the empty string for anchors and scripts; what follows white space and closing marks go."""
    own = F.trim(href)
    full = (
        F.when(own.startswith("//"), F.concat(F.lit("https:"), own))
        .when(own.startswith("/"), F.concat(F.lit(SITE), own))
        .when(F.lower(own).startswith("www."), F.concat(F.lit("https://"), own))
        .otherwise(own)
    )
    return F.when(own.isNull() | (own == "") | own.startswith("#") | F.lower(own).startswith("javascript:"), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(full, r"\s.*$", ""), r"[).,;]+$", ""))


def url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))


def first_of_each(urls: Column) -> Column:
    """URLs without those that repeat an earlier one but for case and trailing slashes."""
    keys = F.transform(urls, url_key)
    return F.filter(urls, lambda u, i: F.array_position(keys, url_key(u)) == i + 1)


def urls_in_text(text: Column) -> Column:
    """Bare URLs, then shortener links, first of each."""
    bare = F.regexp_extract_all(text, F.lit(r"(?i)(?:https?://|www\.)[^\s<>\x22')\]]+"), F.lit(0))
    short = F.regexp_extract_all(text, F.lit(r"(?i)(?:https?://)?(?:www\.)?lnkd\.in/[A-Za-z0-9_-]+"), F.lit(0))
    return F.when(text.rlike(r"(?i)https?://|www\.|lnkd\.in/"), first_of_each(F.filter(F.transform(F.concat(bare, short), normalised_href), lambda u: u != ""))).otherwise(no_strings())


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)href=[\x22']([^\x22']+)[\x22']"), F.lit(1))


def is_shortener(url: Column) -> Column:
    return host_in(host(url), ("lnkd.in",))


def is_internal(url: Column) -> Column:
    return host_in(host(url), ("linkedin.com",))


def is_redirect(url: Column) -> Column:
    return host(url).isin(*REDIRECT_HOSTS) | host(url).endswith(".lnkd.in")


def is_outbound(url: Column) -> Column:
    """Links that may lead to an application: other sites, shorteners, and internal jobs or groups."""
    inside = path(url).rlike(_JOBS_PATH) | path(url).rlike(_GROUP_PATH)
    return (url != "") & (is_shortener(url) | F.when(is_internal(url), inside).otherwise(url.rlike(r"(?i)^https?:")))


def company_host(h: Column, company: Column) -> Column:
    """Whether a word of three letters or more of the folded company name is part of the host."""
    words = F.filter(F.split(fold_company(company), " "), lambda w: F.length(w) >= 3)
    slug = F.regexp_replace(F.lower(company), "[^a-z0-9]+", "")
    words = F.when(F.size(words) > 0, words).when(F.length(slug) >= 3, F.array(slug)).otherwise(no_strings())
    return (h != "") & (company != "") & F.exists(words, lambda w: F.contains(F.replace(h, F.lit("-"), F.lit("")), w))


def link_kind(url: Column, company: Column) -> Column:
    """``careers``, ``junk`` or ``unknown`` for a resolved URL; the first rule that holds decides."""
    h, p = host(url), path(url)
    inside, careers = host_in(h, ("linkedin.com",)), p.rlike(_CAREERS_PATH)
    blob = F.concat(h, p)
    return (
        F.when(url == "", "unknown")
        .when(host_in(h, JUNK_HOSTS) | (inside & p.rlike(_GROUP_PATH)), "junk")
        .when(blob.rlike(r"(?i)invite|join.?group|community") & ~careers & (inside | F.lower(blob).contains("community")), "junk")
        .when((inside & p.rlike(_JOBS_PATH)) | host_in(h, ATS_HOSTS) | careers | company_host(h, company), "careers")
        .otherwise("unknown")
    )


def outbound_set(urls: Column) -> Column:
    """The distinct outbound URLs of a list, normalised."""
    return first_of_each(F.filter(F.transform(urls, normalised_href), is_outbound))


def set_kind(kinds: Column) -> Column:
    """Careers beats junk beats unknown; no links are ``none``."""
    return F.when(F.size(kinds) == 0, "none").when(F.array_contains(kinds, "careers"), "careers").when(F.array_contains(kinds, "junk"), "junk").otherwise("unknown")


def classify_links(urls: Column, company: Column, resolved: Column | None = None) -> Column:
    """``struct<kind, urls, resolved, reasons>`` of a record's links.

    ``resolved`` maps shortener URLs to their targets (see :func:`resolve_links`); a
    URL without an entry is its own target.
    """
    own = outbound_set(urls)
    target = (lambda u: F.coalesce(F.try_element_at(resolved, u), u)) if resolved is not None else (lambda u: u)
    kinds = F.transform(own, lambda u: link_kind(target(u), company))
    label = lambda u: F.concat(F.lit("link:"), link_kind(target(u), company), F.lit(":"), F.coalesce(F.nullif(host(target(u)), F.lit("")), host(u)))
    return F.struct(set_kind(kinds).alias("kind"), own.alias("urls"), F.map_from_arrays(own, F.transform(own, target)).alias("resolved"), F.transform(own, label).alias("reasons"))


def link_category(url: Column, company: Column, set_is: Column) -> Column:
    h = host(url)
    return (
        F.when(host_in(h, CHAT_HOSTS), "social_or_chat")
        .when(host_in(h, HUB_HOSTS), "link_hub_or_junk")
        .when(host_in(h, PORTFOLIO_HOSTS), "poster_portfolio_or_github")
        .when(company_host(h, company), "company_domain")
        .when(link_kind(url, company) == "careers", "ats_or_careers")
        .when(set_is == "junk", "link_hub_or_junk")
        .otherwise("unknown")
    )


def link_categories(verdict: Column, company: Column) -> Column:
    """Distinct categories of the targets in a :func:`classify_links` verdict, in order."""
    return F.array_distinct(F.transform(verdict["urls"], lambda u: link_category(F.coalesce(F.try_element_at(verdict["resolved"], u), u), company, verdict["kind"])))


def resolve_links(rows: DataFrame, key: str, urls: str, redirects: DataFrame) -> DataFrame:
    """Add ``resolved map<string,string>`` from a table ``redirects(url, final_url)``; only redirecting hosts are looked up."""
    links = rows.select(key, F.explode(outbound_set(F.col(urls))).alias("url")).where(is_redirect(F.col("url"))).distinct()
    one = redirects.groupBy("url").agg(F.min("final_url").alias("final_url"))
    found = links.join(one, "url").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("url", "final_url"))).alias("resolved"))
    return rows.join(found, key, "left").withColumn("resolved", F.coalesce("resolved", F.expr("cast(map() as map<string,string>)")))


def link_domains(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, host), lambda h: h != ""))


def clean_link(href: Column) -> Column:
    """Absolute, without query and fragment."""
    return without_query(F.when(href.startswith("/"), F.concat(F.lit(SITE), href)).otherwise(href))


def job_id(link: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(link, r"/jobs/view/(\d+)", 1), F.lit("")), link)


def unwrapped(href: Column) -> Column:
    """The target of a ``/safety/go/?url=`` wrapper."""
    target = F.regexp_extract(F.replace(href, F.lit("&amp;"), F.lit("&")), r"[?&]url=([^&#]*)", 1)
    return F.when(href.contains("/safety/go/") & (target != ""), F.coalesce(F.try_url_decode(target), target)).otherwise(href)


def job_link(links: Column) -> Column:
    """The link to a posting: job views first, then other job pages, shorteners and wrapped links."""
    having = lambda mark: F.filter(links, lambda u: u.contains(mark))
    choices = [having(m) for m in ("/jobs/view/", "/jobs/", "lnkd.in", "/safety/go/")]
    first = F.array_compact(F.array(*(F.try_element_at(c, F.lit(1)) for c in choices)))
    real = F.filter(F.transform(first, unwrapped), lambda u: ~F.regexp_replace(u, "/+$", "").endswith("linkedin.com/jobs"))
    return clean_link(F.coalesce(F.try_element_at(real, F.lit(1)), F.lit("")))


# ----------------------------------------------------------------- permalinks

_URN = r"(?i)urn(?::|%3A)li(?::|%3A)(share|activity|ugcPost)(?::|%3A)(\d+)"
_SLUG = r"(?i)(activity|ugcPost|share)[_-](\d+)"


def plausible_id(digits: Column) -> Column:
    """Real post ids have 19 digits and don't start with 1500."""
    return F.trim(digits).rlike(r"^(?!1500)\d{19}$")


def _decoded(url: Column) -> Column:
    first = F.regexp_replace(F.replace(F.trim(url), F.lit("&amp;"), F.lit("&")), r"\s.*$", "")
    return F.coalesce(F.try_url_decode(F.replace(first, F.lit("+"), F.lit("%2B"))), first)


def _kind(raw: Column) -> Column:
    return F.when(F.lower(raw) == "ugcpost", "ugcPost").otherwise(F.lower(raw))


def update_url(kind: Column, digits: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/feed/update/urn:li:"), kind, F.lit(":"), digits, F.lit("/"))


def is_search_page(url: Column) -> Column:
    return path(url).rlike(r"/search/results/content(?:/|$)")


def activity_id(href: Column) -> Column:
    """The activity id in a permalink, empty unless plausible."""
    found = F.regexp_extract(_decoded(href), r"(?i)activity(?::|_|-)(\d+)", 1)
    return F.when(plausible_id(found), found).otherwise(F.lit(""))


def activity_permalink(digits: Column) -> Column:
    own = F.regexp_extract(digits, r"(\d+)", 1)
    return F.when(plausible_id(own), update_url(F.lit("activity"), own)).otherwise(F.lit(""))


def embedded_permalink(blob: Column) -> Column:
    """The permalink in an embed frame's source or text: the first URN, where its id is plausible."""
    own = F.replace(blob, F.lit("&amp;"), F.lit("&"))
    found = F.coalesce(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), own)
    kind, digits = (F.regexp_extract(found, r"(?i)urn:li:(share|activity|ugcPost):(\d+)", n) for n in (1, 2))
    return F.when(plausible_id(digits), update_url(_kind(kind), digits)).otherwise(F.lit(""))


def activity_id_in_html(html: Column) -> Column:
    """The first activity id in an anchor of a card's markup; other attributes don't count."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=[\x22']([^\x22']+)[\x22']"), F.lit(1)), activity_id)
    return F.coalesce(F.try_element_at(F.filter(found, lambda i: i != ""), F.lit(1)), F.lit(""))


def canonical_permalink(url: Column) -> Column:
    """``/feed/update/urn:li:<kind>:<id>/`` for whatever names a post: a URN, an encoded URN or a slug; else empty."""
    own = _decoded(url)
    kind, digits = F.regexp_extract(own, _URN, 1), F.regexp_extract(own, _URN, 2)
    slug_kind, slug_digits = F.regexp_extract(own, _SLUG, 1), F.regexp_extract(own, _SLUG, 2)
    return (
        F.when((own == "") | is_search_page(own), F.lit(""))
        .when(plausible_id(digits), update_url(_kind(kind), digits))
        .when(plausible_id(slug_digits), update_url(_kind(slug_kind), slug_digits))
        .otherwise(F.lit(""))
    )


def absolute_post_url(href: Column) -> Column:
    """A post's href made absolute, without query, ended by a slash; empty for other sites."""
    raw = _decoded(href)
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(SITE), raw)).otherwise(raw)
    clean = F.concat(F.lit(SITE), F.regexp_replace(path(full), "/*$", ""), F.lit("/"))
    return F.when(host(full).contains("linkedin.com"), clean).otherwise(F.lit(""))


def is_exact_post(url: Column) -> Column:
    """Whether a URL names one post with a plausible id."""
    own, p = _decoded(url), F.regexp_replace(path(_decoded(url)), "/+$", "")
    digits = F.regexp_extract(own, _URN, 2)
    slug = F.regexp_extract(p, r"(?i)/posts/.*?(?:activity|ugcPost|share)[_-](\d+)", 1)
    return (own != "") & ~is_search_page(own) & F.when(digits != "", plausible_id(digits)).otherwise(plausible_id(slug))


def is_feed_page(url: Column) -> Column:
    """Profile and company pages and their post feeds: a fallback, not a post."""
    return F.regexp_replace(path(url), "/+$", "").rlike(r"/(?:company|in)/[^/]+(?:/(?:posts|recent-activity(?:/[^/]+)?))?$")


def permalink_of(links: Column) -> Column:
    """The first href of a card that gives a valid activity permalink."""
    good = F.filter(links, lambda u: (activity_id(u) != "") & is_exact_post(u))
    return F.coalesce(F.try_element_at(F.transform(good, absolute_post_url), F.lit(1)), F.lit(""))


def clean_permalink(url: Column) -> Column:
    canonical = canonical_permalink(url)
    return F.when(is_search_page(F.trim(url)), F.lit("")).when(canonical != "", canonical).when(is_exact_post(url), clean_link(F.trim(url))).otherwise(F.lit(""))


def permalink_cache_key(urn: Column, url: Column, poster: Column, text: Column) -> Column:
    return F.lower(F.when(urn != "", urn).when(is_exact_post(url), F.regexp_replace(url, "/+$", "")).otherwise(F.concat(poster, F.lit("|"), F.substring(text, 1, 120))))


def job_search_url(query: Column, location: Column, start: int = 0, remote_only: bool = False, within_days: int | None = None) -> Column:
    """A listing query as a URL; the remote and age filters are part of it."""
    more = "".join([f"&start={start}" if start else "", "&f_WT=2" if remote_only else "", f"&f_TPR=r{within_days * 86_400}" if within_days else ""])
    return F.concat(F.lit(f"{SITE}/jobs/search/?keywords="), F.url_encode(query), F.when(location != "", F.concat(F.lit("&location="), F.url_encode(location))).otherwise(F.lit("")), F.lit(more))


def content_search_url(query: Column, location: Column, bucket: Column) -> Column:
    """A content query as a URL: the location is one more keyword, the age window a coarse bucket."""
    words = F.trim(F.concat_ws(" ", query, F.nullif(location, F.lit(""))))
    return F.concat(F.lit(f"{SITE}/search/results/content/?keywords="), F.url_encode(words), F.when(bucket.isNotNull(), F.concat(F.lit("&datePosted="), F.url_encode(F.concat(F.lit('"'), bucket, F.lit('"'))))).otherwise(F.lit("")), F.lit("&sortBy=%22date_posted%22"))
