"""Who is behind a record: roundups, spam signals, source types, first-party decisions.

Everything is a Column expression or a chain of columns; the only pattern that
depends on the row is built from the row's company name inside the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.entities import fold_company, mentions, same_company
from siftwell.functions.text import bound, company_line, follower_count, format_followers, has_term, is_verified, no_strings, quoted, text_of, without_hashtags
from siftwell.functions.urls import classify_links, is_shortener, link_categories

#: Source types that may be kept, and followers from which a poster is credible.
KEPT_TYPES = ("company", "employee", "recruiter", "creator")
CREDIBLE_FOLLOWERS = 10_000

#: Patterns that tell sources apart.
DM_REFERRAL = r"(?iUs)\b(?:dm|message|ping)\s+me\b.{0,80}\b(?:referral|refer)\b|\b(?:referral|refer)\b.{0,80}\b(?:dm|message)\s+me\b"
GROUP_INVITE = r"(?iU)\bjoin\s+(?:my|our)\s+(?:whatsapp|telegram|discord|community)\b|\bwhatsapp\s+group\b|\btelegram\s+(?:group|channel)\b"
GENERIC_DM = r"(?iUs)\bi['’]m hiring\b.{0,80}\bdm me\b|\bdm me\b.{0,80}\b(?:hiring|intern)"
#: The rest of a listed line behind its blanks: a number, bullet or keycap, then an opening's word within 90 code points.
_LISTED = r"(?:\d++[\).]|[-•]|[1-9]️⃣)\s*+(?=[^\n]{0,90}?(?:intern|opening|hiring|role))[^\n]*+"
#: Two listed lines on end, blank lines aside.  Nothing is given back once it is taken, so the cost is linear in the text.
ROLE_DUMP = rf"(?iU)(?:^|\n)[^\S\n]*+{_LISTED}\n\s*+{_LISTED}"
FARMER = r"(?iU)\b(?:referral farmer|job aggregator|daily job alert|jobscan)\b|\bfollow\s+for\s+(?:more\s+)?(?:jobs|openings)\b"
ROUNDUP = r"(?iU)\b(?:mass hiring|multiple hiring alerts?|latest tech openings?|hiring alerts?|top (?:tech )?openings?|job roundup)\b"
NAMED_HIRING = r"(?U)\b([A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*){0,2})\s+(?:is\s+|now\s+)?hiring\b"
NAMED_FIELD = r"(?iU)(?:^|\n)[^\S\n]*+company\s*:\s*([^\n|#]+)"
AGGREGATOR = (
    r"(?iU)edutech|edu[\s\-]?tech|job.?alert|jobs?\s+daily|hiring\s+alert|job\s*board|career\s*(?:radar|digest|update)|frontlines|jobright"
    r"|jobscan|daily\s+jobs|jobs\s+in\s+the|vacancy\s*alert|fresher\s*jobs|cybersecurity jobs|hiring opportunities"
)
COMMUNITY = r"(?iU)\bjoin my community\b|\bwhatsapp (?:group|community)\b"
BAIT = r"(?iU)most juniors ask|internship kah[aā] se|your internship search shouldn|internship calendar|save this post|found something you should save"
EXPERIENCED = r"(?iU)\b(?:[2-9]|\d{2})\+?\s*years?\s+(?:of\s+)?experience\b"
SEVERAL_COMPANIES = (
    r"(?iU)\b(?:ibm|google|amazon|meta|apple|infosys|tcs|wipro|oracle|salesforce)\b.{0,50}\b(?:and|&|\/)\b.{0,50}\b(?:microsoft|google|amazon|ibm)\b"
    r"|\b(?:ibm|google|amazon).{0,30}(?:microsoft|are hiring)"
)
STYLISED = r"[\x{1D400}-\x{1D7FF}]{12,}"
RECRUITER = r"(?iU)\b(?:recruiter|talent acquisition|\bta\b|hiring manager|sourcer|university recruiter|campus recruiter)\b"
URL_IN_TEXT = r"(?iU)https?://|\blnkd\.in/|\bwww\."
APPLY_PATH = (
    r"(?iUs)\bapply\s+(?:now|here|at|via|on)?\b|\bapplications?\s+open\b|\bcareers?(?:\s+page)?\b"
    r"|\b(?:dm|message|ping|comment)\b.{0,60}\b(?:referral|refer|cv|resume|apply|link)\b|\b(?:referral|refer)\b.{0,60}\b(?:dm|comment|message|ping)\b"
    r"|\blink\s+in\s+(?:the\s+)?(?:bio|comments?)\b|\bcomment\s+(?:for|to)\s+(?:a\s+)?referral\b"
)
SPECIFIC_ROLE = (
    r"(?iUs)\b(?:software(?:\s+engineering)?|swe|sde|ai|a\.i\.|ml|machine learning|data(?:\s+scien(?:ce|tist))?|backend|frontend|full[\s-]?stack"
    r"|research|security|cybersecurity|devops|engineering|developer|analyst|scientist|product)\b.{0,48}\b(?:intern|internship|interns)\b"
    r"|\b(?:intern|internship|interns)\b.{0,48}\b(?:software|swe|sde|ai|ml|machine learning|data|backend|frontend|full[\s-]?stack|research|security"
    r"|engineering|developer|analyst)\b|\brole:\s*\S[^\n]{2,80}|\b(?:intern|internship)\s+(?:opening|position|role)s?\b"
)

#: What a text has to hold, in lower case, wherever one of these patterns matches; texts that hold none of it are not searched.
_NEEDED = {
    DM_REFERRAL: ("refer",),
    GROUP_INVITE: ("whatsapp", "telegram", "discord", "community"),
    GENERIC_DM: ("dm me",),
    ROLE_DUMP: ("intern", "opening", "hiring", "role"),
    FARMER: ("referral farmer", "job aggregator", "daily job alert", "jobscan", "follow"),
    ROUNDUP: ("mass hiring", "hiring alert", "opening", "job roundup"),
    NAMED_HIRING: ("hiring",),
    NAMED_FIELD: ("company",),
}


def _low(body: Column) -> Column:
    """Lower case as a pattern that ignores case sees it, which takes three more letters for ASCII ones."""
    odd = body.contains("ſ") | body.contains("ı") | body.contains("İ")
    return F.lower(F.when(odd, F.translate(body, "ſıİ", "sii")).otherwise(body))


def _may(low: Column, pattern: str) -> Column:
    first, *rest = (low.contains(w) for w in _NEEDED[pattern])
    for other in rest:
        first = first | other
    return first


def _found(body: Column, low: Column, pattern: str) -> Column:
    return _may(low, pattern) & body.rlike(pattern)


def _read(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(body, low)``: the text without hashtags, and in lower case, each reckoned once a row."""
    return bound(without_hashtags(text), lambda body: bound(_low(body), lambda low: use(body, low)))


def _when_all(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in pairs)))


def roundup_signals(text: Column) -> Column:
    """Signs of a post that lists several openings: its language, a list of roles, several companies."""
    return _read(text, _roundup_signals)


def _roundup_signals(body: Column, low: Column) -> Column:
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    named = F.concat(*(F.when(_may(low, p), F.regexp_extract_all(body, F.lit(p), F.lit(1))).otherwise(no_strings()) for p in (NAMED_HIRING, NAMED_FIELD)))
    several = F.size(F.array_distinct(F.transform(named, name))) >= 2
    return _when_all((_found(body, low, ROUNDUP), "roundup-language"), (_found(body, low, ROLE_DUMP), "multi-role-dump"), (several, "multi-company-openings"))


def is_roundup(text: Column) -> Column:
    return F.arrays_overlap(roundup_signals(text), F.array(F.lit("multi-role-dump"), F.lit("multi-company-openings")))


def spam_signals(text: Column, poster: Column, company: Column, kind: Column) -> Column:
    """Signals in a fixed order; ``kind`` is the class of the record's links."""

    def signals(body: Column, low: Column) -> Column:
        direct = _found(body, low, GENERIC_DM) & (kind != "careers")
        other = (poster != "") & (company != "") & (F.lower(F.trim(poster)) != F.lower(F.trim(company)))
        return F.concat(
            _when_all((_found(body, low, DM_REFERRAL), "dm-for-referral"), ((kind == "junk") | _found(body, low, GROUP_INVITE), "group-invite"), (direct, "generic-dm-hire")),
            _roundup_signals(body, low),
            _when_all((_found(body, low, FARMER), "aggregator-copy"), (direct & other, "not-hiring-company")),
        )

    return _read(text, signals)


def heuristic_reject(text: Column, poster: Column, company: Column, kind: Column) -> Column:
    """Why a record is dropped outright; empty if it isn't."""

    def why(signals: Column) -> Column:
        hard = F.filter(signals, lambda s: s.isin("group-invite", "multi-role-dump", "aggregator-copy"))
        return (
            F.when(kind == "junk", F.concat(F.lit("junk-link:"), F.when(F.size(signals) > 0, F.array_join(signals, ",")).otherwise(F.lit("invite-or-chat"))))
            .when(F.size(hard) > 0, F.concat(F.lit("source-spam:"), F.array_join(hard, ",")))
            .otherwise(F.lit(""))
        )

    return bound(spam_signals(text, poster, company, kind), why)


def engagement_signal(counts: Column, links: Column) -> Column:
    """No engagement at all beside two or more shortener links."""
    silent = (F.size(counts) > 0) & F.forall(F.map_values(counts), lambda v: v == 0)
    return F.when(silent & (F.size(F.filter(links, is_shortener)) >= 2), "zero_engagement_multiple_shorteners").otherwise(F.lit(""))


def is_target(poster: Column, target: Column) -> Column:
    return same_company(fold_company(poster), fold_company(target))


def has_specific_role(body: Column) -> Column:
    return body.rlike(SPECIFIC_ROLE)


def has_apply_path(body: Column, links: Column) -> Column:
    return F.exists(links, lambda u: F.trim(u) != "") | body.rlike(URL_IN_TEXT) | body.rlike(APPLY_PATH)


def _as_hirer(target: Column) -> Column:
    """The pattern of phrases that make ``target`` the hiring side."""
    name = F.concat(F.lit(r"(?<!\w)"), quoted(target), F.lit(r"(?!\w)"))
    return F.concat(
        F.lit("(?iuUs)(?:"), name, F.lit(r"\s+is\s+hiring|(?:intern(?:ship)?|role|opening|position).{0,40}(?:at|with|for)\s+"), name,
        F.lit(r"|join\s+"), name, F.lit("|"), name, F.lit(".{0,50}(?:intern(?:ship)?))"),
    )


def hiring_side(target: Column, poster: Column, headline: Column, body: Column) -> Column:
    """``struct<ok, why>``: whether the target is the organisation that hires; the first rule that applies decides."""
    listed = company_line(body)
    say = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("why"))
    return (
        F.when(target == "", say(False, F.lit("no target company")))
        .when((listed != "") & (is_target(listed, target) | mentions(listed, target)), say(True, F.concat(F.lit("Company:"), listed)))
        .when(listed != "", say(False, F.concat(F.lit("hiring company in post is '"), listed, F.lit("', not '"), target, F.lit("'"))))
        .when(is_target(poster, target), say(True, F.lit("poster is the target company page")))
        .when(has_term(body, target) & F.rlike(body, _as_hirer(target)), say(True, F.lit("target named as hiring org")))
        .when(mentions(headline, target), say(True, F.lit("headline employer is the target")))
        .when(mentions(body, target), say(False, F.lit("target mentioned but not as the hiring org")))
        .otherwise(say(False, F.lit("target not named as the hiring org")))
    )


def source_type(target: Column, poster: Column, headline: Column, body: Column) -> Column:
    hay = F.concat_ws("\n", poster, headline, body)
    return (
        F.when(poster.rlike(AGGREGATOR) | headline.rlike(AGGREGATOR), "aggregator")
        .when(hay.rlike(COMMUNITY) & ~has_specific_role(body), "spam")
        .when(is_target(poster, target), "company")
        .when(mentions(headline, target) & headline.rlike(RECRUITER), "recruiter")
        .when(mentions(headline, target), "employee")
        .when(F.substring(body, 1, 400).rlike(AGGREGATOR) | body.rlike(SEVERAL_COMPANIES) | body.rlike(ROLE_DUMP), "aggregator")
        .when(poster != "", "creator")
        .otherwise("spam")
    )


def first_party(df: DataFrame, target: Column, poster: Column, headline: Column, text: Column, links: Column, *, strict: bool = True) -> DataFrame:
    """Add ``source_type, keep, keep_reason``: a concrete opening (role, hiring side, way to apply) or not.

    A credible poster rescues a record that lacks one of the three.  With ``strict``
    off, aggregators and other types pass, with a reason that says so.
    """
    t, p, h, body = F.trim(text_of(target)), F.trim(text_of(poster)), F.trim(text_of(headline)), text_of(text)
    hay = F.concat_ws("\n", p, h, body)
    step = df.withColumns({"_t": source_type(t, p, h, body), "_f": follower_count(hay), "_side": hiring_side(t, p, h, body), "_role": has_specific_role(body), "_apply": has_apply_path(body, links)})
    kind, ok, role, apply_ = F.col("_t"), F.col("_side.ok"), F.col("_role"), F.col("_apply")
    kept_type = kind.isin(*KEPT_TYPES)
    credible = is_verified(hay) | F.coalesce(F.col("_f") >= CREDIBLE_FOLLOWERS, F.lit(False))
    bait = body.rlike(BAIT) | body.rlike(STYLISED)
    account = p.rlike(AGGREGATOR) | h.rlike(AGGREGATOR)
    rescued = credible & (role.cast("int") + apply_.cast("int") + 1 >= 2) & kept_type
    credit = F.when(F.col("_f").isNotNull(), F.concat(format_followers(F.col("_f")), F.lit(" followers"))).otherwise(F.lit("verified"))
    missing = F.concat_ws(" + ", F.when(~role, F.lit("specific role")), F.when(~apply_, F.lit("apply path")))
    say = lambda type_, keep, why: F.struct(type_.alias("type"), F.lit(keep).alias("keep"), why.alias("why"))
    lone = F.when(account, F.concat(F.lit("aggregator account ("), F.coalesce(F.nullif(p, F.lit("")), F.lit("unknown")), F.lit(")"))).otherwise(F.lit("job-aggregator / multi-company roundup"))
    decision = (
        F.when(kind == "aggregator", say(kind, not strict, lone if strict else F.lit("loose mode: company mentioned, poster unverified")))
        .when((kind == "spam") & hay.rlike(COMMUNITY), say(kind, False, F.lit("community / paid-service spam, no real role")))
        .when(body.rlike(EXPERIENCED), say(kind, False, F.lit("experienced role, not an internship opening")))
        .when(~ok, say(kind, False, F.concat(F.lit("off-topic: "), F.col("_side.why"))))
        .when(bait & ~(role & apply_), say(F.lit("creator"), False, F.lit("no concrete opening (engagement-bait / no role+apply path)")))
        .when(~(role & apply_) & rescued, say(kind, True, F.concat(F.lit("borderline opening rescued by poster credibility ("), credit, F.lit(")"))))
        .when(~(role & apply_), say(kind, False, F.concat(F.lit("no concrete opening (missing "), missing, F.lit(")"))))
        .when(~kept_type, say(kind, not strict, F.concat(F.lit("rejected source_type "), kind) if strict else F.lit("loose mode: concrete opening")))
        .otherwise(say(kind, True, F.concat(F.lit("real opening ("), F.col("_side.why"), F.lit("; role+apply path)"))))
    )
    out = step.withColumn("_d", decision)
    return out.withColumns({"source_type": F.col("_d.type"), "keep": F.col("_d.keep"), "keep_reason": F.col("_d.why")}).drop("_t", "_f", "_side", "_role", "_apply", "_d")


def audit_tokens(poster: Column, headline: Column, kind: Column, why: Column, text: Column) -> Column:
    """What a decision rested on, as tokens."""
    hay = F.concat_ws("\n", poster, headline, text)
    said = F.when(kind != "", F.concat(F.lit("source:"), kind, F.when(why != "", F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(F.lit("")))).when(why != "", why)
    return F.array_compact(
        F.array(
            F.concat(F.lit("poster:"), F.coalesce(F.nullif(poster, F.lit("")), F.lit("(unknown)"))),
            F.concat(F.lit("followers:"), format_followers(follower_count(hay))),
            F.when(is_verified(hay), F.lit("verified:yes")),
            said,
        )
    )


def link_and_source_gate(df: DataFrame, company: str, *, require_opening: bool = True, resolved: Column | None = None) -> DataFrame:
    """Links, then source rules, then the first-party decision: adds the link columns and ``reject_reason`` (empty: passes).

    Native tests come first; the decision columns of rejected rows are still filled, so
    every row can be accounted for.
    """
    urls = F.concat(F.col("outbound_links"), F.when(F.col("job_link") != "", F.array("job_link")).otherwise(F.expr("cast(array() as array<string>)")))
    step = df.withColumn("_links", classify_links(urls, F.col(company), resolved))
    step = step.withColumns({"link_class": F.col("_links.kind"), "link_categories": link_categories(F.col("_links"), F.col(company)), "_hard": heuristic_reject(F.col("post_text"), F.col("poster"), F.col(company), F.col("_links.kind"))})
    step = first_party(step, F.col(company), F.col("poster"), F.col("poster_headline"), F.col("post_text"), urls)
    opening = F.concat(F.lit("not-opening:"), F.col("source_type"), F.lit(":"), F.col("keep_reason"))
    reject = F.when(F.col("_hard") != "", F.col("_hard")).when(F.lit(require_opening) & (F.col(company) != "") & ~F.col("keep"), opening).otherwise(F.lit(""))
    marks = F.concat(F.slice("_links.reasons", 1, 4), F.when(F.col("link_class").isin("careers", "junk"), F.array(F.concat(F.lit("link:"), F.col("link_class")))).otherwise(F.expr("cast(array() as array<string>)")))
    tokens = F.concat(marks, audit_tokens(F.col("poster"), F.col("poster_headline"), F.col("source_type"), F.col("keep_reason"), F.col("post_text")))
    return step.withColumns({"reject_reason": reject, "source_reasons": tokens}).drop("_links", "_hard", "keep")
