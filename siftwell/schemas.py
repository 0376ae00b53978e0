"""Record shapes.  Missing text is the empty string; a null age means undated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "counts": T.MapType(T.StringType(), T.LongType()),
}


def _shape(**fields: str) -> T.StructType:
    """Fields by kind; needs no session, so that modules can be imported without one."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for kind, names in fields.items() for name in names.split()])


POST = T.StructType(
    _shape(string="poster company role location post_date job_link why_matched funding_signal company_class post_url post_text activity_urn").fields
    + _shape(strings="outbound_links").fields
    + _shape(string="link_class").fields
    + _shape(strings="link_categories").fields
    + _shape(string="source_type poster_headline", long="follower_count", boolean="poster_verified", counts="engagement", double="days_old", strings="reasons").fields
)
JOB = _shape(string="company title location link")
HISTORY = T.StructType(
    _shape(string="timestamp company poster poster_employer post_url intent link_class", strings="link_domains", boolean="kept").fields
    + _shape(string="gate_reason", boolean="author_is_hirer is_offer_not_request cta_is_application role_named").fields
    + _shape(string="user_label").fields
)

#: Output projections.
JOB_FIELDS = ("company", "title", "location", "link")
POST_FIELDS = ("poster", "company", "role", "location", "post_date", "job_link", "why_matched", "funding_signal", "company_class", "post_url", "source_type", "link_class")
TXT_FIELDS = ("company", "role", "post_url", "why_matched", "source_type")
COMPANY_POST_FIELDS = ("company", "poster", "poster_employer", "link_class", "snippet", "post_url", "why_matched", "gate_reason", "source_type")
RESULT_FIELDS = ("company", "role", "why_matched", "post_url", "source_type")


def conform(df: DataFrame, schema: T.StructType = POST) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``: absent text is ``''``, absent lists and maps are empty."""
    have = {f.name for f in df.schema}
    out = []
    for f in schema:
        col = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            col = F.coalesce(col, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            col = F.coalesce(col, F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            col = F.coalesce(col, F.create_map().cast(f.dataType))
        out.append(col.alias(f.name))
    return df.select(*out)
