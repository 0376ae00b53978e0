"""Posts that keep landing in a folder: the batch rules on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions.text import identity_key
from siftwell.operators.history import upsert
from siftwell.operators.matching import Vocabulary, match_terms
from siftwell.schemas import POST


def landing(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files of a folder, with the time of arrival."""
    return spark.readStream.schema(POST.add("arrived", "timestamp")).json(path)


def matched_once(posts: DataFrame, vocabulary: Vocabulary = Vocabulary(), late: str = "1 day") -> DataFrame:
    """Matching posts, each identity once within the watermark: state is bounded by ``late``."""
    keyed = posts.withColumn("identity", identity_key(F.coalesce("post_url", F.lit("")), F.coalesce("poster", F.lit("")), F.coalesce("post_text", F.lit(""))))
    once = keyed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["identity"])
    return match_terms(once, "post_text", vocabulary).where("matched")


def funnel_by_window(posts: DataFrame, every: str = "10 minutes", late: str = "1 day", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Counts of seen and matched posts by window of arrival and company."""
    judged = match_terms(posts.withWatermark("arrived", late), "post_text", vocabulary)
    return judged.groupBy(F.window("arrived", every), "company").agg(F.count(F.lit(1)).alias("seen"), F.count_if("matched").alias("matched"))


def upsert_into(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, seq: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges a batch into a history; running a batch again changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        write(upsert(read().unionByName(batch, allowMissingColumns=True), key, seq).drop("first_seq"))

    return sink


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until what is there is processed."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
