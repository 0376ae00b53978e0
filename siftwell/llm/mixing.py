"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 11).

Targets: the mix holds ``share`` times all words; sources share it by weight, none gets more
than ``ceiling`` times its own words, and what is over goes to the others by weight.  The mix
is made of blocks of ``block_words`` words.  Blocks go to the sources, and a source's blocks
to its shards, by the highest quotients ``weight / (2 blocks + 1)``.  A shard reads its
documents in seeded order, over and over; its quota of blocks is drawn from the first pass
before any from the second, by a seeded permutation of the blocks of a pass.

SQL functions only.  Texts are read once, to be counted; the rest moves ids and numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._shared import in_order, join_hot, stash

WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2
BLOCK = 32
SEED = 7
#: Words of a shard, and how many shards all sources have together (beside one for each source): larger corpora have larger shards.
SHARD_WORDS, SHARDS = 65_536, 100_000
#: Prime above the number of blocks in a pass, so that steps of it visit each block once.
STEP = 2_147_483_647
_WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _targets(sources: DataFrame, weights: Sequence[int], share: float, ceiling: int) -> DataFrame:
    """``source_no``, ``target`` of ``sources(_source, _none, source_size)``; code point order, null last."""
    ranked = in_order(sources, [F.col("_none"), F.col("_source")], {"source_no": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("_ratio", F.lit(ceiling) * F.col("source_size") / F.col("weight"))
    words, heavy = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # sources reach their ceiling in the order of size by weight; the level is the highest that those below it leave
    filled = stash(in_order(ranked, [F.col("_ratio"), F.col("source_no")], {"_words": F.col("source_size"), "_weights": F.col("weight")}))
    level = filled.agg(F.max((F.lit(share) * words - ceiling * F.col("_words")) / (heavy - F.col("_weights")))).first()[0]
    return filled.withColumn("target", F.least(F.lit(float(ceiling)) * F.col("source_size"), F.lit(level).cast("double") * F.col("weight"))).drop("_ratio", "_words", "_weights")


def _bounds(weight: Column, seats: Column, whole: Column, parties: Column, limit: Column | None = None) -> tuple[Column, Column]:
    """Least and most seats a party can have: the divisor lies where all parties' roundings together could miss half a seat each."""
    even = lambda n: F.when(whole > 0, weight * n / whole).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.ceil(even(seats - parties / 2) - 0.5) - 1).cast("long")
    high = F.greatest(F.lit(0), F.floor(even(seats + parties / 2) + 0.5) + 1).cast("long")
    return (low, high) if limit is None else (F.least(low, limit), F.least(high, limit))


def _source_quotas(sources: DataFrame, block: int) -> DataFrame:
    """``quota`` blocks of each source: the highest quotients of all, ties by the sources' order."""
    rows = sources.where("target > 0")
    whole, n = rows.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    seats = round(whole / block)
    low, high = _bounds(F.col("target"), F.lit(seats), F.lit(whole), F.lit(n))
    bounded = stash(rows.select("source_no", "target", low.alias("_low"), high.alias("_high")))
    left = seats - (bounded.agg(F.coalesce(F.sum("_low"), F.lit(0))).first()[0])
    rest = bounded.where("_high > _low").select("source_no", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"), "target")
    rest = rest.withColumn("_quotient", F.col("target") / (2 * F.col("_seat") + 1))
    won = in_order(rest, [F.desc("_quotient"), F.col("source_no"), F.col("_seat")], {"_place": F.lit(1)}).where(F.col("_place") < left)
    more = won.groupBy("source_no").agg(F.count(F.lit(1)).alias("_more"))
    return sources.join(bounded.select("source_no", "_low").join(more, "source_no", "left"), "source_no", "left").withColumn("quota", F.coalesce(F.col("_low") + F.coalesce("_more", F.lit(0)), F.lit(0))).drop("_low", "_more")


def _shard_quotas(shards: DataFrame, block: int, ceiling: int) -> DataFrame:
    """``quota`` of each row of ``shards(source_no, shard, shard_words, _seats)``; no shard gets more blocks than ``ceiling`` passes have."""
    own = Window.partitionBy("source_no")
    low, high = _bounds(F.col("shard_words"), F.col("_seats"), F.col("_whole"), F.col("_parties"), F.col("_limit"))
    bounded = (
        shards.withColumns({"_whole": F.sum("shard_words").over(own), "_parties": F.count(F.lit(1)).over(own), "_limit": F.floor(F.lit(ceiling) * F.col("shard_words") / block)})
        .withColumns({"_low": low, "_high": high})
        .withColumn("_left", F.col("_seats") - F.sum("_low").over(own))
    )
    rest = bounded.where("_high > _low").select("source_no", "shard", "shard_words", "_left", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    order = Window.partitionBy("source_no").orderBy(F.desc(F.col("shard_words") / (2 * F.col("_seat") + 1)), "shard", "_seat")
    more = rest.withColumn("_place", F.row_number().over(order)).where("_place <= _left").groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("_more"))
    return bounded.join(more, ["source_no", "shard"], "left").select("source_no", "shard", "shard_words", (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("quota"))


def _pieces(block: int, ceiling: int) -> Column:
    """Word ranges ``(from, to)`` of a document that the chosen blocks of its shard cover.

    A shard of n words read ``ceiling`` times has whole blocks 0, 1, 2 ...; those that begin in a
    pass, the block over its start included, are numbered from the first and drawn together.
    """
    words, begin, size, quota = (F.col(c) for c in ("shard_words", "_begin", "size", "quota"))
    first = lambda p: F.floor(p * words / block)
    last = F.floor(F.lit(ceiling) * words / block)

    def chosen(j: Column, p: Column) -> Column:
        low, high = first(p), F.least(first(p + 1), last)
        drawn = F.pmod((j - low) * F.pmod(F.lit(STEP), F.greatest(high - low, F.lit(1))) + F.col("_turn"), F.greatest(high - low, F.lit(1)))
        return (j < last) & (drawn < quota - low)

    def of_pass(p: Column) -> Column:
        at = p * words + begin
        hits = F.filter(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block)), lambda j: F.when(j < first(p + 1), chosen(j, p)).otherwise(chosen(j, p + 1)))
        return F.transform(hits, lambda j: F.struct((F.greatest(j * block, at) - at).alias("from"), (F.least((j + 1) * block, at + size) - at).alias("to")))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ceiling - 1).cast("long")), of_pass))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, block_words: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, pieces, taken`` for every row of ``docs(doc_id, source, text)``.

    ``weights`` repeat over the sources in code point order, a null source last; they are
    positive.  ``share`` is at most ``ceiling``.  ``pieces`` are the word ranges taken, pass
    by pass, and ``taken`` their words; no word is taken more than ``ceiling`` times.  A
    source's words come within half a block of its target, or less than a block for each of
    its shards below it where the target is its ceiling.  Null texts and texts without words
    have size 0 and give nothing.  Rows that repeat an id with as many words are copies: each
    is a row of its own, but which of them has which pieces is not told apart.  Null ids are
    ids like any other.  Other columns are ignored; an empty table gives an empty one.
    Equal input gives equal output, whatever the partitions.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD)).cast("long").alias("size"))
    rows = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    # equal rows are one with a count, so that no shard has more rows than words
    kinds = stash(rows.groupBy("_source", "_none", "doc_id", "size").agg(F.count(F.lit(1)).alias("_copies")))
    totals = kinds.groupBy("_source", "_none").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.count(F.lit(1)).alias("_rows"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_empty"))
    planned = _source_quotas(_targets(stash(totals), weights, share, ceiling), block_words)
    words = F.greatest(F.lit(shard_words), F.ceil(F.lit(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] / SHARDS)))
    sources = stash(planned.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).cast("long")))
    key = _hash(F.lit(seed), F.col("doc_id"), F.col("size"))
    dealt = join_hot(kinds, sources, ["_source", "_none"], "_rows", "doc_id").withColumn("_hash", key).withColumn("shard", F.pmod(_number(F.col("_hash")), F.col("_shards")))
    dealt = stash(dealt.select("doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_no", "size", "source_size", "target", "quota", "shard", "_hash", "_copies"))
    held = dealt.where("size > 0")
    quotas = _shard_quotas(held.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("_copies")).alias("shard_words"), F.first("quota").alias("_seats")), block_words, ceiling)
    before = Window.partitionBy("source_no", "shard").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.drop("quota").withColumn("_first", F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(before), F.lit(0))).join(quotas, ["source_no", "shard"])
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).withColumns({"_begin": F.col("_first") + F.col("_copy") * F.col("size"), "_turn": _number(_hash(F.lit(seed), F.col("source_no"), F.col("shard")))})
    columns = ["doc_id", "source", "size", "source_size", "target"]
    full = placed.withColumn("pieces", _pieces(block_words, ceiling)).select(*columns, "pieces")
    none = dealt.where("size = 0").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).select(*columns, F.array().cast("array<struct<from:bigint,to:bigint>>").alias("pieces"))
    return full.unionByName(none).withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"]))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``doc_id, part, text``: the words of every piece, joined by spaces; ``doc_id`` has to be unique and not null.

    Documents that the mix takes nothing from have no row.
    """
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))
    taken = mixed.where("taken > 0").select("doc_id", "pieces").join(docs.select("doc_id", "text"), "doc_id").withColumn("_words", words)
    return taken.select("doc_id", "_words", F.posexplode("pieces").alias("part", "_piece")).select("doc_id", "part", F.array_join(F.slice("_words", F.col("_piece.from").cast("int") + 1, (F.col("_piece.to") - F.col("_piece.from")).cast("int")), " ").alias("text"))


def twin(*, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, block_words: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> str:
    """DuckDB SQL for ``mix`` over ``documents``: every quotient and every block is listed and compared."""
    weight = " ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(weights))
    quotas = lambda table, keys, by, seats, limit: f"""
      SELECT * EXCLUDE (place) FROM (
        SELECT p.*, row_number() OVER (PARTITION BY {keys} ORDER BY {by}::DOUBLE / (2 * seat + 1) DESC, source_no, shard, seat) AS place
        FROM {table} p, LATERAL unnest(range(0, {limit})) s(seat)) WHERE place <= {seats}"""  # noqa: E731
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS source_no FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE source_no % {len(weights)} {weight} END AS weight, sum(source_size) OVER () AS words FROM sources
), filled AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0)::BIGINT AS words_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM weighed WINDOW w AS (ORDER BY {ceiling} * source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(({share}::DOUBLE * words::DOUBLE - {ceiling} * words_before) / ((SELECT sum(weight) FROM weighed)::DOUBLE - weight_before)) AS level FROM filled
), aimed AS (
  SELECT source, source_no, 0 AS shard, source_size, least({ceiling}::DOUBLE * source_size, level * weight) AS target,
    greatest(1, ceil(source_size / greatest({shard_words}, ceil(words / {SHARDS}))))::BIGINT AS shards FROM filled, level
), seats AS (SELECT round_even(sum(target) / {block_words}, 0)::BIGINT AS seats FROM aimed
), source_seats AS (
  SELECT source_no, count(*) AS quota FROM ({quotas("(SELECT * FROM aimed, seats WHERE target > 0)", "0", "target", "seats", f"least(seats, (target / {block_words})::BIGINT + 200)")}) GROUP BY source_no
), kinds AS (
  SELECT s.doc_id, s.size, a.source, a.source_no, a.source_size, a.target, coalesce(q.quota, 0) AS quota, count(*) AS copies, md5('{seed}|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size) AS hash, a.shards
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN source_seats q USING (source_no) GROUP BY ALL
), dealt AS (
  SELECT *, ('0x' || substr(hash, 1, 8))::BIGINT % shards AS shard FROM kinds
), rows AS (
  SELECT d.* EXCLUDE (first_word), first_word + copy * size AS begin, sum(size) OVER (PARTITION BY source_no, shard)::BIGINT AS shard_words
  FROM (SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY source_no, shard ORDER BY hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word FROM dealt) d,
    LATERAL unnest(range(0, copies)) c(copy)
), shards AS (
  SELECT source_no, shard, shard_words, any_value(quota) AS quota, {ceiling} * shard_words // {block_words} AS blocks FROM rows WHERE size > 0 GROUP BY source_no, shard, shard_words
), shard_seats AS (
  SELECT source_no, shard, count(*) AS won FROM ({quotas("shards", "source_no", "shard_words", "quota", "least(blocks, quota)")}) GROUP BY source_no, shard
), passes AS (
  SELECT s.*, coalesce(won, 0) AS won, pass, pass * shard_words // {block_words} AS low, least((pass + 1) * shard_words // {block_words}, blocks) AS high,
    ('0x' || substr(md5('{seed}|' || source_no || '|' || shard), 1, 8))::BIGINT AS turn
  FROM shards s LEFT JOIN shard_seats USING (source_no, shard), LATERAL unnest(range(0, {ceiling})) p(pass)
), chosen AS (
  SELECT source_no, shard, shard_words, block FROM passes, LATERAL unnest(range(low, high)) b(block)
  WHERE ((block - low) * ({STEP} % (high - low)) + turn) % (high - low) < won - low
), taken AS (
  SELECT r.doc_id, r.source, r.size, r.begin, sum(greatest(0, least((block + 1) * {block_words}, pass * c.shard_words + r.begin + r.size) - greatest(block * {block_words}, pass * c.shard_words + r.begin)))::BIGINT AS taken
  FROM chosen c, LATERAL unnest(range(0, {ceiling})) p(pass), rows r
  WHERE r.source_no = c.source_no AND r.shard = c.shard AND block * {block_words} < pass * c.shard_words + r.begin + r.size AND (block + 1) * {block_words} > pass * c.shard_words + r.begin GROUP BY ALL
)
SELECT r.doc_id, r.size::BIGINT AS size, r.source_size, r.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM rows r LEFT JOIN taken t ON r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.source IS NOT DISTINCT FROM t.source AND r.size = t.size AND r.begin = t.begin AND r.size > 0
"""
