"""Mixing sources to target weights: block quotas by Sainte-Laguë, then seeded selection of blocks.

A source's documents are dealt to shards of a bounded size and laid end to end there, in a seeded order;
a shard is cut into blocks of equally many words. The blocks that a mix takes are apportioned
by highest quotients three times with one function: to sources, to a source's groups of shards, and to
a group's shards. A shard with quota q and n blocks is taken q div n times as a whole, and q mod n of its blocks once
more, evenly spread from a seeded start. So what a document gives is plain arithmetic
on its place in the shard, and no block ever becomes a row of its own.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, the last one; a null id is an
id; rows that are equal in id, source and text are rows of their own; other columns aren't read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import SPACE, stored

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST = 3
#: Words of a block.
BLOCK = 16
#: Words and documents of a shard, about; shards of a group.
SHARD_WORDS, SHARD_DOCS, GROUP = 1 << 17, 512, 1024
SEED = "mix-1"
#: Votes are counted in fractions of a block, as integers, so that sums don't depend on their order.
GRAIN = 1024
#: Most sources that are broadcast (about 60 bytes and the name each).
FEW = 10_000


def hashed(*parts: Column | str) -> Column:
    """60 bits of a hash of the seed and some texts; SQL engines compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with no (from 1 in order of code points, null last), weight and target.

    A source is full if its share of what the fuller ones before it leave is no less than ``most`` times its size. In order of
    size over weight that holds up to one place, which is where sharing the excess again and again ends, too.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("no") - 1) % len(weights))
    known = sources.withColumn("no", order).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    first = [F.col("limit") / F.col("weight"), F.col("no")]
    before, every = Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    wide = "decimal(38,0)"  # a product of two sums of words and weights
    left = known.withColumns({
        "words_left": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    full = left.withColumn("full", F.col("limit").cast(wide) * F.col("weight_left") <= F.col("words_left").cast(wide) * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(*first, "words_left", "weight_left"))).over(every)
    shared = F.col("weight") * F.col("level.words_left") / F.col("level.weight_left")
    return full.withColumn("level", level).select("source", "source_size", "docs", "no", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def apportioned(parts: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, quota) of ``parts`` (by, key, votes, most, seats): each group's seats by highest quotients votes / (2 k + 1), at most ``most`` a part.

    With n parts, rounding votes at (seats - n) / all votes gives nobody more than the quotients do, and leaves at most 1.5 n seats.
    Only those are ranked, among some 5 n quotients. Equal quotients go by the key.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n, every = F.count("*").over(group), F.sum("votes").over(group)
    sure = F.when((every > 0) & (F.col("seats") > n), F.floor(F.col("votes") / every * (F.col("seats") - n) + 0.5)).otherwise(0).cast("long")
    based = parts.withColumns({"sure": F.least("most", sure), "next": F.when(every > 0, F.ceil(2 * n * F.col("votes") / every)).otherwise(0) + 2})
    asked = based.withColumn("left", F.col("seats") - F.sum("sure").over(group)).withColumn("seat", F.explode(F.sequence("sure", F.col("sure") + F.col("next"))))
    quotient = F.when(F.col("seat") < F.col("most"), F.col("votes") / (2 * F.col("seat") + 1)).otherwise(-1.0)
    place = F.row_number().over(group.orderBy(F.col("quotient").desc(), key, "seat"))
    ranked = asked.withColumn("quotient", quotient).withColumn("place", place)
    more = F.count_if((F.col("quotient") > 0) & (F.col("place") <= F.col("left")))
    return ranked.groupBy(*by, key).agg((F.max("sure") + more).alias("quota"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row for each of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken, and its place.

    The place: shard, start (its first word there), blocks (of the shard), quota (blocks to take), turn (the seeded start of the
    extra blocks); :func:`spans` reads the taken passages from it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"), hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("h"))
    sized = stored(rows, "mix-sizes")
    known = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, most), "mix-sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)).alias("shards")
    named = known.select(F.col("source").alias("named"), "no", "source_size", "target", shards)
    met = sized.join(F.broadcast(named) if known.count() <= FEW else named, F.col("source").eqNullSafe(F.col("named")))
    placed = met.select("doc_id", "size", "h", "no", (F.col("h") % F.col("shards")).alias("shard"), "source_size", "target")

    one = placed.groupBy("no", "shard").agg(F.sum("size").alias("words")).select("no", "shard", F.expr(f"shard div {GROUP}").alias("part"), F.ceil(F.col("words") / block).alias("blocks"))
    one = stored(one, "mix-shards")
    parts = one.groupBy("no", "part").agg(F.sum("blocks").alias("blocks"))
    held = known.join(parts.groupBy("no").agg(F.sum("blocks").alias("blocks")), "no")
    votes = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks") * GRAIN)).otherwise(0).cast("long")
    wanted = held.select("no", "blocks", votes.alias("votes"), (F.col("blocks") * most).alias("most"))
    seats = wanted.agg(F.floor(F.sum("votes") / GRAIN + 0.5).alias("seats"))  # one row
    by_source = apportioned(wanted.join(F.broadcast(seats)), [], "no").withColumnRenamed("quota", "seats")
    ballot = lambda df, up, by: df.join(up, by).select(*df.columns, F.col("blocks").alias("votes"), (F.col("blocks") * most).alias("most"), "seats")
    by_part = apportioned(ballot(parts, by_source, ["no"]), ["no"], "part").withColumnRenamed("quota", "seats")
    by_shard = apportioned(ballot(one, by_part, ["no", "part"]), ["no", "part"], "shard")
    quotas = one.join(by_shard, ["no", "part", "shard"]).select("no", "shard", "blocks", "quota", F.pmod(hashed(F.col("no").cast("string"), F.col("shard").cast("string")), F.greatest("blocks", F.lit(1))).alias("turn"))

    line = Window.partitionBy("no", "shard").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    told = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, ["no", "shard"])
    return told.select("doc_id", "size", "source_size", "target", taken(block).alias("taken"), F.concat_ws("-", "no", "shard").alias("shard"), "start", "blocks", "quota", "turn")


def chosen_before(place: Column) -> Column:
    """How many blocks of a shard before one (by number) are taken once more."""
    return F.floor((place * (F.col("quota") % F.col("blocks")) + F.col("turn")) / F.col("blocks"))


def taken(block: int = BLOCK) -> Column:
    """The words that a mix takes of a document, by its place; repeats count."""

    def extra(word: str) -> Column:
        """Words before this one of the shard in blocks that are taken once more."""
        at = F.expr(f"({word}) div {block}")
        return chosen_before(at) * block + (chosen_before(at + 1) - chosen_before(at)) * F.expr(f"({word}) % {block}")

    return F.when(F.col("blocks") > 0, F.expr("quota div blocks") * F.col("size") + extra("start + size") - extra("start")).otherwise(0).cast("long")


def spans(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, first_word, words, times) for each piece of a block in a document of :func:`mixture` that is taken at least once."""
    number = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("number")
    cut = mixed.where("size > 0").select("*", number)
    first, last = F.greatest("start", F.col("number") * block), F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * block)
    times = F.expr("quota div blocks") + chosen_before(F.col("number") + 1) - chosen_before(F.col("number"))
    return cut.select("doc_id", (first - F.col("start")).alias("first_word"), (last - first).alias("words"), times.cast("long").alias("times")).where("times > 0")


def _apportioned_sql(name: str, parts: str, by: str, key: str) -> str:
    """The tables of :func:`apportioned` over ``parts``; the last one is called ``name``."""
    group = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, {key}" if by else key
    return f"""{name}_a AS (SELECT *, count(*) OVER ({group}) AS n, CAST(sum(votes) OVER ({group}) AS DOUBLE) AS every FROM ({parts})),
{name}_b AS (SELECT *, least(most, CASE WHEN every > 0 AND seats > n THEN CAST(floor(votes / every * (seats - n) + 0.5) AS BIGINT) ELSE 0 END) AS sure, CASE WHEN every > 0 THEN CAST(ceil(2 * n * votes / every) AS BIGINT) ELSE 0 END + 2 AS more FROM {name}_a),
{name}_c AS (SELECT *, seats - sum(sure) OVER ({group}) AS missing FROM {name}_b),
{name}_d AS (SELECT *, sure + unnest(range(0, more + 1)) AS k FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN k < most THEN votes / (2 * k + 1)::DOUBLE ELSE -1.0::DOUBLE END AS quotient FROM {name}_d),
{name}_f AS (SELECT *, row_number() OVER ({group} ORDER BY quotient DESC, {key}, k) AS place FROM {name}_e),
{name} AS (SELECT {keys}, CAST(max(sure) + count(*) FILTER (quotient > 0 AND place <= missing) AS BIGINT) AS quota FROM {name}_f GROUP BY {keys})"""


_HASH = "CAST('0x' || left(md5('" + SEED + "|' || {0}), 15) AS BIGINT)"
_BEFORE = "(({0}) * (quota % blocks) + turn) // blocks"
_EXTRA = f"({_BEFORE.format('({0}) // ' + str(BLOCK))} * {BLOCK} + ({_BEFORE.format('({0}) // ' + str(BLOCK) + ' + 1')} - {_BEFORE.format('({0}) // ' + str(BLOCK))}) * (({{0}}) % {BLOCK}))".replace("{{0}}", "{0}")
MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS size, {_HASH.format("coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')")} AS h FROM documents),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source)),
weighed AS (SELECT *, {list(WEIGHTS)}[(no - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {MOST} AS most FROM named),
remains AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS HUGEINT) AS words_left, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS HUGEINT) AS weight_left
  FROM weighed WINDOW before AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, most * weight_left <= words_left * weight AS filled FROM remains),
levels AS (SELECT words_left AS level_words, weight_left AS level_weight FROM marked WHERE NOT filled ORDER BY most / weight, no LIMIT 1),
known AS (SELECT source, source_size, docs, no, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST(weight * level_words AS DOUBLE) / CAST(level_weight AS DOUBLE) END AS target,
  CAST(greatest(1, ceil(source_size / {SHARD_WORDS}), ceil(docs / {SHARD_DOCS})) AS BIGINT) AS shards FROM marked LEFT JOIN levels ON true),
placed AS (SELECT doc_id, size, h, no, h % shards AS shard, source_size, target FROM sized JOIN known ON sized.source IS NOT DISTINCT FROM known.source),
one AS (SELECT no, shard, shard // {GROUP} AS part, CAST(ceil(sum(size) / {BLOCK}) AS BIGINT) AS blocks FROM placed GROUP BY no, shard),
parts AS (SELECT no, part, CAST(sum(blocks) AS BIGINT) AS blocks FROM one GROUP BY no, part),
wanted AS (SELECT no, blocks, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * blocks * {GRAIN}) AS BIGINT) ELSE 0 END AS votes, blocks * {MOST} AS most FROM known JOIN (SELECT no, CAST(sum(blocks) AS BIGINT) AS blocks FROM parts GROUP BY no) USING (no)),
{_apportioned_sql("by_source", f"SELECT *, CAST(floor((SELECT sum(votes) FROM wanted) / {GRAIN} + 0.5) AS BIGINT) AS seats FROM wanted", "", "no")},
{_apportioned_sql("by_part", f"SELECT p.*, blocks AS votes, blocks * {MOST} AS most, quota AS seats FROM parts p JOIN by_source USING (no)", "no", "part")},
{_apportioned_sql("by_shard", f"SELECT o.*, blocks AS votes, blocks * {MOST} AS most, quota AS seats FROM one o JOIN by_part USING (no, part)", "no, part", "shard")},
quotas AS (SELECT no, shard, blocks, quota, {_HASH.format("no || '|' || shard")} % greatest(blocks, 1) AS turn FROM one JOIN by_shard USING (no, part, shard)),
told AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY no, shard ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM placed JOIN quotas USING (no, shard))
SELECT doc_id, size, source_size, target, CAST(CASE WHEN blocks > 0 THEN quota // blocks * size + {_EXTRA.format("first + size")} - {_EXTRA.format("first")} ELSE 0 END AS BIGINT) AS taken, no || '-' || shard AS shard, quota FROM told
"""
