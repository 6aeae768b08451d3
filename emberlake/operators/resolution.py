"""Entity resolution and contradictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import canonical, literal_map, normalised, quote_supported
from emberlake.model import DEGENERATE


def by_alias(new: DataFrame, known: DataFrame) -> DataFrame:
    """(name, entity_type, action, target, confidence): entities of one canonical name merge if their types agree, else are the same as each other.

    new: ordinal, name, entity_type; known: ordinal, name, entity_type. The first known hit decides.
    """
    own = new.select("name", "entity_type", canonical(F.col("name")).alias("key"))
    there = known.select(F.col("ordinal").alias("known_ordinal"), F.col("name").alias("target"), F.col("entity_type").alias("known_type"), canonical(F.col("name")).alias("key"))
    first = there.groupBy("key").agg(F.min_by(F.struct("target", "known_type"), "known_ordinal").alias("hit"))
    same = F.col("entity_type") == F.col("hit.known_type")
    return own.join(first, "key").select("name", "entity_type", F.when(same, "MERGE").otherwise("SAME_AS").alias("action"), F.col("hit.target").alias("target"), F.when(same, 1.0).otherwise(0.9).alias("confidence"))


def semantic(pairs: DataFrame, same: float = 0.9, related: float = 0.75) -> DataFrame:
    """(a, b, action, confidence) of the nearest partner of each a: SAME_AS, RELATED_TO, or none."""
    best = pairs.groupBy("a").agg(F.min_by(F.struct("b", "similarity"), F.struct(-F.col("similarity"), "b")).alias("hit")).select("a", "hit.b", "hit.similarity")
    action = F.when(F.col("similarity") >= same, "SAME_AS").when(F.col("similarity") >= related, "RELATED_TO")
    return best.withColumn("action", action).where("action IS NOT NULL").select("a", "b", "action", F.round("similarity", 4).alias("confidence"))


def matching_ratio(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with a column ratio: twice the matched characters over all, by matching blocks."""
    from difflib import SequenceMatcher

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ratio=[SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(b[left], b[right], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double")


#: Characters from common to rare; the others are the rarest. Only the order of a search depends on it.
COMMON = " etaoinsrhldcumfpgwybvkxjqz"
#: Grams aren't made longer than this.
LONGEST = 6


def gram_length(n: int, ratio: float) -> int:
    """How long a run of characters two texts share at least, whose shorter one has ``n``, if their matching-block ratio reaches ``ratio``.

    With lengths n and m, M = ratio (n + m) / 2 characters match, in at most (n - M) + (m - M) + 1 blocks, so the longest block has M over that number.
    """

    def longest(m: int) -> int:
        matched = math.ceil(ratio * (n + m) / 2 - 1e-9)
        return math.ceil(matched / max(1, n + m - 2 * matched + 1) - 1e-9)

    return max(1, min(LONGEST, *map(longest, range(n, math.floor(n * (2 - ratio) / ratio + 1e-9) + 1))))


def likely_pairs(left: DataFrame, right: DataFrame, ratio: float, key: str | None = None) -> DataFrame:
    """Distinct pairs (l, r, and ``key`` if named) of texts (columns l and r) that can have a matching-block ratio of at least ``ratio``; none is lost.

    2 M / (n + m) >= ratio means that M characters match, so m lies within n ratio / (2 - ratio) and its inverse. Texts meet in a token, within
    one value of ``key``. From a ratio of 0.8 tokens are runs of characters: matching blocks are few, so one is long (:func:`gram_length` of the shorter
    text), and lies at places no farther apart than characters can be missing. Below, matching blocks can be single characters: then of the characters in
    one order each text shares one among its first n - ceil(n ratio / (2 - ratio)) + 1 with the same of the other, the rarest coming first.
    """
    least, keys = ratio / (2 - ratio), [key] if key else []

    def characters(df: DataFrame, name: str) -> DataFrame:
        order = F.expr(f"array_sort(transform(filter(split({name}, ''), c -> c != ''), c -> named_struct('r', -locate(c, '{COMMON}'), 'c', c)))")
        own = df.select(name, *keys).distinct().withColumn("o", order).withColumn("n", F.size("o"))
        numbered = F.transform("o", lambda x, i: F.struct(x["c"].alias("c"), (i - F.array_position("o", x)).alias("k")))
        kept = F.slice(numbered, 1, F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1))
        return own.where("n > 0").select(name, *keys, F.col("n").alias(f"{name}_n"), F.explode(kept).alias("token"))

    def grams(df: DataFrame, name: str) -> DataFrame:
        """Runs of each length that a shorter partner, or the text itself as the shorter one, asks for, with their place."""
        own = df.select(name, *keys).distinct().withColumn("n", F.length(name)).where("n > 0")
        most = own.agg(F.max("n")).first()[0] or 0  # one row
        lengths = [gram_length(n, ratio) for n in range(1, min(most, 400) + 1)] or [1]  # beyond that it no longer changes
        table = F.array(*[F.lit(x) for x in lengths])
        asks = lambda n: F.get(table, F.least(n, F.lit(len(lengths))).cast("int") - 1)
        low = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)).cast("int")
        wanted = F.array_distinct(F.transform(F.sequence(low, F.col("n")), asks))
        each = own.select(name, *keys, F.col("n").alias(f"{name}_n"), F.explode(wanted).alias("q")).where(F.col("q") <= F.col(f"{name}_n"))
        placed = each.select("*", F.explode(F.sequence(F.lit(1), F.col(f"{name}_n") - F.col("q") + 1)).alias(f"{name}_at"))
        return placed.withColumn("token", F.substring(F.col(name), F.col(f"{name}_at"), F.col("q")))

    close = F.least("l_n", "r_n") >= least * F.greatest("l_n", "r_n") - 1e-9
    if ratio < 0.8:
        return characters(left, "l").join(characters(right, "r"), ["token", *keys]).where(close).select("l", "r", *keys).distinct()
    met = grams(left, "l").join(grams(right, "r"), ["q", "token", *keys]).where(close)
    missing = (F.col("l_n") + F.col("r_n")) * (1 - ratio) + 1e-9
    return met.where(F.abs(F.col("l_at") - F.col("r_at")) <= missing).select("l", "r", *keys).distinct()


def fuzzy(new: DataFrame, known: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(name, target, action, confidence): the known name of the best ratio, if that is ``threshold`` or more.

    The ratio is the best over both names' normalised and canonical forms. Pairs that can't reach it are left out without loss.
    """

    def spelt(df: DataFrame, name: str, form: str) -> DataFrame:
        both = F.array_distinct(F.array(normalised(F.col("name")), canonical(F.col("name"))))
        return df.select(F.col("name").alias(name), F.col("entity_type").alias(f"{name}_type"), F.explode(both).alias(form))

    a, b = spelt(new, "new_name", "l"), spelt(known, "known_name", "r")
    hits = matching_ratio(likely_pairs(a, b, threshold), "l", "r").where(F.col("ratio") >= threshold)
    found = a.join(hits, "l").join(b, "r")
    best = found.groupBy("new_name", "new_name_type").agg(F.min_by(F.struct("known_name", "known_name_type", "ratio"), F.struct(-F.col("ratio"), "known_name")).alias("hit"))
    return best.select(F.col("new_name").alias("name"), F.col("hit.known_name").alias("target"), F.when(F.col("new_name_type") == F.col("hit.known_name_type"), "SAME_AS").otherwise("RELATED_TO").alias("action"), F.round("hit.ratio", 4).alias("confidence"))


def matches(new: DataFrame, known: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(name, target, tier, ratio) of distinct names that are the same by alias (tier 1) or alike by matching blocks (tier 2); new and known: name."""
    spell = lambda df, n: df.select(F.col("name").alias(n)).distinct().select(n, canonical(F.col(n)).alias(f"{n}_key"), F.array_distinct(F.array(normalised(F.col(n)), canonical(F.col(n)))).alias(f"{n}_forms"))
    a, b = spell(new, "name"), spell(known, "target")
    exact = a.join(b, F.col("name_key") == F.col("target_key")).select("name", "target", F.lit(1).alias("tier"), F.lit(1.0).alias("ratio"))
    left, right = a.select("name", "name_key", F.explode("name_forms").alias("l")), b.select("target", "target_key", F.explode("target_forms").alias("r"))
    near = matching_ratio(likely_pairs(left, right, threshold), "l", "r").where(F.col("ratio") >= threshold)
    close = left.join(near, "l").join(right, "r").where("name_key != target_key").groupBy("name", "target").agg(F.max("ratio").alias("ratio"))
    return exact.unionByName(close.select("name", "target", F.lit(2).alias("tier"), "ratio"))


def resolved_in_order(items: DataFrame, known: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(batch, ordinal, name, entity_type, action, target, entity_id) of ``items`` (batch, ordinal, name, entity_type), each resolved after those before it in its batch.

    Candidates are the ``known`` entities (ordinal, name, entity_type) and those that earlier items of the batch have created. The first of one
    canonical name decides, known ones first: MERGE if types agree, else SAME_AS; else the most alike, the first of equals: SAME_AS or RELATED_TO;
    else the most ``similar`` known one (name, target, similarity; 0.9 SAME_AS, 0.75 RELATED_TO); else the item creates an entity.

    Matches are found once for all names. Only the first item of a name in a batch can create an entity: what it finds, later ones find too. Whether it does
    depends on earlier ones only, so each round of joins decides all first items whose earlier matches are decided; rounds end with the longest chain of
    matching names of a batch. What a name of a batch can be resolved to is one list, of which each item takes the first that stands before it.
    """
    from emberlake.operators.graph import cut

    items = cut(items.select("batch", "ordinal", "name", "entity_type").where("trim(name) != ''"))
    known = known.select(F.col("ordinal").alias("k_ordinal"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"))
    names = items.select("name").distinct()
    to_known = cut(matches(names, known.select(F.col("target").alias("name"))).join(known, "target"))
    within = cut(matches(names, names))
    firsts = cut(items.groupBy("batch", "name").agg(F.min("ordinal").alias("ordinal"), F.min_by("entity_type", "ordinal").alias("entity_type")))
    theirs = firsts.select("batch", F.col("ordinal").alias("t_ordinal"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"))
    matched = firsts.select("batch", "ordinal", "name").join(within, "name").join(theirs, ["batch", "target"])
    earlier = cut(matched.where("t_ordinal < ordinal").select("batch", "name", "target"))
    sure = firsts.join(to_known.select("name").distinct(), "name", "left_semi").select("batch", "name", F.lit(False).alias("creates"))
    semantic = None
    if similar is not None:
        best = similar.where("similarity >= 0.75").groupBy("name").agg(F.min_by(F.struct("similarity", "target"), F.struct(-F.col("similarity"), "target")).alias("s"))
        semantic = cut(best.select("name", "s.*"))
    decided, waiting = cut(sure), cut(firsts.join(sure, ["batch", "name"], "left_anti").select("batch", "name"))
    while not waiting.isEmpty():
        state = earlier.join(decided.select("batch", F.col("name").alias("target"), "creates"), ["batch", "target"], "left")
        told = state.groupBy("batch", "name").agg(F.max(F.coalesce("creates", F.lit(False))).alias("hit"), F.max(F.col("creates").isNull()).alias("open"))
        ready = waiting.join(told, ["batch", "name"], "left").where(F.coalesce("hit", F.lit(False)) | ~F.coalesce("open", F.lit(False)))
        new = ready.select("batch", "name", (~F.coalesce("hit", F.lit(False))).alias("creates"))
        if semantic is not None:
            new = new.join(semantic.select("name", F.lit(True).alias("alike")), "name", "left").withColumn("creates", F.col("creates") & F.col("alike").isNull())
        new = cut(new.select("batch", "name", "creates"))
        decided = cut(decided.unionByName(new))
        waiting = cut(waiting.join(new, ["batch", "name"], "left_anti"))
    made = matched.join(decided.where("creates").select("batch", F.col("name").alias("target")), ["batch", "target"], "left_semi")
    choice = lambda of, place: F.struct("tier", (-F.col("ratio")).alias("unlike"), F.lit(of).alias("from"), F.col(place).alias("place"), "target", "target_type")
    best_known = to_known.groupBy("name").agg(F.min(choice(0, "k_ordinal")).alias("c"))
    found = firsts.join(best_known, "name").select("batch", "name", "c").unionByName(made.select("batch", "name", choice(1, "t_ordinal").alias("c")))
    lists = found.groupBy("batch", "name").agg(F.array_sort(F.collect_list("c")).alias("choices"))
    joined = items.join(lists, ["batch", "name"], "left").withColumn("h", F.get(F.filter("choices", lambda c: (c["from"] == 0) | (c["place"] < F.col("ordinal"))), F.lit(0)))
    same = F.col("entity_type") == F.col("h.target_type")
    action = F.when(F.col("h").isNull(), F.lit(None)).when(F.col("h.tier") == 1, F.when(same, "MERGE").otherwise("SAME_AS")).otherwise(F.when(same, "SAME_AS").otherwise("RELATED_TO"))
    target = F.col("h.target")
    if semantic is not None:
        joined = joined.join(semantic.withColumnRenamed("target", "s_target"), "name", "left")
        action = F.coalesce(action, F.when(F.col("similarity") >= 0.9, "SAME_AS").when(F.col("similarity").isNotNull(), "RELATED_TO"))
        target = F.coalesce(target, "s_target")
    out = joined.select("batch", "ordinal", "name", "entity_type", F.coalesce(action, F.lit("CREATE")).alias("action"), target.alias("target"))
    return out.withColumn("entity_id", F.concat(F.lit("entity:"), F.when(F.col("action") == "MERGE", F.col("target")).otherwise(F.col("name"))))


def extraction_edges(resolved: DataFrame, events: DataFrame) -> DataFrame:
    """(src, dst, edge_type) that a batch's resolution writes: SAME_AS and RELATED_TO between entities, and REFERENCES from every event (batch, event_id) of the batch to each of its entities."""
    links = resolved.where("action IN ('SAME_AS', 'RELATED_TO')").select(F.col("entity_id").alias("src"), F.concat(F.lit("entity:"), "target").alias("dst"), F.col("action").alias("edge_type")).distinct()
    entities = resolved.select("batch", "entity_id").distinct()
    return events.select("batch", "event_id").join(entities, "batch").select(F.col("event_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("REFERENCES").alias("edge_type")).unionByName(links)


def preference_conflicts(preferences: DataFrame) -> DataFrame:
    """Pairs (earlier, later) of neighbouring preferences of one category and key whose polarity differs."""
    w = Window.partitionBy("session_id", "category", "key").orderBy("position")
    before = preferences.withColumns({"before": F.lag("preference_id").over(w), "before_polarity": F.lag("polarity").over(w), "before_us": F.lag("confirmed_us").over(w)})
    return before.where(F.col("before").isNotNull() & (F.col("before_polarity") != F.col("polarity"))).select(F.col("before").alias("a"), F.col("preference_id").alias("b"), F.col("before_us").alias("a_us"), F.col("confirmed_us").alias("b_us"))


def preference_winner(conflicts: DataFrame) -> DataFrame:
    """(winner, loser): the newest confirmed wins, an unknown time counts as newest, b among equals."""
    a_wins = F.col("b_us").isNotNull() & (F.col("a_us").isNull() | (F.col("a_us") > F.col("b_us")))
    return conflicts.select(F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("loser"))


def belief_winner(pairs: DataFrame) -> DataFrame:
    """(winner, loser): higher confidence, then later confirmation where both times are known and differ, then more confirmations, then b."""
    a, b = (lambda name: F.col(f"a_{name}")), (lambda name: F.col(f"b_{name}"))
    timed = F.coalesce(a("us") != b("us"), F.lit(False))
    a_wins = F.when(a("confidence") != b("confidence"), a("confidence") > b("confidence")).when(timed, a("us") > b("us")).otherwise(a("count") > b("count"))
    return pairs.select(F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("loser"))


def belief_contradictions(beliefs: DataFrame) -> DataFrame:
    """(a, b, ratio) of beliefs of one category whose texts are alike but not the same (ratio 0.6 to 0.95), whatever words they begin with.

    Beliefs meet within their category only. There, pairs that can't reach the ratio are left out by length and characters, without loss; long texts of one
    language share most characters, and a ratio of 0.6 promises no longer run than one, so a category costs up to the square of its size, dealt out by character.
    """
    low = beliefs.select("belief_id", "category", F.lower("belief_text").alias("text"))
    near = likely_pairs(low.select("category", F.col("text").alias("l")), low.select("category", F.col("text").alias("r")), 0.6, "category").where("l <= r")
    hits = matching_ratio(near, "l", "r").where("ratio BETWEEN 0.6 AND 0.95")
    side = lambda name, text: low.select("category", F.col("belief_id").alias(name), F.col("text").alias(text))
    found = hits.join(side("x", "l"), ["category", "l"]).join(side("y", "r"), ["category", "r"])
    return found.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("ratio", 6).alias("ratio"))


def superseded(items: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """``items`` with superseded_by from ``outcomes`` (winner, loser); the smallest winner of several."""
    last = outcomes.groupBy(F.col("loser").alias(key)).agg(F.min("winner").alias("superseded_by"))
    return items.join(last, key, "left")


def validated(items: DataFrame, conversation: str = "text", thresholds: dict[str, float] | None = None) -> DataFrame:
    """Extracted items (confidence, source, quote) whose quote their text supports, with capped confidence; those under their source's threshold go."""
    from emberlake.functions.text import capped_confidence, quote_window

    quote, said = F.col("quote"), F.col(conversation)
    checked = items.withColumn("supported", quote_supported(quote, said) | quote_window(quote, said))
    kept = checked.where("supported").drop("supported").withColumn("confidence", capped_confidence(F.col("confidence"), F.col("source")))
    if not thresholds:
        return kept
    return kept.where(F.col("confidence") >= F.coalesce(F.try_element_at(literal_map(thresholds), F.col("source")), F.lit(0.0)))


def degenerate(items: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, n, degenerate): whether a group's confidences lie so close together that they say nothing."""
    spread, least = DEGENERATE
    told = items.groupBy(key).agg(F.count(confidence).alias("n"), F.stddev_pop(confidence).alias("spread"))
    return told.select(key, "n", ((F.col("n") >= least) & (F.col("spread") < spread)).alias("degenerate"))


def active_preferences(preferences: DataFrame, active_only: bool = True, category: str | None = None) -> DataFrame:
    """A user's preferences (category, superseded_by), without superseded ones unless asked for, of one category if given."""
    found = preferences.where("superseded_by IS NULL") if active_only else preferences
    return found if category is None else found.where(F.col("category") == category)


def coerced(value, table: tuple[dict[str, str], str]):
    """A model's word as a value of an enumeration, by a table and what unknown words become; null stays null."""
    allowed, default = table
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(literal_map(allowed), value), F.lit(default)))
