"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context,
only its text carries loss. Turns behind the last assistant turn form one more example
with an empty loss span, so the examples of a conversation hold all of its turns.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. Inside roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``; a newline in a role becomes ``<\\n|``.
An escaped text holds no ``<|``, so control strings in texts can't end a turn, and since
doubled backslashes come in even runs, both substitutes can be told from text.

Defined results: null texts and roles are empty; rows of one turn number are ordered by
role and text and all kept, repeated rows too; a null turn number comes first; rows with
a null conversation id form one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def prefix_target_examples(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Examples of all conversations.

    Takes conv_id, turn, role, text. Returns conv_id, example (from 0), formatted, loss_start
    (from 0) and loss_length in characters of ``formatted`` as escaped there (both over the
    target's text, without its end mark), has_target, is_last (the example holds all turns).
    The conversation is the unit of an example, so its turns meet in one row.
    """
    turns = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("turns"))
    )
    said = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("turns", lambda t: t["role"] == assistant).alias("is_target"),
    )
    size = F.size("bodies")
    # An example ends at each assistant turn, and at the last turn whoever has said it.
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.get("is_target", i - 1) | (i == size))
    placed = said.select("*", F.posexplode(ends).alias("example", "end"))
    target = F.get("bodies", F.col("end") - 1)
    context = F.array_join(
        F.zip_with(F.slice("heads", F.lit(1), F.col("end") - 1), F.slice("bodies", F.lit(1), F.col("end") - 1), lambda h, b: F.concat(h, b, F.lit(END + "\n"))), ""
    )
    opened = placed.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.concat(context, F.get("heads", F.col("end") - 1)).alias("before"),
        target.alias("target"), F.get("is_target", F.col("end") - 1).alias("has_target"), (F.col("end") == size).alias("is_last"),
    )
    return opened.select(
        "conv_id", "example", F.concat("before", "target", F.lit(END + "\n")).alias("formatted"),
        F.length("before").cast("long").alias("loss_start"),
        F.when(F.col("has_target"), F.length("target")).otherwise(0).cast("long").alias("loss_length"), "has_target", "is_last",
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples.

    n_turns and turns_sha256 come from the example that holds all turns, the loss columns
    from the loss spans of all examples in order; formatted_chars counts all examples.
    """
    turns = F.when(F.col("is_last"), parsed_turns(F.col("formatted")))
    read = examples.select(
        "conv_id", "example", "has_target",
        F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))).alias("loss"), F.length("formatted").alias("chars"),
    )
    per = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("n") >= 0, F.col("n"))).alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("has_target"), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    return per.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )


#: DuckDB's form of :func:`digests`; %s: a relation with conv_id, turn, role, text.
DIGESTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (%s)
), p AS (
  SELECT *, role = 'assistant' AS target,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(22 + 1 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 1)
      OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (target), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (target), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (target OR k = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (target OR k = n) AS n_examples
FROM p GROUP BY conv_id
"""
