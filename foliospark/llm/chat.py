"""Chat formatting with Spark expressions only.

Template: a block `<s>[INST]role[/INST]text</s>` for each run of adjacent turns of one role, the texts of a run joined
by `<sep>`. Control strings inside roles and texts are escaped reversibly, so that a formatted conversation can be read
back to the turns it was made of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings. None of them holds a backslash.
OPEN, HEAD, TEXT, JOIN, CLOSE = "<s>", "[INST]", "[/INST]", "<sep>", "</s>"
CONTROL = (OPEN, HEAD, TEXT, JOIN, CLOSE)


def escape(c: Column) -> Column:
    """Backslashes doubled, then one put after the first character of each control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROL, c)


def unescape(c: Column) -> Column:
    """A backslash pair is a backslash; a single one goes."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def running(lengths: Column) -> Column:
    """For each of an array of numbers, the sum of those before it. Runs of about the square root of the array's length
    are summed first, so that no long array is copied for each of its elements."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("before"))

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["total"] + F.coalesce(x, F.lit(0))).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))

    def cut(xs: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs)))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), step), lambda at: sums(F.slice(xs, at, step)))

    def put_together(runs: Column) -> Column:
        starts = sums(F.transform(runs, lambda r: r["total"]))["before"]
        return F.flatten(F.zip_with(runs, starts, lambda r, x: F.transform(r["before"], lambda y: x + y)))

    return bound(bound(lengths, cut), put_together)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start:long,stop:long>>) for each conversation.

    Turns are ordered by turn, then role and text (ties), nulls first. Adjacent turns of a role share a block. loss has
    the code-point spans of the escaped texts whose role is in `learn`. Null roles and texts are empty ones; rows with
    a null conversation id form one conversation; repeated rows are turns of their own; other columns are ignored
    whatever their names; an empty table gives an empty one.

    A conversation's turns are collected as structs and sorted; the places where the role changes cut the array into
    runs, whose texts are joined. Work grows in proportion to a conversation's size, which is one row of the result."""
    turn = F.struct(F.col(f"`{turn_col}`").alias("t"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("x"))
    rows = df.groupBy(F.col(f"`{conv_col}`").alias("c")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role = lambda i: F.get(F.col("turns"), i)["r"]
    changes = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    rows = rows.withColumn("changes", changes)
    runs = F.arrays_zip(F.col("changes").alias("a"), F.concat(F.slice("changes", 2, F.size("changes")), F.array(F.size("turns"))).alias("b"))
    run = lambda z: F.struct(role(z["a"]).alias("r"), F.transform(F.slice("turns", z["a"] + 1, z["b"] - z["a"]), lambda s: escape(s["x"])).alias("xs"))
    rows = rows.withColumn("runs", F.transform(runs, run))
    block = lambda s: F.struct(F.concat(F.lit(OPEN + HEAD), escape(s["r"]), F.lit(TEXT)).alias("head"), F.array_join(s["xs"], JOIN).alias("body"))
    rows = rows.withColumn("blocks", F.transform("runs", block))
    rows = rows.withColumn("starts", running(F.transform("blocks", lambda s: (F.length(s["head"]) + F.length(s["body"]) + len(CLOSE)).cast("long"))))
    places = F.filter(F.arrays_zip("runs", "blocks", "starts"), lambda z: z["runs"]["r"].isin(*learn))

    def spans(z: Column) -> Column:
        at = z["starts"] + F.length(z["blocks"]["head"])
        sizes = F.transform(z["runs"]["xs"], lambda x: F.length(x).cast("long"))
        place = lambda ns: F.zip_with(ns, running(F.transform(ns, lambda n: n + len(JOIN))), lambda n, o: F.struct((at + o).alias("start"), (at + o + n).alias("stop")))
        return bound(sizes, place)

    formatted = F.array_join(F.transform("blocks", lambda s: F.concat(s["head"], s["body"], F.lit(CLOSE))), "")
    return rows.select(F.col("c").alias(conv_col), formatted.alias("formatted"), F.flatten(F.transform(places, spans)).alias("loss"))


def read_chats(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted conversation, unescaped."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        inner = F.substring(b, len(OPEN + HEAD) + 1, 1 << 30)
        role = unescape(F.substring_index(inner, TEXT, 1))
        texts = F.split(F.regexp_replace(inner, r"(?s)^.*?\[/INST\]", ""), JOIN, -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all conversations and of conversation -7, read back from the formatted texts."""
    tricky = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    out = format_chats(rows.unionByName(extra))
    turns, learned = read_chats(F.col("formatted")), learned_text(F.col("formatted"), F.col("loss"))
    out = out.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Counts and digests from the rows themselves; the escaped length follows from the template.
OP6_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after,
    length(x) + (length(x) - length(replace(x, '\\', '')))
      + (length(x) - length(replace(x, '<s>', ''))) // 3 + (length(x) - length(replace(x, '[INST]', ''))) // 6
      + (length(x) - length(replace(x, '[/INST]', ''))) // 7 + (length(x) - length(replace(x, '<sep>', ''))) // 5
      + (length(x) - length(replace(x, '</s>', ''))) // 4 AS body
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, x)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(body + CASE WHEN before IS NOT DISTINCT FROM r THEN 5 ELSE 16 + length(r) END
      + CASE WHEN after IS NOT DISTINCT FROM r THEN 0 ELSE 4 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
