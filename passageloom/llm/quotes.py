"""Conversations without quotations, linked by what they quote; in DataFrame
functions.

The lines of a message carry a quote level, the number of ">" before them. A
quoted line is normalised (A-Z lower-cased, white space collapsed), hashed and
joined to the first earlier message of the conversation that says it unquoted;
the texts are compared as well. Lines that are no line of an earlier message are
joined to passages over their breaks and looked for in its text, whole or by
sentence; see passage_votes. The message it answers is the one that most of
its lines of the lowest quoted level come from, the later one on a tie. Replies
then lead to the message that began their thread, found by doubling the links.
Messages in the order of thread_turn and turn have every reply after what it
answers and every thread together.

Originals are reduced to one row per conversation and line before the join, and
no conversation is gathered in one task: one may hold a third of all messages.

Rows: a null text is empty. Messages without a conversation or turn aren't
linked. Messages that share both count as one when they are linked. Lines
without a letter or digit link nothing. Lines that announce a quotation go from
the text with it, and are lines like any other when messages are linked. Very long
texts are read line by line, whole. An empty table gives no row. Other columns, of
whatever names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cat
from .common import lower_ascii, materialise, text_of

QUOTED = r"^(?:[ \t]*>)+[ \t]?"
#: "On Monday Ann wrote:" right before a quotation, or with a blank line between; a
#: line that begins with "On" and ends in no full stop belongs to it.
ANNOUNCED = r"(^|\n)(?:On [^\n]*[^ \t\r\n.!?:;][ \t\r]*\n)?[ \t]*(?:[^ \t\n>][^\n]*[ \t])?wrote:[ \t\r]*\n((?:[ \t\r]*\n)?[ \t]*>)"
TELLING = r"[\p{L}\p{N}]"
#: Words of a passage or sentence at least that is looked for within a text; what
#: is shorter links as a whole line or sentence only.
LEAST_WORDS = 3
#: A run that a passage is met by has 2**LONGEST words at most.
LONGEST = 5


def lines(text: Column) -> Column:
    return F.split(text_of(text), "\n")


def level(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, QUOTED, 0), F.lit(">"))


def normalised(line: Column) -> Column:
    bare = F.regexp_replace(line, QUOTED, "")
    return F.btrim(F.regexp_replace(lower_ascii(bare), r"[\x20\x09-\x0D]+", " "))


def unquoted(text: Column) -> Column:
    """The text without its quoted lines and the lines that announce them."""
    bare = F.regexp_replace(text_of(text), ANNOUNCED, "$1$2")
    return F.array_join(F.filter(lines(bare), lambda x: level(x) == 0), "\n")


def bare_words(passage: Column) -> Column:
    """A normalised passage without anything but letters, digits and single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(passage, r"[^\p{L}\p{M}\p{N} ]+", ""), " +", " "))


def windows(words: Column, n: Column) -> Column:
    """Hashes of the runs of n words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.xxhash64(F.array_join(F.slice(words, k, n), " ")))


def passage_votes(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """conv, turn, level, origin and linked of quoted lines that are no line of an
    earlier message: consecutive ones of a level make a passage, which is looked
    for in the unquoted text of earlier messages over line breaks; where it isn't
    found, its sentences are. A passage or sentence is met by the hash of 2**k of
    its words in a row, most of a short one, and compared as a text; of all such runs the one
    that fewest bodies of the conversation hold, so that a common opening leads to
    no comparisons. One of fewer than LEAST_WORDS words is met as a sentence.

    quoted: conv, turn, m, level, rn and passage; said: conv, turn, body and
    sentences."""
    level = W.partitionBy("conv", "turn", "m", "level").orderBy("rn")
    runs = (
        quoted.withColumn("island", F.col("rn") - F.row_number().over(level))
        .groupBy("conv", "turn", "m", "level", "island")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "passage"))).alias("x"))
        .select("conv", "turn", "m", "level", "island", F.size("x").alias("n"), F.array_join(F.transform("x", lambda v: v["passage"]), " ").alias("text"))
    )
    whole = F.struct(F.lit(True).alias("whole"), bare_words(F.col("text")).alias("unit"), F.col("n").cast("long").alias("weight"))
    each = F.transform(F.split("text", r"(?<=[.!?]) "), lambda v: F.struct(F.lit(False).alias("whole"), bare_words(v).alias("unit"), F.lit(1).cast("long").alias("weight")))
    units = runs.select("conv", "turn", "m", "level", "island", F.explode(F.concat(F.array(whole), each)).alias("u")).select("conv", "turn", "m", "level", "island", "u.*")
    units = materialise(units.withColumn("size", F.size(F.split("unit", " "))).where("unit <> ''"))
    said = materialise(said)
    power = lambda n: F.least(F.floor(F.log2(n)).cast("int"), F.lit(LONGEST))
    run_of = F.pow(F.lit(2.0), F.col("j")).cast("int")
    asked = units.where(F.col("size") >= LEAST_WORDS).select("conv", "unit", "size").distinct().withColumn("j", power(F.col("size")))
    told = said.join(asked.select("conv", "j").distinct(), "conv").withColumn("n", run_of)
    told = told.groupBy("conv", "body", "j", "n").agg(F.min("turn").alias("origin"))
    told = told.withColumn("words", F.split("body", " ")).where(F.size("words") >= F.col("n"))
    told = told.select("conv", "j", "body", "origin", F.explode(F.array_distinct(windows(F.col("words"), F.col("n")))).alias("h"))
    held = told.groupBy("conv", "j", "h").agg(F.count("*").alias("bodies"))
    runs_asked = asked.select("*", F.explode(F.array_distinct(windows(F.split("unit", " "), run_of))).alias("h"))
    rarest = runs_asked.join(held, ["conv", "j", "h"], "left").groupBy("conv", "j", "unit").agg(F.min(F.struct(F.coalesce("bodies", F.lit(0)).alias("bodies"), "h")).alias("x"))
    rarest = rarest.where("x.bodies > 0").select("conv", "j", "unit", F.col("x.h").alias("h"))
    hits = rarest.join(told, ["conv", "j", "h"]).where(F.contains(cat(" ", F.col("body"), " "), cat(" ", F.col("unit"), " ")))
    first = hits.groupBy("conv", "unit").agg(F.min("origin").alias("origin"))
    brief = said.select("conv", "turn", F.explode(F.array_distinct("sentences")).alias("unit")).where(F.size(F.split("unit", " ")) < LEAST_WORDS)
    brief = brief.groupBy("conv", "unit").agg(F.min("turn").alias("origin"))
    first = first.unionByName(brief.join(units.select("conv", "unit").distinct(), ["conv", "unit"], "left_semi"))
    found = units.join(first, ["conv", "unit"]).where("origin < turn")
    run = ["conv", "turn", "m", "level", "island"]
    found = found.withColumn("any", F.max("whole").over(W.partitionBy(*run))).where("whole = any")
    return found.groupBy("conv", "turn", "level", "origin").agg(F.sum("weight").alias("linked"))


def reply_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, parent_turn and linked: quoted lines found in the parent, and
    its sentences found where a quoted passage isn't whole."""
    known = messages.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), lines(F.col(text_col)).alias("lines")
    )
    shape = lambda line: [level(line).alias("level"), normalised(line).alias("passage")]
    telling = F.col("passage").rlike(TELLING)
    said = known.select("conv", "turn", F.explode("lines").alias("line")).select("conv", "turn", *shape(F.col("line"))).where(telling).withColumn("h", F.xxhash64("passage"))
    quoting = known.where(F.exists("lines", lambda x: level(x) > 0)).withColumn("m", F.xxhash64("lines"))
    quoted = quoting.select("conv", "turn", "m", F.posexplode("lines").alias("pos", "line")).select("conv", "turn", "m", "pos", *shape(F.col("line"))).where(telling)
    message = W.partitionBy("conv", "turn", "m").orderBy("pos")
    quoted = materialise(quoted.withColumn("rn", F.dense_rank().over(message)).where("level > 0").withColumn("h", F.xxhash64("passage")))
    asked = quoted.select("conv", "h", "passage").distinct()
    first = said.where("level = 0").groupBy("conv", "h", "passage").agg(F.min("turn").alias("origin"))
    first = materialise(first.join(asked, ["conv", "h", "passage"], "left_semi"))
    votes = quoted.join(first, ["conv", "h", "passage"]).where("origin < turn").groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("linked"))
    found = first.select(*[F.col(c).alias(f"f_{c}") for c in first.columns])
    same = (F.col("conv") == F.col("f_conv")) & (F.col("h") == F.col("f_h")) & (F.col("passage") == F.col("f_passage")) & (F.col("f_origin") < F.col("turn"))
    rest = materialise(quoted.join(found, same, "left_anti").select("conv", "turn", "m", "level", "rn", "passage").distinct())
    unquoted_lines = F.filter(F.transform(F.filter("lines", lambda x: level(x) == 0), normalised), lambda x: x.rlike(TELLING))
    bodies = known.join(rest.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.array_join(unquoted_lines, " ").alias("all"))
    bodies = bodies.select("conv", "turn", bare_words(F.col("all")).alias("body"), F.transform(F.split("all", r"(?<=[.!?]) "), bare_words).alias("sentences"))
    votes = votes.unionByName(passage_votes(rest, bodies)).groupBy("conv", "turn", "level", "origin").agg(F.sum("linked").alias("linked"))
    best = F.struct(-F.col("level"), "linked", "origin")
    chosen = votes.groupBy("conv", "turn").agg(F.max(best).alias("best"))
    return chosen.select("conv", "turn", F.col("best.origin").alias("parent_turn"), F.col("best.linked").alias("linked"))


def threads(links: DataFrame) -> DataFrame:
    """conv, turn and thread_turn, the message that each reply leads back to."""
    at = materialise(links.select("conv", "turn", F.col("parent_turn").alias("up")))
    while True:
        up = at.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"))
        step = at.join(up, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        at = materialise(step.select("conv", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("conv", "turn", F.col("up").alias("thread_turn"))
        at = at.drop("moved")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of reply_ordered, sorted: written out, each conversation stands in
    one piece, thread by thread, with every reply after what it answers; a long one
    runs over several files, so no task gets it whole."""
    return reply_ordered(messages, conv_col, turn_col, role_col, text_col).orderBy("conv_id", "thread_turn", "turn")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, thread_turn, turn, role, parent_turn, n_quoted
    (quoted lines), n_linked, text without quotes, and chat, the text under a
    line that names the role."""
    links = materialise(reply_links(messages, conv_col, turn_col, text_col))
    found = links.join(threads(links), ["conv", "turn"])
    found = found.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent_turn", "thread_turn", "linked")
    bare = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.size(F.filter(lines(F.col(text_col)), lambda x: level(x) > 0)).cast("long").alias("n_quoted"),
        unquoted(F.col(text_col)).alias("text"),
    )
    return bare.join(found, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        "turn",
        "role",
        "parent_turn",
        "n_quoted",
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        "text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text")).alias("chat"),
    )
