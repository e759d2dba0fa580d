"""Repair of the structure of conversations, by folding over their turns.

A conversation should read: a system turn or none, then user and assistant in
turn. Each row may be kept (0), given the role user or assistant (2) or deleted
(3, and it must be if it is blank or repeats an earlier one); turns without text
may be inserted anywhere (2); a truncated row that stays costs 1 more. Of the
cheapest edits those with the ASCII-least initials (K, R, D, I) are taken.

Windows derive the flags of each row, sorted structs of them are collected, and
aggregate() carries four (cost, audit) structs, one for each thing that may stand
last (nothing, system, user, assistant), through native least expressions. Two
audits of equal cost at one row never begin with one another, as an insertion
always costs, so the least of the prefixes leads to the least of the whole.

A conversation may hold a third of all rows. Rows are sorted by ranges and written,
and a conversation is folded in blocks of at most BLOCK rows, a later block from
each of the four states; what blocks make of a state is then composed, FAN blocks
at a time. Texts are in none of these steps; they meet the edits block by block.
One digest of a long conversation is a sequential thing: its blocks pass one after
another through one task, a batch at a time.

Rows: nulls of any column stand as one space where they are read as text; a null
turn sorts first, a null conversation is one of its own. Rows of equal turn are
ordered by a digest of role and text. Repeated rows are duplicates of the first. An
empty text is blank. A conversation of no rows has no edits. An empty table gives
an empty one. Very long texts are only read whole by the digests of their rows.
Other columns, of whatever names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import barrier
from .common import materialise

#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: More than any edits cost.
NEVER = 1 << 40
#: Rows of a block (a power of two), and blocks composed at a time.
BLOCK, FAN = 256, 64
#: What may stand last: nothing yet, or a turn of that initial.
STATES = ("e", "s", "u", "a")
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}


def shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and alive of messages that lose or change some
    rows, by a checksum of conversation and turn: to measure a repair by. A row
    that is dropped stays with alive false."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(F.col(text_col)), "[.!?]", "")).otherwise(shown(F.col(text_col)))
    role = F.when(kind == 4, "user").otherwise(shown(F.col(role_col)))
    copies = F.explode(F.array_repeat(kind > 0, F.when(kind == 3, 2).otherwise(1))).alias("alive")
    return messages.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), copies)


def placed(rows: DataFrame) -> DataFrame:
    """The rows written in order, with pos, which grows with it, and block."""
    name = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    mark = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    made = rows.withColumns({"c": name, "mark": mark, "tie": F.monotonically_increasing_id()})
    order = ["c", F.col("turn").asc_nulls_first(), "mark", "tie"]
    pos = F.monotonically_increasing_id()
    made = made.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("pos", pos)
    return materialise(made.withColumn("block", F.shiftright("pos", BLOCK.bit_length() - 1)))


def flagged(rows: DataFrame) -> DataFrame:
    """Each row's flags, and head: whether its block begins its conversation. What
    was seen first of a message is aggregated before it moves, so that one said a
    million times is no group of a task."""
    firsts = rows.groupBy("c", "mark").agg(F.min("pos").alias("pos")).select("c", "pos", F.lit(False).alias("head"))
    heads = rows.groupBy("c").agg(F.min("pos").alias("pos")).select("c", "pos", F.lit(True).alias("head"))
    firsts = firsts.unionByName(heads).groupBy("c", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(F.collect_set("pos").alias("firsts"), F.max("head").alias("head"))
    bare = F.btrim("text", F.lit(BLANK))
    narrow = rows.select("c", "block", "pos", "conv_id", "turn", F.substring("role", 1, 1).alias("i"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    before = W.partitionBy("c", "block").orderBy("pos")
    near = narrow.withColumns({"i_before": F.lag("i").over(before), "turn_before": F.lag("turn").over(before)})
    seen = near.join(firsts, ["c", "block"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    again = ~F.col("blank") & ~F.coalesce(F.array_contains("firsts", F.col("pos")), F.lit(False))
    cut = ~F.col("blank") & ~again & F.col("open")
    clash = F.col("i_before").isNotNull() & ~F.concat("i_before", "i").isin(*LEGAL)
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return seen.withColumns({"duplicate": again, "truncated": cut, "illegal": clash, "new_turn": new}).drop("firsts")


# -- the fold ---------------------------------------------------------------------
def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def state(cost: Column | int, audit: Column | str) -> Column:
    kinds = [F.lit(x) if isinstance(x, (int, str)) else x for x in (cost, audit)]
    return F.struct(kinds[0].cast("long").alias("cost"), kinds[1].alias("audit"))


def then(x: Column, cost: Column | int, letter: Column | str) -> Column:
    return state(x["cost"] + cost, F.concat(x["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def vector(**of: Column) -> Column:
    return F.struct(*[of[k].alias(k) for k in STATES])


def started(at: str) -> Column:
    return vector(**{k: state(0 if k == at else NEVER, "") for k in STATES})


def inserted(v: Column) -> Column:
    """The states after turns may have been inserted."""
    user = F.least(v["u"], *[then(v[k], INSERT, "I") for k in "esa"])
    with_user = vector(e=v["e"], s=v["s"], u=user, a=v["a"])
    return let(with_user, lambda w: vector(e=w["e"], s=w["s"], u=w["u"], a=F.least(w["a"], then(w["u"], INSERT, "I"))))


def stepped(v: Column, r: Column) -> Column:
    """The states after a row: i is its role's initial, gone whether it must be
    deleted, cut whether it is truncated."""
    kept = r["cut"].cast("long")

    def put(x: Column, role: str) -> Column:
        same = r["i"] == role
        return then(x, F.when(same, kept + KEEP).otherwise(kept + REROLE), F.when(same, "K").otherwise("R"))

    def moved(w: Column) -> Column:
        out = {k: then(w[k], DELETE, "D") for k in STATES}
        stay = vector(
            e=out["e"],
            s=F.when(r["i"] == "s", F.least(out["s"], then(w["e"], kept + KEEP, "K"))).otherwise(out["s"]),
            u=F.least(out["u"], put(F.least(w["e"], w["s"], w["a"]), "u")),
            a=F.least(out["a"], put(w["u"], "a")),
        )
        return F.when(r["gone"], vector(**out)).otherwise(stay)

    return let(inserted(v), moved)


def folded(steps: Column, head: Column) -> Column:
    """What a block makes of the states it may begin in: of nothing where it begins
    a conversation, else of each of the four; with path, the state that it ends in."""
    starts = F.when(head, F.array(started("e"))).otherwise(F.array(*map(started, STATES)))
    ends = F.transform(starts, lambda v: F.aggregate(steps, v, stepped))
    return F.transform(ends, lambda v: F.struct(*[F.struct(v[k]["cost"].alias("cost"), v[k]["audit"].alias("audit"), F.lit(k).alias("path")).alias(k) for k in STATES]))


def composed(parts: Column) -> Column:
    """What blocks make of a state one after another; all but the first have a row
    for each state."""

    def after(v: Column, m: Column) -> Column:
        joint = lambda j, k: F.struct(*[(v[j][x] + m[n][k][x] if x == "cost" else F.concat(v[j][x], m[n][k][x])).alias(x) for n in (STATES.index(j),) for x in ("cost", "audit", "path")])
        return F.struct(*[F.least(*[joint(j, k) for j in STATES]).alias(k) for k in STATES])

    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.aggregate(rest, parts[0], lambda made, m: F.transform(made, lambda v: after(v, m)))


def block_sums(flags: DataFrame) -> DataFrame:
    """A row per block of a conversation: counts, what stands at its ends, and what
    it makes of each state (m)."""
    n = lambda c: F.count_if(F.col(c)).alias(c)
    at = lambda f, c, name: f(c, "pos").alias(name)
    step = F.struct("pos", "i", (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("cut"))
    made = flags.groupBy("c", "block").agg(
        F.first("conv_id").alias("conv_id"), F.max("head").alias("head"), F.min("turn").alias("least"), F.max("turn").alias("most"), *map(n, ("new_turn", "blank", "duplicate", "truncated", "illegal")),
        at(F.min_by, "i", "i_first"), at(F.max_by, "i", "i_last"), at(F.min_by, "turn", "turn_first"), at(F.max_by, "turn", "turn_last"), F.sort_array(F.collect_list(step)).alias("steps"),
    )
    return materialise(made.withColumn("m", folded(F.col("steps"), F.col("head"))).drop("steps"))


def joined_up(blocks: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Neighbouring blocks as one: sums, what clashes where they meet, and m."""
    part = F.struct("block", *[c for c in blocks.columns if c not in ("c", "block", "conv_id")])
    made = blocks.groupBy(*keys).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("block", part.alias("x")))), asc=True).alias("xs"))
    made = barrier(made, xs=F.transform("xs", lambda v: v["x"]))
    first, last = F.get("xs", F.lit(0)), F.try_element_at("xs", F.lit(-1))
    total = lambda c: F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x[c])
    meet = lambda f: F.when(F.size("xs") > 1, F.aggregate(F.sequence(F.lit(1), F.size("xs") - 1), F.lit(0).cast("long"), lambda s, k: s + f(F.get("xs", k - 1), F.get("xs", k)).cast("long"))).otherwise(0)
    clash = meet(lambda a, b: ~F.concat(a["i_last"], b["i_first"]).isin(*LEGAL))
    # a block's first turn counts as new; it isn't if the block before ended with it
    same = meet(lambda a, b: F.coalesce(a["turn_last"] == b["turn_first"], F.lit(False)))
    return made.select(
        *[k for k in ("c", "group") if k in made.columns], "conv_id", first["block"].alias("block"), F.coalesce(first["head"], F.lit(False)).alias("head"), F.array_min(F.transform("xs", lambda x: x["least"])).alias("least"), F.array_max(F.transform("xs", lambda x: x["most"])).alias("most"),
        (total("new_turn") - same).alias("new_turn"), *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")], (total("illegal") + clash).alias("illegal"),
        *[(first if c.endswith("first") else last)[c].alias(c) for c in ("i_first", "i_last", "turn_first", "turn_last")], F.when(F.size("xs") > 0, composed(F.transform("xs", lambda x: x["m"]))).alias("m"),
    )


def edits(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, and path, the state that each
    of its blocks ends in."""
    none = rows.where("NOT alive").groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    at = blocks
    while (at.groupBy("c").count().agg(F.max("count")).first()[0] or 0) > FAN:
        rank = F.row_number().over(W.partitionBy("c").orderBy("block")) - 1
        at = materialise(joined_up(at.withColumn("group", F.floor(rank / FAN)), ["c", "group"]).drop("group"))
    whole = barrier(joined_up(at.unionByName(none, allowMissingColumns=True), ["c"]), m=F.col("m"))
    blank_end = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))
    v = F.get("m", F.lit(0))
    add = lambda x, n: F.struct((x["cost"] + n * INSERT).alias("cost"), F.concat(x["audit"], F.lit("I" * n)).alias("audit"), x["path"].alias("path"))
    best = F.when(F.col("m").isNotNull(), F.least(v["e"], v["a"], add(v["u"], 1), add(v["s"], 2))).otherwise(blank_end)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.when(F.col("least").isNotNull(), F.col("most") - F.col("least") + 1 - F.col("new_turn")).otherwise(0).cast("long")
    return barrier(whole, best=best).select("c", "conv_id", gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated", "illegal")), "best.cost", "best.audit", "best.path")


# -- what the edits make -------------------------------------------------------------
def repaired_blocks(rows: DataFrame, blocks: DataFrame, done: DataFrame) -> DataFrame:
    """c, block, blocks (how many its conversation has) and lines, the repaired
    turns of each block as structs of role and text."""
    order = blocks.select("c", "block", "m").withColumn("k", F.row_number().over(W.partitionBy("c").orderBy("block")))
    at = order.join(done.select("c", "path", F.col("audit").alias("all")), "c")
    enter = F.when(F.col("k") == 1, "e").otherwise(F.substring("path", F.col("k") - 1, F.lit(1)))
    leave = F.substring("path", F.col("k"), F.lit(1))
    row = F.get("m", F.when(F.col("k") == 1, 0).otherwise(F.position(enter, F.lit("".join(STATES))) - 1))
    mine = F.coalesce(*[F.when(leave == s, row[s]["audit"]) for s in STATES])
    last = F.col("k") == F.length("path")
    tail = F.when(last, F.regexp_extract("all", "I*$", 0)).otherwise("")
    pieces = at.select("c", "block", F.length("path").alias("blocks"), enter.alias("enter"), F.concat(mine, tail).alias("piece"))
    texts = rows.where("alive").groupBy("c", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    both = texts.join(pieces, ["c", "block"])
    gone = F.length(F.regexp_extract("piece", "^D*", 0))
    system = (F.col("enter") == "e") & (F.substring("piece", gone + 1, F.lit(1)) == "K") & (F.substring(F.get("rows", gone)["role"], 1, 1) == "s")
    both = both.withColumn("odd", (system | (F.col("enter") == "u")).cast("int"))
    head = lambda k: F.substring("piece", F.lit(1), k)
    marks = F.transform(
        F.sequence(F.lit(1), F.length("piece")),
        lambda k: F.struct(F.substring("piece", k, F.lit(1)).alias("op"), (F.length(F.replace(head(k), F.lit("I"))) - 1).alias("row"), F.length(F.replace(head(k), F.lit("D"))).alias("out")),
    )
    user = lambda x: F.when((x["out"] - 1 + F.col("odd")) % 2 == 0, ROLE["u"]).otherwise(ROLE["a"])
    line = lambda x: F.struct(
        F.when(x["op"] == "K", F.get("rows", x["row"])["role"]).otherwise(user(x)).alias("role"), F.when(x["op"] == "I", "").otherwise(F.get("rows", x["row"])["text"]).alias("text")
    )
    lines = F.when(F.length("piece") > 0, F.transform(F.filter(marks, lambda x: x["op"] != "D"), line))
    return both.select("c", "block", "blocks", F.coalesce(lines, F.array().cast("array<struct<role:string,text:string>>")).alias("lines"))


def digests(parts: DataFrame) -> DataFrame:
    """c and repaired_sha256 of conversations: of one block in a column, of several
    by a digest that their blocks pass through in order."""
    shape = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    parts = parts.select("c", "block", "blocks", F.when(F.size("lines") > 0, shape).alias("said"))
    short = parts.where("blocks = 1").select("c", F.sha2(F.coalesce("said", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, some = None, hashlib.sha256(), False
        row = lambda: pa.RecordBatch.from_pydict({"c": [now], "repaired_sha256": [sha.hexdigest()]})
        for batch in batches:
            for c, said in zip(batch.column(0), batch.column(1)):
                if c.as_py() != now:
                    if now is not None:
                        yield row()
                    now, sha, some = c.as_py(), hashlib.sha256(), False
                if said.is_valid:
                    sha.update((b"\n" if some else b"") + said.as_py().encode())
                    some = True
        if now is not None:
            yield row()

    long = parts.where("blocks > 1").repartition("c").sortWithinPartitions("c", "block").select("c", "said")
    return short.unionByName(long.mapInArrow(hashed, "c string, repaired_sha256 string"))


def repair(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages: conv_id, turn, role, text and, if rows may be there for their
    conversation's name alone, alive. Returns a row per conversation (c, conv_id,
    counts of faults, cost, audit) and the repaired blocks, see repaired_turns."""
    given = messages if "alive" in messages.columns else messages.withColumn("alive", F.lit(True))
    given = given.select("conv_id", "turn", shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"), "alive")
    rows = placed(given)
    blocks = block_sums(flagged(rows.where("alive")))
    done = materialise(edits(rows, blocks))
    return done, repaired_blocks(rows, blocks, done)


def repaired_turns(messages: DataFrame) -> DataFrame:
    """conv_id, block, place, role and text: the turns of repaired conversations;
    block and place give their order."""
    done, parts = repair(messages)
    names = done.select("c", "conv_id")
    return parts.join(names, "c").select("conv_id", "block", F.posexplode("lines").alias("place", "x")).select("conv_id", "block", "place", "x.*")


def repair_report(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256, of its turns as role:text lines."""
    done, parts = repair(messages)
    empty = F.lit(hashlib.sha256().hexdigest())
    found = done.drop("path").join(digests(parts), "c", "left")
    return found.drop("c").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
