"""Quotation linking for chat threads (native DataFrame functions only).

A message's lines are parsed into nested quote levels by their leading `>` marks. Each maximal run of quoted lines of one
level is a passage; it is normalised (A-Z lower-cased, white space squeezed) and hashed, whole and line by line. A passage
links to the message of the same conversation that wrote it: the latest earlier turn whose own text is that passage or has it as
a paragraph, or the one turn that is the latest to have each of its lines. A message's parent is the origin of its last quoted
passage of level 1, or else the turn before it. Conversations come out in reply order: a turn, then what quotes it (by turn), each
with all of its own replies, then what follows it without a quote.

A run of turns of which each answers the one before is a branch; a turn that answers another one heads a new branch. A turn's
reply path names the turn at which each branch on the way from the first turn is left, and the turn itself: within branches the
chain of parents is turn by turn. Paths of branches are built by pointer doubling, and reply order is the order of paths.

Defined results: null text is empty; a null conv_id is a conversation of its own; a null turn sorts first and a null role
stays null. Equal turns are ordered by role and text. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def quote_level(line: Column) -> Column:
    """How many `>` marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _CAPITALS, _SMALL), r"\s+", " "))


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, own (text without quotes), depth (deepest level), passages (pos, level, hash of the whole, hashes of lines)."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.struct(quote_level(x).alias("level"), unquoted(x).alias("line"))
    )
    passage = "struct<level:int,text:string>"
    runs = F.aggregate(
        F.col("_lines"),
        F.array().cast(f"array<{passage}>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["level"] == x["level"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(x["level"].alias("level"), F.concat_ws("\n", F.get(acc, F.size(acc) - 1)["text"], x["line"]).alias("text")).cast(passage)),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["line"].alias("text")).cast(passage)))),
    )
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    quoted = F.filter(F.col("_runs"), lambda r: (r["level"] > 0) & (normalise(r["text"]) != ""))
    return (
        messages.select("conv_id", "turn", "role", "text")
        .withColumn("_lines", lines)
        # Runs are joined line by line only where a line is quoted at all.
        .withColumn("_runs", F.when(F.exists("_lines", lambda x: x["level"] > 0), runs).otherwise(F.array().cast(f"array<{passage}>")))
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.regexp_replace(own, r"^\s+|\s+$", "").alias("own"),
            F.array_max(F.transform("_lines", lambda x: x["level"])).alias("depth"),
            F.transform(
                quoted,
                lambda r, i: F.struct(
                    i.alias("pos"), r["level"].alias("level"), F.xxhash64(normalise(r["text"])).alias("whole"), F.array_distinct(F.transform(F.filter(F.split(r["text"], "\n"), lambda y: normalise(y) != ""), lambda y: F.xxhash64(normalise(y)))).alias("lines")
                ),
            ).alias("passages"),
        )
    )


def _branches(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """parsed with its links, place (from 1 in the conversation), parent_turn, heads (whether a branch begins) and branch (from 0)."""
    order = W.partitionBy("_conv").orderBy("turn", "role", "text")
    linked = (
        parsed.join(found, ["_conv", "_id"], "left")
        .withColumn("previous_turn", F.lag("turn").over(order))
        .withColumn("place", F.row_number().over(order))
        .withColumn("parent_turn", F.coalesce("quoted_turn", "previous_turn"))
        .withColumn("heads", F.col("quoted_turn").isNotNull() & ~F.col("quoted_turn").eqNullSafe(F.col("previous_turn")))
    )
    return linked.withColumn("branch", F.sum(F.when(F.col("heads"), 1).otherwise(0)).over(order))


def _branch_paths(linked: DataFrame) -> DataFrame:
    """_conv, branch and path: the places and turns at which the branches above are left, from the first one; of all branches but it."""
    rows = linked.select("_conv", "turn", "place", "branch", "heads", "quoted_turn")
    # An answer goes to the first row of its turn.
    targets = rows.groupBy("_conv", F.col("turn").cast("long").alias("quoted_turn")).agg(F.min(F.struct("place", "branch")).alias("at"))
    paths = materialize(
        rows.where("heads")
        .select("_conv", "branch", F.col("quoted_turn").cast("long").alias("quoted_turn"))
        .join(targets, ["_conv", "quoted_turn"])
        .select("_conv", "branch", F.col("at.branch").alias("up"), F.array(F.struct(F.col("at.place").alias("place"), F.col("quoted_turn").alias("turn"))).alias("path")),
        "branches",
    )
    # Each round doubles the branches that a path covers.
    while not paths.where(F.col("up") > 0).isEmpty():
        above = paths.select("_conv", F.col("branch").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        paths = materialize(
            paths.join(above, ["_conv", "up"], "left").select(
                "_conv", "branch", F.coalesce("_up", F.lit(0)).cast("long").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")
            ),
            "branches",
        )
    return paths.select("_conv", "branch", "path")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own, depth, n_passages, n_linked, quoted_turn, parent_turn, reply_path and reply_order.

    Own texts meet quoted passages by conversation and hash, never as pairs of messages; the latest earlier origin wins.
    """
    parsed = parse_messages(messages).withColumns(
        {
            "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("~")),
            "_id": F.xxhash64("turn", F.coalesce("role", F.lit("~")), F.coalesce("text", F.lit("~"))),
        }
    )
    pieces = F.array_distinct(
        F.concat(
            F.array(F.xxhash64(normalise(F.col("own")))),
            F.transform(F.filter(F.split("own", r"\n"), lambda x: normalise(x) != ""), lambda x: F.xxhash64(normalise(x))),
            F.transform(F.split("own", r"\n[ \t]*\n"), lambda x: F.xxhash64(normalise(x))),
        )
    )
    quoting = parsed.where(F.size("passages") > 0)
    wanted = quoting.select("_conv", "_id", F.col("turn").alias("at"), F.explode("passages").alias("p"))
    parts = F.concat(F.array(F.struct(F.lit(True).alias("all"), F.col("p.whole").alias("hash"))), F.transform("p.lines", lambda x: F.struct(F.lit(False).alias("all"), x.alias("hash"))))
    wanted = wanted.select("_conv", "_id", "at", "p.pos", "p.level", F.explode(parts).alias("part")).select("_conv", "_id", "at", "pos", "level", "part.all", "part.hash")
    # What is quoted at all is asked for first, so that only such pieces of own text are kept; one row per distinct hash.
    origins = (
        parsed.where(F.col("own") != "")
        .select("_conv", F.col("turn").cast("long").alias("at"), F.explode(pieces).alias("hash"))
        .join(wanted.select("_conv", "hash").distinct(), ["_conv", "hash"], "left_semi")
        .distinct()
        .select("_conv", "hash", "at", F.col("at").alias("origin"))
    )
    # The latest earlier origin by a running maximum over one sorted pass, not by pairs of quotes and origins.
    before = W.partitionBy("_conv", "hash").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    # All lines of a passage must have the same latest origin.
    line = F.when(~F.col("all"), F.coalesce("origin", F.lit(-1 << 62)))
    by_lines = F.when(F.min(line) == F.max(line), F.max(F.when(~F.col("all"), F.col("origin"))))
    found = (
        wanted.withColumn("at", F.col("at").cast("long"))
        .unionByName(origins, allowMissingColumns=True)
        .withColumn("origin", F.max("origin").over(before))
        .where(F.col("_id").isNotNull())
        .groupBy("_conv", "_id", "pos", "level")
        .agg(F.greatest(F.max(F.when(F.col("all"), F.col("origin"))), by_lines).alias("origin"))
        .groupBy("_conv", "_id")
        .agg(
            F.count("origin").alias("n_linked"),
            F.max_by("origin", F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.col("pos"))).alias("quoted_turn"),
        )
    )
    found = materialize(found, "quotes")  # one row per quoting message; used for branches and for the result
    linked = _branches(parsed, found)
    answered = found.where(F.col("quoted_turn").isNotNull()).select("_conv").distinct()
    paths = _branch_paths(_branches(parsed.join(answered, "_conv", "left_semi"), found))
    place = F.struct(F.col("place"), F.col("turn").cast("long").alias("turn"))
    whole = linked.join(paths, ["_conv", "branch"], "left").withColumn(
        "_path", F.concat(F.coalesce("path", F.array().cast("array<struct<place:int,turn:bigint>>")), F.array(place))
    )
    return whole.select(
        "conv_id",
        "turn",
        "role",
        "own",
        "depth",
        F.size("passages").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("quoted_turn"),
        "parent_turn",
        F.transform("_path", lambda x: x["turn"]).alias("reply_path"),
        F.row_number().over(W.partitionBy("_conv").orderBy("_path")).cast("long").alias("reply_order"),
    )
