"""Quotation linking of chat messages, and conversations without quotes.

A line's quote level is the number of leading '>' (spaces between them allowed). Runs of lines at
one level are passages; level 0 is the message's own text. Passages are normalised (quote marks
off, lower case, white space to single spaces) and hashed. The originals of a conversation - each
message's whole own text, its parts between quotes, its paragraphs and its lines - are reduced to
the earliest turn that has a hash, so that a line that everyone writes is one row; quoted passages
join that row, and link to it if it is an earlier turn. A passage of several lines that finds no
such original links to the earliest turn that has these lines in a row (blank lines aside): messages
of its conversation hash their runs of as many lines as unlinked passages have. A message replies to
the original of its first linked passage of the least level, else it starts a thread. Threads are
followed to their roots by pointer jumping.

Defined results: a null text is empty; messages that only quote have an empty body; null conv_id or
turn cannot be quoted or reply; repeated rows are separate messages of one turn; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import forget, materialize

#: Tasks over which the messages of one conversation are dealt where runs of lines are asked for.
SPREAD = 32
MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def level(line: Column) -> Column:
    """Quote level of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hashed(text: Column) -> Column:
    return F.xxhash64(normalised(text))


def filled(text: Column) -> Column:
    """The normalised lines of a text, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def parse(messages: DataFrame) -> DataFrame:
    """Adds body (own text), passages (level, text, place) and units (own texts that may be quoted)
    to conv_id, turn, role. Everything is computed in the message's own row."""
    d = messages.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\r?\n").alias("raw"))
    d = d.withColumn("lines", F.transform("raw", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))))
    # A passage begins where the level changes.
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    d = d.withColumn("begins", begins)

    def passage(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("lines"))
        parts = F.slice("lines", i + 1, end - i)
        return F.struct(F.get("lines", i)["level"].alias("level"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), k.alias("place"))

    d = d.withColumn("parts", F.transform("begins", passage))
    own = F.filter("parts", lambda p: p["level"] == 0)
    d = d.withColumn("body", F.regexp_replace(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), r"^\s+|\s+$", ""))
    units = F.concat(F.array("body"), F.transform(own, lambda p: p["text"]), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    d = d.withColumn("units", F.array_distinct(F.filter(F.transform(units, normalised), lambda u: u != "")))
    quoted = F.filter("parts", lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))
    return d.select("conv_id", "turn", "role", "body", "units", quoted.alias("quotes"))


def originals(parsed: DataFrame) -> DataFrame:
    """(conv, h, first): the earliest turn of a conversation that has a normalised text."""
    rows = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", F.explode("units").alias("u"))
    return rows.groupBy("conv", F.xxhash64("u").alias("h")).agg(F.min("turn").alias("first"))


def passages(parsed: DataFrame) -> DataFrame:
    """A row for each quoted passage: conv_id, turn, place, level, n_lines, h."""
    rows = parsed.select("conv_id", "turn", F.explode("quotes").alias("q"))
    return rows.select("conv_id", "turn", "q.place", "q.level", F.size(filled(F.col("q.text"))).alias("n_lines"), hashed(F.col("q.text")).alias("h"))


def runs(parsed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, n, h, first): the earliest turn of a conversation that has a run of n lines, for the
    lengths (c, n) that are asked for."""
    lengths = lengths.groupBy("c").agg(F.collect_set("n").alias("ns")).select("c", "ns", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s"))
    d = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "body", F.pmod(F.xxhash64("turn"), F.lit(SPREAD)).cast("int").alias("salt"))
    d = d.join(lengths, (F.col("conv_id") == F.col("c")) & (F.col("salt") == F.col("s")))
    d = d.select(F.col("conv_id").alias("conv"), "turn", filled(F.col("body")).alias("lines"), F.explode("ns").alias("n")).where(F.size("lines") >= F.col("n"))
    d = d.select("conv", "turn", "lines", "n", F.explode(F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1)).alias("i"))
    # Joined by spaces, the lines of a run are its normalised text.
    d = d.select("conv", "turn", "n", F.xxhash64(F.array_join(F.slice("lines", F.col("i"), F.col("n")), " ")).alias("h"))
    return d.groupBy("conv", "n", "h").agg(F.min("turn").alias("first"))


def links(parsed: DataFrame) -> DataFrame:
    """Passages with the turn of their original (null where none is earlier)."""
    quoted = passages(parsed)
    source = originals(parsed)
    earlier = F.when(F.col("first") < F.col("turn"), F.col("first")).alias("original")
    joined = quoted.join(source, (F.col("conv_id") == F.col("conv")) & (quoted.h == source.h), "left")
    whole = materialize(joined.select("conv_id", "turn", "place", "level", "n_lines", quoted.h, earlier), "passages")
    columns = ["conv_id", "turn", "place", "level", "original"]
    open_ = F.col("original").isNull() & (F.col("n_lines") > 1) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    missing = whole.where(open_)
    if missing.isEmpty():
        return whole.select(*columns)
    source = runs(parsed, missing.select(F.col("conv_id").alias("c"), F.col("n_lines").alias("n")).distinct())
    missing = missing.drop("original")
    on = (F.col("conv_id") == F.col("conv")) & (F.col("n_lines") == F.col("n")) & (missing.h == source.h)
    return whole.where(~open_).select(*columns).union(missing.join(source, on, "left").select(*columns[:-1], earlier))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, at, root, depth) of each replying turn, from (conv, at, up), by pointer jumping: a
    chain of n replies takes log2 n rounds."""
    state = materialize(replies.select("conv", "at", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("conv").alias("c"), F.col("at").alias("a"), F.col("root").alias("r"), F.col("depth").alias("d"))
        joined = state.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("a")), "left")
        new = materialize(joined.select("conv", "at", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        moved = not new.where("moved").isEmpty()
        forget(state)
        state = new.drop("moved")
        state.stored_at = new.stored_at
        if not moved:
            return state


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, reply_to, thread (turn of the thread's first
    message) and depth of every message. Ordered by conv_id, thread, depth, turn, it is the
    conversation in order of replies."""
    parsed = materialize(parse(messages), "messages")
    linked = materialize(links(parsed), "links")
    by_turn = linked.groupBy(F.col("conv_id").alias("conv"), F.col("turn").alias("at")).agg(
        F.count("*").alias("quoted"),
        F.count("original").alias("linked"),
        F.min(F.when(F.col("original").isNotNull(), F.struct("level", "place", "original")))["original"].alias("up"),
    )
    by_turn = materialize(by_turn, "turns")
    found = threads(by_turn.where("up IS NOT NULL").select("conv", "at", "up")).select(F.col("conv").alias("tc"), F.col("at").alias("ta"), "root", "depth")
    d = parsed.withColumn("n_quotes", F.size("quotes").cast("long")).drop("units", "quotes")
    d = d.join(by_turn, (F.col("conv_id") == F.col("conv")) & (F.col("turn") == F.col("at")), "left")
    d = d.join(found, (F.col("conv_id") == F.col("tc")) & (F.col("turn") == F.col("ta")), "left")
    return d.select("conv_id", "turn", "role", "body", "n_quotes", F.least(F.coalesce("linked", F.lit(0)), F.col("n_quotes")).cast("long").alias("n_linked"), F.col("up").alias("reply_to"), F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
