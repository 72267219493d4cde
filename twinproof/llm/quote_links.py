"""Chat formatting: quoted passages linked to the messages they come from.

Each text is read line by line: leading ``>`` signs give the quote level, and an
attribution ("... wrote:") right before a quote belongs to it. Quoted passages are runs of lines
of one level. Their lines, their paragraphs (between blank lines) and the whole passage are
normalised and hashed, and joined to the earliest message of the conversation that said
the same in its own words, if it came before. A passage none of which was found, as it is a part of
a paragraph that was wrapped anew, is looked for by runs of ``RUN`` words, which are
hashed at every place of the originals. The message that most lines of level one come
from is the parent; of two with as many, the later one. Roots and depths of
replies follow by pointer doubling, so long reply chains take few rounds, and each message
gets its place in the conversation in reply order.

Everything is built from column functions and joins. Keys of a unit are unique on the
side of the originals (they are aggregated first), so a popular line multiplies
nothing, and adaptive execution splits its quoting side. Only conversations with
quotes are taken apart. Places are counted over a range-sorted table, not in one window
per conversation.

Defined results: null texts stay null and quote nothing; texts of quotes only become
empty; a message without a linked quote starts a thread; ``n_linked`` counts the quoted lines
whose message was found, all lines of a passage found as a whole or by a run; rows
with a null conversation or turn are kept, link with nothing and have no place;
repeated rows give repeated rows, with places of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.tables import located, table
from twinproof.session import settle

RUN = 8  # words of a run
MARK = r"^\s{0,3}(?:>[ \t]?)+"
# Sentences that introduce a quote, at the end of a line.
SAYS = r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def key_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def parsed(text: str = "text") -> Column:
    """The lines as structs (level, body, lead): lead marks an attribution."""
    lines = F.split(F.col(text), "\r?\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))
    rows = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("body")))

    def led(x: Column, i: Column) -> Column:
        after = F.get(rows, i + 1)
        return F.struct(x["level"].alias("level"), x["body"].alias("body"), (x["body"].rlike(SAYS) & F.coalesce(after["level"] > x["level"], F.lit(False))).alias("lead"))

    return F.transform(rows, led)


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as structs (level, bodies)."""

    def starts(i: Column) -> Column:
        x, before = F.get(lines, i), F.get(lines, i - 1)
        return (i == 0) | (x["level"] != before["level"])

    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), starts)

    def run(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(at, k + 1), F.size(lines))
        own = F.filter(F.slice(lines, s + 1, end - s), lambda x: ~x["lead"])
        return F.struct(F.get(lines, s)["level"].alias("level"), F.transform(own, lambda x: x["body"]).alias("bodies"))

    return F.filter(F.transform(at, run), lambda p: p["level"] > 0)


def paragraphs(bodies: Column) -> Column:
    """Structs (unit, lines) of the runs of lines between blank ones."""
    nothing = F.array().cast("array<struct<unit:string,lines:int>>")
    start = F.struct(nothing.alias("done"), F.lit("").alias("unit"), F.lit(0).alias("lines"))

    def closed(state: Column) -> Column:
        one = F.array(F.struct(state["unit"].alias("unit"), state["lines"].alias("lines")))
        return F.when(state["lines"] > 0, F.concat(state["done"], one)).otherwise(state["done"])

    def step(state: Column, line: Column) -> Column:
        blank = F.trim(line) == ""
        text = F.when(state["lines"] > 0, F.concat(state["unit"], F.lit(" "), line)).otherwise(line)
        return F.when(blank, F.struct(closed(state).alias("done"), F.lit("").alias("unit"), F.lit(0).alias("lines"))).otherwise(
            F.struct(state["done"].alias("done"), text.alias("unit"), (state["lines"] + 1).alias("lines"))
        )

    joined = F.aggregate(bodies, start, step, closed)
    return F.transform(joined, lambda p: F.struct(normalised(p["unit"]).alias("unit"), p["lines"].alias("lines")))


def runs(unit: Column, step: int) -> Column:
    """Runs of ``RUN`` words of a normalised text, every ``step`` words; none of a shorter one."""
    words = F.split(unit, " ")
    last = F.size(words) - RUN
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, RUN), " "))


def _met(asked: DataFrame, said: DataFrame) -> DataFrame:
    """``asked`` (conv_id, turn, unit, ...) with ``origin``, the first earlier turn that said the
    unit; ``said`` has (conv_id, turn, units)."""
    units = said.select("conv_id", "turn", F.explode("units").alias("unit")).where("unit <> ''")
    first = units.groupBy("conv_id", key_of(F.col("unit")).alias("key")).agg(F.min("turn").alias("origin"))
    wanted = asked.where("unit <> ''").withColumn("key", key_of(F.col("unit")))
    return wanted.join(first, ["conv_id", "key"]).where(F.col("origin") < F.col("turn")).drop("key")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), parent_turn, root_turn, reply_depth, quote_level, n_quoted, n_linked, place."""
    messages, a, b = located(messages)
    lines = messages.select(F.col(a).alias("a"), F.col(b).alias("b"), "conv_id", "turn", "role", "text", parsed().alias("lines"))
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["lead"])
    said = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))
    read = lines.select("a", "b", "conv_id", "turn", "role", F.when(F.col("text").isNotNull(), said).alias("said"), passages(F.col("lines")).alias("quotes"), F.transform(own, lambda x: x["body"]).alias("bodies"))
    read = settle(read, "chat-read")

    # quoted passages, numbered, and what conversations with any said themselves
    quoting = read.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & (F.size("quotes") > 0))
    quoted = quoting.select("a", "b", "conv_id", "turn", F.posexplode("quotes").alias("q", "p")).select("a", "b", "conv_id", "turn", "q", "p.level", "p.bodies")
    own_words = read.where(F.col("turn").isNotNull()).join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    units = F.array_union(F.array_union(F.transform("bodies", normalised), F.transform(paragraphs(F.col("bodies")), lambda p: p["unit"])), F.array(normalised(F.col("said"))))

    full = F.size(F.filter("bodies", lambda x: F.trim(x) != ""))
    unit = lambda text, n, kind: F.struct(text.alias("unit"), n.cast("int").alias("lines"), F.lit(kind).alias("kind"))
    asked = quoted.select(
        "a", "b", "conv_id", "turn", "q", "level", "bodies",
        F.explode(F.concat(
            F.transform("bodies", lambda x: unit(normalised(x), F.lit(1), 0)),
            F.transform(paragraphs(F.col("bodies")), lambda p: unit(p["unit"], p["lines"], 1)),
            F.array(unit(normalised(F.array_join("bodies", " ")), full, 2)),
        )).alias("u"),
    )
    met = _met(asked.select("a", "b", "conv_id", "turn", "q", "level", "u.*"), own_words.select("conv_id", "turn", units.alias("units")))
    place = ["a", "b", "conv_id", "turn", "q", "level"]
    found = settle(met.groupBy(*place, "origin", "kind").agg(F.sum("lines").alias("lines")), "chat-found")

    # what is left: parts of paragraphs, by runs of words
    left = quoted.join(found.select("a", "b", "q").distinct(), ["a", "b", "q"], "left_anti")
    left = settle(left.select(*place, F.explode(runs(normalised(F.array_join("bodies", " ")), RUN)).alias("unit"), full.alias("lines"), F.lit(3).alias("kind")), "chat-left")
    sayers = own_words.join(left.select("conv_id").distinct(), "conv_id", "left_semi")
    by_run = _met(left, sayers.select("conv_id", "turn", runs(normalised(F.col("said")), 1).alias("units")))
    found = found.unionByName(by_run.groupBy(*place, "origin", "kind").agg(F.max("lines").alias("lines")))

    # per passage and origin the kind of unit that says most; a message's votes are its lines of level one
    votes = found.groupBy(*place, "origin").agg(F.max("lines").alias("lines"))
    linked_lines = found.groupBy(*place, "kind").agg(F.sum("lines").alias("lines")).groupBy(*place).agg(F.max("lines").alias("n"))
    linked_lines = linked_lines.groupBy("a", "b").agg(F.sum("n").alias("n_linked"))
    best = votes.where("level = 1").groupBy("a", "b", "conv_id", "turn", "origin").agg(F.sum("lines").alias("votes"))
    best = best.groupBy("a", "b", "conv_id", "turn").agg(F.max(F.struct("votes", "origin")).alias("best"))
    links = settle(linked_lines.join(best, ["a", "b"], "left").select("a", "b", "conv_id", "turn", F.col("best.origin").alias("parent"), "n_linked"), "chat-links")

    roots = reply_roots(links.where(F.col("parent").isNotNull()).groupBy("conv_id", "turn").agg(F.max("parent").alias("parent")))
    put = links.join(roots, ["conv_id", "turn"], "left").select("a", "b", "parent", "n_linked", "root", "depth")
    threads = read.select("a", "b", "conv_id", "turn").join(put, ["a", "b"], "left").select(
        "a", "b", "conv_id", "turn", "parent", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")
    )
    facts = _with_places(threads).drop("conv_id", "turn")
    out = read.join(facts, ["a", "b"])
    n_quoted = F.aggregate("quotes", F.lit(0), lambda n, p: n + F.size(p["bodies"]))
    deepest = F.coalesce(F.array_max(F.transform("quotes", lambda p: p["level"])), F.lit(0))
    return out.select(
        "conv_id", "turn", "role", F.col("said").alias("text"), F.col("parent").alias("parent_turn"), "root_turn", "reply_depth",
        F.coalesce(deepest, F.lit(0)).cast("long").alias("quote_level"), F.coalesce(n_quoted, F.lit(0)).cast("long").alias("n_quoted"), "n_linked", "place",
    )


def _with_places(rows: DataFrame) -> DataFrame:
    """``place``, the number of a message in its reply-ordered conversation, from 0.

    The rows, without their texts, are written sorted by range; a row's place is its position in all files less
    that of its conversation's first row, so a conversation may span any number of tasks.
    """
    ordered = settle(rows.repartitionByRange(*reply_order()).sortWithinPartitions(*reply_order()), "chat-ordered")
    at = ordered.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = at.groupBy("file").agg(F.count("*").alias("m"))  # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    numbered = at.join(offsets, "file").withColumn("at", F.col("offset") + F.col("row"))
    first = numbered.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.min(F.when(F.col("turn").isNotNull(), F.col("at"))).alias("first"))
    place = F.when(F.col("turn").isNotNull(), F.col("at") - F.col("first")).alias("place")
    return numbered.join(first, "conv_id", "left").select(*rows.columns, place)


def reply_roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) from (conv_id, turn, parent); parents are earlier
    turns, so there are no circles. Each round doubles the distance of the pointers."""
    now = settle(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "chat-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = settle(now.join(up, ["conv_id", "root"], "left"), "chat-roots")
        if not joined.where(F.col("above").isNotNull()).head(1):
            return now
        now = settle(joined.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-roots")


def reply_order() -> tuple[Column, ...]:
    """Sort columns of a reply-ordered conversation: threads by their first turn, then by depth and turn."""
    return F.col("conv_id"), F.col("root_turn"), F.col("reply_depth"), F.col("turn")


def op6_quote_links(spark, sf_dir):
    return linked(table(spark, sf_dir, "conversations"))
