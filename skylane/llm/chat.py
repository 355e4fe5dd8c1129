"""Chat formatting by quotation linking (built-in functions only).

Lines that begin with ``>`` are quotes, nested as deep as they have marks.
Runs of lines of one depth are passages; the normalised hash of a run, of
each of its paragraphs and of each of its lines is joined to the messages of
the same conversation that hold that passage (as their whole own text, a
paragraph or a line, or in a quote of fewer marks). A message replies to the
original of its outermost linked quote. Quoted lines that an earlier message
holds are taken out, others stay in the chat markup, and messages are put in
reply order: each right after what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skylane.llm.common import staged, text_or_empty

MARKS = r"^[ \t]*(?:>[ \t]?)+"
MAX_ROUNDS = 64         # of doubling: conversations of up to 2^63 messages


def normal(text: Column) -> Column:
    """What quoting may change is folded: white space and case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}]+", " "))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text), 256))


def lines_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, line_no, line, depth, body, run, para`` of every line of the messages that hold a quote mark.

    A run is a row of lines of one depth; blank lines part its paragraphs."""
    m = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    lines = m.select("conv_id", "turn", "mid", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.select("conv_id", "turn", "mid", "line_no", "line", F.length(F.regexp_replace(marks, "[^>]", "")).alias("depth"),
                         F.expr("substring(line, length(regexp_extract(line, '" + MARKS.replace("\\", "\\\\") + "', 0)) + 1)").alias("body"))
    w = Window.partitionBy("conv_id", "turn", "mid").orderBy("line_no")
    new = F.coalesce((F.col("depth") != F.lag("depth").over(w)).cast("int"), F.lit(1))
    blank = (normal(F.col("body")) == "").cast("int")
    return lines.withColumn("new", new).select("*", F.sum("new").over(w).alias("run"), F.sum(blank).over(w).alias("para")).drop("new")


def passages(lines: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, run, depth, first, last, body``: runs, their paragraphs and their lines, with the first and last line."""
    def joined(rows: DataFrame, *by: str) -> DataFrame:
        ls = rows.groupBy("conv_id", "turn", "mid", "run", "depth", *by).agg(F.sort_array(F.collect_list(F.struct("line_no", "body"))).alias("ls"))
        return ls.select("conv_id", "turn", "mid", "run", "depth", F.array_min("ls.line_no").alias("first"), F.array_max("ls.line_no").alias("last"),
                         F.array_join(F.col("ls.body"), "\n").alias("body"))
    full = lines.where(normal(F.col("body")) != "")
    one = full.select("conv_id", "turn", "mid", "run", "depth", F.col("line_no").alias("first"), F.col("line_no").alias("last"), "body")
    return joined(lines).unionByName(joined(full, "para")).unionByName(one).distinct()


def _without(lines: DataFrame, name: str) -> DataFrame:
    """``conv_id, turn, mid`` and the given lines of each message as one text."""
    return (lines.groupBy("conv_id", "turn", "mid").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
            .select("conv_id", "turn", "mid", F.array_join(F.col("ls.line"), "\n").alias(name)))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def own_text(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, role, own``: the messages without their quotes."""
    plain = _without(lines.where("depth = 0"), "plain")
    quoting = lines.select("conv_id", "turn", "mid").distinct()
    left = messages.join(quoting.withColumn("quotes", F.lit(True)), ["conv_id", "turn", "mid"], "left").join(plain, ["conv_id", "turn", "mid"], "left")
    own = F.when(F.col("quotes"), F.coalesce("plain", F.lit(""))).otherwise(F.col("text"))
    return left.select("conv_id", "turn", "mid", "role", _trimmed(own).alias("own"), "n_rows")


def originals(own: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, key, under, source``: the earliest turn that holds a passage under ``under`` marks.

    Only conversations with quotes are looked at; of many messages with the
    same passage one row is left, however many there are, and of more marks
    only one that is earlier than all with fewer."""
    here = own.join(parts.where("depth > 0").select("conv_id").distinct(), "conv_id", "left_semi").where("own != ''")
    split = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n")))
    plain = here.select("conv_id", "turn", F.lit(0).alias("under"), F.explode(split).alias("part"))
    held = plain.unionByName(parts.select("conv_id", "turn", F.col("depth").alias("under"), F.col("body").alias("part")))
    first = (held.select("conv_id", "turn", "under", _key(F.col("part")).alias("key"))
             .groupBy("conv_id", "key", "under").agg(F.min("turn").alias("source")))
    w = Window.partitionBy("conv_id", "key").orderBy("under").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.min("source").over(w)).where("before is null or source < before").drop("before")


def linked_parts(parts: DataFrame, own: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, run, depth, first, last, source``: quoted passages that an earlier message holds under fewer marks, and the earliest such."""
    keyed = parts.where("depth > 0").where(normal(F.col("body")) != "").withColumn("key", _key(F.col("body"))).drop("body")
    found = keyed.join(originals(own, parts), ["conv_id", "key"]).where(F.col("source") < F.col("turn")).where(F.col("under") < F.col("depth"))
    return found.groupBy("conv_id", "turn", "mid", "run", "depth", "first", "last").agg(F.min("source").alias("source"))


def reply_links(linked: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, reply_to, n_linked``: a message replies to the source of its shallowest linked quote.

    Of quotes of one depth the last in the message counts (the answer stands
    below what it answers)."""
    return linked.groupBy("conv_id", "turn", "mid").agg(
        F.max_by("source", F.struct(-F.col("depth"), F.col("run"), F.col("source"))).alias("reply_to"),
        F.countDistinct("run").alias("n_linked"))


def kept_text(lines: DataFrame, linked: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, kept, unlinked``: quoting messages without the lines that an earlier one holds; what is left of their quotes."""
    gone = linked.select("conv_id", "turn", "mid", "run", F.explode(F.sequence("first", "last")).alias("line_no"))
    blank = (lines.join(linked.select("conv_id", "turn", "mid", "run").distinct(), ["conv_id", "turn", "mid", "run"])
             .where(normal(F.col("body")) == "").select("conv_id", "turn", "mid", "run", "line_no"))
    left = lines.join(gone.unionByName(blank).distinct(), ["conv_id", "turn", "mid", "run", "line_no"], "left_anti")
    rest = left.where("depth > 0").where(normal(F.col("body")) != "")
    return _without(left, "kept").join(_without(rest, "unlinked"), ["conv_id", "turn", "mid"], "left").withColumn("kept", _trimmed(F.col("kept")))


def _indexed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in the order of ``keys``: ranges of the order, each counted by itself."""
    order = [F.col(k) for k in keys]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "indexed")
    piece = dealt.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))          # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(piece.select("part", (before - F.col("first")).alias("shift")), "part").select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"))


def reply_order(turns: DataFrame, links: DataFrame) -> DataFrame:
    """``conv_id, turn, seq, depth``: order of the turns (growing along the conversation) and their depth in the thread.

    ``turns`` are all turns of the conversations with links. Each turn is
    entered and left on a walk through the replies; every step knows the next
    one, and doubling these pointers counts for every step what is entered
    after it and how deep it stands. So a long chain of replies costs rounds
    that grow with its logarithm, and rows of fixed size."""
    one = links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    tree = _indexed(turns.join(one, ["conv_id", "turn"], "left").select("conv_id", "up", "turn"), ["conv_id", "up", "turn"])
    tree = staged(tree, "reply-tree")
    if tree.isEmpty():
        return tree.select("conv_id", "turn", F.col("idx").alias("seq"), F.lit(0).cast("long").alias("depth"))
    after = tree.select(F.col("conv_id").alias("c2"), F.col("up").alias("u2"), (F.col("idx") - 1).alias("idx"), F.col("idx").alias("sibling"))
    child = tree.where("up is not null").groupBy("conv_id", "up").agg(F.min("idx").alias("child"))
    parent = tree.select("conv_id", F.col("turn").alias("up"), F.col("idx").alias("parent"))
    t = tree.join(after, "idx", "left")
    t = t.withColumn("sibling", F.when((F.col("conv_id") == F.col("c2")) & F.col("up").eqNullSafe(F.col("u2")), F.col("sibling"))).drop("c2", "u2")
    t = t.join(parent, ["conv_id", "up"], "left").join(child.withColumnRenamed("up", "turn"), ["conv_id", "turn"], "left")
    enter = F.struct((F.col("idx") * 2).alias("id"), F.coalesce(F.col("child") * 2, F.col("idx") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("level"))
    leave = F.struct((F.col("idx") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("level"))
    steps = staged(t.select(F.inline(F.array(enter, leave))), "reply-steps")
    for _ in range(MAX_ROUNDS):
        if steps.where("next is not null").isEmpty():
            break
        far = steps.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("n").alias("n2"), F.col("level").alias("level2"))
        joined = steps.join(far, "next", "left")
        steps = staged(joined.select("id", F.col("next2").alias("next"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
                                     (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level")), "reply-steps")
    # what is entered from a turn on falls along the walk; the levels from a turn on add up to less the turns around it
    entered = steps.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("idx"), (-F.col("n")).alias("seq"), (-F.col("level")).alias("depth"))
    return tree.join(entered, "idx").select("conv_id", "turn", "seq", "depth")


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each row in its conversation, from 0, without one task per conversation.

    Rows are dealt by ranges of (conversation, order); a row's place is its
    place in its range plus the conversation's rows in earlier ranges."""
    order = [F.col(k) for k in keys]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    piece = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    a, b = dealt.alias("a"), piece.alias("b")
    on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, on).select("a.*", (F.col("at") - F.col("first") + F.col("before")).alias("position")).drop("part", "at")


def format_chat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, role, text, reply_to, depth, n_quotes, n_linked, unlinked, position, formatted.

    ``text`` is the message without quotes; ``reply_to`` the turn it answers
    by quotation (null if it quotes nothing that is known); ``depth`` the
    number of turns above it in its thread; ``position`` its
    place in reply order within the conversation: threads in the order of
    their first turn, answers right after what they answer; ``unlinked`` the
    quoted lines that no earlier message holds, with their marks (null without
    any); ``formatted`` the message in chat markup, with those lines in place.

    * null text counts as empty, null role as "unknown"; null conversation
      ids form one conversation without links, null turns come first;
    * a quote of a passage that several messages hold links to the earliest;
      a quote of nothing earlier (a prompt, a block quote) links to nothing
      and is not in ``text``, but in ``unlinked`` and ``formatted``;
    * repeated rows each get their row, side by side;
    * an empty table gives an empty result; other columns are ignored.
    """
    raw = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                               F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), text_or_empty(text_col).alias("text"))
    raw = raw.withColumn("mid", F.xxhash64("role", "text"))
    quoted = raw.where("conv_id is not null and turn is not null")
    distinct = quoted.groupBy("conv_id", "turn", "mid", "role", "text").agg(F.count("*").alias("n_rows"))
    has = distinct.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    lines = staged(lines_of(has), "quote-lines")
    parts = staged(passages(lines), "passages")
    involved = distinct.join(lines.select("conv_id").distinct(), "conv_id", "left_semi")
    own = staged(own_text(involved, lines), "own-text")
    linked = staged(linked_parts(parts, own), "linked-passages")
    links = staged(reply_links(linked), "reply-links")
    order = reply_order(involved.join(links.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn").distinct(), links)
    counts = lines.where("depth > 0").groupBy("conv_id", "turn", "mid").agg(F.countDistinct("run").alias("n_quotes"))
    extra = (own.select("conv_id", "turn", "mid", "own").join(links, ["conv_id", "turn", "mid"], "left")
             .join(counts, ["conv_id", "turn", "mid"], "left").join(kept_text(lines, linked), ["conv_id", "turn", "mid"], "left").join(order, ["conv_id", "turn"], "left"))
    joined = raw.join(extra.withColumn("known", F.lit(True)), ["conv_id", "turn", "mid"], "left")
    text = F.when(F.col("known"), F.col("own")).otherwise(F.col("text"))
    # a message of nothing but linked quotes has a count of quotes and nothing kept
    kept = F.when(F.col("n_quotes").isNull(), text).otherwise(F.coalesce("kept", F.lit("")))
    rows = joined.select("conv_id", "turn", "role", text.alias("text"), kept.alias("kept"), "unlinked", "reply_to",
                         F.when(F.col("turn").isNotNull(), F.coalesce("seq", F.lit(0).cast("long"))).alias("seq"), F.coalesce("depth", F.lit(0).cast("long")).cast("int").alias("depth"),
                         F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
                         F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "mid")
    placed = _positions(rows, ["conv_id", "seq", "turn", "mid"])         # seq: null first, and the same for all turns where nothing is linked
    return placed.select("conv_id", "turn", "role", "text", "reply_to", "depth", "n_quotes", "n_linked",
                         "unlinked", "position", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "kept", F.lit("\n<|end|>\n")).alias("formatted"))


def conversation_blocks(messages: DataFrame, block: int = 256) -> DataFrame:
    """``conv_id, block, text``: formatted messages in reply order, at most ``block`` of them in a row."""
    return (messages.groupBy("conv_id", F.floor(F.col("position") / block).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("position", "formatted"))).alias("ms"))
            .select("conv_id", "block", F.array_join(F.col("ms.formatted"), "").alias("text")))
