"""Chat formatting by quotation linking, with DataFrame functions only.

Method: the lines of each message are parsed into nested quote levels (the number of leading ``>``). A quoted line,
and a whole run of quoted lines of one level, is normalised (lower case, white space runs to one space) and hashed;
the hashes join to the hashes of the unquoted lines and bodies of earlier messages of the conversation, the latest of
which counts. The quoted message of level 1 with the most matching units (ties: the latest) is the one replied to, that
of level 2 its predecessor, and so on. A message without such a link replies to the message before it. Conversations
come without quotes and in reply order: a message stands behind the one it replies to, with all that follows on it
before the next reply to the same message.

Defined cases: a null text is empty; a null role is ``user``; rows with a null conv_id form a conversation of their
own; rows with a null turn come first, link to nothing and nothing links to them. Rows that share a turn keep an order
by a hash of role and text, and repeated rows are all kept; none of them is earlier than another. A quote that no
earlier message holds links to nothing. Texts of any length are taken whole. Other columns are dropped, so none can
clash; an empty table gives an empty result.

Hot keys: places in a conversation are running counts over ranges of the sorted rows (``running``), so neither a long
conversation nor a turn that repeats falls to one task. The latest earlier holder of a hash is found in two steps,
within buckets of turns and then between buckets, over distinct turns. Reply chains are followed by doubling, over
branches, not messages. No pairs of messages are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut, n_partitions

BUCKET = 256
MARK = r"^((?:[ \t]{0,3}>)+)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse_quotes(text: Column) -> Column:
    """array<struct<level int, text string>>: the runs of lines of one quote level, in order. Linear in the text."""
    line = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    levels = F.transform(
        line,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARK + " ?", "").alias("body"),
        ),
    )

    def runs(ls: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, k: let(
                    F.slice(ls, s, F.coalesce(F.get(starts, k + 1), F.size(ls) + 1) - s),
                    lambda part: F.struct(
                        F.element_at(part, 1)["level"].alias("level"), F.array_join(F.transform(part, lambda p: p["body"]), "\n").alias("text")
                    ),
                ),
            )

        first = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (i == 1) | (F.element_at(ls, i)["level"] != F.get(ls, F.greatest(i - 2, F.lit(0)))["level"]))
        return let(first, cut)

    return let(levels, runs)


def _units(runs: Column, wanted) -> Column:
    """Hashes with levels: each line that isn't empty, and each run of several lines."""

    def of(r: Column) -> Column:
        whole = F.array(r["text"])
        each = F.split(r["text"], "\n", -1)
        return F.transform(
            F.filter(F.transform(F.when(F.size(each) > 1, F.concat(each, whole)).otherwise(whole), normalised), lambda t: t != ""),
            lambda t: F.struct(r["level"].alias("level"), F.xxhash64(t).alias("h1"), F.substring(F.sha2(t, 256), 1, 16).alias("h2")),
        )

    return F.flatten(F.transform(F.filter(runs, wanted), of))


def running(rows: DataFrame, key: str, order: list[str], weight: str, out: str) -> DataFrame:
    """rows with ``out``: the sum of ``weight`` over the rows of the key that stand before, in a unique order.

    The rows are dealt to ranges of (key, order); each range sums up its own, and the ranges' totals of a key are summed
    up in turn. So the largest task holds a range, whatever the key.
    """
    dealt = rows.repartitionByRange(n_partitions(rows), key, *order).sortWithinPartitions(key, *order)
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    inside = F.sum(weight).over(W.partitionBy(key, "range").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    totals = dealt.groupBy(key, "range").agg(F.sum(weight).alias("total"))
    carried = F.sum("total").over(W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(key, "range", F.coalesce(carried, F.lit(0)).alias("carried"))
    out_ = F.col("carried") + F.coalesce("inside", F.lit(0))
    return dealt.withColumn("inside", inside).join(totals, [key, "range"]).withColumn(out, out_).drop("at", "range", "inside", "carried")


def latest(points: DataFrame, marks: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """points (keys, at; distinct) with ``mark``: the mark (keys, at, mark; distinct at) with the greatest ``at`` that is
    not beyond the point's (strict: that is before it); null without one. Buckets of ``at`` are looked at first."""
    rows = points.select(*keys, "at", F.lit(None).cast(marks.schema["mark"].dataType).alias("held"))
    rows = rows.unionByName(marks.select(*keys, "at", F.col("mark").alias("held"))).withColumn("bucket", F.floor(F.col("at") / BUCKET))
    found = F.when(F.col("held").isNotNull(), F.struct("at", "held"))
    near = W.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "bucket").agg(F.max(found).alias("last")).withColumn("far", F.max("last").over(before)).drop("last")
    rows = rows.withColumn("near", F.max(found).over(near)).where("held is null").drop("held")
    return rows.join(last, [*keys, "bucket"]).select(*keys, "at", F.coalesce("near", "far")["held"].alias("mark"))


def _numbered(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, at: messages numbered from 0 in their conversation, by turn. Settled."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    rows = cut(
        messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumns({"conv": conv, "row": F.monotonically_increasing_id()})
    )
    slim = rows.select("conv", "turn", F.xxhash64("role", "text").alias("h"), "row", F.lit(1).alias("one"))
    places = running(slim, "conv", ["turn", "h", "row"], "one", "n").select("row", F.col("n").alias("at"))
    return cut(rows.join(places, "row").drop("row"))


def _links(numbered: DataFrame) -> DataFrame:
    """conv, at, target (struct<turn, at> or null), ancestors: of messages that quote an earlier one. Settled."""
    quoting = numbered.where(F.col("turn").isNotNull() & F.col("text").rlike(r"(?m)^[ \t]{0,3}>"))
    convs = quoting.select("conv").distinct()
    parsed = numbered.where("turn is not null").join(convs, "conv", "left_semi").select("conv", "turn", "at", parse_quotes(F.col("text")).alias("runs"))
    quotes = parsed.select("conv", "turn", "at", F.inline(_units(F.col("runs"), lambda r: r["level"] > 0)))
    held = parsed.select("conv", "turn", "at", F.inline(_units(F.col("runs"), lambda r: r["level"] == 0)))
    keys = ["conv", "h1", "h2"]
    marks = held.groupBy(*keys, "turn").agg(F.max("at").alias("last")).select(*keys, F.col("turn").alias("at"), F.struct("turn", F.col("last").alias("at")).alias("mark"))
    asked = quotes.select(*keys, F.col("turn").alias("at")).distinct()
    found = cut(latest(asked, marks, keys, strict=True).where("mark is not null").withColumnRenamed("at", "turn"))
    votes = quotes.join(found, [*keys, "turn"]).groupBy("conv", "at", "level", "mark").count()
    best = votes.groupBy("conv", "at", "level").agg(F.max(F.struct("count", "mark"))["mark"].alias("mark"))
    return cut(
        best.groupBy("conv", "at").agg(
            F.max(F.when(F.col("level") == 1, F.col("mark"))).alias("target"),
            F.array_sort(F.collect_list(F.struct("level", F.col("mark.turn").alias("turn")))).alias("ancestors"),  # a row for each level
        )
    )


def _branches(numbered: DataFrame, links: DataFrame) -> DataFrame:
    """conv, start, path, size: stretches of messages that each reply to the one before; all but a conversation's first
    begin at a link to another message. Paths sort as the reply order does."""
    starts = cut(links.where(F.col("target.at") < F.col("at") - 1).select("conv", F.col("at").alias("start"), F.col("target.at").alias("onto")))
    first = starts.select("conv").distinct().select("conv", F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("onto"))
    marks = first.unionByName(starts).select("conv", F.col("start").alias("at"), F.col("start").alias("mark"))
    parents = latest(starts.select("conv", F.col("onto").alias("at")).distinct(), marks, ["conv"], strict=False).withColumnsRenamed({"at": "onto", "mark": "up"})
    # of replies to one stretch, those to its later messages come first: they follow on what stands before them
    own = F.array(F.struct((-F.col("onto")).alias("onto"), "start"))
    none = F.filter(F.array(F.struct(F.col("start").alias("onto"), "start")), lambda x: F.lit(False))
    now = cut(first.select("conv", "start", F.col("onto").alias("up"), none.alias("path")).unionByName(starts.join(parents, ["conv", "onto"]).select("conv", "start", "up", own.alias("path"))))
    while not now.where("up is not null").isEmpty():
        above = now.select("conv", F.col("start").alias("up"), F.col("up").alias("upper"), F.col("path").alias("before"))
        new = cut(now.join(above, ["conv", "up"], "left").select("conv", "start", F.col("upper").alias("up"), F.concat(F.coalesce("before", none), "path").alias("path")))
        drop_cut(now)
        now = new
    inside = latest(numbered.join(first.select("conv"), "conv", "left_semi").select("conv", "at"), marks, ["conv"], strict=False)
    sizes = inside.groupBy("conv", F.col("mark").alias("start")).agg(F.count("*").alias("size"))
    return running(now.drop("up").join(sizes, ["conv", "start"]), "conv", ["path", "start"], "size", "first")


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, quote_depth, reply_to, ancestors, body: messages without quotes in reply order.

    reply_to: the turn replied to, where a quote tells it, else null. ancestors: array<struct<level, turn>> of all
    quoted levels that are found. position: from 0, in the conversation's reply order.
    """
    numbered = _numbered(messages)
    links = _links(numbered)
    text = F.col("text")
    runs = F.when(text.rlike(r"(?m)^[ \t]{0,3}>"), parse_quotes(text)).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))))
    rows = numbered.withColumn("runs", runs).withColumn("quote_depth", F.array_max(F.transform("runs", lambda r: r["level"])))
    own = F.array_join(F.filter(F.transform("runs", lambda r: F.when(r["level"] == 0, F.regexp_replace(r["text"], r"^\s+|\s+$", ""))), lambda t: t.isNotNull() & (t != "")), "\n\n")
    rows = rows.withColumn("body", F.when(F.col("quote_depth") > 0, own).otherwise(text)).drop("runs", "text")
    rows = rows.join(links, ["conv", "at"], "left").withColumn("reply_to", F.col("target.turn"))
    moved = links.where(F.col("target.at") < F.col("at") - 1).select("conv").distinct()
    if moved.isEmpty():  # all replies are to the message before
        rows = rows.withColumn("position", F.col("at"))
    else:
        branches = cut(_branches(numbered, links))
        at = latest(numbered.join(moved, "conv", "left_semi").select("conv", "at"), branches.select("conv", F.col("start").alias("at"), F.col("start").alias("mark")), ["conv"], strict=False)
        place = at.withColumnRenamed("mark", "start").join(branches, ["conv", "start"]).select("conv", "at", (F.col("first") + F.col("at") - F.col("start")).alias("place"))
        rows = rows.join(place, ["conv", "at"], "left").withColumn("position", F.coalesce("place", "at"))
    return rows.select("conv_id", "turn", "role", F.col("position").cast("bigint").alias("position"), "quote_depth", "reply_to", "ancestors", "body")


def render(linked: DataFrame, start: str = "<|", end: str = "|>") -> DataFrame:
    """The chat template, a row for each message: conversations are read back by (conv_id, position)."""
    said = F.concat(F.lit(start), F.col("role"), F.lit(end + "\n"), F.col("body"), F.lit(f"\n{start}end{end}\n"))
    return linked.withColumn("message", said)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return render(link_quotations(messages)).select("conv_id", "turn", "role", "position", "quote_depth", "reply_to", "message")
