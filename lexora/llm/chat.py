"""Chat formatting: quotation linking, with DataFrame functions only.

A line's quote level is the number of ``>`` in its prefix. Runs of lines of one level are
passages; a passage, normalised (lower case, blanks collapsed), is hashed and linked to the
latest earlier message of its conversation that offers the same text: as its whole own text or as
one of its own lines. A longer passage without such a message is linked by its longest line. The
passage of the least level decides which message is replied to. Messages keep their own text
without quotes, and are ordered by thread (its first message's turn) and turn: each comes after
the one it replies to.

The latest earlier offer is found by ordering, never by pairing: within ranges of BUCKET turns,
and between ranges over one row each, so neither a long conversation nor a text that is said over
and over meets in one task. Threads' first messages are found by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUCKET = 1024
PREFIX = r"^[ \t]*(?:>[ \t]*)+"
QUOTES = r"(?md)^[ \t]*>"


def normal(c: Column) -> Column:
    """Lower case, blanks collapsed and gone at both ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), "^ | $", ""))


def _own(text: Column) -> Column:
    """The text's lines outside quotes, without blanks at both ends."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^[ \t]*>"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def _latest_earlier(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """``asked(conv_id, turn, key, ...)`` plus up: the greatest turn of ``offers(conv_id, turn, key)`` below its own."""
    names = asked.columns
    offers = offers.join(asked.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").distinct()
    both = asked.withColumn("offer", F.lit(None).cast(asked.schema["turn"].dataType)).unionByName(offers.withColumn("offer", F.col("turn")), allowMissingColumns=True)
    both = both.withColumn("range", F.floor(F.col("turn") / BUCKET))
    near = Window.partitionBy("conv_id", "key", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("offer").over(near)).where("offer IS NULL")
    ranges = asked.select("conv_id", "key", "turn", F.lit(None).cast(asked.schema["turn"].dataType).alias("offer")).unionByName(offers.withColumn("offer", F.col("turn")))
    ranges = ranges.groupBy("conv_id", "key", F.floor(F.col("turn") / BUCKET).alias("range")).agg(F.max("offer").alias("most"))
    before = Window.partitionBy("conv_id", "key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("far", F.max("most").over(before)).drop("most")
    return both.join(ranges, ["conv_id", "key", "range"]).select(*names, F.coalesce("near", "far").alias("up"))


def _threads(edges: DataFrame) -> DataFrame:
    """``edges(conv_id, turn, up)``, one row a message, plus thread and depth; by doubling."""
    now = saved(edges.select("conv_id", "turn", F.col("up").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        far = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = saved(now.join(far, ["conv_id", "thread"], "left"))
        if step.where("next IS NOT NULL").limit(1).count() == 0:
            return now
        now = step.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``: conv_id, turn, role, text, reply_to, thread, depth, n_quotes, n_linked.

    text is the message's own text, without quotes; a null text gives an empty one. reply_to is
    the linked message's turn or null, thread the first turn of the reply chain, depth its length
    below that. A null conv_id or turn is kept and links nothing. Repeated rows give repeated
    rows; of rows of one conv_id and turn the greatest reply_to counts for the chain. An empty
    table gives an empty result. Other columns are not read.
    """
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("raw"))
    quoting = m["raw"].rlike(QUOTES)
    plain = m.where(~quoting).select("conv_id", "turn", "role", _own(F.col("raw")).alias("text"))
    q = saved(m.where(quoting)).withColumn("rid", F.monotonically_increasing_id())

    lines = q.select("rid", "conv_id", "turn", F.posexplode(F.split("raw", "\n")).alias("pos", "line"))
    prefix = F.regexp_extract("line", PREFIX, 0)
    lines = lines.select("rid", "conv_id", "turn", "pos", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.regexp_replace("line", PREFIX, "").alias("body"))
    place = F.row_number().over(Window.partitionBy("rid", "level").orderBy("pos"))
    runs = lines.withColumn("run", F.col("pos") - place).where("level > 0").groupBy("rid", "conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("x"))
    bodies = F.transform("x", lambda y: normal(y["body"]))
    runs = runs.withColumn("said", F.filter(bodies, lambda y: y != ""))
    # the longest line says most of where a passage comes from; a greeting says nothing
    longest = F.array_max(F.transform("said", lambda y, i: F.struct(F.length(y).alias("n"), (-i).alias("i"), y.alias("y"))))["y"]
    runs = saved(runs.where(F.size("said") > 0).select("rid", "conv_id", "turn", "level", "run", F.array_join("said", " ").alias("passage"), longest.alias("line")))

    own = plain.select("conv_id", "turn", "text").unionByName(q.select("conv_id", "turn", _own(F.col("raw")).alias("text")))
    said = F.array_distinct(F.concat(F.array(normal(F.col("text"))), F.transform(F.split("text", "\n"), normal)))
    ids = "conv_id IS NOT NULL AND turn IS NOT NULL"
    offers = own.where(ids).select("conv_id", "turn", F.explode(said).alias("said")).where("said <> ''").select("conv_id", "turn", F.md5(F.encode("said", "UTF-8")).alias("key"))
    keyed = runs.where(ids).select("rid", "conv_id", "turn", "level", "run", F.posexplode(F.array(F.md5(F.encode("passage", "UTF-8")), F.md5(F.encode("line", "UTF-8")))).alias("kind", "key"))
    found = _latest_earlier(keyed, offers)
    linked = found.groupBy("rid", "level", "run").agg(F.min(F.when(F.col("up").isNotNull(), F.struct("kind", (-F.col("up")).alias("n")))).alias("x"))
    per = runs.select("rid", "level", "run").join(linked, ["rid", "level", "run"], "left").groupBy("rid").agg(
        F.count("*").alias("n_quotes"),
        F.count("x").alias("n_linked"),
        F.min(F.when(F.col("x").isNotNull(), F.struct("level", F.col("x.n").alias("n")))).alias("y"),
    )
    quoted = saved(
        q.join(per, "rid", "left").select(
            "conv_id", "turn", "role", _own(F.col("raw")).alias("text"), (-F.col("y.n")).alias("reply_to"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        )
    )
    chain = _threads(quoted.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")))
    quoted = quoted.join(chain, ["conv_id", "turn"], "left")
    none = F.lit(None).cast(messages.schema["turn"].dataType)
    out = plain.select("*", none.alias("reply_to"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), none.alias("thread"), F.lit(0).cast("long").alias("depth")).unionByName(quoted)
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", "n_linked")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """link_quotes() in the order of conversations, threads and turns; a long conversation spans partitions.

    Nulls, empty texts and repeated rows are as link_quotes() says, null keys come first; an empty table stays empty.
    """
    linked = link_quotes(messages)
    return linked.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")


SQL = r"""
with recursive m as (
  select conv_id, turn, role, coalesce(text, '') as raw, row_number() over () as rid from conversations),
l as (
  select rid, conv_id, turn, unnest(string_split(raw, chr(10))) as line, generate_subscripts(string_split(raw, chr(10)), 1) as pos from m),
p as (
  select rid, conv_id, turn, pos, line,
         length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) as level,
         regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') as body
  from l),
n as (
  select *, lower(regexp_replace(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')) as said,
         pos - row_number() over (partition by rid, level order by pos) as run
  from p),
passages as (
  select rid, any_value(conv_id) as conv_id, any_value(turn) as turn, level, run,
         string_agg(said, ' ' order by pos) as passage, arg_max(said, struct_pack(n := length(said), i := -pos)) as line
  from n where level > 0 and said <> '' group by rid, level, run),
own as (
  select m.rid, m.conv_id, m.turn, m.role,
         regexp_replace(coalesce(string_agg(p.line, chr(10) order by p.pos) filter (where p.level = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as text
  from m join p on m.rid = p.rid group by all),
offers as (
  select conv_id, turn, lower(regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g')) as said from own
  union
  select conv_id, turn, said from n where level = 0),
linked as (
  select a.rid, a.level, a.run,
         coalesce(max(o.turn) filter (where o.said = a.passage), max(o.turn)) as up
  from passages a left join offers o
    on o.conv_id = a.conv_id and o.turn < a.turn and o.said <> '' and (o.said = a.passage or o.said = a.line)
  group by a.rid, a.level, a.run),
per as (
  select rid, count(*) as n_quotes, count(up) as n_linked,
         max(up) filter (where level = least_level) as reply_to
  from (select *, min(level) filter (where up is not null) over (partition by rid) as least_level from linked) group by rid),
e as (
  select o.conv_id, o.turn, max(per.reply_to) as up from own o join per on o.rid = per.rid
  where per.reply_to is not null group by o.conv_id, o.turn),
walk as (
  select conv_id, turn, up as thread, 1::bigint as depth from e
  union all
  select w.conv_id, w.turn, e.up, w.depth + 1 from walk w join e on e.conv_id = w.conv_id and e.turn = w.thread),
ends as (
  select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from walk group by conv_id, turn)
select o.conv_id, o.turn, o.role, o.text, per.reply_to, coalesce(ends.thread, o.turn) as thread, coalesce(ends.depth, 0)::bigint as depth,
       coalesce(per.n_quotes, 0)::bigint as n_quotes, coalesce(per.n_linked, 0)::bigint as n_linked
from own o left join per on o.rid = per.rid
left join ends on ends.conv_id = o.conv_id and ends.turn = o.turn
"""
