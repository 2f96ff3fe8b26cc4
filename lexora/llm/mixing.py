"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions.

Targets: a source's share of the whole is its weight times the water level, but at most
``max_epochs`` times its size; what is clamped off is reshared by weight until no target is above
its cap. Repetitions: every document is taken floor(target / size) times, and the documents of
the first seeded hashes once more until the source's target is met. The extra part is one hash
threshold a source, so applying a mix needs no shuffle of the texts.

Thresholds are exact and found without ordering a source in one task: sizes are summed by source
and 4096 ranges of the hash, the range in which the target falls is found from these sums, and
only that range's documents are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, saved

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "17"


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str = SEED) -> F.Column:
    """A row's place in its source's order: 16 hex digits from its id, or from its text where the id is null."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode("text", "UTF-8")), F.lit(""))
    return F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), key), "UTF-8")), 1, 16)


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with n: the place of each source by code point, from 0, null last. Range partitions, then counts of them."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count"))
    inner = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("k", F.row_number().over(inner) - 1).join(F.broadcast(before.select("part", "before")), "part").withColumn("n", F.col("k") + F.col("before")).drop("part", "k", "before")


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """``sources(source, source_size)`` with weight and target.

    The level rises in rounds: each round is one aggregate over the sources, and clamps all that
    it finds above their caps. Sources are never collected.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("n") % len(weights) + 1).cast("int"))
    s = saved(_numbered(sources).select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    total = min(float(total) * share, float(total) * max_epochs)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        capped, free = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        risen = (total - capped) / free
        if level is not None and risen <= level:
            break
        level = risen
    if level is None:
        return s.withColumn("target", F.lit(0.0))
    return s.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))


def mixing_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """For ``docs(source, size, draw)``: source, source_size, weight, target, whole repetitions and the last draw taken once more."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(sizes, weights, max_epochs, share)
    whole = F.when(F.col("source_size") == 0, 0).when(F.col("target") >= F.col("cap"), max_epochs).otherwise(F.floor(F.col("target") / F.col("source_size")))
    plan = saved(plan.withColumn("whole", whole.cast("int")).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).drop("cap"))

    parts = docs.groupBy("source", F.substring("draw", 1, 3).alias("range")).agg(F.sum("size").alias("size"))
    parts = parts.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("range")))
    p = plan.select(F.col("source").alias("s"), "extra")
    parts = parts.join(p, parts["source"].eqNullSafe(p["s"])).drop("s")
    # the last full range of each source, and the one in which its extra words end
    full = parts.where("upto <= extra").groupBy("source").agg(F.max("range").alias("full_range"))
    cross = parts.where("upto > extra AND upto - size < extra").select("source", F.col("range").alias("cross_range"), (F.col("extra") - (F.col("upto") - F.col("size"))).alias("rest"))
    cross = saved(cross)
    c = cross.withColumnsRenamed({"source": "s"})
    d = docs.withColumn("range", F.substring("draw", 1, 3))
    inside = d.join(c, d["source"].eqNullSafe(c["s"]) & (d["range"] == c["cross_range"])).groupBy("source", "range", "draw", "rest").agg(F.sum("size").alias("size"))
    mid = F.sum("size").over(Window.partitionBy("source", "range").orderBy("draw")) - F.col("size") / 2
    taken = inside.withColumn("mid", mid).where("mid <= rest").groupBy("source").agg(F.max("draw").alias("cross_draw"))

    out = plan
    for side, name in ((full, "full_range"), (taken, "cross_draw")):
        side = side.withColumnRenamed("source", "s")
        out = out.join(side, out["source"].eqNullSafe(side["s"]), "left").drop("s")
    last = F.coalesce("cross_draw", F.concat(F.col("full_range"), F.lit("f" * 13)), F.lit(""))
    return saved(out.select("source", "source_size", "weight", "target", "whole", last.alias("last_draw")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, copies and taken.

    size: the text's words (null or empty text: 0). A null source is a source of its own, sorted
    last; a null id is drawn by its text. Repeated rows each count and are drawn alike. An empty
    table gives an empty result. Other columns are not read.
    """
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("draw")))
    plan = mixing_plan(sized.select("source", "size", "draw"), weights, max_epochs, share)
    out = _planned(sized, plan)
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return join_small(rows, plan, ["source"], "inner").withColumn("copies", F.col("whole") + (F.col("draw") <= F.col("last_draw")).cast("int"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    A null source is one of its own, last in order; a null or empty text has size 0 and is taken with
    its source's whole repetitions. Equal rows are drawn alike; an empty table stays empty.
    """
    columns = docs.columns
    keys = docs.select("source", word_count(F.col("text")).alias("size"), draw(seed).alias("draw"))
    plan = mixing_plan(saved(keys), weights, max_epochs, share)
    rows = docs.select(F.struct(*columns).alias("row"), "source", draw(seed).alias("draw"))
    out = _planned(rows, plan).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         substr(md5('17:' || coalesce(doc_id::varchar, md5(text), '')), 1, 16) as draw
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as weight
  from d group by source),
r as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio from s),
levels as (
  select a.ratio,
         ((select sum(source_size) from s)::double
           - coalesce((select sum(b.cap) from r b where b.ratio < a.ratio), 0.0::double))
         / (select sum(b.weight) from r b where b.ratio >= a.ratio) as level
  from r a),
chosen as (select max(level) as level from levels where level <= ratio),
t as (
  select source, source_size, weight, least(cap, coalesce(level, 1e300::double) * weight) as target, cap
  from r left join chosen on true),
p as (
  select *, case when source_size = 0 then 0 when target >= cap then 3 else floor(target / source_size) end as whole from t),
u as (
  select d.doc_id, d.size, p.source_size, p.target, p.whole,
         greatest(0.0::double, p.target - p.whole * p.source_size) as extra,
         sum(d.size) over (partition by d.source order by d.draw) as upto
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (size * (whole + case when upto - size / 2.0 <= extra then 1 else 0 end))::bigint as taken
from u
"""
