"""Sources mixed to target weights by weighted fair queueing, in DataFrame functions only.

Sources share the words to be taken by weight; none gets more than `max_epochs` times what it has,
and what is cut off is shared again among the others. Each source's documents are shuffled by a hash
and queue up `max_epochs` times, one pass after the other. A copy's virtual finish time is the words of
its source up to its end divided by the source's target. All copies are sorted by finish time over
the whole corpus; a copy's position is the words before it in that order, copies at or beyond the
total are left out and the one that crosses it is cut. The targets add up to the total, so the sort
reaches it when every source has served its target, at time 1. A copy in service at that moment queues
up in pieces of PIECE words, each with its own finish time, so a source's words are within a piece of
its target however long its documents are.

Running sums are made in two steps, within hash ranges of a source and over the ranges' sums, and so
are the positions, within ranges of finish time and over their sums: no source and no sort is one
task's work, however much it holds. Texts are read once, for their sizes; only sizes and keys are
shuffled. What is per source (shares, targets) is a row for each source and is worked out in one task:
sources are collections that people name, thousands at most, not hosts of the web.

Null texts have size 0 and a null source is one source, last in order. Empty sources get target 0.
Rows that repeat a doc_id queue up separately; ties in the hash go by doc_id and size, and rows equal
in all of these are interchangeable. Reruns agree. An empty table gives an empty result. Columns of the
input other than doc_id, text and source are left out unless named in `keep`, which may hold any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, source_order, stash, table

WEIGHTS, TOTAL, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Words of a piece of the copy that a source serves when the mix ends.
PIECE = 16
#: Hash ranges of a source; ranges of finish time up to the end of the mix, and in each doubling of it.
RANGES, BINS = 1024, 8192
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target and budget (words of the whole mix). One row for each source; sums over few rows decide the shares."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size").cast("double") * max_epochs
    each = each.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("all_words", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    all_words = F.col("all_words")
    each = each.withColumn("level", (all_words * total - before) / left)
    level = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap")).otherwise(level * F.col("weight"))
    return each.select("source", "source_size", target.alias("target"), F.floor(all_words * min(total, max_epochs)).alias("budget"))


def queue(docs: DataFrame, keep: dict[str, Column], text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS, ranges: int = RANGES) -> DataFrame:
    """A row for each of docs: nth, kept (struct of `keep`), source, key, size, source_size, target,
    budget and upto, the words of its source up to its end in the first pass."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    key = F.md5(F.concat(F.lit(SEED + ":"), name).cast("binary"))
    rows = stash(docs.select(source_order().alias("nth"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("kept"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), key.alias("key")), "sizes")
    shares = stash(targets(rows, weights, total, max_epochs), "targets").select(F.col("source").alias("s"), "source_size", "target", "budget")
    span = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * ranges / 65536)
    dealt = rows.withColumn("span", span)
    sums = dealt.groupBy("source", "span").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = stash(sums.select(F.col("source").alias("bs"), F.col("span").alias("bspan"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base")), "bases")
    within = Window.partitionBy("source", "span").orderBy("key", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("inside", F.sum("size").over(within))
    placed = summed.join(base, F.col("source").eqNullSafe(F.col("bs")) & (F.col("span") == F.col("bspan")))
    told = placed.join(shares, F.col("source").eqNullSafe(F.col("s")))
    return told.select("nth", "kept", "source", "key", "size", "source_size", "target", "budget", (F.col("base") + F.col("inside")).alias("upto"))


def copies(queued: DataFrame, max_epochs: int = MAX_EPOCHS, piece: int = PIECE) -> DataFrame:
    """What queues up: queued with epoch, part (place of a piece in its copy), words and finish."""
    each = queued.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs)))))
    end = F.col("epoch") * F.col("source_size") + F.col("upto")
    each = each.withColumn("begin", end - F.col("size"))
    serving = (F.col("begin") < F.col("target")) & (F.col("target") < end)
    last = F.when(serving, F.ceil(F.col("size") / piece) - 1).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("serving", serving).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    words = F.when(F.col("serving"), F.least(F.lit(piece), F.col("size") - F.col("part") * piece)).otherwise(F.col("size"))
    each = each.withColumn("words", words.cast("long"))
    return each.withColumn("finish", F.try_divide(F.col("begin") + F.col("part") * piece + F.col("words"), F.col("target"))).drop("begin", "serving")


def mix(queued: DataFrame, max_epochs: int = MAX_EPOCHS, bins: int = BINS, piece: int = PIECE) -> DataFrame:
    """The mix: nth, kept, epoch, part, finish, words taken and position (words of the mix before it)."""
    finish = F.col("finish")
    # beyond the end of the mix a range is as long as it is late, so a source that is far from its target makes few
    place = F.when(finish < 1, F.floor(finish * bins)).otherwise(bins + F.floor(F.log2(finish) * bins))
    served = copies(queued, max_epochs, piece).withColumn("bin", place)
    sums = served.groupBy("bin").agg(F.sum("words").alias("held"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("bin", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("bin").orderBy("finish", "source", "key", "nth", "epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = served.join(base, "bin").where("base < budget")  # ranges that begin after the end are not ordered
    placed = placed.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
    placed = placed.withColumn("position", F.col("base") + F.col("inside")).where("position < budget")
    return placed.select("nth", "kept", "epoch", "part", "finish", F.least("words", F.col("budget") - F.col("position")).alias("words"), "position")


def by_copy(mixed: DataFrame) -> DataFrame:
    """The mix with a row for each copy: nth, kept, epoch, words and the position it begins at. A
    copy's pieces are served in order, so what is taken is its beginning."""
    return mixed.groupBy("nth", "epoch").agg(F.first("kept").alias("kept"), F.sum("words").alias("words"), F.min("position").alias("position"))


def first_words(text: Column, words: Column) -> Column:
    """The first `words` words of a text, joined by spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words.cast("int")), " ")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position is where a document first stands in the mix, in words; -1 if it is not taken."""
    queued = stash(queue(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}), "queue")
    taken = mix(queued).groupBy("nth").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    rows = queued.join(taken, "nth", "left")
    return rows.select("kept.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("position", F.lit(-1)).alias("position"))


ORACLE = r"""
with sized as (
  select row_number() over () as rn, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as key from documents),
each as (
  select source, sum(size)::bigint as source_size, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source),
caps as (select *, source_size::double * 2 as cap, source_size::double * 2 / weight as full_at from each),
levels as (
  select *, (sum(source_size::double) over () * 1.5::double
             - coalesce(sum(cap) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) as level
  from caps),
shares as (
  select source, source_size, case when full_at <= level then cap
         else max(case when full_at > level then level end) over () * weight end as target from levels),
placed as (
  select s.rn, s.doc_id, s.source, s.key, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows unbounded preceding) as upto
  from sized s join shares t on s.source is not distinct from t.source),
copies as (
  select p.*, e.epoch, e.epoch * source_size + upto - size as begin_, e.epoch * source_size + upto as end_
  from placed p, (values (0), (1)) e(epoch) where size > 0),
parts as (
  select c.*, t.part, begin_ < target and target < end_ as serving
  from copies c, unnest(case when begin_ < target and target < end_ then range(0, (size + 15) // 16) else [0::bigint] end) t(part)),
sized_parts as (select *, case when serving then least(16, size - part * 16) else size end::bigint as words from parts),
finishing as (select *, (begin_ + part * 16 + words) / target::double as finish from sized_parts),
ordered as (
  select *, coalesce(sum(words) over (order by finish, source nulls first, key, doc_id, size, rn, epoch, part rows between unbounded preceding and 1 preceding), 0)::bigint as position
  from finishing),
taken as (
  select rn, sum(least(words, budget - position))::bigint as taken, min(position) as position
  from ordered, (select floor(sum(source_size) * 1.5::double)::bigint as budget from shares) where position < budget group by rn)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(position, -1)::bigint as position
from placed left join taken using (rn)
"""
