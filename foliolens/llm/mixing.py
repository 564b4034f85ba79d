"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule: weights at knots of training time 0..1, linear between
them.  Integrated and shared out, the schedules give each source's cumulative demand for
words; a source's target is its demand at time 1.  A document's place in its source (a
hash order) gives the words before it in each pass over the source, and the time at which
demand reaches them is that pass's training position.  Passes are then sorted by position.

Running sums are taken in two steps, over hash buckets of a source and inside a bucket,
so that a source with a third of all rows is spread like any other.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 take nothing; repeated rows follow each other in the order and
each takes its own share; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliolens.llm.common import stored, whole_rows

WEIGHTS = (5.0, 2.0, 1.0)
# Weight at the beginning and at the end of training, as multiples of the mean.
SHAPES = ((2.0, 0.0), (1.0, 1.0), (0.0, 2.0))
MAX_REPEATS = 3
PASSES = "array<struct<pass:bigint,words:bigint,position:double>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sized(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, text_key, size, copy)``; ``copy`` numbers rows that agree in all of these."""
    rows = documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))
    # Equal rows are counted before they are spread again, so none is lost or merged.
    counted = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").cast("int").alias("copies"))
    return counted.select(
        "doc_id", "source", "text_key", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )


def default_schedules(sources: DataFrame) -> DataFrame:
    """Weights 5, 2, 1, repeating, by the sources' code-point order, null last: the first kind falls to 0 over
    the time, the second stays, the third grows from 0, each with its weight as its mean."""
    # One row per source: the table is as small as the list of sources.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    shapes = F.array(*[
        F.array(F.lit(weight * first), F.lit(weight * last)) for weight, (first, last) in zip(WEIGHTS, SHAPES)
    ])
    return sources.select("source", F.element_at(shapes, turn + 1).alias("schedule"))


def integral(schedule: Column) -> Column:
    """Area under equally spaced knots over time 0..1."""
    steps = F.sequence(F.lit(1), F.size(schedule) - 1)
    return F.aggregate(
        steps, F.lit(0.0),
        lambda area, i: area + (F.element_at(schedule, i) + F.element_at(schedule, i + 1)) / 2,
    ) / (F.size(schedule) - 1)


def targets(sizes: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, schedule, target)``: all sizes shared by weight, none above its cap.

    Shares are filled level by level: sources in order of cap per weight, the full ones held
    at their caps, the rest sharing what is left by weight.  With ``level`` the share per unit
    of weight, a source is full exactly when its cap per weight is at most that level.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plans = default_schedules(sources.select("source")) if schedules is None else schedules
    plans = plans.select(F.col("source").alias("_source"), "schedule")
    joined = sources.join(plans, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "schedule", F.coalesce(integral(F.col("schedule")), F.lit(0.0)).alias("weight"),
        (F.lit(max_repeats) * F.col("source_size")).alias("cap"),
    )
    everything = Window.partitionBy(F.lit(0))
    # Weightless sources come last, so that they never stand before one that can take words.
    order = everything.orderBy(
        F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(),
        F.col("source").asc_nulls_last(),
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.col("caps_before"), F.lit(0))) / F.col("weight_left")
    levels = joined.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        F.sum("cap").over(before).alias("caps_before"), F.sum("weight").over(after).alias("weight_left"),
    ).withColumn(
        # Levels rise up to the first source that its level does not fill, and fall after it.
        "level", F.when((F.col("weight") > 0) & (F.col("cap") > level * F.col("weight")), level)
    ).withColumn("level", F.max("level").over(everything))
    share = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    )
    return levels.select(
        "source", "source_size", "schedule",
        F.round(F.when(F.col("weight") > 0, share).otherwise(0.0), 6).alias("target"),
    )


def placed(sizes: DataFrame, rows: int) -> DataFrame:
    """Documents of a source in the order of their id's MD5.  Adds ``before``: words of the source's documents that stand before this one in hash order."""
    # As many buckets as documents in one, so that neither sum is long: the first bits of the order.
    bits = (rows.bit_length() + 1) // 2
    keyed = sizes.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(
        "_bucket", F.shiftright(F.conv(F.substring("_order", 1, 12), 16, 10).cast("bigint"), 48 - bits)
    )
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "text_key", "copy").rowsBetween(
        Window.unboundedPreceding, -1
    )
    run = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return run.join(
        offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    ).select(*sizes.columns, (F.col("_offset") + F.col("_inside")).alias("before"))


def training_time(schedule: Column, share: Column) -> Column:
    """The time at which a source has used this share (0..1) of its demand: the integral inverted.

    Between two knots demand is quadratic in time, so the inverse is a square root.
    """
    pieces = F.size(schedule) - 1
    wanted = share * integral(schedule) * pieces

    def step(state: Column, i: Column) -> Column:
        left, right = F.element_at(schedule, i), F.element_at(schedule, i + 1)
        area = (left + right) / 2
        slope = right - left
        rest = wanted - state["area"]
        root = F.sqrt(F.greatest(F.lit(0.0), left * left + 2 * slope * rest))
        inner = F.when(left + root > 0, 2 * rest / (left + root)).otherwise(0.0)
        here = state["time"].isNull() & ((rest <= area) | (i == pieces))
        return F.struct(
            (state["area"] + area).alias("area"),
            F.when(here, (i - 1 + F.least(F.lit(1.0), inner)) / pieces).otherwise(state["time"]).alias("time"),
        )

    start = F.struct(F.lit(0.0).alias("area"), F.lit(None).cast("double").alias("time"))
    return F.aggregate(F.sequence(F.lit(1), pieces), start, step, lambda state: state["time"])


def mix(documents: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(doc_id, source, text_key, copy, size, source_size, target, taken, position)`` of every document.

    A source passes over its documents as often as its target holds its size; the pass cut
    short takes documents in hash order until the target is met, the last one in part.
    ``passes`` has ``(pass, words, position)`` of each pass that takes words of the document, position
    being the training time of its first word there; ``position`` is that of the first pass,
    null if nothing is taken.
    """
    sizes = stored(sized(documents), "sizes")
    aims = targets(sizes, schedules, max_repeats)
    run = placed(sizes, sizes.count())
    joined = run.join(
        aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    aim = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = aim - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (passes * F.col("size") + part).cast("bigint")

    def at(number: Column) -> Column:
        share = (number * F.col("source_size") + F.col("before")) / F.col("target")
        return training_time(F.col("schedule"), F.least(F.lit(1.0), share))

    def taking(number: Column) -> Column:
        words = F.when(number < passes, F.col("size")).otherwise(part).cast("bigint")
        return F.struct((number + 1).alias("pass"), words.alias("words"), at(number).alias("position"))

    # Whole passes, and the one cut short if it takes any of this document.
    last = passes + F.when(part > 0, 0).otherwise(-1)
    repeats = F.when(
        taken > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last), taking)
    ).otherwise(F.array().cast(PASSES))
    return joined.select(
        "doc_id", "source", "text_key", "copy", "size", "source_size", "target", taken.alias("taken"),
        F.when(taken > 0, at(F.lit(0))).alias("position"), repeats.alias("passes"),
    )


def planned(documents: DataFrame, plan: DataFrame, added: list[str]) -> DataFrame:
    """The documents with their rows of the plan, sorted by position over all files, with the columns
    ``added`` of the plan (behind ``mix_`` if the documents have a column of that name)."""
    keys = ["doc_id", "source", "text_key", "copy"]
    plan = plan.select(*[F.col(key).alias(f"_{key}") for key in keys], F.struct(*added).alias("_plan"))
    rows = whole_rows(documents, doc_id=F.col("doc_id"), source=F.col("source"), text_key=F.xxhash64("text"))
    numbered = rows.withColumn("copy", F.row_number().over(
        Window.partitionBy("doc_id", "source", "text_key").orderBy(F.lit(0))
    ))
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    own = numbered.join(plan, same)
    taken = {name.lower() for name in documents.columns}
    names = {}
    for name in added:
        names[name] = name
        while names[name] in taken:
            names[name] = f"mix_{names[name]}"
        taken.add(names[name])
    return own.select(
        *[F.col("row").getField(name).alias(name) for name in documents.columns],
        *[F.col("_plan").getField(name).alias(names[name]) for name in added],
    ).repartitionByRange(names["position"], "doc_id").sortWithinPartitions(names["position"], "doc_id")


def curriculum(documents: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each document that the mix takes, sorted by its first position, with
    ``size, source_size, target, taken, position`` and ``passes`` added."""
    plan = mix(documents, schedules, max_repeats).filter("taken > 0")
    return planned(documents, plan, ["size", "source_size", "target", "taken", "position", "passes"])


def training_order(documents: DataFrame, schedules: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each pass that takes words of a document, sorted by position, with ``size, source_size, target``,
    ``taken`` (by all passes), ``pass`` (from 1), ``words`` (by this pass) and ``position`` added."""
    plan = mix(documents, schedules, max_repeats).drop("position").select("*", F.inline("passes")).drop("passes")
    return planned(documents, plan, ["size", "source_size", "target", "taken", "pass", "words", "position"])
