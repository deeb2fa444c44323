"""Mixing sources to target weights.

``source_plan`` aggregates the words of each source and derives its target and repetition
rate; ``mix`` emits each document ``floor(rate)`` times plus one copy by a hash-seeded
Bernoulli draw whose probability is the fraction of the rate.

Targets share all words by weight (1, 2, 3, repeating, sources in code point order, null
last). A target stops at ``max_rate`` times its source's words and the excess is reshared
by weight. That level is closed form: with sources in order of cap/weight, the first k are
at their caps exactly when the level left for the rest lies above their ratio, so running
sums over the (one row per source) table give it without a loop.

Draws near the target. Under seed r and turn k, a document whose hash u lies in the arc of the
unit circle that begins at k / TURNS and is as long as the fraction gets the copy: for any seed
and turn that has the wanted probability. Each source takes the one of SEEDS x TURNS whose
words come nearest to its target. All turns' words follow from sums by source, seed and cell
of the circle, since a document enters the arc at its hash and leaves at its hash less the fraction;
so this costs one aggregation, and at most 2 * TURNS rows for a source and seed. A source's words
miss its target by a part of one document, as far as its documents allow (one that is larger
than the miss of all others can't be cut).

Defined results: null text counts 0 words; a source without words has target 0 and rate 0;
rows with the same id draw alike; a null id is a value of its own; an empty table gives an
empty result; other columns, whatever their names, are carried through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, carried, checkpointed, column, restored, small_enough

WEIGHTS = (1, 2, 3)
MAX_RATE = 3.0
SEED = 20_240_601
#: Seeds that a source chooses from, and turns of the circle for each.
SEEDS, TURNS = 8, 1024
#: Salts of the shuffled join that replaces a broadcast when there are very many sources.
SALTS = 64


def words_of(name: str = "text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(in_order) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    cap = F.lit(max_rate) * F.col("source_size")
    filled = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("rank", F.row_number().over(in_order))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.sum(cap).over(filled))
        .withColumn("capped_weight", F.sum("weight").over(filled))
        # Level for the rest if this source and all before it stay at their caps.
        .withColumn("after", F.when(F.col("all_weight") > F.col("capped_weight"), (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))))
        .withColumn("at_cap", F.col("after") >= cap / F.col("weight"))
    )
    # Sources at the cap form a prefix of that order, so the last such row has the level.
    level = F.coalesce(F.max_by("after", F.when(F.col("at_cap"), F.col("capped_weight"))).over(everything), F.first(F.col("total") / F.col("all_weight")).over(everything))
    target = F.least(cap, level * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(max_rate))).otherwise(0.0)
    return leveled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(id_column: str = "doc_id", number=None, seed: int = SEED):
    """A number in [0, 1) that depends on the id, the seed and its number alone: 52 bits of an MD5."""
    number = F.lit(0) if number is None else number
    name = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def _cell(place):
    return F.floor(place * TURNS).cast("int")


def _leaves(u, fraction):
    """Where on the circle an arc that ends at ``u`` begins."""
    return u - fraction + F.when(u < fraction, 1.0).otherwise(0.0)


def _joined(sized: DataFrame, plan: DataFrame, id_column: str) -> DataFrame:
    """``sized`` with its source's row of the plan, as ``plan``.

    The plan has a row per source. It is broadcast if its counted rows allow; else it is
    joined by shuffle, with each document salted so that no source meets in one task.
    """
    fields = F.struct(*[c for c in plan.columns if c != "source"]).alias("plan")
    if small_enough(plan):
        side = F.broadcast(plan.select(F.col("source").alias("plan_source"), fields))
        return sized.join(side, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    side = plan.select(F.col("source").alias("plan_source"), fields, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("plan_salt"))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int"))
    return salted.join(side, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("salt") == F.col("plan_salt"))).drop("salt", "plan_salt", "plan_source")


def with_draws(sizes: DataFrame, plan: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The plan with ``fraction`` of its rate and the ``number`` and ``turn`` of each source's draw."""
    plan = plan.withColumn("fraction", F.col("rate") - F.floor("rate"))
    drawn = _joined(sizes.select(id_column, "source", "size").filter("size > 0"), plan, id_column).withColumn("fraction", F.col("plan.fraction")).filter("fraction > 0")
    numbered = drawn.select("source", "size", "fraction", F.explode(F.array(*[F.struct(F.lit(r).alias("number"), draw(id_column, F.lit(r), seed).alias("u")) for r in range(SEEDS)])).alias("d"))
    u, size = F.col("d.u"), F.col("size")
    # Per cell of the circle: words that enter there less words that leave there; words at turn 0.
    entered = F.struct(_cell(u).alias("cell"), size.alias("net"), F.when(u < F.col("fraction"), size).otherwise(0).alias("first"))
    left = F.struct(_cell(_leaves(u, F.col("fraction"))).alias("cell"), (-size).alias("net"), F.lit(0).cast("long").alias("first"))
    events = numbered.select("source", F.col("d.number").alias("number"), F.explode(F.array(entered, left)).alias("e"))
    cells = events.groupBy("source", "number", "e.cell").agg(F.sum("e.net").alias("net"), F.sum("e.first").alias("first"))
    circle = Window.partitionBy("source", "number")
    words = F.sum("net").over(circle.orderBy(F.col("cell").desc())) + F.sum("first").over(circle)
    turns = cells.select("source", "number", F.col("cell").alias("turn"), words.alias("words"))
    wanted = plan.select(F.col("source").alias("plan_source"), (F.col("fraction") * F.col("source_size")).alias("wanted"))
    near = turns.join(wanted, F.col("source").eqNullSafe(F.col("plan_source")))
    best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("wanted")).alias("miss"), "number", "turn")).alias("best"))
    chosen = best.select(F.col("source").alias("best_source"), "best")
    return plan.join(chosen, F.col("source").eqNullSafe(F.col("best_source")), "left").select(
        "source", "source_size", "target", "rate", "fraction", F.coalesce("best.number", F.lit(0)).alias("number"), F.coalesce("best.turn", F.lit(0)).alias("turn")
    )


def with_copies(sized: DataFrame, plan: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``sized`` (with source) with its source's plan (with draws) and ``copies``."""
    u, fraction = draw(id_column, F.col("plan.number"), seed), F.col("plan.fraction")
    held = lambda place: (_cell(place) >= F.col("plan.turn")).cast("long")
    extra = held(u) - held(_leaves(u, fraction)) + (u < fraction).cast("long")
    return _joined(sized, plan, id_column).withColumn("copies", F.floor("plan.rate") + extra)


def _planned(docs: DataFrame, weights, max_rate: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of all rows, checkpointed, and the plan with draws. Texts are read once."""
    sized = checkpointed(docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "source").cast("string").alias("source"), words_of("text").alias("size")))
    return sized, checkpointed(with_draws(sized, checkpointed(source_plan(sized, weights, max_rate)), "doc_id", seed))


def takes(docs: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    sized, plan = _planned(docs, weights, max_rate, seed)
    return with_copies(sized, plan, "doc_id", seed).select(
        "doc_id", "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("plan.rate").alias("rate")
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, all columns kept."""
    names = docs.columns
    plan = _planned(docs, weights, max_rate, seed)[1]
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "source").cast("string").alias("source"), carried(docs))
    return with_copies(rows, plan, "doc_id", seed).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*restored(names))
