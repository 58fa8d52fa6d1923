"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, but at most ``EPOCHS``
times its own words; what it cannot give is shared by the others. Complete
epochs of all its documents come first. What is then missing is a weighted
sample without replacement: every document has an exponential key, divided by
its quality weight, and documents are taken in the order of their keys until
the budget of words is reached; the last one gives the words that fill it.

Sources can hold any part of the rows, so none is sorted whole. Keys fall into
ranges, ``RANGES`` for each doubling; words are summed by source and range, with
sums inside the tasks first. Whatever the weights' scale, the fullest range has
about a thousandth of a source's documents. Prefix sums over a source's ranges find the one in which its
budget ends, and only keys of that range are sorted, each different key once.
So a source comes down to one row: its epochs, the key at which it ends and
what rows with this key give. That row is looked up by every document.

Keys follow from a hash of ``doc_id`` and text, so a rerun takes the same. Rows
equal in both have equal keys; where the budget ends among such rows, each
gives an equal part of its words, rounded down.

Defined cases: a null or empty text has no words and gives none; a null source
is a source, the last in order; a null ``doc_id`` is hashed as an empty one. A
weight that is null, not finite or not positive counts as the least one, ``LEAST_WEIGHT``.
An empty table gives no rows, and a source without words has the target 0.
Other columns, of any name, are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import write_down
from vitaeflow.session import lookup_side

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: How often a source may be passed through.
EPOCHS = 3
RANGES = 256
#: Sources ranked in one range of names.
RANGE_ROWS = 100_000
LEAST_WEIGHT = 1e-3
#: Quality weights by label; documents without one have that of ``None``.
LABEL_WEIGHTS = {1: 4.0, None: 2.0, 0: 1.0}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of an MD5."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sampling_key(weight: Column | None = None) -> Column:
    """The exponential key of a row with ``doc_id`` and ``text``: the smaller, the sooner it is taken."""
    given = F.lit(1.0) if weight is None else weight.cast("double")
    usable = F.when((given > LEAST_WEIGHT) & (given < 1 / LEAST_WEIGHT**9), given).otherwise(LEAST_WEIGHT)
    return -F.log(uniform(F.col("doc_id"), F.col("text"))) / usable


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight``: weights by the order of the names, by code point, null last.

    Names are cut into ranges; a source's rank is that in its range after all ranges before.
    """
    rows = sizes.count()
    ranged = sizes.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), F.asc_nulls_last("source"))
    ranged = write_down(ranged.withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, start = {}, 0
    for part in sorted(counts):
        before[part], start = start, start + counts[part]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    offset = F.lit(0)
    if len(before) > 1:
        offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part"))
    rank = (offset + inside) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int"))
    return write_down(ranged.select("source", "source_size", weight.cast("bigint").alias("weight")), "weighed")


def targets(ranked: DataFrame) -> DataFrame:
    """``ranked`` with each source's ``target`` as a double and its whole words, ``budget``.

    Rounds over sums: sources whose share is above ``EPOCHS`` times their words are held there, the
    rest is shared anew, until none is above. One row of sums comes to the driver in each round.
    """
    limit = F.lit(EPOCHS) * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    held, level = F.lit(False), None
    while True:
        sums = ranked.agg(F.sum(F.when(held, limit)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("weights"),
                          F.count(F.when(held, 1)).alias("n")).first()
        if level is not None and sums["n"] == level[2]:
            break
        level = (total - (sums["held"] or 0), sums["weights"], sums["n"])
        if not level[1]:
            break
        # the share left / weights grows from round to round, so what was held stays so
        held = F.lit(level[0]).cast("decimal(38,0)") * F.col("weight") > F.lit(level[1]) * limit
    left, weights, _ = level
    shared = F.lit(left).cast("bigint") * F.col("weight")
    target = F.when(held, limit.cast("double")).otherwise(shared.cast("double") / F.lit(weights or 1).cast("double"))
    budget = F.when(held, limit).otherwise(F.expr(f"CAST({left} AS BIGINT) * weight DIV {weights or 1}"))
    return ranked.withColumns({"target": target, "budget": budget.cast("bigint")})


def cuts(rows: DataFrame) -> DataFrame:
    """One row for each source: ``epochs``, the key ``last`` at which its sample ends, and what rows with this key give.

    Rows before it give all their words, rows behind nothing; rows with this key give ``part`` words of every
    ``whole``. ``rows`` has ``source, size, key`` and is read three times: write it down first.
    """
    sizes = write_down(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    aims = targets(ranked_sources(sizes))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(0).cast("bigint")
    aims = write_down(aims.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "aims")
    span = F.coalesce(F.floor(F.log2("key") * RANGES), F.lit(-(1 << 20))).cast("int")
    rows = rows.where("size > 0").withColumn("span", span)
    by_span = rows.groupBy("source", "span").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("source").eqNullSafe(F.col("s"))
    wanted = lookup_side(aims.where("rest > 0").select(F.col("source").alias("s"), "rest"))
    ending = by_span.withColumn("sum", F.sum("words").over(running)).join(wanted, same)
    ending = write_down(ending.where("sum >= rest AND sum - words < rest").select(
        "s", F.col("span").alias("at"), (F.col("rest") - F.col("sum") + F.col("words")).alias("missing")), "ending")
    by_key = rows.join(lookup_side(ending), same & (F.col("span") == F.col("at")))
    by_key = by_key.groupBy("source", "missing", "key").agg(F.sum("size").alias("words"))
    in_order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = by_key.withColumn("sum", F.sum("words").over(in_order)).where("sum >= missing AND sum - words < missing").select(
        F.col("source").alias("s"), F.col("key").alias("last"), (F.col("missing") - F.col("sum") + F.col("words")).alias("part"),
        F.col("words").alias("whole"))
    made = aims.join(found, same, "left")
    return write_down(made.select("source", "source_size", "target", "epochs", "last", "part", "whole"), "cuts")


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``doc_id, source, size, key`` of every row, written down: texts are read once."""
    return write_down(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
                                  sampling_key(weight).alias("key")), "sized")


def taken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with ``source, size, key``) and what the cuts ``found`` say of them: sources are looked up, rows stay."""
    side = lookup_side(found.withColumnRenamed("source", "s"))
    share = F.expr("CAST(CAST(size AS DECIMAL(38, 0)) * part DIV whole AS BIGINT)")
    sampled = F.when(F.col("key") < F.col("last"), F.col("size")).when(F.col("key") == F.col("last"), share).otherwise(0)
    placed = rows.join(side, F.col("source").eqNullSafe(F.col("s")))
    return placed.withColumn("sampled", F.coalesce(sampled, F.lit(0)).cast("bigint")).drop("s", "last", "part", "whole")


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, sampled, taken`` of every row.

    The mix takes the whole document ``epochs`` times and its first ``sampled`` words once more; ``taken``
    is the number of its words in all. ``weight`` is a quality weight, an expression over ``docs``.
    """
    rows = sized(docs, weight)
    return taken(rows, cuts(rows)).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "sampled",
        (F.col("epochs") * F.col("size") + F.col("sampled")).alias("taken"))


def mixed_texts(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The mix itself: ``doc_id, source, epoch, text``, a row for each time a document is passed through.

    The last epoch of a document of which only some words are taken holds the text up to the last of them.
    """
    found = cuts(sized(docs, weight))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", words(F.col("text")).alias("size"),
                       sampling_key(weight).alias("key"))
    placed = taken(rows, found).withColumn("times", F.col("epochs") + (F.col("sampled") > 0).cast("bigint")).where("times > 0")
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("sampled") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(ends, F.lit(1), F.col("sampled").cast("int")), "")).otherwise(F.col("text"))
    return each.where("size > 0").select("doc_id", "source", "epoch", text.alias("text"))


def label_weights(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """``doc_id, source, text`` with their quality labels (the highest of an id), and the weight that follows from them."""
    best = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality_label"))
    rows = docs.select("doc_id", "source", "text").join(lookup_side(best), F.col("doc_id") == F.col("labelled"), "left")
    weight = F.lit(LABEL_WEIGHTS[None])
    for label in (0, 1):
        weight = F.when(F.col("quality_label") == label, LABEL_WEIGHTS[label]).otherwise(weight)
    return rows, weight
