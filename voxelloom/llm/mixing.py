"""Mixing sources to target weights, in DataFrame operations only.

Each source is one stream of words, its documents one after the other, cut into blocks of at
most `block` words (shorter in a source of under `fine` such blocks, so that whole blocks can
meet its target). Output shards of `shard` slots draw their source counts from a multinomial
law: those counts say how many slots of a source a shard takes. A source's slots are numbered
over the shards and slot j takes block perm(j mod n) of epoch j div n, where perm is a keyed
bijection of the source's n block numbers. Slots and blocks then meet in an equi-join on
(source, block).

A source takes what its shards drew. Only where a whole source's draws end farther than `near`
(a fraction) from its quota, which the law of large numbers leaves to small corpora, the last
draws beyond that band are given back, or one more shard takes the slots that are lacking; no
source takes more than `most` epochs.

Defined cases: null text has size 0; null source is a source of its own, last in order; rows
repeated in every column are separate documents; no rows give no rows; a size of 0 takes 0; a
very long text spans many blocks. Extra columns are ignored by `mix_report` and `mix_blocks` and
kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelloom.functions.columns import let
from voxelloom.llm.shared import buckets_for, running_offset, written

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it (and before the first), so that slices keep layout.
WORD_AND_SPACE = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_AND_SPACE), F.lit(0))


def source_targets(rows: DataFrame, weights: list[float], share: float, most: float, block: int, near: float, fine: int = 1024) -> DataFrame:
    """One row per source: size, target, block length, blocks, slots and their bounds. Window over sources only, which are few."""
    sums = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("_source").isNull(), "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = W.partitionBy()
    filled = W.orderBy("_level", F.col("_source").isNull(), "_source")
    earlier, onward = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(onward)
    out = (
        sums.withColumn("_w", weight)
        .withColumn("sidx", F.row_number().over(by_name) - 1)
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_reach", level)
        .withColumn("_water", F.min_by("_reach", F.when(F.col("_level") > F.col("_reach"), F.struct("_level", F.col("_source").isNull(), "_source"))).over(everything))
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_w") * F.col("_water"), F.col("_cap"))))
        .withColumn("len", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {fine}L"))).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("len")).cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("slot_hi", F.sum("slots").over(by_name.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_band", F.floor(F.col("slots") * F.lit(float(near))))
        .withColumn("fewest", F.col("slots") - F.col("_band"))
        .withColumn("most", F.least(F.col("slots") + F.col("_band"), F.floor(F.col("blocks") * F.lit(float(most)))))
    )
    return out.select("_source", "sidx", "source_size", "target", "len", "blocks", "slots", "fewest", "most", (F.col("slot_hi") - F.col("slots")).alias("slot_lo"), "slot_hi")


def permuted(df: DataFrame, index: str, size: str, key: list[str], seed: int, rounds: int = 8) -> DataFrame:
    """Replace `index` in [0, size) by a keyed bijection of it: swap-or-not rounds (Hoang, Morris, Rogaway)."""
    keys = F.array(*[F.xxhash64(F.lit(seed), F.lit(r), *key) for r in range(rounds)])

    def swap_or_not(x: Column, k: Column) -> Column:
        other = F.array(F.pmod(F.pmod(k, F.col(size)) - x, F.col(size)))  # a lambda binds it once
        return F.element_at(F.transform(other, lambda o: F.when(F.xxhash64(k, F.greatest(x, o)).bitwiseAND(F.lit(1)) == 1, o).otherwise(x)), 1)

    return df.withColumn(index, F.aggregate(keys, F.col(index), swap_or_not))


def shard_counts(targets: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, sidx, n): the multinomial draws, one of `shard` slots for each output shard."""
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    cells, most = 1024, max(total, 1)
    ranges = targets.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"slot_lo * {cells}L div {most}L"), F.expr(f"(slot_hi - 1) * {cells}L div {most}L"))))
    draws = targets.sparkSession.range(0, total, 1, max(8, total // 1_000_000)).select(F.expr(f"id div {shard}L").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most)).alias("x"))
    draws = draws.withColumn("cell", F.expr(f"x * {cells}L div {most}L"))
    hit = draws.join(ranges.select("cell", "sidx", "slot_lo", "slot_hi"), "cell").where("x >= slot_lo and x < slot_hi")
    return hit.groupBy("shard", "sidx").agg(F.count("*").alias("n"))


def drawn_slots(targets: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, sidx, j, epoch, block): one row per output slot. j numbers a source's slots over all shards."""
    counts = written(shard_counts(targets, shard, seed))
    rows = counts.count()
    numbered = running_offset(counts, ["sidx"], F.col("n"), ["shard"], buckets_for(rows), "first")
    limits = targets.select("sidx", "fewest", "most", "slots", "blocks")
    kept = numbered.join(limits, "sidx").where("first < most").select("shard", "sidx", "first", F.least("n", F.col("most") - F.col("first")).alias("n"))
    drawn = counts.groupBy("sidx").agg(F.sum("n").alias("drawn"))
    lacking = limits.join(drawn, "sidx", "left").withColumn("first", F.coalesce("drawn", F.lit(0))).where("fewest > first")
    last = lacking.select(F.lit(-1).cast("long").alias("shard"), "sidx", "first", (F.col("fewest") - F.col("first")).alias("n"))
    # a run of slots is at most one shard long, but that of the shard that makes up for lacking draws may be longer
    runs = kept.unionByName(last).withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {shard}L)")))
    runs = runs.select("shard", "sidx", (F.col("first") + F.col("piece") * shard).alias("first"), F.least(F.lit(shard), F.col("n") - F.col("piece") * shard).alias("n"))
    runs = runs.join(limits.select("sidx", "blocks"), "sidx").repartition(max(8, rows * shard // 20_000_000), "shard", "sidx", "first")
    slots = runs.select("shard", "sidx", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j"))
    slots = slots.select("shard", "sidx", "j", "blocks", F.expr("j div blocks").alias("epoch"), F.expr("j % blocks").alias("block"))
    return permuted(slots, "block", "blocks", ["sidx", "epoch"], seed)


def plan(rows: DataFrame, order: list[str], weights, share, most, block, shard, seed, near) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(_source, size, *order): the rows with their targets and offsets, their blocks, and the slots."""
    rows = written(rows)
    targets = written(source_targets(rows, list(weights), share, most, block, near))
    placed = rows.join(targets.select("_source", "sidx", "source_size", "target", "len").withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = written(running_offset(placed, ["sidx"], F.col("size"), order, buckets_for(rows.count(), least=64), "offset"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr("sequence(offset div len, (offset + size - 1) div len)")))
    begin = F.greatest("offset", F.col("block") * F.col("len"))
    pieces = pieces.withColumn("start", begin - F.col("offset")).withColumn("length", F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * F.col("len")) - begin)
    return placed, pieces, drawn_slots(targets, shard, seed)


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as _row under two hashes of all its columns, and what `plan` needs of it."""
    columns = docs.columns
    one = {c: F.col(f"`{c}`") for c in columns}
    whole = [F.to_json(F.struct(one[c])) if "map<" in kind else one[c] for c, kind in docs.dtypes]  # maps have no hash
    keyed = docs.select(F.struct(*[v.alias(c) for c, v in one.items()]).alias("_row"), F.xxhash64(*whole).alias("_k1"), F.xxhash64(F.lit(5), *whole).alias("_k2"))
    return keyed, keyed.select("_k1", "_k2", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").cast("string").alias("_source"), words(F.col("_row.text")).alias("size"))


def mix_report(docs: DataFrame, *, weights=(3, 1, 2), share=1.5, most=2.0, block=64, shard=8192, seed=17, near=0.0005) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("_source"), words(F.col("text")).alias("size"))
    placed, pieces, slots = plan(rows, ["doc_id", "size"], weights, share, most, block, shard, seed, near)
    # exploded slots look tiny to the planner, which would broadcast them: their joins ask for a merge
    takes = slots.groupBy("sidx", "block").agg(F.count("*").alias("times"))
    taken = pieces.select("sidx", "offset", "block", "length").join(takes.hint("merge"), ["sidx", "block"]).groupBy("sidx", "offset").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    # an offset belongs to one row of positive size; empty rows take nothing
    full = placed.where("size > 0").join(taken, ["sidx", "offset"], "left")
    empty = placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return full.unionByName(empty).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, weights=(3, 1, 2), share=1.5, most=2.0, block=64, shard=8192, seed=17, near=0.0005) -> DataFrame:
    """The mixed corpus: one row per document and epoch, its text the words that the epoch takes.

    Words keep the white space after them; a document taken whole keeps its text as it is.
    All columns of docs stay; n_chars, where there is one, is set anew. Documents without
    words take no part.
    """
    columns = docs.columns
    keyed, rows = keyed_rows(docs)
    _, pieces, slots = plan(rows, ["doc_id", "_k1", "_k2"], weights, share, most, block, shard, seed, near)
    took = pieces.select("_k1", "_k2", "sidx", "offset", "size", "block", "start", "length").join(slots.hint("merge"), ["sidx", "block"])
    spans = took.groupBy("_k1", "_k2", "offset", "epoch", "size").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"), F.sum("length").alias("got"))
    texts = keyed.dropDuplicates(["_k1", "_k2"]).join(spans.hint("merge"), ["_k1", "_k2"])
    partly = let(split_words("_row.text"), lambda p: F.array_join(F.transform("spans", lambda s: F.array_join(F.slice(p, (s["start"] + 1).cast("int"), s["length"].cast("int")), "")), ""))
    out = texts.select("_row", F.when(F.col("got") == F.col("size"), F.col("_row.text")).otherwise(partly).alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[made.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def mix_blocks(docs: DataFrame, *, weights=(3, 1, 2), share=1.5, most=2.0, block=64, shard=8192, seed=17, near=0.0005) -> DataFrame:
    """The mix as its shards hold it: shard, slot, doc_id, source, start, text, one row per document piece of a slot.

    Slots lie in pseudorandom order within their shard; pieces of one slot run in the order of
    `start` within each document. Shard -1 makes up for lacking draws.
    """
    keyed, rows = keyed_rows(docs)
    _, pieces, slots = plan(rows, ["doc_id", "_k1", "_k2"], weights, share, most, block, shard, seed, near)
    took = pieces.select("_k1", "_k2", "sidx", "offset", "block", "start", "length").join(slots.hint("merge"), ["sidx", "block"])
    placed = took.select("_k1", "_k2", "offset", "start", "length", "shard", F.xxhash64(F.lit(seed), "sidx", "j").alias("slot"))
    # an offset belongs to one document: copies of a row are not gathered into one list
    spans = placed.groupBy("_k1", "_k2", "offset").agg(F.collect_list(F.struct("shard", "slot", "start", "length")).alias("spans"))
    texts = keyed.dropDuplicates(["_k1", "_k2"]).join(spans.hint("merge"), ["_k1", "_k2"])
    cut = let(split_words("_row.text"), lambda p: F.transform("spans", lambda s: F.struct(s["shard"].alias("shard"), s["slot"].alias("slot"), s["start"].alias("start"), F.array_join(F.slice(p, (s["start"] + 1).cast("int"), s["length"].cast("int")), "").alias("text"))))
    out = texts.select("_row.doc_id", "_row.source", F.explode(cut).alias("_piece"))
    return out.select("_piece.shard", "_piece.slot", "doc_id", "source", "_piece.start", "_piece.text")
