"""Mixing sources to target weights, in native DataFrame operations.

A source's words, its documents laid end to end, fall into blocks of ``block`` words.  The
targets say how many blocks (slots) each source fills.  Per output shard the numbers of
slots of each source are drawn: a multinomial draw given the sources' totals, so that a
source meets its target whatever the draw.  The mix is laid out by it: a shard holds the
slots drawn for it, sources intermingled in a pseudorandom order of positions.  Running
totals over the shards number a source's slots; slot j stands for pass j // n over its n blocks, and within a pass the
slots go through a pseudorandom permutation of the block indices (a Feistel network, walked
until it falls in range).  Blocks are then joined to slots by index.  The last slot of a
source is cut where its target ends, and a source's short last block comes last in a pass.

Defined results: a null source is a source of its own, last; null and empty texts have size
0 and are taken 0 times; very long texts are counted and taken whole, block by block; rows equal in doc_id are ordered by their size and are else
interchangeable; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partcast.llm.base import SPACES, chunks_for, materialise, prefix_sums, unwrapped, whole_rows
from partcast.llm.quality import let, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024
SHARD_SLOTS = 4096
#: Slots made from one row at a time (bounds the arrays that are exploded).
STEP = 4096
SALTS = 64


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sid, source, source_size, target.  Sources in code point order, null last, have the
    weights in turn; the target is least(most * size, level * weight), with the level at
    which the targets sum to ``share`` of all sizes.  One row per source goes through the
    windows."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("sid", F.row_number().over(by_name) - 1)
            .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights)))))
            .withColumn("most", most * F.col("source_size")))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "sid")
    first = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    rows = (rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(first), F.lit(0)))
                            / F.sum("weight").over(rest))
            # the first source that the level does not fill sets it
            .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(every)["level"]))
    return rows.select("sid", "source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A permutation of 0..n-1 that depends on the seed."""
    def walk(dims: Column) -> Column:
        def rounds(x: Column) -> Column:
            halves = F.struct(F.floor(x / dims["b"]).cast("long").alias("l"), (x % dims["b"]).alias("r"))
            done = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), halves, lambda s, i: F.struct(
                s["r"].alias("l"),
                let(F.when(i % 2 == 0, dims["a"]).otherwise(dims["b"]),
                    lambda d: (s["l"] + F.pmod(F.xxhash64(s["r"], i, *seed), d)) % d).alias("r")))
            return let(done, lambda s: s["l"] * dims["b"] + s["r"])

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), rounds(index), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))

    return let(let(F.ceil(F.sqrt(n.cast("double"))).cast("long"), lambda a: F.struct(a.alias("a"), F.ceil(n / a).cast("long").alias("b"))), walk)


def draw_slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11) -> DataFrame:
    """sid, shard, slot, pass, block, take, position: every slot of the mix, what it takes
    and where it goes (by position within its shard)."""
    full = F.floor(F.col("source_size") / block).cast("long")
    plan = (sources.where("target >= 1").withColumn("full", full)
            .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
            .withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
            .withColumn("over", F.floor("target").cast("long") - F.col("passes") * F.col("source_size"))
            .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block).cast("long")))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(W.partitionBy()) / shard_slots)).cast("long")
    plan = plan.withColumn("shards", shards).where("slots > 0")
    steps = plan.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / STEP).cast("long"))))
    draws = (steps.withColumn("draw", F.explode(F.sequence(F.col("step") * STEP, F.least((F.col("step") + 1) * STEP, "slots") - 1)))
             .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "sid", "draw"), F.col("shards"))))
    counts = draws.groupBy("sid", "shard", "source_size", "full", "blocks", "passes", "over").agg(F.count("*").alias("n"))
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = (counts.withColumn("first", F.sum("n").over(before) - F.col("n"))
             .withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
             .withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
             .withColumn("index", F.col("slot") % F.col("blocks")))
    spread = slots.withColumn("block", F.when(F.col("index") >= F.col("full"), F.col("index"))
                              .otherwise(permuted(F.col("index"), F.col("full"), F.lit(seed), F.col("sid"), F.col("pass"))))
    words = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    take = F.when(F.col("pass") < F.col("passes"), words).otherwise(F.least(words, F.greatest(F.col("over") - F.col("index") * block, F.lit(0).cast("long"))))
    position = F.xxhash64(F.lit(seed), "sid", "slot", F.lit("position"))
    return spread.select("sid", "shard", "slot", "pass", "block", take.alias("take"), position.alias("position"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """sid, shard, slots: what the draw gave each shard."""
    return slots.groupBy("sid", "shard").agg(F.count("*").alias("slots"))


def _plan(docs: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source, and the slots."""
    sizes = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = materialise(targets(sizes), "sources")
    # the salt spreads a hot source if the table of sources is too large for Spark to send to all tasks
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")
    with_source = (sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).alias("d")
                   .join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("d.salt") == salted["salt"]))
                   .select("doc_id", "size", "source", "sid", "source_size", "target"))
    placed = prefix_sums(with_source, ["sid"], ["doc_id", "size"], "size", "start", chunks_for(sizes.count()))
    return placed, draw_slots(sources, block, seed=seed)


def taken_parts(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of documents of some size and the slots that take from them: pass, the document's
    words ``lo`` up to ``hi``, and the slot's shard and position."""
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    lo = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start"))
    hi = F.when(F.col("take").isNotNull(), F.least(F.col("size"), F.col("block") * block + F.col("take") - F.col("start")))
    # there are as many slots as blocks, though they come from the small table of sources
    drawn = slots.select("sid", "block", "pass", "take", "shard", "position").hint("merge")
    return (pieces.join(drawn, ["sid", "block"], "left")
            .withColumn("lo", lo).withColumn("hi", F.greatest(F.col("lo"), F.coalesce(hi, F.lit(0).cast("long")))))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, of every document, and ``places``: the shard
    and position of each part taken, and its words."""
    placed, slots = _plan(docs, block, seed)
    parts = taken_parts(placed, slots, block)
    words = (F.col("hi") - F.col("lo")).cast("long")
    place = F.when(words > 0, F.struct(F.col("shard").cast("long").alias("shard"), "position", words.alias("words")))
    some = (parts.groupBy("sid", "start", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("taken"), F.array_sort(F.collect_list(place)).alias("places")))
    none = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "places": F.array().cast("array<struct<shard:long,position:long,words:long>>")})
    columns = ["doc_id", "size", "source_size", "target", "taken", "places"]
    return some.select(columns).unionByName(none.select(columns))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """The mix as documents: a row per document and pass with the words that it takes there
    (with the white space that follows them), and the other columns as they are.  The rows
    of a shard are together, in the order of the positions drawn (a document longer than a
    block goes where its first part goes)."""
    placed, slots = _plan(docs, block, seed)
    passes = (taken_parts(placed, slots, block).where("hi > lo")
              .groupBy("sid", "start", "doc_id", "size", "source", "pass").agg(F.collect_list(F.struct("lo", "hi", "shard", "position")).alias("ranges"))
              .withColumn("key", F.to_json(F.struct("doc_id", "size", "source"))))
    # rows equal in doc_id, size and source are numbered on either side; any pairing of them is a mix
    ranges = (passes.groupBy("key", "sid", "start").agg(F.collect_list(F.array_sort("ranges")).alias("_passes"))
              .withColumn("_nr", F.row_number().over(W.partitionBy("key").orderBy("start")))
              .select(F.col("key").alias("_rkey"), "_nr", "_passes"))
    rows = (whole_rows(docs).withColumn("_size", n_words(F.col("doc.text")))
            .withColumn("_key", F.to_json(F.struct("doc.doc_id", F.col("_size").alias("size"), "doc.source")))
            .withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(F.xxhash64("doc.text")))))
    # not an equality, so that the rows stay where the window has put them
    same = (F.col("_key") == F.col("_rkey")) & (F.col("_n") >= F.col("_nr")) & (F.col("_n") <= F.col("_nr"))
    pieces = F.regexp_extract_all("doc.text", F.lit(f"([^{SPACES}]+[{SPACES}]*)"), F.lit(1))
    taken = F.aggregate("_pass", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])
    cut = let(pieces, lambda w: F.array_join(F.flatten(F.transform("_pass", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), ""))
    out = rows.join(ranges, same).withColumn("_pass", F.explode("_passes"))
    out = out.withColumns({"_shard": F.element_at("_pass", 1)["shard"], "_position": F.element_at("_pass", 1)["position"]})
    out = out.repartition("_shard").sortWithinPartitions("_shard", "_position")
    out = out.withColumn("_text", F.when(taken == F.col("_size"), F.col("doc.text")).otherwise(cut))
    return unwrapped(out, docs.columns, {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")})
