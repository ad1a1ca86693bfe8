"""Document fingerprints of spot signatures, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. A common word
(``ANCHORS``) is an anchor; its signature is a hash of the anchor and of the
``CHAIN`` content words (words that are no anchors) that follow it, with the
anchors between them left out. Boilerplate without common words thus adds
little, and an edited word changes the chains around it only. The set of a
text's signatures is its fingerprint; two are compared by Jaccard likeness.

``likeness`` prunes by length: sets whose sizes alone rule out the least
likeness asked for are not intersected. ``near_pairs`` is the join: equal sets
form one class, sets are partitioned by length so that only neighbouring
partitions can be alike, and within them only sets sharing one of their rarest
signatures (the prefix that any partner must hit) are compared.

``edited_copies`` pairs every document with the next one in descending doc_id
without a global sort: ids are cut into buckets of about ``BUCKET_ROWS`` rows by
a grid over the id range; the first row of every bucket is also sent to the one
before it, so a window within buckets sees each row's successor.

Defined results: a null text is an empty one. A text without an anchor that a
content word follows has one signature, its whole word sequence, or the text
itself if it has no words; an empty text has none, and two empty sets are alike
(1.0). Rows with equal doc_id follow each other by text; null doc_ids come last.
Rows of equal doc_id share a bucket. A single row is its own next. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.shared import Scratch, doc_columns

# Common words of English, German, French and Spanish.
ANCHORS = ("the of and to a in is that for it was on with be as by this are at from "
           "der die und den von zu das sich mit auf des für ist nicht im dem ein eine als "
           "de la le et les un du une que pour est qui dans par pas au sur avec en "
           "el y los se del las por no con su para es al lo").split()
CHAIN = 2
BUCKET_ROWS = 1024
GRID = 1024            # cells of the id range whose rows are counted
FAN_OUT = 1024         # buckets per window when empty buckets are skipped
MOST_BUCKETS = 100_000  # bucket table is broadcast up to here


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> Column:
    """Sorted distinct signatures (array<long>) of a text column."""
    longest = max(map(len, anchors))
    anchor = rf"(?<![^ ])(?=[^ ]{{1,{longest}}} )({'|'.join(anchors)}) "

    def chains(spots: Column) -> Column:
        """Signatures of an array of (anchors, word)."""
        return F.flatten(F.transform(spots, lambda x, i: F.transform(x["anchors"], lambda a: F.xxhash64(
            a, *[F.get(spots, i + k)["word"] for k in range(chain)]))))

    def of_words(words: Column) -> Column:
        # every anchor is glued to what follows it: the old man of the sea -> the~old man of~the~sea
        tokens = F.split(F.regexp_replace(F.concat(words, F.lit(" ")), anchor, "$1~"), " ")
        spots = F.transform(F.transform(tokens, lambda t: F.split(t, "~")), lambda t: F.struct(
            F.slice(t, 1, F.size(t) - 1).alias("anchors"), F.element_at(t, -1).alias("word")))
        # a trailing run of anchors has no content word
        found = _let(F.filter(spots, lambda x: x["word"] != ""), chains)
        alone = F.when(words != "", F.array(F.xxhash64(F.lit("words"), words))) \
            .when(text != "", F.array(F.xxhash64(F.lit("text"), text))) \
            .otherwise(F.array().cast("array<bigint>"))
        return _let(found, lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(alone))

    return _let(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), of_words)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, 0.0 where it is below ``least``;
    sizes that rule ``least`` out are not intersected."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    value = shared / (small + large - shared)
    return (F.when(large == 0, F.lit(1.0))
            .when((small == 0) | (small < F.lit(least) * large), F.lit(0.0))
            .otherwise(F.when(value >= least, value).otherwise(F.lit(0.0))))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in order, as hexadecimal numbers."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), " ")


def _texts(docs: DataFrame) -> DataFrame:
    return doc_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, signatures) of every document."""
    return _texts(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"),
                               signatures(F.col("text")).alias("signatures"))


def _bucket(ids: DataFrame, rows_per_bucket: int) -> Column:
    """Number of an id's bucket, rising with the id; 0 for null."""
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(0).cast("long")
    width = (high - low) // GRID + 1
    cell = F.expr(f"(doc_id - ({low})) div {width}")
    counts = {r.cell: r.n for r in ids.where("doc_id is not null").groupBy(cell.alias("cell"))
              .agg(F.count("*").alias("n")).collect()}  # one row per cell of the grid
    first, parts, at = [], [], 1
    for c in range(GRID):
        # no more parts than ids in the cell
        n = min(width, math.ceil(counts.get(c, 0) / rows_per_bucket))
        first.append(at)
        parts.append(max(1, n))
        at += n
    inside = F.expr(f"(doc_id - ({low})) % {width}")
    at_cell = (cell + 1).cast("int")
    place = F.floor(inside.cast("double") / width * F.element_at(F.lit(parts), at_cell))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.element_at(F.lit(first), at_cell) + place).cast("long")


def _previous(numbers: DataFrame, fan_out: int) -> DataFrame:
    """(b, prev): the next greater b (0 or more), the least for the greatest, by
    windows over ``fan_out`` numbers and a smaller table of their groups."""
    groups = numbers.withColumn("g", F.expr(f"b div {fan_out}"))
    inside = groups.withColumn("up", F.lead("b").over(Window.partitionBy("g").orderBy("b")))
    ends = groups.groupBy("g").agg(F.min("b").alias("least"))
    only = ends.limit(2).collect()
    if len(only) < 2:
        least = only[0].least if only else None
        return inside.select("b", F.coalesce("up", F.lit(least)).alias("prev"))
    above = _previous(ends.select(F.col("g").alias("b")), fan_out)
    nearest = (above.select(F.col("b").alias("g"), F.col("prev").alias("pg"))
               .join(ends.select(F.col("g").alias("pg"), "least"), "pg").select("g", "least"))
    return inside.join(nearest, "g").select("b", F.coalesce("up", "least").alias("prev"))


def edited_copies(spark: SparkSession, docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS,
                  fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, text, next_text, edited, sigs, next_sigs): every document, the next
    in descending doc_id, and its text with the second half taken from there."""
    if rows_per_bucket < 1 or fan_out < 2:
        raise ValueError("rows_per_bucket is 1 at least, fan_out 2")
    scratch = Scratch(spark, "spots")
    texts = _texts(docs)
    ids = texts.select("doc_id")
    bucket = _bucket(ids, rows_per_bucket)
    firsts = scratch.save(ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")), "firsts")
    places = scratch.save(firsts.join(_previous(firsts.select("b"), fan_out), "b"), "places")
    if places.count() <= MOST_BUCKETS:
        places = F.broadcast(places)
    to = F.when(F.col("top").eqNullSafe(F.col("doc_id")), F.array(
        F.struct(F.col("b").alias("at"), F.lit(0).alias("copy")),
        F.struct(F.col("prev").alias("at"), F.lit(1).alias("copy")))).otherwise(F.array(
            F.struct(F.col("b").alias("at"), F.lit(0).alias("copy"))))
    dealt = (texts.withColumn("b", bucket).join(places, "b")
             .select("doc_id", "text", F.explode(to).alias("to")).select("to.at", "to.copy", "doc_id", "text"))
    order = ["copy", F.col("doc_id").desc_nulls_last(), "text"]
    # signatures after the exchange: they are neither shuffled nor sorted
    signed = (dealt.repartition("at").sortWithinPartitions("at", *order)
              .withColumn("sigs", signatures(F.col("text"))))
    following = Window.partitionBy("at").orderBy(*order)
    n = F.length("text")
    return (signed.withColumn("next_text", F.lead("text").over(following))
            .withColumn("next_sigs", F.lead("sigs").over(following)).where("copy = 0")
            .select("doc_id", "text", "next_text", F.concat(
                F.left("text", n - F.floor(n / 2).cast("int")),
                F.left("next_text", F.floor(n / 2).cast("int"))).alias("edited"), "sigs", "next_sigs"))


def fingerprint_report(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    both = (edited_copies(spark, docs, **kw)
            .select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2("edited", 256).alias("edited_sha256"), "sigs", "next_sigs",
                    signatures(F.col("edited")).alias("edited_sigs")))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"),
                       as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(spark: SparkSession, docs: DataFrame, num: int = 80,
               den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Classes and links at likeness num / den or more.

    Classes: (doc_id, class_id), documents of equal signature sets, class_id the
    smallest doc_id; documents without signatures have none. Links: (a, b, likeness)
    between classes, a < b.
    """
    if not 0 < num <= den:
        raise ValueError("0 < num <= den")
    scratch = Scratch(spark, "spot-pairs")
    sets = scratch.save(fingerprints(docs).where("size(signatures) > 0")
                        .withColumn("digest", F.sha2(as_text(F.col("signatures")), 256)), "sets")
    classes = scratch.save(sets.groupBy("digest").agg(F.min("doc_id").alias("class_id"),
                                                     F.min("signatures").alias("signatures"))
                           .where("class_id is not null"), "classes")
    members = sets.join(classes.select("digest", "class_id"), "digest").select("doc_id", "class_id")
    each = classes.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("of"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("of", "sig"))
    # a partner shares ceil(num n / den) signatures at least, so one of the first n - that + 1
    prefix = (each.join(rarity.where("of > 1"), "sig").withColumn("rank", rank)
              .withColumn("lone", F.col("n") - F.count("*").over(Window.partitionBy("class_id")))
              .where(F.expr(f"rank + lone <= n - ceil({num} * n / {den}) + 1")))
    level = F.floor(F.log(F.col("n")) / math.log(den / num + 1e-9)) if num < den else F.col("n").cast("long")
    keyed = prefix.select("class_id", "n", "sig", level.alias("level"))
    mine = keyed.select("sig", "level", F.col("class_id").alias("x"), F.col("n").alias("nx"))
    other = keyed.select("sig", F.explode(F.array("level", F.col("level") + 1)).alias("level"),
                         F.col("class_id").alias("y"), F.col("n").alias("ny"))
    candidates = (mine.join(other, ["sig", "level"])
                  .where(f"x <> y and {num} * nx <= {den} * ny and {num} * ny <= {den} * nx")
                  .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    sigs = classes.select("class_id", "signatures")
    value = likeness(F.col("sa"), F.col("sb"))
    links = (candidates.join(sigs.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa")), "a")
             .join(sigs.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb")), "b")
             .where(F.expr(f"{den} * size(array_intersect(sa, sb)) >= "
                           f"{num} * size(array_union(sa, sb))"))
             .select("a", "b", value.alias("likeness")))
    return members, links
