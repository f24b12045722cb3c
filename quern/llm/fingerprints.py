"""Document fingerprints by consistent weighted sampling over word counts. JVM only.

For term k of weight w and sample i, hashes of (k, i) give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1). With
t = floor(ln w / r + b) the sample value is ln c - r (t - b + 1), the logarithm of the classical c / (y e^r) with
y = exp(r (t - b)). The smallest value over a document's terms is its i-th sample; two documents share it with a
probability equal to the generalised Jaccard similarity of their weights (sum of minima over sum of maxima). The value is a
function of (k, t) alone, so equal minima stand for equal samples, and a plain ``min`` of doubles finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, let, words_of

#: Samples in a fingerprint: PER_BLOCK in each generated loop body (short enough to be compiled), times blocks.
SAMPLES = 64
PER_BLOCK = 4
#: A packed term holds its word's 40-bit hash above WEIGHT_BITS bits of its count (a count beyond them is held at the most).
WEIGHT_BITS = 24
#: Bytes of text in a bucket of neighbours, if that makes more buckets than twice the shuffle partitions.
BUCKET_BYTES = 256 << 20
#: Most buckets, so that their bounds (16 bytes each, sent twice) stay within 2 MB; beyond 16 TB of text buckets grow.
MAX_BUCKETS = 1 << 16
_LOWEST = -(1 << 63)


def weighted_terms(text: Column) -> Column:
    """Array of packed (term, weight) longs of a text, each once: the run lengths of its sorted word hashes."""
    most = (1 << WEIGHT_BITS) - 1

    def runs(hs: Column) -> Column:
        starts = F.filter(F.transform(hs, lambda h, i: F.when((i == 0) | (F.get(hs, i - 1) != h), i)), lambda i: i.isNotNull())
        count = lambda at, s, k: F.least(F.coalesce(F.get(at, k + 1), F.size(hs)) - s, F.lit(most)).cast("long")
        return let(starts, lambda at: F.transform(at, lambda s, k: F.shiftleft(F.get(hs, s), WEIGHT_BITS).bitwiseOR(count(at, s, k))))

    return let(F.sort_array(F.transform(words_of(text), lambda w: F.shiftrightunsigned(F.xxhash64(w), WEIGHT_BITS))), runs)


def _value(term: Column, ln_weight: Column, i: Column) -> Column:
    """Value of one sample for one term (see the module's formula). Two hashes give five uniforms: two of 25 bits each for
    r and for c, and one of 28 bits for b from what is left of both. Logarithms cost most, so there are three."""
    h = [F.xxhash64(term, i * 2 + j) for j in range(2)]
    unit = lambda bits: bits.bitwiseAND(F.lit((1 << 25) - 1)) + 0.5
    gamma = lambda x: -F.ln(unit(x) * unit(F.shiftrightunsigned(x, 25)) * F.lit(2.0**-50))
    b = (F.shiftleft(F.shiftrightunsigned(h[0], 50), 14).bitwiseOR(F.shiftrightunsigned(h[1], 50)) + 0.5) * F.lit(2.0**-28)
    r = gamma(h[0])
    return F.ln(gamma(h[1])) - r * (F.floor(ln_weight / r + b) - b + 1)


def sample_value(term: Column, weight: Column, i: Column) -> Column:
    return _value(term, F.ln(weight), i)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, copy, doc_id, text, next_text) of every row, next in descending doc_id, the last followed by the first.

    Rows go to buckets between bounds, so that a window inside the buckets sees every successor. The bounds are the first
    (doc_id, text hash) of each range partition of the keys alone; their number follows from the size of the texts up to
    MAX_BUCKETS, and as one row of 16 bytes a bound they are broadcast. Texts are shuffled once: the first row of each bucket goes to the bucket
    before it as well. ``place`` numbers rows uniquely. The first of a bucket's copies is returned too (``copy``), as the
    successor of the last row; what is grouped by bucket needs no further shuffle. Null ids come last, null texts are empty,
    rows that share an id are ordered by a hash of their text, so one id with very many texts still spreads.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spot = F.struct("key", F.xxhash64("text").alias("tag"))
    keys = Stored(rows.select(spot.alias("spot"), F.octet_length("text").cast("long").alias("bytes")), "keys").df
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    n = max(2, min(MAX_BUCKETS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)))
    firsts = keys.repartitionByRange(n, F.desc("spot")).groupBy(F.spark_partition_id().alias("part")).agg(F.max("spot").alias("spot"))
    step = max(1, int(n**0.5))
    cuts = firsts.agg(F.sort_array(F.collect_list("spot"), False).alias("all"))
    cuts = Stored(cuts.select("all", F.transform(F.sequence(F.lit(0), F.greatest((F.size("all") - 1) / step, F.lit(0)).cast("int")), lambda i: F.slice("all", i * step + 1, F.lit(step))).alias("steps")), "bounds").df
    upto = lambda xs, of: F.size(F.filter(xs, lambda x: of(x) >= F.col("spot")))
    step_at = F.greatest(upto(F.col("steps"), lambda x: F.get(x, F.lit(0))) - 1, F.lit(0))
    rows = rows.withColumn("spot", spot).crossJoin(F.broadcast(cuts)).withColumn("step_at", step_at)
    rows = rows.withColumn("own", F.col("step_at") * step + F.greatest(upto(F.get("steps", F.col("step_at")), lambda x: x) - 1, F.lit(0)))
    of = lambda b, copy: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"))
    is_first = F.get("all", F.col("own")) == F.col("spot")
    rows = rows.withColumn("at", F.when(is_first, F.array(of(F.col("own"), False), of((F.col("own") + F.size("all") - 1) % F.size("all"), True))).otherwise(F.array(of(F.col("own"), False))))
    rows = rows.select("doc_id", "key", "text", F.col("spot.tag").alias("tag"), F.explode("at").alias("at")).select("doc_id", "key", "tag", "text", "at.bucket", "at.copy")
    w = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), F.desc("tag"), "text")
    place = F.shiftleft(F.col("bucket").cast("long"), 40).bitwiseOR(F.row_number().over(w).cast("long"))
    seen = rows.select("bucket", "doc_id", "text", "copy", F.lead("text").over(w).alias("next_text"), place.alias("place"), F.lag("copy").over(w).alias("after_copy"))
    return seen.where(~F.col("copy") | ~F.coalesce("after_copy", F.lit(False))).drop("after_copy")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``next_text``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A text without words has a fingerprint of its own kind, alike (1.0) to that of any other such text only. The likeness
    is the share of equal samples. An empty table gives no rows; a table of one row has itself as next document.
    """
    blocks = samples // PER_BLOCK
    both = with_next(docs, doc_id, text).withColumn("edited", F.when(~F.col("copy"), edited(F.col("text"), F.col("next_text"))))
    both = both.select(
        "bucket", "place", "copy", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        weighted_terms(F.col("text")).alias("a"), weighted_terms(F.col("edited")).alias("b"),
    )
    meta = ["copy", "doc_id", "n_chars", "edited_sha256"]
    marked = lambda xs, v: F.transform(xs, lambda p: F.struct(p.alias("p"), F.lit(v).alias("v")))
    # what both versions hold with one weight is sampled once
    terms = F.concat(marked(F.array_intersect("a", "b"), 3), marked(F.array_except("a", "b"), 1), marked(F.array_except("b", "a"), 2))
    terms = both.select("bucket", "place", *meta, F.explode_outer(terms).alias("x"))
    terms = terms.select("bucket", "place", *meta, F.col("x.v").alias("v"), F.shiftrightunsigned("x.p", WEIGHT_BITS).alias("term"), F.col("x.p").bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1)).alias("weight"))
    terms = terms.withColumn("weight", F.ln("weight"))  # once a term, not once a sample
    lead_block = lambda c: F.when(F.col("block") == 0, F.col(c)).alias(c)
    every = range(PER_BLOCK)
    parts = terms.select("*", F.explode(F.array(*(F.lit(b) for b in range(blocks)))).alias("block")).select(
        "bucket", "place", "block", "v", *(lead_block(c) for c in meta), *(_value(F.col("term"), F.col("weight"), F.col("block") * PER_BLOCK + j).alias(f"s{j}") for j in every)
    ).groupBy("bucket", "place", "block", *meta).agg(
        *(F.min(F.when(F.col("v") != 2, F.col(f"s{j}"))).alias(f"a{j}") for j in every), *(F.min(F.when(F.col("v") != 1, F.col(f"s{j}"))).alias(f"b{j}") for j in every)
    )
    listed = F.sort_array(F.collect_list(F.struct("block", F.array(*(f"a{j}" for j in every)).alias("a"), F.array(*(f"b{j}" for j in every)).alias("b"))))
    signs = parts.groupBy("bucket", "place").agg(*(F.max(c).alias(c) for c in meta), listed.alias("l"))
    of = lambda v: F.flatten(F.transform("l", lambda x: x[v]))
    signed = signs.select("bucket", "place", *meta, of("a").alias("own"), of("b").alias("ed"))
    after = signed.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("copy"))
    near = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: F.when(x.isNull(), F.lit("-" * 8)).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), 1, 8))), "")
    return after.select("doc_id", "n_chars", "edited_sha256", text_of("own").alias("fingerprint"), text_of("ed").alias("edited_fingerprint"), near("own", "ed").alias("near_edited"), near("own", "next").alias("near_next"))
