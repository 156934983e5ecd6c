"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the ``K`` smallest distinct hashes of a text's shingles. Sketches of parts
merge into the sketch of the whole (the k smallest of their union). Two sketches give the resemblance of
their texts' shingle sets and the containment of one in the other, one gives its number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered

WIDTH = 5
K = 128
BITS = 48
#: Rows of a bucket of neighbouring ids, roughly.
DEPTH = 20_000
#: A table of more rows is joined by a shuffle.
BROADCAST_ROWS = 20_000
WORDS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Runs without ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORDS), lambda w: w != "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes (below 2^48) of all ``width``-word shingles; a shorter text is one shingle, no word none."""
    w = words(text)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1))),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + (j - 1)) for j in range(width)]),
    )
    return w, F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(grams, lambda h: F.shiftrightunsigned(h, 64 - BITS))))


def with_sketch(df: DataFrame, text: str = "text", name: str = "sketch", width: int = WIDTH, k: int = K) -> DataFrame:
    """``df`` with the sketch of ``text`` (whole texts) as column ``name``."""
    w, hashes = shingle_hashes(F.col(text), width)
    return df.withColumn("_w", w).withColumn(name, F.slice(F.sort_array(hashes), 1, k)).drop("_w")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sketches' texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(sketches: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one sketch for all rows of a key, however many.

    Each task keeps the k smallest hashes of a key before the shuffle; null sketches add nothing.
    """
    rows = sketches.select(key, F.explode(sketch).alias("h")).distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets (exact while both have at most k/2); two empty ones: 1."""
    union = merged(a, b, k)
    both = F.array_intersect(a, b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, both)) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * float(1 << BITS) / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and distinct counts; 1 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def encode(a: Column) -> Column:
    """A sketch as text: 12 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def _buckets(ids: DataFrame, key: Column, tie: Column, least: int) -> tuple[Column, Column | None]:
    """(bucket, crowded): a number that rises with ``key`` (a long) and falls with ``tie`` (a hash), and whether ``key`` is a crowd.

    Equal-depth buckets of keys, evenly cut again where rows are many. A key with more rows than ``DEPTH`` and than one bucket
    in 1,024 would hold is a crowd: at most 1,024 keys are. It has buckets of its own, cut evenly by ``tie``.
    """
    n = ids.count()
    p = min(10, max(4, (least - 1).bit_length()))
    shares = [i / (1 << p) for i in range(1, 1 << p)]
    bottom = -(1 << 63)  # no id
    found = ids.agg(F.percentile_approx(key, [*shares, 1.0], 20_000).alias("b"), F.min(F.when(key > bottom, key)).alias("lo")).first()
    counted = ids.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > max(DEPTH, n >> 10))
    crowds = {r.k: -(-r.n // DEPTH) for r in counted.collect()}  # at most 1,024 rows
    marks = sorted({*(found.b or [0]), *crowds, *(k - 1 for k in crowds if k > bottom)})
    p = max(1, len(marks).bit_length())
    marks += [marks[-1]] * ((1 << p) - len(marks))
    bounds = F.array(*[F.lit(int(x)).cast("long") for x in marks])
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(p))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(bounds, at + s) < key, at + s).otherwise(at))
    cuts = max(1, -(-n // (DEPTH * len(shares))))
    most = max([cuts, *crowds.values()])
    if most <= 1:
        return bucket.cast("long"), None
    least_id = F.lit(int(found.lo or 0)).cast("long")
    low = F.when(bucket == 0, least_id).otherwise(F.greatest(F.element_at(bounds, bucket), least_id))
    real = lambda c: c.cast("double")  # noqa: E731  differences of ids may not fit a long
    width = F.greatest(real(F.element_at(bounds, bucket + 1)) - real(low), F.lit(1.0))
    inside = F.greatest(F.least(F.floor((real(key) - real(low)) * float(cuts) / width), F.lit(cuts - 1)).cast("long"), F.lit(0).cast("long"))
    crowded = None
    if crowds:
        parts = F.create_map(*[c for k, m in crowds.items() for c in (F.lit(int(k)).cast("long"), F.lit(m))])[key]
        crowded = parts.isNotNull()
        place = F.least(F.floor((real(tie) / float(1 << 64) + 0.5) * parts), parts - 1).cast("long")
        inside = F.coalesce(parts - 1 - place, inside)
    return bucket.cast("long") * most + inside, crowded


def _next_heads(heads: DataFrame) -> DataFrame:
    """(to, down, tie2): each bucket with the first row of the one after it, from high to low; after the last comes the first."""
    placed = cut(numbered(heads, [F.desc("bucket")], "place"))
    n = placed.count()
    after = placed.select(F.pmod(F.col("place") - 1, F.lit(max(1, n))).alias("place"), F.col("head.down").alias("down"), F.col("head.tie").alias("tie2"))
    wanted = placed.select("place", F.col("bucket").alias("to")).join(after, "place").select("to", "down", "tie2")
    return F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted


def edit_pairs(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Every document's text and sketch beside an edited text and the next document's sketch.

    Order: descending doc_id (equal ids: by hash of text; null ids last); after the last comes the first. The
    edited text replaces the last floor(n/3) code points by the first as many (or all) of the next text. Null
    texts are empty; a single row is its own next. Repeated rows follow one another. Returns doc_id, text,
    n_chars, edited, sketch, next_sketch, edited_sketch.

    Texts are shuffled once, into buckets of consecutive ids; each bucket also gets the first row of the next. Rows of an id
    that many share are spread over buckets of their own, and repeated rows of such an id are one row with a count until the end.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket, crowded = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id")), key, F.xxhash64("text"), 4 * parts)
    keyed = rows.withColumn("key", key).withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket).withColumn("copies", F.lit(1).cast("long"))
    if crowded is not None:
        same = ["doc_id", "text", "key", "tie", "bucket"]
        keyed = keyed.where(~crowded).unionByName(keyed.where(crowded).groupBy(*same).agg(F.sum("copies").alias("copies")))
    heads = keyed.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "tie")).alias("head"))
    guests = (
        keyed.join(_next_heads(heads), (F.bitwise_not("key") == F.col("down")) & (F.col("tie") == F.col("tie2")))
        .select("doc_id", "text", "key", "tie", F.col("to").alias("bucket"), F.lit(1).alias("guest"), "copies")
    )
    dealt = keyed.select("doc_id", "text", "key", "tie", "bucket", F.lit(0).alias("guest"), "copies").unionByName(guests).repartition(parts, "bucket")
    ordered = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "tie")
    sketched = with_sketch(dealt, "text", "sketch", width, k)
    led = sketched.select(
        "doc_id", "text", "guest", "copies", "sketch",
        F.lead("text").over(ordered).alias("next_text"), F.lead("sketch").over(ordered).alias("next_sketch"),
    ).where("guest = 0")
    if crowded is not None:  # a repeated row comes before itself, all but once
        last = led.withColumn("copies", F.lit(1).cast("long"))
        before = led.where("copies > 1").withColumn("next_text", F.col("text")).withColumn("next_sketch", F.col("sketch")).withColumn("copies", F.col("copies") - 1)
        led = last.unionByName(before)
    n = F.length("text")
    cutoff = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cutoff), F.substring("next_text", F.lit(1), cutoff))
    out = led.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch", "copies")
    done = with_sketch(out, "edited", "edited_sketch", width, k)
    return done.drop("copies") if crowded is None else done.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")


def fingerprint_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    p = edit_pairs(docs, k)
    return p.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
    )
