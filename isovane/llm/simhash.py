"""SimHash near-duplicates by anchor-point covering.

Fingerprints link at ``THRESHOLD`` = 3 or fewer differing bits of 64. Of two 32-bit halves one then
differs in at most 1 bit. Anchors of a half are the words of a perfect covering code, the Hamming code of
length 31 (covering radius 1) with one free bit: any half lies within 1 of an anchor. A half is
replicated to every anchor within covering radius + threshold = 1 + 1 = 2 (17 at most). If two halves
differ in at most 1 bit, the anchor nearest to the one is within 2 of the other, so the two meet at it;
there the whole fingerprints are compared. Only distinct fingerprints take part, so that copies
never multiply.

``near_duplicates`` links fingerprints of word shingles. ``alike`` takes the same links as its first candidates, and exact
likeness of the whole shingle sets decides. A text whose 5-word shingles are 80 % alike differs in some 6 to 16 bits of such
a fingerprint, out of reach of any covering that stays small. So that no link is lost, texts that this leaves apart then
meet in an exact prefix join: two sets with Jaccard likeness s share one of the first n - ceil(s n) + 1 members of each, in
any order common to all sets. Texts that share one are candidates too, under the same exact check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isovane.llm.arrowtext import in_pieces
from isovane.plans.fixpoint import connected_components
from isovane.plans.lineage import cut

THRESHOLD = 3
HALF = 32
CODE = 31
#: Anchors with more nearest fingerprints than this are split by the other half.
CROWD_AT = 64
#: Fingerprints of a partition while links are looked for; each makes 34 rows. At least so many partitions.
FPS_A_PART = 20_000
ROWS_A_FP = 34
LEAST_PARTS = 8
SIMILARITY = 0.8
WIDTH = 5
#: More than so many texts with a shingle in common first compare with one of them; only what that leaves apart compares on.
CROWD = 8
#: Shingles that COMMON or more of the sampled texts hold, one text in SAMPLED, come last in the order of the prefixes.
SAMPLED = 16
COMMON = 3
#: Bits of the map that marks them: 4 MB, broadcast to the tasks.
SLOTS = 1 << 25
#: 64-bit words of the parities that meet in a crowd.
SIGN = 8
#: A table with more rows than this is joined, not broadcast.
BROADCAST_ROWS = 20_000


def fingerprint_of(text: str | bytes | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of one text: majority bits over all shingle hashes; 0 if it has no word."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    counts, block = np.zeros(64, np.int64), []
    for a, b in spans:
        block.append(digest(whole[a:b], 42))
        if len(block) == 65_536:
            counts += _bit_counts(block)
            block = []
    if block:
        counts += _bit_counts(block)
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.int64))


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (signed long) for every row; null and empty texts get 0. Whole texts are read."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_of(t.as_py(), width) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.int64())], [*keep, "fp"])

    body = F.col(text).cast("binary").alias("_body")
    return docs.select(*keep, body).mapInArrow(run, schema)


def anchor_masks() -> list[list[int]]:
    """For each syndrome: what to flip in a half to reach every anchor within distance 2, the nearest first.

    Bit p (0 to 30) of the half is position p + 1 of the code, bit 31 is free. A word's syndrome is the
    xor of its set positions; flipping positions whose xor is the syndrome leads to an anchor.
    """
    free = 1 << CODE
    table = []
    for s in range(CODE + 1):
        near = 0 if s == 0 else 1 << (s - 1)
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE + 1) if s and i < i ^ s]
        table.append([near, near | free, *pairs])
    return table


def _syndrome(half: Column) -> Column:
    parts = []
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, CODE + 1) if p >> j & 1)
        parts.append(F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << j))
    return sum(parts[1:], parts[0])


def _halves(fp: Column) -> Column:
    low = F.lit((1 << HALF) - 1)
    return F.array(
        F.struct(F.lit(0).alias("side"), fp.bitwiseAND(low).alias("half")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned(fp, HALF).bitwiseAND(low).alias("half")),
    )


def _at_anchors(distinct_fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, anchor): each half at the anchor nearest to it, (v, anchor): each half at every anchor within distance 2)."""
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in anchor_masks()])
    sides = distinct_fps.select("fp", F.explode(_halves(F.col("fp"))).alias("h")).select("fp", "h.side", "h.half")
    sides = sides.withColumn("flips", F.element_at(masks, _syndrome(F.col("half")) + 1))
    key = lambda flip: F.col("half").bitwiseXOR(flip) * 2 + F.col("side")
    home = sides.select(F.col("fp").alias("u"), key(F.element_at("flips", 1)).alias("anchor"))
    spread = sides.select(F.col("fp").alias("v"), "half", "side", F.explode("flips").alias("flip")).select("v", key(F.col("flip")).alias("anchor"))
    return home, spread


def _close(threshold: int) -> Column:
    return F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold


def _checked(threshold: int) -> None:
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the two-half covering holds for thresholds of 0 to 3 bits")


def links(distinct_fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v), u < v: all pairs of different ``fp`` that differ in at most ``threshold`` (3 or fewer) bits."""
    _checked(threshold)
    home, spread = _at_anchors(distinct_fps)
    return home.join(spread, "anchor").where((F.col("u") < F.col("v")) & _close(threshold)).select("u", "v").distinct()


def _quarters(fp: Column, flipped: bool) -> Column:
    """Keys inside an anchor, by the half that the anchor is not made of: fingerprints that link there share one.

    That half differs in at most 3 bits, so one of its two quarters in at most 1: one side brings its quarters, the other
    its quarters and all at distance 1.
    """
    other = F.when(F.col("anchor").bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned(fp, HALF)).otherwise(fp.bitwiseAND(F.lit((1 << HALF) - 1)))
    flips = [0, *[1 << i for i in range(HALF // 2)]] if flipped else [0]
    part = lambda q: F.shiftrightunsigned(other, q * HALF // 2).bitwiseAND(F.lit((1 << HALF // 2) - 1))
    return F.explode(F.array(*[F.xxhash64("anchor", F.lit(q), part(q).bitwiseXOR(F.lit(m).cast("long"))) for q in (0, 1) for m in flips]))


def _centres(home: DataFrame) -> DataFrame:
    """(key, u): at each key the fingerprint nearest to the bits that most have there, the smallest of several."""
    ones = [F.sum(F.shiftrightunsigned("u", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(2 * HALF)]
    word = lambda i: F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    most = home.groupBy("key").agg(*ones)
    middle = word(0)
    for i in range(1, 2 * HALF):
        middle = middle.bitwiseOR(word(i))
    off = F.bit_count(F.col("u").bitwiseXOR(F.col("middle")))
    return home.join(most.select("key", middle.alias("middle")), "key").groupBy("key").agg(F.min(F.struct(off.alias("off"), "u")).alias("m")).select("key", "m.u")


def joining_links(distinct_fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): pairs that differ in at most ``threshold`` bits and join the same groups as all of ``links`` do."""
    first, _, rest = _joined(distinct_fps, threshold)
    return first if rest is None else first.unionByName(rest.select("u", "v").distinct())


def linked_groups(distinct_fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of every fingerprint that has a link; the component is its smallest fingerprint."""
    first, roots, rest = _joined(distinct_fps, threshold)
    if rest is None:
        return connected_components(first)
    between = cut(rest.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct())
    if between.isEmpty():
        return roots
    over = connected_components(between).select(F.col("node").alias("root"), F.col("component").alias("lower"))
    named = roots.withColumnRenamed("component", "root").join(over, "root", "left").select("node", F.coalesce("lower", "root").alias("component"))
    alone = over.join(roots, over.root == roots.node, "left_anti").select(F.col("root").alias("node"), F.col("lower").alias("component"))
    return named.unionByName(alone)


def _joined(distinct_fps: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(first links, their groups, (u, v, root_u, root_v) of further links between these groups); the latter two None where no anchor is full.

    An anchor with at most ``CROWD_AT`` nearest fingerprints compares them with all that come. So do fuller ones if their
    comparisons are fewer than the rows of the covering. Else they are split by quarters of the other half; there all first compare with the most central one, and only fingerprints that
    this leaves outside a key's largest group meet the others of the key.
    """
    _checked(threshold)
    n = distinct_fps.count()
    parts = max(LEAST_PARTS, n // FPS_A_PART + 1)
    few_parts = lambda rows: rows.coalesce(parts)
    home, spread = _at_anchors(few_parts(distinct_fps))
    full = cut(few_parts(home.groupBy("anchor").agg(F.count("*").alias("n"))).where(F.col("n") > CROWD_AT))
    n_full = full.count()
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    sent = F.broadcast(full) if n_full <= BROADCAST_ROWS else full
    if n_full == 0 or few_parts(spread.join(sent, "anchor")).agg(F.sum("n")).first()[0] <= ROWS_A_FP * n:
        return links(few_parts(distinct_fps), threshold), None, None
    full = sent.select("anchor")
    few = few_parts(home.join(full, "anchor", "left_anti").join(spread, "anchor")).where((F.col("u") != F.col("v")) & _close(threshold)).select(*pair)
    homes = cut(home.join(full, "anchor", "left_semi").select("u", _quarters(F.col("u"), False).alias("key")))
    comers = cut(few_parts(spread.join(full, "anchor", "left_semi").select("v", _quarters(F.col("v"), True).alias("key")).join(homes.select("key").distinct(), "key", "left_semi")))
    led = few_parts(comers.join(_centres(homes), "key")).where((F.col("u") != F.col("v")) & _close(threshold)).select(*pair)
    first = cut(few_parts(few.unionByName(led).distinct()))
    roots = connected_components(first)
    rooted = lambda rows, c: rows.join(roots.withColumnRenamed("node", c), c, "left").select(c, "key", F.coalesce("component", c).alias(f"root_{c}"))
    ours, theirs = rooted(homes, "u"), rooted(comers, "v")
    main = theirs.groupBy("key", "root_v").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root_v")).alias("m"), F.count("*").alias("groups"))
    open_ = cut(few_parts(main).where("groups > 1").select("key", F.col("m.root_v").alias("main")))
    ours, theirs = ours.join(open_, "key"), theirs.join(open_.select("key", F.col("main").alias("main_v")), "key")
    met = [ours.where("root_u <> main").join(theirs, "key"), ours.where("root_u = main").join(theirs.where("root_v <> main_v"), "key")]
    rest = [few_parts(m).where((F.col("root_u") != F.col("root_v")) & _close(threshold)).select(*pair, "root_u", "root_v") for m in met]
    return first, roots, rest[0].unionByName(rest[1])


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of ``width`` words keep repeats;
    a shorter text is one shingle; a text without words (null, empty, blank) has fingerprint 0 and
    links like any other. ``component_id`` is the smallest doc_id reachable over links. Rows with a null
    doc_id are kept and never name a component unless no other id is there (then null). Repeated rows
    stay repeated. Extra columns are ignored.
    """
    marked = cut(fingerprints(docs, text, width))
    unique = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = linked_groups(unique, threshold)
    rooted = unique.join(roots, unique.fp == roots.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """Ascending signed hashes of the distinct ``width``-word shingles; a shorter text is one shingle."""
    words = raw.lower().split()
    grams = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)).view(np.int64))


def _prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(tid, grams) of (tid, text): all distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1):
            rows = [_shingle_hashes(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["tid", "grams"])

    return docs.select("tid", F.col("text").cast("binary")).mapInArrow(run, "tid long, grams array<long>")


def _common_first_last(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ascending ``hashes`` with those whose slot is marked in the bitmap ``common`` put last."""
    slot = (hashes & (SLOTS - 1)).astype(np.int64)
    late = (common[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return np.concatenate([hashes[~late], hashes[late]])


def _parities(hashes: np.ndarray, words: int = 0) -> np.ndarray:
    """64-bit words, a power of 2 of them, with a bit for each hash at least: each hash flips the bit of its slot."""
    words = words or (1 << max(0, (len(hashes) - 1).bit_length() - 6) if len(hashes) else 1)
    odd = np.bincount((hashes & (64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shingle_prefixes(bodies: DataFrame, common: Broadcast, similarity: float, width: int = WIDTH) -> DataFrame:
    """(tid, size, grams, odd, sign, fp) of (tid, text): number of distinct shingles, as many of them as the prefix join needs,
    parities over as many slots as shingles, and over ``SIGN`` words, and the SimHash of ``near_duplicates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(common.value, np.uint8)
        for batch in in_pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            rows = [_shingle_hashes(t, width) for t in texts]
            fps = pa.array([fingerprint_of(t) for t in texts], pa.int64())
            sizes = pa.array([len(r) for r in rows], pa.int64())
            heads = pa.array([_common_first_last(r, marks)[: _prefix_length(len(r), similarity)] for r in rows], pa.list_(pa.int64()))
            odd = pa.array([_parities(r) for r in rows], pa.list_(pa.int64()))
            sign = pa.array([_parities(r, SIGN) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, heads, odd, sign, fps], ["tid", "size", "grams", "odd", "sign", "fp"])

    return bodies.select("tid", F.col("text").cast("binary")).mapInArrow(run, "tid long, size long, grams array<long>, odd array<long>, sign array<long>, fp long")


def _sizes_fit(similarity: float) -> Column:
    """Sets of size_u and size_v members can be ``similarity`` alike."""
    return F.least("size_u", "size_v") >= F.greatest("size_u", "size_v") * F.lit(similarity - 1e-9)


def _folded(odd: Column, words: Column) -> Column:
    """Parities over half as many slots where there are more than ``words``: both halves together."""
    halves = F.zip_with(F.slice(odd, 1, words), F.slice(odd, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(odd) > words, halves).otherwise(odd)


def _maybe_alike(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` that the parities of their shingle sets don't rule out.

    A shingle that only one of the sets has flips one bit, so the sets differ in as many members at least as their parities
    in bits. No pair that is alike enough is lost. Where sizes fit, the one has at most twice as many words as the other.
    """
    of = lambda s: heads.select(F.col("tid").alias(s), F.col("size").alias(f"size_{s}"), F.col("odd").alias(f"odd_{s}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").where(_sizes_fit(similarity))
    words = F.least(F.size("odd_u"), F.size("odd_v"))
    bits = F.zip_with(_folded(F.col("odd_u"), words), _folded(F.col("odd_v"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)
    total = F.col("size_u") + F.col("size_v")
    return both.where((total - differing) * F.lit(1 + similarity) >= total * F.lit(2 * similarity) - 1e-6).select("u", "v")


def _slot_words(ids: DataFrame, key: str) -> DataFrame:
    """(_at, _word): a bitmap of ``SLOTS`` bits with the slots of ``ids``, in rows of 64 bits."""
    slot = F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return ids.groupBy(F.shiftright(slot, 6).alias("_at")).agg(F.bit_or(bit).alias("_word"))


def _split_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is in ``ids``, the other rows). Long rows that are not in ``ids`` are not shuffled.

    A few ids are broadcast. Of many ids a bitmap is, 4 MB of bits whatever their number; only rows that hit it meet the ids.
    """
    if ids.count() <= BROADCAST_ROWS:
        few = F.broadcast(ids)
        return rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")
    slot = F.xxhash64(rows[key]).bitwiseAND(F.lit(SLOTS - 1))
    words = F.broadcast(_slot_words(ids, key))
    hit = (F.shiftright(slot, 6) == words["_at"]) & (F.call_function("shiftright", words["_word"], slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    some, none = rows.join(words, hit, "left_semi"), rows.join(words, hit, "left_anti")
    return some.join(ids, key, "left_semi"), none.unionByName(some.join(ids, key, "left_anti"))


def _alike_of(pairs: DataFrame, heads: DataFrame, bodies: DataFrame, similarity: float, width: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose whole shingle sets are ``similarity`` alike or more."""
    pairs = cut(_maybe_alike(pairs, heads, similarity))
    some = cut(pairs.select(F.explode(F.array("u", "v")).alias("tid")).distinct())
    sets = cut(shingle_sets(_split_by_ids(bodies, some, "tid")[0], width).groupBy("tid").agg(F.first("grams").alias("grams")))
    of = lambda name: sets.select(F.col("tid").alias(name), F.col("grams").alias(f"grams_{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    shared = F.size(F.array_intersect("grams_u", "grams_v"))
    counted = both.select("u", "v", shared.alias("shared"), (F.size("grams_u") + F.size("grams_v")).alias("total"))
    return cut(counted.where(F.col("shared") >= (F.col("total") - F.col("shared")) * F.lit(similarity)).select("u", "v"))


def common_slots(bodies: DataFrame, width: int = WIDTH) -> bytes:
    """A bitmap of ``SLOTS`` bits: the slots of shingles that many texts hold, by one text in ``SAMPLED``.

    At most one slot in eight is marked: where more shingles are common, the most common ones. The bitmap only sets an order,
    so what the sample misses costs time alone. It is all that reaches the driver, whatever the size of the corpus.
    """
    some = shingle_sets(bodies.where(F.pmod(F.xxhash64("tid"), F.lit(SAMPLED)) == 0), width).dropDuplicates(["tid"])
    counted = cut(some.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON))
    digits = F.length(F.bin("n"))
    by_digits = {r.d: r.c for r in counted.groupBy(digits.alias("d")).agg(F.count("*").alias("c")).collect()}  # 64 rows at most
    least, held = 65, 0
    for d in sorted(by_digits, reverse=True):
        held += by_digits[d]
        if held > SLOTS // 8:
            break
        least = d
    slot = F.col("gram").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = counted.where(digits >= least).groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()  # SLOTS / 64 rows at most
    marks = np.zeros(SLOTS // 64, np.int64)
    marks[words["at"].to_numpy()] = words["word"].to_numpy()
    return marks.astype("<i8").tobytes()


def _heads(bodies: DataFrame, similarity: float, width: int) -> DataFrame:
    """(tid, size, grams, odd, sign, fp) of ``shingle_prefixes``, once for each text.

    Members are in the order of their hashes, common ones last, so that a passage of many texts makes no candidates.
    """
    common = bodies.sparkSession.sparkContext.broadcast(common_slots(bodies, width))
    return shingle_prefixes(bodies, common, similarity, width).groupBy("tid").agg(F.first(F.struct("size", "grams", "odd", "sign", "fp")).alias("s")).select("tid", "s.*")


def _covered(heads: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): texts with words whose SimHash fingerprints are equal or meet in the covering within ``threshold`` bits.

    The smallest text of each fingerprint stands for it. Pairs that join the same groups are enough; the exact check of each
    and the prefix join come after.
    """
    worded = heads.where(F.col("size") > 0).select("tid", "fp")
    unique = cut(worded.groupBy("fp").agg(F.min("tid").alias("first")))
    same = worded.join(unique, "fp").where(F.col("tid") != F.col("first")).select(F.col("first").alias("a"), F.col("tid").alias("b"))
    of = lambda fp, name: unique.select(F.col("fp").alias(fp), F.col("first").alias(name))
    met = joining_links(unique.select("fp"), threshold).join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    return same.unionByName(met).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _shared_grams(heads: DataFrame) -> DataFrame:
    """(gram, tid, size, pos, n): prefix shingles that ``n`` >= 2 texts have in their prefixes, with their place from 1."""
    rows = heads.select("tid", "size", F.posexplode("grams").alias("pos", "gram")).select("gram", "tid", "size", (F.col("pos") + 1).alias("pos"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("gram"))).where(F.col("n") > 1)


def _to_leaders(shared: DataFrame, similarity: float) -> DataFrame:
    """(u, v): each text of a crowd with the crowd's most typical text, whose prefix has the most shingles of others.

    In a crowd of copies that is the original: edits give a copy shingles of its own.
    """
    typical = shared.groupBy("tid").agg((F.sum(F.least("n", F.lit(1 << 20))) / F.max("size")).alias("typical"))
    crowds = shared.where(F.col("n") > CROWD).join(typical, "tid")
    led = crowds.groupBy("gram").agg(F.max(F.struct("typical", "tid", "size")).alias("m")).select("gram", F.col("m.tid").alias("v"), F.col("m.size").alias("size_v"))
    met = crowds.select("gram", F.col("tid").alias("u"), F.col("size").alias("size_u")).join(led, "gram")
    return met.where((F.col("u") != F.col("v")) & _sizes_fit(similarity)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _still_apart(shared: DataFrame, heads: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs that share a prefix shingle, are not in one group yet, and can be alike by sizes, parities and places.

    At a shingle, texts outside its largest group meet all others, so a crowd that is one group costs nothing. In a crowd
    of texts that are not alike, their parities (see ``_maybe_alike``) rule pairs out where they meet, before a row is made.
    A pair's likeness is bounded by the shingles shared up to the last shared place and what follows it.
    """
    signs = [F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(SIGN)]
    groups = heads.select("tid", *signs).join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("component", "tid")).drop("component")
    named = shared.join(groups, "tid")
    most = named.groupBy("gram", "root").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max(F.struct("m", "root")).alias("m"), F.count("*").alias("groups"))
    open_ = named.join(most.where(F.col("groups") > 1).select("gram", F.col("m.root").alias("main")), "gram")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("tid", "size", "pos", "root", *(f"s{i}" for i in range(SIGN)))]
    all_ = open_.select("gram", (F.col("root") == F.col("main")).alias("in_main"), *side("v"))
    rest = open_.where(F.col("root") != F.col("main")).select("gram", *side("u"))
    once = F.col("in_main") | (F.col("tid_u") < F.col("tid_v"))
    differing = sum((F.bit_count(F.col(f"s{i}_u").bitwiseXOR(F.col(f"s{i}_v"))) for i in range(1, SIGN)), F.bit_count(F.col("s0_u").bitwiseXOR(F.col("s0_v"))))
    near = (F.col("size_u") + F.col("size_v") - differing) * F.lit(1 + similarity) >= (F.col("size_u") + F.col("size_v")) * F.lit(2 * similarity) - 1e-6
    met = rest.join(all_, "gram").where((F.col("root_u") != F.col("root_v")) & once & _sizes_fit(similarity) & near)
    flip = F.col("tid_u") > F.col("tid_v")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    left = F.least(F.col("size_u") - F.col("pos_u"), F.col("size_v") - F.col("pos_v"))
    rows = met.select(pick("tid_u", "tid_v").alias("u"), pick("tid_v", "tid_u").alias("v"), left.alias("left"), (F.col("size_u") + F.col("size_v")).alias("total"))
    pairs = rows.groupBy("u", "v").agg(F.count("*").alias("c"), F.min("left").alias("left"), F.first("total").alias("total"))
    return pairs.where((F.col("c") + F.col("left")) * F.lit(1 + similarity) >= F.col("total") * F.lit(similarity) - 1e-6).select("u", "v")


def _body() -> Column:
    return F.coalesce("text", F.lit(""))


def _first_hash(body: Column) -> Column:
    return F.xxhash64(body)


def text_ids(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(``keep`` columns, tid) and (tid, text) of ``docs``; equal texts share ``tid``, different ones don't.

    A tid is a text's 64-bit hash, or a hash of two where different texts share the first, as 3 pairs of 10^10 texts do.
    So it names a text by 128 bits. Null texts count as empty.
    """
    first, second = _first_hash(_body()), F.xxhash64(F.lit("second"), _body())
    facts = cut(docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], first.alias("h1"), second.alias("h2")))
    twins = cut(facts.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo <> hi").select(F.col("h1").alias("twin")))
    n_twins = twins.count()

    def named(rows: DataFrame) -> DataFrame:
        if n_twins == 0:
            return rows.withColumn("tid", F.col("h1"))
        few = F.broadcast(twins) if n_twins <= BROADCAST_ROWS else twins
        return rows.join(few, F.col("h1") == F.col("twin"), "left").withColumn("tid", F.when(F.col("twin").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2")))

    bodies = named(docs.select(first.alias("h1"), second.alias("h2"), _body().alias("text"))).select("tid", "text")
    return named(facts).select(*[F.col(f"_k_{c}").alias(c) for c in keep], "tid"), bodies


def alike(bodies: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(u, v), u < v: the tids of (tid, text) whose shingle sets are ``similarity`` alike or more; rows of one tid are one text.

    SimHash fingerprints in the anchor-point covering name the first pairs, leaders of crowds and the prefix join the others.
    The pairs join the same groups as all such pairs would: pairs whose texts others join already may be absent.
    Likeness is exact over 64-bit hashes of the shingles.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the prefix join holds for a similarity above 0, to 1")
    heads = cut(_heads(bodies, similarity, width))
    shared = cut(_shared_grams(heads))
    led = _alike_of(_covered(heads).unionByName(_to_leaders(shared, similarity)).distinct(), heads, bodies, similarity, width)
    apart = _alike_of(_still_apart(shared, heads, connected_components(led), similarity), heads, bodies, similarity, width)
    return led.unionByName(apart)


def keep_one_per_group(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group: equal and alike texts, and what these lead to.

    Null texts count as empty. Rows with a null doc_id stay: nothing identifies them. Rows that share the
    smallest doc_id of their group stay together.
    """
    narrow, bodies = text_ids(docs, ("doc_id",))
    narrow = narrow.where(F.col("doc_id").isNotNull())
    roots = connected_components(alike(bodies, similarity, width))
    firsts = narrow.groupBy("tid").agg(F.min("doc_id").alias("first_id"))
    grouped = firsts.join(roots, firsts.tid == roots.node, "left").select("tid", "first_id", F.coalesce("component", "tid").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("kept_id"))
    named = grouped.join(lowest, "root").select("tid", "kept_id")
    stay = narrow.join(named, "tid").where(F.col("doc_id") == F.col("kept_id")).select("doc_id").distinct()
    gone = cut(narrow.select("doc_id").distinct().join(stay, "doc_id", "left_anti"))
    return _split_by_ids(docs, gone, "doc_id")[1]


__all__ = ["THRESHOLD", "alike", "anchor_masks", "fingerprint_of", "fingerprints", "hex_fingerprint", "joining_links", "keep_one_per_group", "links", "near_duplicates", "text_ids"]
