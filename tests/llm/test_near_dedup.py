"""Near dedup against the exact groups of all pairs: copies with one block of difference."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from isovane.llm import simhash


def shingles(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def firsts(texts: list[str]) -> tuple[set[int], int]:
    """The smallest number of each group of texts that are 0.8 alike or led to by such, and how many pairs are."""
    sets, root, n = [shingles(t) for t in texts], list(range(len(texts))), 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            n += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {top(i) for i in range(len(texts))}, n


def kept(spark, texts: list[str]) -> set[int]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.keep_one_per_group(df).select("doc_id").collect()}


def bits(a: str, b: str) -> int:
    return ((simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)) & (2**64 - 1)).bit_count()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def appended(rng, base):
    return base + words(rng, len(base) * 22 // 100)


def truncated(rng, base):
    return base[: len(base) * 85 // 100]


def scattered(rng, base):
    copy = list(base)
    for _ in range(max(1, len(base) // 60)):
        copy[rng.randrange(len(copy))] = words(rng, 1)[0]
    return copy


@pytest.mark.parametrize("change", [appended, truncated, scattered])
def test_copies_with_any_change_are_found(spark, change):
    rng = random.Random(11)
    bases = [words(rng, rng.randrange(60, 400)) for _ in range(120)]
    texts = [" ".join(t) for b in bases for t in (b, change(rng, b))]
    want, n = firsts(texts)
    assert n > 90
    assert kept(spark, texts) == want


@pytest.mark.parametrize("n", [5, 20, 1000])
def test_crowds_of_copies(spark, n):
    rng = random.Random(n)
    base = words(rng, 100)
    texts = [" ".join(scattered(rng, base)) for _ in range(n)]
    want, pairs = firsts(texts)
    assert pairs and kept(spark, texts) == want


def test_copies_alike_to_the_original_only(spark):
    rng = random.Random(2)
    base = words(rng, 200)
    texts = [" ".join(base)] + [" ".join(base[:i] + words(rng, 14) + base[i + 14 :]) for i in range(0, 180, 6)]
    assert firsts(texts)[0] == {0}
    assert kept(spark, texts) == {0}


def test_chains_in_one_crowd(spark):
    rng = random.Random(4)
    line, passage = words(rng, 900), words(rng, 60)
    chains = [line[i : i + 120] for i in range(0, 700, 12)]
    others = [words(rng, 10) + passage for _ in range(60)]
    texts = [" ".join(t) for t in chains + others]
    want, pairs = firsts(texts)
    assert pairs and kept(spark, texts) == want


def test_the_simhash_covering_finds_close_copies(spark, monkeypatch):
    """Copies within 3 bits go by the covering alone; texts within 3 bits that are not alike stay."""
    none = lambda *_: spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(simhash, "_to_leaders", none)
    monkeypatch.setattr(simhash, "_still_apart", none)
    rng = random.Random(5)
    texts, close = [], set()
    for _ in range(40):
        base = words(rng, 300)
        copy = [*base[:-1], words(rng, 1)[0]]
        texts += [" ".join(base), " ".join(copy)]
        if bits(texts[-2], texts[-1]) <= 3:
            close.add(len(texts) - 1)
    passage = words(rng, 31)
    texts += [" ".join(passage * n + words(rng, 40)) for n in (400, 400)]  # repeats count in a fingerprint, not in a set
    assert len(close) > 30 and bits(texts[-2], texts[-1]) <= 3
    assert kept(spark, texts) == set(range(len(texts))) - close


def shuffled(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("few", [0, 20_000])
def test_texts_that_nothing_is_alike_to_are_not_shuffled(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    rng = random.Random(8)
    texts = [" ".join(words(rng, 400)) for _ in range(800)]
    texts += [t + " more" for t in texts[:20]]
    df = spark.createDataFrame([(i, t, bytes(rng.randbytes(20_000))) for i, t in enumerate(texts)], "doc_id long, text string, load binary")
    df.write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = shuffled(spark)
        out = simhash.keep_one_per_group(spark.read.parquet(f"{tmp_path}/docs"))
        assert {r.doc_id for r in out.where(F.length("load") > 0).select("doc_id", "load").collect()} == set(range(800))
        assert shuffled(spark) - at < 0.5 * len(texts) * 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_by_a_bitmap_split_rows_as_a_join_does(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLOTS", 1 << 10)  # most rows hit it
    rows = spark.createDataFrame([(None if i % 50 == 0 else i, i) for i in range(4000)], "doc_id long, n long")
    ids = spark.createDataFrame([(i,) for i in range(1, 4000, 7)], "doc_id long")
    got = {}
    for few in (0, 20_000):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
        got[few] = [sorted(r.n for r in part.collect()) for part in simhash._split_by_ids(rows, ids, "doc_id")]
    assert got[0] == got[20_000] and sorted(sum(got[0], [])) == list(range(4000))
