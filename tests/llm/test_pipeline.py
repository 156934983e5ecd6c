"""The stages of the pipeline, each on its own input, against plain versions."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isovane.llm import simhash
from tests.llm.test_edges import CLASHING, ROWS, SCHEMA

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def shingles(text: str) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_the_stages_keep_the_columns(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.dtypes == docs.dtypes, name


def test_language_stage_keeps_clean_documents(spark, docs):
    kept = {r.doc_id for r in STAGES["language_id"](spark, docs, SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("lang IS NOT NULL AND n_chars > 200").select("doc_id").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_near_copies_lose_all_but_one(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    kept = {r.doc_id for r in STAGES["near_dedup"](spark, docs, SF).select("doc_id").collect()}
    first: dict[str, int] = {}
    for r in sorted(rows):
        first.setdefault(r.text, r.doc_id)
    assert kept <= set(first.values())  # of equal texts only the first
    sets = {i: shingles(t) for t, i in first.items() if t}
    names = sorted(sets)
    near = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and len(sets[a]) * 0.8 <= len(sets[b]) <= len(sets[a]) / 0.8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    touched = {i for p in near for i in p}
    assert set(first.values()) - kept <= touched  # nothing else goes
    assert sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)


def test_planted_near_copies_are_found(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, copies, n = [], {}, 0
    for _ in range(150):
        base = [word() for _ in range(rng.randrange(120, 500))]
        rows.append((n, " ".join(base)))
        origin, n = n, n + 1
        for _ in range(rng.choice([0, 1, 1, 3])):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            copies[n] = origin
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one_per_group(df).select("doc_id").collect()}
    assert {r[0] for r in rows} - set(copies) <= kept
    assert sum(i in kept for i in copies) <= 0.06 * len(copies)


def test_mixing_and_packing_take_effect(spark, docs):
    mixed = STAGES["mix_sources"](spark, docs, SF)
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times.values()) == {1, 2} and len(times) < docs.count()
    packed = STAGES["pack_sequences"](spark, mixed, SF).where("piece = 0")
    assert Counter(r.doc_id for r in packed.select("doc_id").collect()) == times


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.drop("sequence_id", "offset").collect())))


def test_run_gives_the_rows_of_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert rows_of(whole) == rows_of(out)
    plan = whole._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") <= 1  # tokens at most; no stage before is in the plan


@pytest.mark.parametrize("rows", [ROWS, []])
def test_run_with_nulls_clashing_names_and_no_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(9) for c in CLASHING})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert (whole.count() > 0) == bool(rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_on_nulls_and_no_rows(spark, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(9) for c in CLASHING})
    assert STAGES[stage](spark, docs.where("doc_id > 100"), SF).count() == 0
    assert STAGES[stage](spark, docs, SF).count() > 0


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    texts = [f"text number {i} with some words of its own {i * i} and more {i * 31}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50]])], "doc_id long, text string")
    monkeypatch.setattr(simhash, "_first_hash", lambda body: F.pmod(F.xxhash64(body), F.lit(40)))
    narrow, _ = simhash.text_ids(docs, ("doc_id",))
    tid = dict(tuple(r) for r in narrow.collect())
    assert len(set(tid.values())) == 200 and all(tid[i] == tid[200 + i] for i in range(50))
    assert {r.doc_id for r in simhash.keep_one_per_group(docs).select("doc_id").collect()} == set(range(200))


def test_parities_rule_out_no_alike_pair():
    import random

    import numpy as np

    rng = random.Random(6)
    for _ in range(400):
        n = rng.choice([1, 5, 63, 64, 65, 200, 1_000])
        base = [rng.getrandbits(63) for _ in range(n)]
        other = [h for h in base if rng.random() > 0.1] + [rng.getrandbits(63) for _ in range(rng.randrange(0, n // 8 + 1))]
        a, b = (np.unique(np.array(x, np.int64)) for x in (base, other))
        u, v = (simhash._parities(x).view("<u8") for x in (a, b))
        while len(u) > len(v):
            u = u[: len(u) // 2] ^ u[len(u) // 2 :]
        while len(v) > len(u):
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        assert sum(int(x).bit_count() for x in u ^ v) <= len(set(a.tolist()) ^ set(b.tolist()))
