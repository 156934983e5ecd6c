"""Queries with SQL give the same rows; the others are held against brute force on the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from isovane.llm import packing, queries
from tests.compare import differing, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differing(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()}


def remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def test_language_of_held_out_documents(spark):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    assert all(r.held_out == (remainder(r.doc_id) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(held) > 100
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_quality_of_held_out_documents(spark):
    rows = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    marks = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, quality FROM labels").fetchall())
    good = [r.score for r in rows if r.held_out and marks.get(r.doc_id) == 1]
    poor = [r.score for r in rows if r.held_out and marks.get(r.doc_id) == 0]
    assert good and poor
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in poor])
    assert auc > 0.85
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_simhash_against_all_pairs(spark, texts):
    def brute(text: str) -> int:
        words = text.encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: brute(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    rows = queries.op4_simhash(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", root(i)) for i, p in prints.items()}


def test_fingerprints_of_edited_texts(spark, texts):
    import hashlib

    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    rows = queries.op5_fingerprints(spark, SF).collect()
    assert len(rows) == len(texts)
    seen: dict[str, str] = {}
    for r in rows:
        text, other = texts[r.doc_id], texts[after[r.doc_id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        exact = likeness(text, edited)
        assert abs(r.near_edited - exact) < 0.25 and 0 <= r.near_next <= 1
    assert np.mean([abs(r.near_edited - likeness(texts[r.doc_id], edit(texts, after, r.doc_id))) for r in rows]) < 0.05


def edit(texts, after, i):
    text, other = texts[i], texts[after[i]]
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def grams(text: str) -> set:
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_mixing_meets_targets(spark):
    rows = queries.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    source = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, source FROM documents").fetchall())
    taken, sizes, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    names = sorted(target, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:  # rounds of clamping
        share = sum(weight[s] for s in names if s not in capped)
        want = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and want[s] > 2.0 * sizes[s]}
        if not over:
            break
        capped |= over
        left -= sum(2.0 * sizes[s] for s in over)
    for s in names:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) < max(r.size for r in rows if source[r.doc_id] == s)  # less than one document
    assert sum(abs(taken[s] - target[s]) for s in names) < 0.01 * sum(target.values())


def test_shards_are_gapless_and_even(spark, texts):
    rows = queries.op9_sharding(spark, SF).collect()
    by_shard = defaultdict(list)
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
        by_shard[r.shard].append(r)
    counts = [len(by_shard[i]) for i in range(24)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1
    last = -1
    for i in range(24):
        run = sorted(by_shard[i], key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run)))
        for r in run:
            assert r.curve >= last
            last = r.curve


def test_packing_is_whole_and_tight(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op10_packing(spark, SF).collect()
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 1024 for r in parts[1:])
        assert len(parts) == 1 or len(ids) > 1024
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
        total += len(ids)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *[r.length for r in parts]])
        assert [r.offset for r in parts] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(by_sequence) <= 1.03 * -(-total // 1024) + 1
    assert packing.cuts(1024) == [(0, 1024)] and packing.cuts(1025) == [(0, 1), (1, 1024)]
