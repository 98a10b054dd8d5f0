"""Decontamination and SimHash against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
import xxhash

from pvgrid.llm.decontaminate import decontaminate, drop_contaminated
from pvgrid.llm.simhash import components, covering_masks, drop_near_duplicates, near_duplicates, star_edges

from .cases import documents, frame, lower, words

MASK = (1 << 64) - 1


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="module")
def items():
    rows = documents()
    deep = next(r for r in rows if r[0] == 76)
    return [(1, " ".join(plain_words(rows[4][1])[:14])), (2, " ".join(plain_words(deep[1])[-25:]).upper()), (10, "two, words"),
            (3, None), (4, "..."), (2, "One"), (7, "never anywhere in these texts"), (None, "no id")]


def expected(items):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add("" if i is None else str(i))
    out = []
    for i, text, *_ in documents():
        w, hit, names = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_chars", [8_000_000, 300])
def test_decontamination_matches_brute_force(spark, items, max_chars):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate(frame(spark), bench, max_chars=max_chars).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=repr)
    assert got == expected(items)
    texts = {i: t for i, t, *_ in documents() if i not in (None, 3, 5)}
    for r in found:  # ranges of the original hold just the hit words
        if r.doc_id in texts:
            assert sum(len(plain_words(texts[r.doc_id][s.start:s.end])) for s in r.spans) == r.n_hit


def test_contaminated_documents_go_and_others_stay(spark, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for max_chars in (8_000_000, 300):
        kept = drop_contaminated(frame(spark), bench, max_chars=max_chars)
        assert kept.columns == frame(spark).columns
        assert sorted((repr(r.doc_id) for r in kept.collect())) == sorted(repr(x[0]) for x in expected(items) if not x[5])


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(none, bench).count() == 0 and near_duplicates(none).count() == 0
    assert drop_near_duplicates(none).count() == 0
    assert not decontaminate(frame(spark), bench).where("contaminated").count()


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(fps, radius=3):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            up[root(a)] = root(b)
    groups = defaultdict(set)
    for f in fps:
        groups[root(f)].add(f)
    return list(groups.values())


def test_near_duplicates_match_brute_force(spark):
    of = defaultdict(list)
    for i, t, *_ in documents():
        of[fingerprint(t)].append(i)
    want = []
    for group in linked(list(of)):
        ids = [i for f in group for i in of[f]]
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, f"{f:016x}", least) for f in group for i in of[f]]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_row_of_each_component_stays(spark):
    """Rows of one id, and rows without, are rows of their own; the first row by id of a component stays."""
    rows = documents()
    group_of = {f: k for k, group in enumerate(linked(list({fingerprint(r[1]) for r in rows}))) for f in group}
    first = {}
    for r in rows:
        group, key = group_of[fingerprint(r[1])], (r[0] is None, r[0] or 0)
        if group not in first or key < first[group][0]:
            first[group] = (key, r[:2])
    kept = drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((f[1] for f in first.values()), key=repr)
    alone = [(None, "some text of its own", "en", "s", 1)] * 3 + [(4, "x y z", "en", "s", 1), (4, "quite another text here", "en", "s", 1)]
    assert drop_near_duplicates(frame(spark, alone)).count() == 3


def test_masks_cover_every_choice_of_positions():
    positions = list(range(0, 64, 5))
    masks = covering_masks(positions, 3)
    for chosen in itertools.combinations(positions, 3):
        assert any(not any(m >> p & 1 for p in chosen) for m in masks)
    assert all(masks)


@pytest.mark.parametrize("bucket", [8, 256])
def test_crowded_buckets_lose_no_link(spark, bucket):
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << p for p in rng.sample(range(64), k)) for k in range(8) for _ in range(8)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(20), 2)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    df = spark.createDataFrame(signed, "fp long")
    edges = star_edges(df, bucket=bucket)
    edges.persist()
    groups = linked(list(fps))
    for r in edges.collect():  # a star never joins what doesn't link
        assert any({r.a & MASK, r.b & MASK} <= g for g in groups)
    roots = {r.node & MASK: r.root for r in components(edges).collect()}
    got = defaultdict(set)
    for f in fps:
        got[roots.get(f, f - (1 << 64) if f >> 63 else f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_components_of_a_long_path(spark):
    n = 120
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}
