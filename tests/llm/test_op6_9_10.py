"""Mixing, exact dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pvgrid.llm.exactdedup import exact_duplicates
from pvgrid.llm.linedup import drop_repeated_lines
from pvgrid.llm.mixing import mix, take_mix

from .cases import DOCS, WHITE, documents, frame, lower, words


def mixture(rows):
    """(id, size, source size, target, taken) by sorting all copies."""
    sizes, docs = defaultdict(int), []
    for k, (i, text, _, source, _) in enumerate(rows):
        place = [hashlib.md5(("" if x is None else str(x)).encode()).hexdigest() for x in (i, text)]
        docs.append((i, source, len(words(text)), "".join(place) + f"{k:06d}"))
        sizes[source] += docs[-1][2]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    budget = left = sum(sizes.values())
    target, share = {}, set(order)
    while share:
        level = Fraction(left, sum(weight[s] for s in share))
        over = {s for s in share if level * weight[s] > 3 * sizes[s]}
        for s in over or share:
            target[s] = Fraction(3 * sizes[s]) if over else level * weight[s]
        left -= sum(3 * sizes[s] for s in over)
        share = share - over if over else set()
    upto = {d: sum(x[2] for x in docs if x[1] == d[1] and x[3] <= d[3]) for d in set(docs)}
    copies = [((e * sizes[d[1]] + upto[d]) / float(target[d[1]]), d[1] is None, d[1] or "", e, d[3], k)
              for k, d in enumerate(docs) if target[d[1]] for e in range(3)]
    copies.sort()
    taken, spent, at = defaultdict(int), 0, 0
    while at < len(copies):
        tie = [c for c in copies[at:] if c[:5] == copies[at][:5]]
        spent += sum(docs[c[5]][2] for c in tie)
        if spent > budget:
            break
        for c in tie:
            taken[c[5]] += 1
        at += len(tie)
    return [(d[0], d[2], sizes[d[1]], float(target[d[1]]), d[2] * taken[k]) for k, d in enumerate(docs)], taken


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    return len(got) == len(want) and all(
        a == b or isinstance(a, float) and math.isclose(a, b) for x, y in zip(got, want) for a, b in zip(x, y, strict=True))


def test_mix_matches_sorting_all_copies(spark):
    got = [tuple(r) for r in mix(frame(spark)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert same(got, mixture(documents())[0])


@pytest.mark.parametrize("texts", [["same"], ["one", "two words", "three words here"]])
def test_rows_without_or_with_one_id_are_taken_one_by_one(spark, texts):
    rows = [(None, texts[k % len(texts)], "en", "a", 1) for k in range(40)] + [(7, texts[k % len(texts)], "en", "b", 1) for k in range(80)]
    rows += [(1000 + k, "w w w", "en", "c", 1) for k in range(80)]
    got = [tuple(r) for r in mix(spark.createDataFrame(rows, DOCS)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert same(got, mixture(rows)[0])
    per = defaultdict(lambda: [0, 0.0])
    for _, _, source_size, target, taken in got:
        per[source_size, target][0] += taken
    assert all(abs(taken[0] - target) <= 9 for (_, target), taken in per.items())
    assert take_mix(spark.createDataFrame(rows, DOCS)).count() == sum(t // s for _, s, _, _, t in got)


def test_mix_on_even_documents_meets_the_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 9), "en", rng.choice("aaaaaab") + rng.choice("xyz"), 1) for k in range(900)]
    assert same([tuple(r) for r in mix(spark.createDataFrame(rows, DOCS)).drop("copies").collect()], mixture(rows)[0])
    per = mix(spark.createDataFrame(rows, DOCS)).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 12 for r in per)


def test_taken_documents_repeat_with_all_columns(spark):
    df = frame(spark)
    rows = take_mix(df)
    assert rows.columns == df.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[(r.doc_id, r.text)] += 1
    want = defaultdict(int)
    for k, n in mixture(documents())[1].items():
        want[documents()[k][:2]] += n
    assert got == {k: n for k, n in want.items() if n}


def keep(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups["".join(c for c in text or "" if c not in WHITE)].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], best[3], len(members), digest) for m in members]
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates_match_brute_force(spark, weak):
    """With a hash of two values almost all chunks clash, and their contents decide."""
    params = {"chunk_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(2))} if weak else {}
    rows = exact_duplicates(frame(spark), **params).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=repr) == sorted(keep(documents()), key=repr)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_long_texts_that_differ_at_one_place(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcesu \n") for _ in range(60_000))
    rows = [(1, text), (2, text[:30_000] + "#" + text[30_001:]), (3, text.replace("\n", " \n")), (4, text + "x"), (5, "x" + text)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1)}


def lines(rows, min_docs=5):
    def key(line):
        return lower(line.strip(WHITE))
    held = defaultdict(list)
    for i, text, *_ in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(i)
    out = []
    for i, text, *_ in rows:
        all_lines, kept = (text or "").split("\n"), []
        for line in all_lines:
            ids = held.get(key(line), [])
            last = max((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or last is None or last == i:
                kept.append(line)
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("params", [{}, {"max_lookup": 0}, {"batches": 7, "fan_out": 2}, {"batches": 1}])
def test_repeated_lines_match_brute_force(spark, params):
    found = drop_repeated_lines(frame(spark), **params).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=repr) == lines(documents())
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in found)
    assert sum(r.n_dropped for r in found) > 5


def test_empty_tables(spark):
    none = frame(spark, [])
    assert [f(none).count() for f in (mix, take_mix, exact_duplicates, drop_repeated_lines)] == [0, 0, 0, 0]
