"""Toxicity where few rows are labelled, and where labels and documents don't meet."""

from __future__ import annotations

import random
import zlib

import pytest

from pvgrid.llm import toxicity

from .cases import DOCS, prose

LABELS = "doc_id bigint, quality int, toxic int"


def auc(pairs):
    """Share of (toxic, clean) pairs in order; ties count half."""
    bad, good = [s for t, s in pairs if t], [s for t, s in pairs if not t]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_hundred_documents(spark, seed):
    rng = random.Random(seed)
    insults = ["grobian", "lump", "flegel", "schuft", "tropf", "wicht", "knilch", "halunke"]
    docs, labels = [], []
    for k in range(200):
        words, toxic = prose(rng, rng.randint(30, 120)).split(" "), k % 6 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    found = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 200 and all(0 <= r.score <= 1 for r in found) and len({r.score for r in found}) > 50
    out = [(r.doc_id % 6 == 0, r.score) for r in found if r.held_out]
    assert len(out) > 40 and auc(out) > 0.8


def test_labels_of_other_documents(spark):
    docs = spark.createDataFrame([(k, f"text number {k}", "en", "s", 1) for k in range(6)], DOCS)
    labels = spark.createDataFrame([(1000 + k, 1, int(k % 4 == 0)) for k in range(20)], LABELS)
    learned = [k for k in range(20) if zlib.crc32(str(1000 + k).encode()) % 3 != 1]
    share = sum(k % 4 == 0 for k in learned) / len(learned)
    assert [r.score for r in toxicity.score_toxicity(docs, labels).collect()] == [pytest.approx(share)] * 6
    # clean labels meet documents, toxic ones don't
    some = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(1000 + k, 1, 1) for k in range(20)], LABELS)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, some).collect())
    assert toxicity.drop_toxic(docs, labels).count() == 6


def test_every_telling_word_is_kept(spark):
    """The vocabulary has no limit of its own: rare words beyond the first twenty thousand count too."""
    rng = random.Random(9)
    docs = [(k, " ".join(f"w{k % 2}x{rng.randrange(12_000)}" for _ in range(600)), "en", "s", 1) for k in range(500)]
    sample = spark.createDataFrame([(d[1], d[0] % 2, 1.0, True, d[0]) for d in docs], "_text string, toxic int, weight double, fit boolean, id long")
    found = toxicity._offending(sample)
    assert found.num_rows > 20_000
    assert {w[:2] for w, o in zip(found["word"].to_pylist(), found["offending"].to_pylist()) if o} <= {"w1"}
