"""Co-training against a plain version over dictionaries, most rows without a label and both views telling something."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from pvgrid.llm import quality
from pvgrid.llm.toxicity import logistic

from .cases import DOCS, prose

LABELS = "doc_id bigint, quality int, toxic int"


def crowd(n=1500, labelled=60):
    """Documents of sources that are mostly good or mostly bad; bad ones have junk words, a third of them none."""
    rng = random.Random(4)
    rows, labels, truth = [], [], {}
    for i in range(n):
        good = rng.random() < 0.5
        source = f"{'g' if good != (rng.random() < 0.08) else 'b'}{rng.randrange(12)}"
        text = prose(rng, rng.randint(10, 50)).split(" ")
        junk = [f"junk{rng.randrange(150)}" for _ in range(0 if good or rng.random() < 0.3 else 6)]
        rows.append((i, " ".join(text + junk), rng.choice(["en", "de", None]), source, rng.randint(1, 500)))
        truth[i] = int(good)
    labels = [(i, truth[i], 0) for i in rng.sample(range(n), labelled)] + [(rows[3][0], None, 0), (None, 1, 0), (n + 7, 1, 0)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "g1", 0), (None, "no id", "en", "b2", 5), rows[0]]
    truth |= {n: None, n + 1: None, None: None}
    return rows, labels, truth


def plain(rows, labels, part_of, bits, rounds):
    """The same scores by loops over documents and dictionaries."""
    label = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            label[i] = min(q, label.get(i, 1))
    docs = []
    for i, text, lang, source, size in rows:
        words = {zlib.crc32(w) >> 16 for w in (text or "").encode().lower().split()}
        docs.append(((i, text), part_of[i] if i in label else quality.POOL, label.get(i),
                     [sorted(words), quality.shape_of(text).tolist()], [quality.meta_of(lang, source, size, bits).tolist()]))
    check = sorted((d for d in docs if d[1] == quality.CHECK), key=lambda d: d[0][0])

    def design(d, view, model):
        return [1.0, *(sum(m.get(t, 0.0) for t in part) / len(part) if part else 0.0 for part, m in zip(d[3 + view], model))]

    models, calibrations = None, None
    for _ in range(rounds + 1):
        taught = [[], []]
        for d in docs:
            if d[1] == quality.FIT:
                taught[0].append((d, d[2]))
                taught[1].append((d, d[2]))
            elif d[1] == quality.POOL and models:
                for k in (0, 1):
                    odds = float(np.dot(design(d, k, models[k]), calibrations[k]))
                    if abs(odds) >= math.log(0.95 / 0.05):
                        taught[1 - k].append((d, int(odds > 0)))
        new = []
        for k in (0, 1):
            model = []
            n = [sum(g == c for _, g in taught[k]) for c in (0, 1)]
            for p in range(2 - k):
                counts = {}
                for d, g in taught[k]:
                    for t in set(d[3 + k][p]):
                        counts.setdefault(t, [0, 0])[g] += 1
                model.append({t: math.log((c[1] + 4 * sum(c) / sum(n)) / (n[1] + 4)) - math.log((c[0] + 4 * sum(c) / sum(n)) / (n[0] + 4))
                              for t, c in counts.items()})
            new.append(model)
        models = new
        y = np.array([d[2] for d in check], float)
        calibrations = [logistic(np.array([design(d, k, models[k]) for d in check]), y, np.full(len(y), 1 / len(y)), ridge=1e-3) for k in (0, 1)]
    odds = [[float(np.dot(design(d, k, models[k]), calibrations[k])) for k in (0, 1)] for d in docs]
    at = {id(d): o for d, o in zip(docs, odds)}
    both = logistic(np.array([[1.0, *at[id(d)]] for d in check]), y, np.full(len(y), 1 / len(y)), ridge=1e-3)
    return [(d[0][0], o[0], o[1], 1 / (1 + math.exp(-float(np.dot(both, [1.0, *o]))))) for d, o in zip(docs, odds)]


@pytest.fixture(scope="module")
def data(spark):
    rows, labels, truth = crowd()
    return rows, labels, truth, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("rounds", [0, 3])
def test_scores_match_plain_loops(spark, data, rounds):
    rows, labels, _, docs, marks = data
    from pyspark.sql import functions as F

    part = F.when(quality.hold_out(F.col("doc_id"), 3, 1), quality.OUT).when(
        F.pmod(F.xxhash64(F.lit(quality.SEED), "doc_id"), F.lit(4)) == 0, quality.CHECK).otherwise(quality.FIT)
    part_of = {r[0]: r[1] for r in docs.select("doc_id", part).collect()}
    bits = quality._meta_bits(docs, "lang", "source")
    want = sorted(plain(rows, labels, part_of, bits, rounds), key=repr)
    got = sorted(((r.doc_id, r.content_odds, r.meta_odds, r.score) for r in quality.score_quality(docs, marks, rounds=rounds).collect()), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-6, atol=1e-6)


def test_the_exchange_helps(spark, data):
    _, _, truth, docs, marks = data

    def right(rounds):
        found = quality.score_quality(docs, marks, rounds=rounds).collect()
        rated = [r for r in found if truth.get(r.doc_id) is not None]
        return sum(r.predicted == truth[r.doc_id] for r in rated) / len(rated)

    alone, exchanged = right(0), right(4)
    assert exchanged > 0.8 and exchanged > alone + 0.05


def test_metadata_tokens_grow_with_the_values(spark):
    many = spark.createDataFrame([(i, "t", "en", f"source {i}", 1) for i in range(5000)], DOCS)
    assert quality._meta_bits(many, "lang", "source") >= 15 > quality._meta_bits(many.limit(0), "lang", "source") == 10
