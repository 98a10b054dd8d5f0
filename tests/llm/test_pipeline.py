"""The pipeline's stages, each on what its predecessor kept, against plain versions; and all of them by run()."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pvgrid.llm.common import table
from pvgrid.llm.queries import TOKENIZER

from .cases import DOCS, documents, prose
from .test_op1_7 import fingerprint, linked
from .test_op6_9_10 import mixture

ITEMS = ["which of the ten old rivers of the land runs north and ends in a lake of salt", "yes", "1984 it was"]


def planted():
    rng = random.Random(31)
    insults = ["grobian", "lump", "flegel", "schuft", "tropf"]
    rows, labels = list(documents()), []
    for k in range(120):
        words, toxic = prose(rng, rng.randint(40, 90)).split(" "), k % 5 == 0
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((1000 + k, " ".join(words), "en", f"s{k % 4}", 1))
        labels.append((1000 + k, 1, int(toxic)))
    clean = [r for r in rows if r[0] and r[0] >= 1000 and r[0] % 5]
    rows += [(2000 + k, f"{r[1]} {ITEMS[0].upper()}, so {r[1]}", "en", "s0", 1) for k, r in enumerate(clean[:6])]
    rows += [(2100 + k, f"{r[1]} yes, in 1984", "en", "s1", 1) for k, r in enumerate(clean[10:14])]
    rows += [(2200 + k, clean[20][1], "en", "s2", 1) for k in range(9)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, labels) = str(tmp_path_factory.mktemp("corpus")), planted()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def first_of_groups(rows):
    every = list(rows.elements())
    group_of = {f: k for k, g in enumerate(linked(list({fingerprint(r[1]) for r in every}))) for f in g}
    least = {}
    for r in every:
        g = group_of[fingerprint(r[1])]
        least[g] = min(least.get(g, (True, 1 << 62)), (r[0] is None, r[0] or 0))
    return least, group_of


def test_every_stage_and_run(spark, folder):
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(step(spark, docs, folder), f"test-{name}")
        assert name == "tokens" or out.columns == docs.columns
        kept[name], docs = out, out
    start = rows_of(table(spark, folder, "documents"))
    now = rows_of(kept["toxicity"])
    toxic = {1000 + k for k in range(120) if k % 5 == 0}
    left = {r[0] for r in now}
    assert len(toxic & left) <= 2 and sum(r[0] not in left for r in start if r[0] and r[0] not in toxic and r[0] >= 1000) <= 3

    before, now = now, rows_of(kept["near_duplicates"])
    least, group_of = first_of_groups(before)
    assert sum(now.values()) == len(least) and not now - before
    for r, n in now.items():
        assert n == 1 and least[group_of[fingerprint(r[1])]] == (r[0] is None, r[0] or 0)

    before, now = now, rows_of(kept["decontamination"])
    passage = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ITEMS[0])
    windows = {tuple(passage[k:k + 10]) for k in range(len(passage) - 9)}

    def contaminated(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        return any(tuple(words[k:k + 10]) in windows for k in range(len(words)))
    assert now == Counter({r: n for r, n in before.items() if not contaminated(r[1])}) and sum(before.values()) > sum(now.values())

    before, now = now, rows_of(kept["mixing"])
    listed = list(before.elements())
    assert now == Counter({listed[k]: n for k, n in mixture(listed)[1].items() if n})

    library, want, start_at = Tokenizer.from_file(TOKENIZER), [], 0
    for i, text in sorted(((r[0], r[1]) for r in now.elements()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start_at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start_at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept["tokens"].collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(kept["tokens"])


def test_empty_table(spark, folder, tmp_path):
    docs = table(spark, folder, "documents").where("false")
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0, name
