"""Classifiers by held-out accuracy and exact inference, lattice scores, tool calls and token planes by brute force."""

from __future__ import annotations

import itertools
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pvgrid.llm import lattice, planes, toolcalls, toxicity
from pvgrid.llm.quality import score_quality
from pvgrid.llm.queries import PIECES, TOKENIZER, TOOLS
from pvgrid.llm.toolcalls import levels, link_every_call

from .cases import DOCS, documents, frame, prose, words


def labelled(spark, n=400):
    """Prose, a third of it with insults, a quarter of it junk; sources tell nothing."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 3 == 0, i % 4 == 1
        text = prose(rng, rng.randint(20, 120)).split(" ")
        for _ in range(rng.randint(2, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Grobian", "lump,", "flegel"]))
        text = " ".join(w + "$$$" if junk else w for w in text)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), len(text)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (None, "no id", "en", "a", 5), rows[3]]
    labels += [labels[3], (n + 50, 1, 1), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    found = toxicity.score_toxicity(docs, labels, steps=12).collect()
    assert len(found) == 404 and all(0 <= r.score <= 1 for r in found)
    truth = {i: i % 3 == 0 for i in range(400)}
    out = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and sum(r.predicted == truth[r.doc_id] for r in out) > 0.95 * len(out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marked = [texts[r.doc_id][s.start:s.end].lower() for r in out for s in r.spans if r.predicted]
    assert sum(w in ("grobian", "lump", "flegel") for w in marked) > 0.95 * len(marked) > 50
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(9)), labels, steps=12)
    assert kept.columns[-1] == "score" and kept.count() == sum(not r.predicted for r in found)


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 12)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0
    assert toxicity.score_toxicity(frame(spark), labels).count() == len(documents())


def test_gradient_is_that_of_all_taggings():
    rng, n = np.random.default_rng(0), 4
    ids, sizes = rng.integers(0, n + 1, 9), np.array([4, 1, 3, 1])
    tags, weight = rng.integers(0, 2, 9).astype(float), np.repeat(rng.random(4) + 0.5, sizes)
    w = rng.normal(size=3 * (n + 1) + 5)

    def likelihood(w):
        left, right, first = toxicity._neighbours(ids, sizes, n)
        d, total = toxicity._potential(w, ids, left, right, n), 0.0
        for f, s in zip(first, sizes, strict=True):
            def score(y):
                return sum(d[f + k] * y[k] for k in range(s)) + sum(w[-4 + 2 * int(y[k]) + int(y[k + 1])] for k in range(s - 1))
            total += weight[f] * (score(tags[f:f + s]) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=s)]))
        return total

    numeric = [(likelihood(w + 1e-5 * e) - likelihood(w - 1e-5 * e)) / 2e-5 for e in np.eye(len(w))]
    assert np.allclose(toxicity.gradient(w, n, ids, sizes, tags, weight), numeric, atol=1e-6)


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    found = score_quality(docs, labels).collect()
    assert len(found) == 404 and all(0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 1) for r in out) > 0.95 * len(out)
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), labels).count() == 0
    assert score_quality(frame(spark), labels).count() == len(documents())


@pytest.fixture(scope="module")
def pieces():
    return lattice.vocabulary(PIECES)


def test_lattice_sums_all_segmentations(pieces):
    names, of_byte = pieces
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(len(names))))
    place = {p: k for k, p in enumerate(names) if p}

    def ways(text):  # by bytes; a character that is no piece goes byte by byte
        mark = "▁" + text
        raw, spelled, at = mark.encode(), set(), 0
        for c in mark:
            size = len(c.encode())
            if c.encode() not in place:
                spelled |= set(range(at, at + size))
            at += size
        total = [1.0] + [0.0] * len(raw)
        for end in range(1, len(raw) + 1):
            total[end] = sum(total[s] * math.exp(log_p[place[raw[s:end]]]) for s in range(end) if raw[s:end] in place)
            if end - 1 in spelled:
                total[end] += total[end - 1] * math.exp(log_p[of_byte[raw[end - 1]]])
        return math.log(total[-1])

    texts = ["the", "internationalization", "réeux", "日本語", "\x00x", "𝔘😀", "▁▁", "|", "a" * 70]
    found = lattice.Lattice(names, of_byte)
    raw = [t.encode() for t in texts]
    assert np.allclose(found.score(raw, log_p), [ways(t) for t in texts])
    counts = np.arange(1.0, len(raw) + 1)
    used = found.expected(raw, counts, log_p)
    for k in (place["▁the".encode()], place[b"a"], of_byte[0]):
        step = np.zeros(len(log_p))
        step[k] = 1e-5
        slope = ((found.score(raw, log_p + step) - found.score(raw, log_p - step)) * counts).sum() / 2e-5
        assert math.isclose(used[k], slope, abs_tol=1e-4)


@pytest.mark.parametrize("max_head", [150_000, 20])
def test_document_scores(spark, max_head):
    found = lattice.score_documents(frame(spark), PIECES, max_head=max_head).collect()
    rows = [(i, words(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t, *_ in documents()]
    counts, ends = Counter(w for _, ws, out in rows if not out for w in ws), sum(not out for *_, out in rows)
    n, below = sum(counts.values()) + ends, sum(counts.values()) + ends + len(counts) + 2
    want = [(i, out, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n,
             sum(math.log10((counts[w] + 1) / below) for w in ws) + math.log10((ends + 1) / below)) for i, ws, out in rows]
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in found), key=repr)
    for a, b in zip(got, sorted(map(list, want), key=repr), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5])
    assert all(r.score < 0 for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[70] == by_id[71] == by_id[72] and by_id[30] == by_id[4]


def test_scores_do_not_depend_on_the_head_and_take_no_rows(spark):
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in lattice.score_documents(frame(spark), PIECES, max_head=m).collect()}
            for m in (150_000, 0))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
    assert lattice.score_documents(frame(spark, []), PIECES).count() == 0
    assert lattice.score_documents(frame(spark), PIECES, held_out=F.lit(True)).where("n_known > 0 OR train_tokens > 0").count() == 0


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on string, level int"
RESULTS = "conv_id long, call_id string, turn long, content string, errors string"


def test_tool_calls(spark):
    calls = [(1, "a", 1, "search", '{ "limit": 3, "query": "x\\n" }', None, 0), (1, "b", 3, "lookup", '{"share": 1.50, "key": "k"}', "a", 0),
             (1, "c", 5, "search", '{"limit": "3"}', "b", 0), (1, "d", 6, "shell", '{}', "zz", 0),
             (1, "e", 7, "lookup", '{"key": 1, "more": [1, {"z": 1, "a": null}]}', "f", 0), (1, "f", 8, "lookup", "[1]", "e", 0),
             (1, "g", 9, "lookup", None, "f", 0), (1, None, 2, "search", '{"query": "q", "limit": 1}', None, 0),
             (2, "a", 1, "lookup", '{"key": "x", "key": "y"}', None, 0), (2, "a", 0, "lookup", '{"key": "first"}', None, 0),
             (None, "a", 1, None, None, None, 0)]
    results = [(1, "a", 2, "late", "x"), (1, "a", 1, "early", "x"), (1, "q", 4, "orphan", "x"), (2, "a", 2, None, "x"), (1, None, 1, "lost", "x")]
    schemas = spark.createDataFrame(list(TOOLS), "name string, param string, type string, required boolean")
    rows = link_every_call(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    got = {(r.conv_id, r.call_id, r.turn, r.state): (r.level, r.n_calls, r.n_results, r.errors) for r in rows}
    texts = {(r.conv_id, r.call_id, r.turn): r.canonical_json for r in rows}
    assert len(got) == len(rows) and got == {
        (1, "a", 1, "answered"): (0, 1, 1, ""), (1, "b", 3, "unanswered"): (1, 1, None, ""), (1, "a", None, "orphan_result"): (None, None, 1, None),
        (1, "c", 5, "unanswered"): (2, 1, None, "missing:query,type:limit"), (1, "d", 6, "unanswered"): (0, 1, None, "unknown_tool,missing_call"),
        (1, "e", 7, "circle"): (-1, 1, None, "type:key,unknown:more"), (1, "f", 8, "circle"): (-1, 1, None, "not_json"),
        (1, "g", 9, "circle"): (-1, 1, None, "not_json"), (1, None, 2, "unanswered"): (0, 1, None, ""),
        (2, "a", 0, "unanswered"): (0, 1, None, ""), (2, "a", 1, "answered"): (0, 1, 1, "not_json"),
        (None, "a", 1, "unanswered"): (0, 1, None, "unknown_tool"), (1, "q", None, "orphan_result"): (None, None, 1, None),
        (1, None, None, "orphan_result"): (None, None, 1, None)}
    for text in texts.values():
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(texts[1, "e", 7])["arguments"] == {"key": 1, "more": [1, {"a": None, "z": 1}]}
    assert json.loads(texts[1, "a", 1])["result"] == "early" and json.loads(texts[2, "a", 0])["arguments"] == {"key": "first"}


def test_schemas_of_several_types_and_numbers(spark):
    schemas = [("t", "x", "integer", True), ("t", "x", "string", False), ("t", "n", "number", None), ("t", "n", "number", None),
               ("t", None, "string", True), (None, "x", "string", True), ("t", "odd", "date", False), ("t", "z", None, None), ("t", "i", "integer", False)]
    given = ['{"x": 1}', '{"x": "1"}', '{"x": true}', '{"n": 1e2}', '{"x": 3.0, "i": 3.00}', '{"x": 1, "i": 3.5}', '{"x": 1, "odd": "2020-01-01"}',
             '{"x": 1, "z": 1}', '{"x": 12345678901234567890123456789012345678}', '{"x": 1, "n": 123456789012345678901234567890123456789012}',
             '{"x": 1, "n": 0.1234567890123456789012345}', '{"x": "123456789012345678901234567890123456789012"}']
    calls = spark.createDataFrame([(1, f"c{k}", k, "t", a, None, 0) for k, a in enumerate(given)], CALLS)
    tools = spark.createDataFrame(schemas, "name string, param string, type string, required boolean")
    rows = link_every_call(calls, spark.createDataFrame([], RESULTS), tools).collect()
    got = {r.turn: (r.errors, r.canonical_json.split('"arguments":')[1].split(',"id"')[0]) for r in rows}
    assert got == {
        0: ("", '{"x":1}'), 1: ("", '{"x":"1"}'), 2: ("type:x", '{"x":true}'), 3: ("missing:x", '{"n":100.0}'), 4: ("", '{"i":3,"x":3}'),
        5: ("type:i", '{"i":3.5,"x":1}'), 6: ("type:odd", '{"odd":"2020-01-01","x":1}'), 7: ("type:z", '{"x":1,"z":1}'),
        8: ("", '{"x":12345678901234567890123456789012345678}'), 9: ("inexact:n", '{"n":1.2345678901234568E41,"x":1}'),
        10: ("", '{"n":0.1234567890123456789012345,"x":1}'), 11: ("", '{"x":"123456789012345678901234567890123456789012"}')}


def test_identifiers_used_once_are_hash_joined(spark):
    calls = spark.createDataFrame([(1, f"c{k}", k, "t", "{}", f"c{k - 1}", 0) for k in range(20)], CALLS)
    results = spark.createDataFrame([(1, f"c{k}", k + 1, "r", "") for k in range(0, 30, 2)], RESULTS)
    plain = [f.select(*[c for c in f.columns if c not in ("level", "errors")]).withColumn("node", F.monotonically_increasing_id()) for f in (calls, results)]
    links, needed = toolcalls._linked_once(*plain, plain[0].withColumn("call_id", F.col("depends_on")))
    for joined in (links, needed):
        assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert links.count() == 10 and needed.count() == 19


def test_levels_of_a_long_chain_and_no_calls(spark):
    n = 200
    chain = spark.createDataFrame([(1, f"c{k}", f"c{k - 1}" if k else None) for k in range(n)], "conv_id long, call_id string, depends_on string")
    assert {r.call_id: r.level for r in levels(chain).collect()} == {f"c{k}": k for k in range(n)}
    schemas = spark.createDataFrame([], "name string, param string, type string, required boolean")
    assert link_every_call(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), schemas).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n, block in ((0, 8), (1, 8), (8, 8), (1003, 64), (70_000, 65_536)):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (planes.unpack(planes.pack(ids, kind, block)) == ids).all()
    with pytest.raises(ValueError):
        planes.unpack(b"x" * 40)


def test_check_sums_join():
    rng = random.Random(4)
    for _ in range(20):
        a, b = rng.randbytes(rng.randint(0, 90)), rng.randbytes(rng.randint(0, 9000))
        assert planes.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ODD = ["a  b\n\n c\t\td  x\x1cy  ", "x <|endoftext|> y", "don't  I'll GO 12 3!!  they've", " word, other; Üben?ja é.", "ʼn ǆ ß, ſt ",
       "日本語 です。 x　y", "a.b,c !? ...", "  lead", "nbsp\xa0x \x85y", "\r\n\r\n x", "'s 's", "ab" * 60 + " " + "é" * 80, "👩‍👩‍👧 oḱ é"]


@pytest.mark.parametrize("params", [{}, {"planes": "bit", "chunk_ids": 700, "block_ids": 64}])
def test_token_files(spark, params, monkeypatch):
    rows = documents() + [(900 + k, t, "en", "s", 1) for k, t in enumerate(ODD)]
    library, want, start = Tokenizer.from_file(TOKENIZER), [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = planes.token_digest(frame(spark, rows), TOKENIZER, **params)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    assert planes.token_digest(frame(spark, []), TOKENIZER).count() == 0


def test_encoder_forgets_and_remembers(monkeypatch):
    monkeypatch.setattr(planes, "MEMO", 50)
    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, own, rng = Tokenizer.from_str(content), planes.Encoder(content), random.Random(6)
    for _ in range(12):
        texts = [prose(rng, 40) for _ in range(5)] + ODD
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
