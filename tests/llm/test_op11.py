"""Conversation repair against all edit strings, in blocks of any cut, and against SQL on damaged and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from pvgrid.llm import repair as module
from pvgrid.llm.queries import OP11_SQL, _crc32, op11_repair
from pvgrid.llm.repair import MOVES, Survivors, _Repaired, block_moves, cheapest, find_faults, repair, repaired_turns

TURNS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def all_edits(kinds):
    """(cost, edits) of the best among every string of edits with at most two inserts in a row."""
    best = []
    for inserts in itertools.product(("", "I", "II"), repeat=len(kinds) + 1):
        for edits in itertools.product("DKR", repeat=len(kinds)):
            out, cost, text = [], 0, ""
            for gap, edit, kind in zip(inserts, edits + ("",), kinds + " "):
                for _ in gap:
                    out.append("u" if not out or out[-1] in "sa" else "a")
                    cost += 3
                text += gap + edit
                if edit == "D":
                    cost += 4
                elif edit:
                    if kind == "-" or edit == "K" and kind in "oO":
                        break
                    out.append(kind.lower() if edit == "K" else "u" if not out or out[-1] in "sa" else "a")
                    cost += (3 if edit == "R" else 0) + (3 if kind.isupper() else 0)
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(out)):
                    best.append((cost, text))
    return min(best)


def test_edits_match_all_strings():
    rng = random.Random(11)
    cases = {"", *("".join(k) for n in (1, 2) for k in itertools.product("suaoSUAO-", repeat=n))}
    cases |= {"".join(rng.choice("suaoUA-") for _ in range(rng.choice([3, 3, 4]))) for _ in range(60)}
    for kinds in cases:
        assert cheapest(kinds) == all_edits(kinds), kinds


def plain(kinds):
    """The same by keeping whole strings."""
    best = {0: (0, "")}
    def put(to, cost, text, into):
        if to not in into or (cost, text) < into[to]:
            into[to] = (cost, text)
    def insert(now):
        out = dict(now)
        for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if p in out:
                put(q, out[p][0] + 3, out[p][1] + "I", out)
        return out
    best = insert(best)
    for kind in kinds:
        new = {}
        for p, q, e, c in MOVES[kind]:
            if p in best:
                put(q, best[p][0] + c, best[p][1] + e, new)
        best = insert(new)
    return min(v for k, v in best.items() if k in (0, 3))


def test_long_conversations_and_blocks_match_whole_strings():
    rng = random.Random(12)
    for n in (13, 40, 300):
        for letters in ("ua", "suaoSUAO-", "o", "oU-", "uU", "ooooua", "UA"):
            kinds = "".join(rng.choice(letters) for _ in range(n))
            want = plain(kinds)
            assert cheapest(kinds) == want, kinds
            search, rest, got = Survivors(), kinds, ""
            search.insert()
            while rest:
                cut = rng.randint(1, 30)
                search.advance(block_moves(rest[:cut], range(4)), rest[:cut])
                got += "".join(e for e, _ in search.settled())
                rest = rest[cut:]
            cost = search.finish()
            assert (cost, got + "".join(e for e, _ in search.settled())) == want


def test_survivors_forget_what_is_settled():
    search, settled = Survivors(), 0
    search.insert()
    for kind in "ua" * 5000:
        search.advance(MOVES[kind])
        search.insert()
        settled += len(list(search.settled()))
        assert sum(map(len, (s or "" for s in search.strings()))) < 40
    assert settled > 9990


def odd_rows():
    rng = random.Random(13)
    role = ["user", "assistant", "system", "tool", "", None, "agent", "User"]
    text = ["Fine.", "Yes!", "cut off", "", " \t\n", None, "Fine.", "ends here. ", "dots... ", "é?", "1?\r\n"]
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 9)):
            said = rng.choice(text)
            if said and rng.random() < 0.7:
                said = f"{rng.randint(0, 99)} {said}"
            rows.append((c, t * rng.choice([1, 1, 1, 2]), rng.choice(role[:2] if c % 2 else role), said))
    rows += [(None, None, "user", "Null id."), (None, 3, "assistant", "Null id, too."), (None, None, "user", "Null id.")]
    rows += [(200, None, "user", "No number."), (200, None, "assistant", "None."), (200, 5, "user", "Five?"), (200, 5, "user", "Five?")]
    rows += [(300, t, role[t % 2], f"Turn {t % 700}." if t % 5 else f"turn {t}") for t in range(3000)]   # a hot conversation
    rows += [(301, 7, "user", "All the same row.")] * 400
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(odd_rows(), TURNS).selectExpr("*", "1 AS conv", "2 AS row", "'k' AS key", "3 AS block", "4 AS copy", "5 AS kind")
    df.repartition(5).write.parquet(str(path / "conversations.parquet"))
    return str(path)


def sql_rows(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet/*.parquet'")
    found = con.execute(OP11_SQL)
    return [d[0] for d in found.description], sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("rows, parts", ((1000, "4"), (3, "4"), (7, "40")))
def test_damaged_rows_match_sql(spark, odd, rows, parts, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for key, value in (("spark.sql.shuffle.partitions", parts), ("spark.sql.adaptive.coalescePartitions.enabled", str(parts == "4").lower())):
            spark.conf.set(key, value)
        names, want = sql_rows(odd)
        got = op11_repair(spark, odd)
        assert got.columns == names
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_turns_give_the_digest(spark):
    df = spark.createDataFrame([r for r in odd_rows() if r[0] not in (300, 301)], TURNS)
    turns = {}
    for r in repaired_turns(df).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    for r in repair(df).collect():
        mine = sorted(turns.get(r.conv_id, []))
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{m[2]}:{m[3]}" for m in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(m[1] for m in mine) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(m[2][0] for m in mine))


def test_faults(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", " \x0b"), (1, 4, "user", " \x0b"),
            (1, 5, "user", "so"), (1, 6, "user", "so"), (2, 0, "user", "Hi."), (1, 7, "user", "x. ")]
    got = {(r.conv, r.turn): r.fault for r in find_faults(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {(1, 0): None, (1, 1): "duplicate", (1, 2): None, (1, 3): "blank", (1, 4): "blank", (1, 5): "truncated",
                   (1, 6): "duplicate", (2, 0): None, (1, 7): "truncated"}


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], TURNS)
    assert repair(empty).collect() == [] and repaired_turns(empty).collect() == []
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert op11_repair(spark, str(tmp_path)).collect() == []


def test_conversation_that_is_lost_whole(spark, tmp_path):
    import zlib

    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Gone.")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in op11_repair(spark, str(tmp_path)).collect()] == [
        (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_check_sum_in_sql():
    import zlib

    for text in ("1:2", " : ", "-5:123456789"):
        assert duckdb.sql(f"SELECT {_crc32(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())


def test_take_follows_the_edits():
    out = _Repaired(True)
    out.take("KDRI", [("system", "s"), ("tool", "x"), ("tool", "t")])
    assert [r[1:] for r in out.listed] == [("K", "system", "s"), ("R", "user", "t"), ("I", "assistant", "")]
