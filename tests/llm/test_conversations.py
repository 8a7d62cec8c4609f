"""Conversation repair against a recursion over all edits, with small chunks so that pointers are spilled."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from compare import compare

from runloom.llm import conversations
from runloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, kind int, audit string, cost long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "x", 1) for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def edits(symbols):
    """Least cost and ASCII-least edit string; symbols: (initial, must go, open end). By recursion from the end."""
    keep = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    turned = {"-": "u", "s": "u", "a": "u", "u": "a"}

    @functools.cache
    def best(at, state, inserted):
        ways = [(10**9, "")]
        if at == len(symbols):
            if state in "-a":
                ways.append((0, ""))
        else:
            initial, gone, open_end = symbols[at]
            c, s = best(at + 1, state, 0)
            ways.append((c + 4, "D" + s))
            if not gone:
                c, s = best(at + 1, turned[state], 0)
                ways.append((c + 3 + 3 * open_end, "R" + s))
                if (state, initial) in keep:
                    c, s = best(at + 1, keep[state, initial], 0)
                    ways.append((c + 3 * open_end, "K" + s))
        if inserted < 3:
            c, s = best(at, turned[state], inserted + 1)
            ways.append((c + 3, "I" + s))
        return min(ways)

    return best(0, "-", 0)


def brute(rows, originals):
    """Rows after damage to what the operator returns for each of ``originals``."""
    out = {}
    for conv in originals:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        symbols, seen = [], set()
        for _, _, role, text in mine:
            bare, fault = text.strip(SPACE), None
            if not bare:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif bare[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit = edits(tuple(symbols))
        fixed, state, at = [], "a", 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else mine[at][2:]
            at += letter != "I"
            if letter in "RI":
                role = "assistant" if state == "u" else "user"
            if letter != "D":
                fixed.append(f"{role}:{text}")
                state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(f[0] for f in fixed))
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(fixed).encode()).hexdigest(),
        }
    return out


def told(df):
    found = df.collect()
    out = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}
    assert len(out) == len(found)
    return out


def made(seed, n, turns):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, turns)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", "user"])
            text = rnd.choice(["Yes.", "No", "Why?", "", " \n", f"Said {turn}.", f"Said {turn}", "Well!  \t", "…"])
            if rnd.random() < 0.9:
                rows.append((conv, rnd.choice([turn, turn, turn, turn + 3]), role, text))
    return rows


def test_query_is_the_recursion(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op12_conversations"](spark, SF)) == brute(damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 3])
def test_made_conversations(spark, chunk):
    rows = made(1, 150, 14)
    assert told(conversations.repair(table(spark, rows), chunk=chunk)) == brute(rows, {r[0] for r in rows})


ODD = [
    (None, 0, "user", "No conversation."), (None, None, "assistant", "Nor turn."), (5, None, "user", "Hi."), (5, None, None, "No role."),
    (5, 2, "", "Empty role."), (5, 3, "assistant", None), (6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, 9, "user", "Same."),
    (7, 0, "assistant", "x" * 300_000), (7, 0, "user", "漢字\U0001f600."), (8, 2**60, "user", "Far."), (8, -(2**60), "system", "Off."), (9, 4, "usher", "Kept?"),
]


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 1])
def test_odd_rows(spark, chunk):
    rows = table(spark, ODD)
    assert told(conversations.repair(conversations.damaged(rows), rows, chunk)) == brute(damage(ODD), {r[0] for r in ODD})


def test_all_rows_of_a_conversation_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = table(spark, [(gone, 0, "user", "Hello."), (gone + 1, 0, "user", "Hello.")])
    got = told(conversations.repair(conversations.damaged(rows), rows))[gone]
    assert got == dict.fromkeys(conversations.COUNTS, 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    rows = table(spark, [])
    assert conversations.repair(conversations.damaged(rows), rows).collect() == []
    assert conversations.repaired(rows).collect() == []


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = table(spark, made(2, 40, 20))
    digests = {k: v["repaired_sha256"] for k, v in told(conversations.repair(rows)).items()}
    lines: dict = {k: [] for k in digests}
    for r in conversations.repaired(rows, chunk=4).orderBy("conv_id", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert digests == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()}


def test_a_giant_conversation_streams(spark):
    """A third of a million rows in one conversation, in many batches and chunks."""
    rows = spark.range(300_000).selectExpr(
        "0L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id % 250000, IF(id % 5 = 0, '', '.')) AS text"
    )
    got = told(conversations.repair(rows))[0]
    assert got["duplicate"] == 50_000 - sum(("user" if i % 7 == 3 or i % 2 == 0 else "assistant") != ("user" if (i - 250_000) % 7 == 3 or i % 2 == 0 else "assistant") for i in range(250_000, 300_000))
    assert len(got["audit"].replace("I", "")) == 300_000


def test_sql_on_odd_and_made_rows(spark):
    rows = [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in ODD] + made(5, 60, 12)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    given = table(spark, rows)
    assert compare(conversations.repair(conversations.damaged(given), given), con, conversations.oracle_sql()) is None
