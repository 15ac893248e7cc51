"""Conversation repair against brute force: all edits of short conversations, and the
whole query written out row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from veilframe.llm import conversation_repair as R
from veilframe.llm.queries import op11_conversation_repair

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(letters: str) -> tuple[int, str]:
    """Every edit of every row, with up to two inserts in all."""
    choices = []
    for x in letters:
        late = 5 if x.isupper() else 0
        own = [("D", "", 2)]
        if x != "x":
            own += [("K", x.lower(), late), ("R", "u", 1 + late), ("R", "a", 1 + late)]
        choices.append(own)
    gaps = len(letters) + 1
    inserts = [("",) * gaps]
    for n in (1, 2):
        for places in itertools.combinations_with_replacement(range(gaps), n):
            for roles in itertools.product("ua", repeat=n):
                slots = [""] * gaps
                for p, r in zip(places, roles, strict=True):
                    slots[p] += r
                inserts.append(tuple(slots))
    best = None
    for picked in itertools.product(*choices):
        for slots in inserts:
            said = slots[0] + "".join(p[1] + s for p, s in zip(picked, slots[1:], strict=True))
            if not LEGAL.fullmatch(said):
                continue
            audit = "I" * len(slots[0]) + "".join(p[0] + "I" * len(s) for p, s in zip(picked, slots[1:], strict=True))
            got = sum(p[2] for p in picked) + 5 * sum(map(len, slots)), audit
            best = got if best is None or got < best else best
    return best


def test_parse_is_the_cheapest_and_least():
    for n in range(4):
        for letters in itertools.product("suaoUAx", repeat=n):
            assert R.parse("".join(letters)) == cheapest("".join(letters)), letters
    rnd = random.Random(3)
    for _ in range(60):
        letters = "".join(rnd.choice("suaoSUAOx") for _ in range(4))
        assert R.parse(letters) == cheapest(letters), letters


def test_long_conversations_fold():
    rnd = random.Random(4)
    letters = "".join(rnd.choice("uauauasoUAx") for _ in range(700))
    cost, audit = R.parse.__wrapped__(letters)
    before, R.FOLD = R.FOLD, 16
    try:
        assert R.parse.__wrapped__(letters) == (cost, audit)
    finally:
        R.FOLD = before
    assert R.parse.__wrapped__("x" * 20000) == (40000, "D" * 20000)


def expected(rows):
    """The query, row by row: (conv_id, turn, role, text) to its result by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, letters, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in kept:
            bare = text.rstrip(R.SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                faults[fault] += 1
        turns = {t for t, *_ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit = R.parse(letters)
        said, at = [], 0
        for edit in audit:
            row = None if edit == "I" else kept[at]
            at += edit != "I"
            wanted = "assistant" if said and said[-1].startswith("u") else "user"
            if edit != "D":
                said.append(f"{row[1] if edit == 'K' else wanted}:{row[2] if row else ''}")
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def collected(df):
    got = [tuple(r) for r in df.select("conv_id", *R.COUNTS, "audit", "repaired_sha256").collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


SCHEMA = "conv_id long, turn long, role string, text string, conv string, audit int"


def test_query_row_by_row(spark):
    df = op11_conversation_repair(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(df) == expected(rows)


def test_nulls_ties_repeats_and_strange_roles(spark):
    rnd = random.Random(5)
    said = ["Yes.", "No", "", " \t", "No. ", None, "é?", "Who…", "Ja!\n", "x" * 300_000 + "."]
    rows = [
        (rnd.choice([None, 1, 2, 3, *range(20, 60)]), rnd.choice([None, 0, 1, 2, 3, 3, 7, -4]), rnd.choice(["user", "assistant", "system", None, "", "User", "tool"]), rnd.choice(said))
        for _ in range(400)
    ]
    rows += rows[:40] + [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert collected(R.repair_damaged(df)) == expected(rows)


def test_empty_and_text_ids(spark):
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hello."), ("b", 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "id string, n int, who string, said string")
    parsed = R.parse_conversations(df, "id", "n", "who", "said")
    assert {r.conv: (r.cost, r.audit) for r in parsed.collect()} == {"a": (1, "KR"), "b": (2, "D")}
    fixed = R.repair_conversations(df, parsed, "id", "n", "who", "said").collect()
    assert [tuple(r) for r in fixed] == [("a", 0, "K", "user", "Hi."), ("a", 1, "R", "assistant", "Hello.")]


@pytest.mark.parametrize("rows", [[], [(7, 0, None, None, None, None)]])
def test_only_dropped_or_blank_rows(spark, rows):
    got = collected(R.repair_damaged(spark.createDataFrame(rows, SCHEMA)))
    assert got == expected([r[:4] for r in rows])
