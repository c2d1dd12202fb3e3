"""Chat formatting: Viterbi against all paths, blocks against whole transcripts, roles without their markers."""

import random
from itertools import product

import pytest

from eventloom.llm import chat, queries
from eventloom.llm._base import written

SCHEMA = "conv_id long, turn long, role string, text string, turns string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def talk(rnd, conv, n, roles=("user", "assistant")):
    rows = []
    for turn in range(n):
        role = roles[turn % len(roles)]
        size = 1 if turn % len(roles) == 0 else rnd.randint(1, 3)
        rows.append((conv, turn, role, "\n".join(" ".join("".join(rnd.choices("abcdef", k=4)) for _ in range(3 if turn % len(roles) == 0 else 30)) for _ in range(size))))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [r for conv in range(60) for r in talk(rnd, conv, rnd.randint(2, 9), ("user", "assistant") if conv % 3 else ("system", "user", "assistant"))]
    return chat.learn(written(chat.transcripts(frame(spark, rows), dropped=0.3, other=0.1, wrong=0.05), "labelled"))


def score(model, lines, path, entry=None):
    """The sum that Viterbi maximises, added up along one path; None for a path that there cannot be."""
    size, total, before = len(model.roles), 0, entry
    for t, (line, state) in enumerate(zip(lines, path)):
        role, start = state % size, state < size
        shown = model.shows(*line)
        total += shown[0 if start else 1][role]
        if t == 0 and entry is None:
            if not start:
                return None
            total += model.first[role]
        elif start:
            total += model.leave[before] + max([model.any_next[before], *(s for q, s in model.into[role] if q == before)])
        elif role != before:
            return None
        else:
            total += model.stay[role]
        before = role
    return total


def test_viterbi_against_all_paths(model):
    rnd = random.Random(2)
    for _ in range(25):
        text = "\n".join(rnd.choice(["Human: hi", "AI: no", "some words", "a longer line " * 9, "User: what?", "### System", "Note: x", ""]) for _ in range(5))
        lines = model.observe(text)
        for entry in (None, 0, 1):
            best = max(s for p in product(range(2 * len(model.roles)), repeat=len(lines)) if (s := score(model, lines, p, entry)) is not None)
            assert score(model, lines, model.path(lines, entry), entry) == best


def test_blocks_against_the_whole(spark, model, monkeypatch):
    rnd = random.Random(3)
    rows = [r for conv in range(25) for r in talk(rnd, conv, rnd.randint(1, 30))]
    rows += [(None, 0, "user", f"lost {i}") for i in range(9)] + [(77, None, "user", f"no number {i}") for i in range(7)] + [(78, 5, "assistant", "the same")] * 11
    noise = {"dropped": 0.4, "other": 0.1, "wrong": 0.1}

    def parsed():
        found = written(chat.transcripts(frame(spark, rows), **noise), "transcripts")
        out = chat.rendered(chat.parse_transcripts(found, model)).orderBy("conv_id", "block").collect()
        whole: dict = {}
        for r in out:
            whole.setdefault(r["conv_id"], []).append(r["rendered"])
        return {i: "\n".join(parts) for i, parts in whole.items()}, len(out)

    monkeypatch.setattr(chat, "BLOCK", 10**6)
    expected, one_each = parsed()
    monkeypatch.setattr(chat, "BLOCK", 2)
    got, more = parsed()
    assert got == expected and one_each == len(expected) < more


def test_marked_turns_come_back(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "What is it?\nTell me."), (1, 2, "assistant", "It is this.\n\nNote: that too."), (1, 3, "user", ""), (2, 0, "user", "Hi"),
        (2, 1, "user", "Hi again"), (2, 2, "assistant", None), (3, 0, "user", "x" * 50000), (3, 600, "assistant", "late"), (None, 0, "user", "lost"), (4, 0, "user", "a"), (4, 0, "user", "a"),
    ]
    df = frame(spark, rows)
    found = written(chat.transcripts(df), "transcripts")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_transcripts(found, chat.learn(found)).collect()}
    expected: dict = {}
    for conv, _, role, text in rows:
        expected.setdefault(conv, []).append((role, text or ""))
    assert got == expected
    model = chat.learn(found.limit(0))
    assert chat.rendered(chat.parse_transcripts(chat.transcripts(df.limit(0)), model)).count() == 0
    assert chat.parse_transcripts(spark.createDataFrame([(1, 0, 1, None)], "conv_id long, block long, blocks long, text string"), model).first()["turns"] == []


def test_any_number_of_roles(spark):
    rnd, roles = random.Random(5), [f"speaker-{i} of many" for i in range(40)] + ["r" * 60]
    rows = [(i // 7, i % 7, roles[i % len(roles)], " ".join(rnd.choices(["yes", "no", "well"], k=6))) for i in range(400)]
    found = written(chat.transcripts(frame(spark, rows)), "transcripts")
    got = {r["conv_id"]: [t["role"] for t in r["turns"]] for r in chat.parse_transcripts(found, chat.learn(found)).collect()}
    expected: dict = {}
    for conv, _, role, _ in rows:
        expected.setdefault(conv, []).append(role)
    assert got == expected


def test_unmarked_turns_are_recovered(spark, model):
    """Of held-out conversations with three markers in ten left out, by lines that get their role."""
    rnd = random.Random(11)
    rows = [r for conv in range(1000, 1120) for r in talk(rnd, conv, rnd.randint(2, 9))]
    found = written(chat.transcripts(frame(spark, rows), dropped=0.3, other=0.1, wrong=0.02), "transcripts")
    assert accuracy(found, model) >= 0.95


def accuracy(found, model):
    right = total = 0
    for r in found.where("blocks = 1").collect():
        lines = model.observe(r["text"])
        truth = [t["role"] for t in r["truth"] for _ in range(t["lines"])]
        said = [model.roles[s % len(model.roles)] for s in model.path(lines)]
        right, total = right + sum(map(str.__eq__, said, truth)), total + len(truth)
    return right / total


def test_query(spark, sf_dir):
    rows = queries.op1_chat_format(spark, sf_dir).collect()
    conversations = {r["conv_id"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    assert {r["conv_id"] for r in rows} == conversations and len(rows) == len(conversations)
    found = written(chat.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"), **queries.OP1_MARKERS), "transcripts")
    held = queries.language.held_out("conv_id")
    learnt = chat.learn(found.where(~held))
    assert accuracy(found.where(held), learnt) >= 0.8
