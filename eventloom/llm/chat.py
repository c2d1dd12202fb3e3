"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

A state is a role and whether the line starts a turn.  A line shows a speaker marker (of some role, or none) and
features of its text (length, question mark, first letter).  What roles follow each other, how long turns are, what markers
their lines show (missing, wrong or stray ones too) and what the lines look like is counted over labelled transcripts.  Viterbi finds the best
states of a transcript, so that an unmarked or wrongly marked line gets the role that fits its neighbours.

A long conversation is stored in blocks of ``BLOCK`` turns.  The best path through all of them is exact: for each block
the best scores from every role before it to every state at its end are found on their own (all entries soon share one path, from
where on they are carried as one), the blocks' scores are combined in order, and each block is read again between the
states that the whole path has at its ends.  Scores are integers, so that both readings agree.

Defined results: a transcript without text has no turns; a turn with a null role is written without a marker, and gets a
role from the model; a null turn text is empty; turns are ordered by number (null first), those with equal numbers by role and a hash of their
text; rows with a null conversation id are one conversation; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from ast import literal_eval
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._base import worker_state, written

#: Turns of a conversation that are kept in one row.
BLOCK = 512
#: Scores are logarithms in units of one part in so many.
UNIT = 1 << 20
NEVER = -(1 << 56)
KINDS = 16
#: What all roles show counts as much as so many lines of each single one, so that rare roles are read sensibly.
POOLED = 4

# Names that speakers go by in transcripts.
NAMES = {
    "user": ("user", "human", "question", "q", "you", "customer", "prompter"),
    "assistant": ("assistant", "ai", "answer", "a", "bot", "model", "agent", "chatgpt", "gpt"),
    "system": ("system", "instructions", "context"),
}
#: Styles of markers that :func:`transcripts` writes: {0} is the speaker's name.
STYLES = ("{0}: ", "[{0}] ", "### {0}\n", "<{0}> ")

_NAME = r"([^\s:\[\]<>|*#][^:\[\]<>|*#]*?)"
_MARKER = re.compile(rf"\s*(?:#{{1,6}}\s*{_NAME}:?\s*$|\[{_NAME}\]:?\s?|<\|?{_NAME}\|?>:?\s?|\*{{0,2}}{_NAME}\*{{0,2}}\s?:\s?)")


def marker(line: str, names: dict[str, str]) -> tuple[str | None, str]:
    """The role that a line's marker names (or None), and the line without it."""
    m = _MARKER.match(line)
    role = names.get(next(g for g in m.groups() if g).lower()) if m else None
    return (role, line[m.end() :]) if role else (None, line)


def names_of(roles: list[str]) -> dict[str, str]:
    """Names that markers may give, in lower case, and the role that each means."""
    return {n: r for r in sorted(roles) for n in NAMES.get(r, ())} | {r.lower(): r for r in sorted(roles)}


def feature(line: str) -> int:
    """One of ``KINDS`` classes: length (4), question mark, capital."""
    bare = line.strip()
    size = 0 if len(bare) < 20 else 1 if len(bare) < 80 else 2 if len(bare) < 240 else 3
    return size * 4 + 2 * bare.endswith("?") + bare[:1].isupper()


def _score(p: float) -> int:
    return round(math.log(p) * UNIT)


class ChatModel:
    """Scores of role successions, turn lengths, markers and line features.

    ``counts`` holds how often: ``("first", role)``; ``("next", role, role)``; ``("line", role, start)`` with features as
    ``("kind", role, start, kind)`` and markers as ``("seen", role, start, role or "")``.  There is no limit on roles; only counted
    pairs of them cost time, all others share one score.
    """

    def __init__(self, roles: list[str], counts: dict[tuple, int]):
        self.roles = sorted(roles) or ["user"]
        self.names = names_of(self.roles)
        size = len(self.roles)
        place = {r: i for i, r in enumerate(self.roles)}
        by_key: dict[tuple, dict] = {}
        for k, n in counts.items():
            by_key.setdefault(k[:-1], {})[k[-1]] = n
        own = by_key.get(("first",), {})
        self.first = [_score((own.get(r, 0) + 0.5) / (sum(own.values()) + 0.5 * size)) for r in self.roles]
        self.into: list[list[tuple[int, int]]] = [[] for _ in self.roles]  # counted predecessors of each role
        self.any_next = []
        for i, r in enumerate(self.roles):
            after = by_key.get(("next", r), {})
            total = sum(after.values()) + 0.5 * size
            self.any_next.append(_score(0.5 / total))
            for other, n in after.items():
                self.into[place[other]].append((i, _score((n + 0.5) / total)))
        # what a role shows: its own counts, and as many as POOLED lines of all roles together
        lines = {s: [counts.get(("line", r, s), 0) for r in self.roles] for s in (True, False)}
        shares = [sum(lines[s]) + 1 for s in (False, True)]
        stays = [(no + POOLED * shares[0] / sum(shares)) / (no + yes + POOLED) for no, yes in zip(lines[False], lines[True])]
        self.stay, self.leave = ([_score(p) for p in ps] for ps in (stays, [1 - p for p in stays]))
        self.shown: list[list[list[int]]] = [[] for _ in self.roles]
        self.marked: list[list[tuple[dict, int]]] = [[] for _ in self.roles]
        for start in (True, False):
            kinds = [by_key.get(("kind", r, start), {}) for r in self.roles]
            every = [sum(k.get(c, 0) for k in kinds) + 0.5 for c in range(KINDS)]
            seen = [by_key.get(("seen", r, start), {}) for r in self.roles]
            mine = sum(k.get(r, 0) for r, k in zip(self.roles, seen)) + 0.5
            none = sum(k.get("", 0) for k in seen) + 0.5
            other = sum(map(sum, map(dict.values, seen))) + 1 - mine - none + 0.5
            pooled = {True: mine / (mine + none + other), None: none / (mine + none + other), False: other / (mine + none + other) / max(1, size - 1)}
            for i, r in enumerate(self.roles):
                total = lines[start][i] + POOLED
                self.shown[i].append([_score((kinds[i].get(c, 0) + POOLED * every[c] / sum(every)) / total) for c in range(KINDS)])
                share = lambda x, n: _score((n + POOLED * pooled[True if x == r else None if x == "" else False]) / total)  # noqa: B023, E731
                self.marked[i].append(({x: share(x, n) for x, n in ({r: 0, "": 0} | seen[i]).items()}, share(False, 0)))

    # -- the chain: states 0 to R - 1 start a turn of that role, states R to 2R - 1 continue one --

    def observe(self, text: str) -> list[tuple[str | None, str, str]]:
        """Marker's role, line without the marker, and line, of each line."""
        return [(*marker(line, self.names), line) for line in text.split("\n")]

    def shows(self, role: str | None, rest: str, line: str) -> tuple[list[int], list[int]]:
        """Scores of what a line shows, by role: as a start, and as a continuation."""
        seen, kind, whole = role or "", feature(rest), feature(line)
        return (
            [k[0][kind] + m[0][0].get(seen, m[0][1]) for k, m in zip(self.shown, self.marked)],
            [k[1][whole] + m[1][0].get(seen, m[1][1]) for k, m in zip(self.shown, self.marked)],
        )

    def begin(self, shown: tuple[list[int], list[int]]) -> list[int]:
        """Scores of the states of a conversation's first line."""
        return [f + s for f, s in zip(self.first, shown[0])] + [NEVER] * len(self.roles)

    def step(self, value: list[int], shown: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """Scores of the states one line later, and the state before each."""
        size = len(self.roles)
        best = [(value[r], r) if value[r] > value[size + r] else (value[size + r], size + r) for r in range(size)]
        leaving = [b[0] + out for b, out in zip(best, self.leave)]
        common = max(range(size), key=lambda q: leaving[q] + self.any_next[q])
        most = leaving[common] + self.any_next[common]
        now, back = [], []
        for r, into in enumerate(self.into):
            top, before = most, common
            for q, score in into:
                if leaving[q] + score > top:
                    top, before = leaving[q] + score, q
            now.append(top + shown[0][r])
            back.append(best[before][1])
        for r in range(size):
            now.append(best[r][0] + self.stay[r] + shown[1][r])
            back.append(best[r][1])
        return now, back

    def enter(self, role: int) -> list[int]:
        """Scores of the states before a block, if the line before it belongs to a role."""
        return [0 if s == role else NEVER for s in range(2 * len(self.roles))]

    def path(self, lines: list[tuple], entry: int | None = None, end: int | None = None) -> list[int]:
        """Best states of the lines, after a role and up to a state at the end if they are given."""
        value, backs = [], []
        for t, line in enumerate(lines):
            shown = self.shows(*line)
            if t == 0 and entry is None:
                value = self.begin(shown)
                backs.append([])
            else:
                value, back = self.step(self.enter(entry) if t == 0 else value, shown)
                backs.append(back)
        state = max(range(len(value)), key=value.__getitem__) if end is None else end
        states = [state]
        for back in reversed(backs[1:]):
            state = back[state]
            states.append(state)
        return states[::-1]

    def across(self, lines: list[tuple], first: bool) -> tuple[list[int], list[list[int]]]:
        """Best scores through a block: one added number for each role before it, and scores of the states at its end.

        The scores are one list if those of all roles differ by the added numbers only, and a list for each role otherwise.
        """
        rows: list[list[int]] = []
        added = [0] * (1 if first else len(self.roles))
        for t, line in enumerate(lines):
            shown = self.shows(*line)
            if t == 0:
                rows = [self.begin(shown)] if first else [self.step(self.enter(r), shown)[0] for r in range(len(self.roles))]
                continue
            rows = [self.step(row, shown)[0] for row in rows]
            if len(rows) > 1 and all(row[i] - row[0] == rows[0][i] - rows[0][0] for row in rows for i in range(len(row))):
                added = [row[0] - rows[0][0] for row in rows]
                rows = rows[:1]
        return added, rows

    def turns(self, lines: list[tuple], states: list[int]) -> list[tuple[str, str, bool]]:
        """Turns ``(role, text, continued)``; the first one may continue the block before."""
        size, found = len(self.roles), []
        for state, (role, rest, line) in zip(states, lines):
            if state < size:
                heading = role is not None and not rest and line.lstrip().startswith("#")
                found.append((self.roles[state], [] if heading else [rest], False))
            elif found:
                found[-1][1].append(line)
            else:
                found.append((self.roles[state - size], [line], True))
        return [(role, "\n".join(rows), continued) for role, rows, continued in found]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """Turns ``(role, text)`` of a whole transcript."""
        lines = self.observe(text) if text else []
        return [(role, part) for role, part, _ in self.turns(lines, self.path(lines))] if lines else []


def learn(labelled: DataFrame) -> ChatModel:
    """Count over transcripts with their ``truth`` (see :func:`transcripts`); the driver gets counts of roles and pairs of roles only."""
    roles = [r[0] for r in labelled.select(F.explode("truth.role").alias("role")).where("role is not null").distinct().collect()]
    names = names_of(roles)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, truth, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, at, before = (text or "").split("\n"), 0, None
                for n, turn in enumerate(truth):
                    role = turn["role"]
                    if role is not None:
                        if n == 0 and block == 0:
                            counts["first", role] += 1
                        elif before is not None:
                            counts["next", before, role] += 1
                        for i, line in enumerate(lines[at : at + turn["lines"]]):
                            seen, rest = marker(line, names)
                            counts["line", role, i == 0] += 1
                            counts["kind", role, i == 0, feature(line if i else rest)] += 1
                            counts["seen", role, i == 0, seen or ""] += 1
                    at, before = at + turn["lines"], role
        rows = [repr(k) for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(list(counts.values()), pa.int64())], ["cell", "n"])

    counted = labelled.select("text", "truth", "block").mapInArrow(run, "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return ChatModel(roles, {literal_eval(r["cell"]): r["n"] for r in counted.collect()})


def _ordered(conversations: DataFrame, dropped: float, other: float, wrong: float) -> DataFrame:
    """``conv_id, turn, role, tie, line``: each turn as it is written."""
    draw = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(1_000_000)) / 1_000_000
    style = F.pmod(F.xxhash64("conv_id") + F.when(draw < dropped + other, F.lit(1)).otherwise(F.lit(0)), F.lit(len(STYLES))).cast("int")
    head = F.element_at(F.array(*(F.lit(s.split("{0}")[0]) for s in STYLES)), style + 1)
    tail = F.element_at(F.array(*(F.lit(s.split("{0}")[1]) for s in STYLES)), style + 1)
    alias = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(F.initcap("role"))
    plain = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(2)) == 0
    name = F.when(plain != (draw < dropped + other), F.initcap("role")).otherwise(alias)
    name = F.when((draw >= dropped + other) & (draw < dropped + other + wrong), F.when(F.col("role") == "user", "Assistant").otherwise("User")).otherwise(name)
    bare = F.col("role").isNull() | (draw < dropped)
    line = F.concat(F.when(bare, "").otherwise(F.concat(head, name, tail)), F.coalesce("text", F.lit("")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.xxhash64("text").alias("tie"), line.alias("line"))


def transcripts(conversations: DataFrame, dropped: float = 0.0, other: float = 0.0, wrong: float = 0.0) -> DataFrame:
    """``conv_id, block, blocks, text, truth``: turns written one after another under speaker markers, in blocks of ``BLOCK`` turns.

    The style of the markers varies by conversation.  Shares of them, chosen by a hash, are left out (``dropped``), written
    in another style under another name (``other``), or name a wrong role (``wrong``).  ``truth`` has each turn's role and number of lines.

    Only conversations of more than ``BLOCK`` turns are sorted, by ranges, so that many tasks share one.
    """
    rows = _ordered(conversations, dropped, other, wrong)
    long = written(conversations.groupBy(F.col("conv_id").cast("long").alias("l_id")).count().where(F.col("count") > BLOCK).select("l_id"), "long")
    same = F.col("conv_id").eqNullSafe(F.col("l_id"))
    turn = lambda t: F.struct(t["role"].alias("role"), F.size(F.split(t["line"], "\n")).alias("lines"))

    def joined(groups: DataFrame) -> DataFrame:
        return groups.select("conv_id", "block", "blocks", F.array_join(F.transform("t", lambda t: t["line"]), "\n").alias("text"), F.transform("t", turn).alias("truth"))

    short = rows.join(long, same, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "line"))).alias("t"))
    short = joined(short.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), "t"))
    if long.isEmpty():
        return short
    order = ["conv_id", "turn", "role", "tie", "salt"]  # the salt deals out rows that are alike in all
    parted = rows.join(long, same, "left_semi").withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    parted = written(parted.select("conv_id", "role", "line", F.monotonically_increasing_id().alias("at")), "sorted")
    part = F.shiftright("at", 33).alias("part")
    parts = parted.groupBy("conv_id", part).agg(F.min("at").alias("least"), F.count("*").alias("n"))  # a few for each task
    by = Window.partitionBy("conv_id")
    parts = parts.select(
        F.col("conv_id").alias("p_id"), F.col("part").alias("p_part"), F.sum("n").over(by.orderBy("part")).alias("upto"), "n", "least", F.sum("n").over(by).alias("total")
    )
    placed = parted.join(parts, F.col("conv_id").eqNullSafe(F.col("p_id")) & (F.shiftright("at", 33) == F.col("p_part")))
    place = F.col("upto") - F.col("n") + F.col("at") - F.col("least")
    blocks = placed.groupBy("conv_id", F.floor(place / BLOCK).alias("block"), F.ceil(F.col("total") / BLOCK).alias("blocks"))
    return short.union(joined(blocks.agg(F.array_sort(F.collect_list(F.struct("at", "role", "line"))).alias("t"))))


_PATH = "p_id long, p_block long, entry int, exit int"
TURNS = "conv_id long, block long, blocks long, turns array<struct<role:string,text:string,continued:boolean>>"


def _ends(found: DataFrame, shared, key: str) -> DataFrame:
    """``p_id, p_block, entry, exit`` of each block of conversations of several blocks: role before it, state at its end, on the best path."""

    def scores(batches):
        model = worker_state(("chat", key), lambda: shared.value)
        for batch in batches:
            out = [model.across(model.observe(text or ""), block == 0) for block, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.list_(pa.int64())), pa.array([r for _, r in out], pa.list_(pa.list_(pa.int64())))],
                ["conv_id", "block", "added", "rows"],
            )

    def combine(batches):
        size = len(shared.value.roles)

        def ends(conv_id, value, backs):
            """Walk back from the best last state; ``backs`` holds the role before each block by the state at its end."""
            state, out = max(range(2 * size), key=value.__getitem__), []
            for block in range(len(backs) - 1, -1, -1):
                entry = backs[block][state] if block else None
                out.append((conv_id, block, entry, state))
                # the state before the block is the better one of its role's two
                state = None if entry is None else (entry if values[block - 1][entry] > values[block - 1][size + entry] else size + entry)
            return out

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["p_id", "p_block", "entry", "exit"])

        current, value, backs, values = object(), [], [], []
        for batch in batches:
            for conv_id, block, added, rows in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block == 0:
                    if backs:
                        yield batch_of(ends(current, value, backs))
                    current, value, backs, values = conv_id, rows[0], [[]], [rows[0]]
                    continue
                best = [max(value[r], value[size + r]) for r in range(size)]
                reach = [max((best[r] + added[r] + rows[min(r, len(rows) - 1)][s], -r) for r in range(size)) for s in range(2 * size)]
                value = [v for v, _ in reach]
                backs.append([-r for _, r in reach])
                values.append(value)
        if backs:
            yield batch_of(ends(current, value, backs))

    several = found.where("blocks > 1").select("conv_id", "block", "text").mapInArrow(scores, "conv_id long, block long, added array<long>, rows array<array<long>>")
    return several.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(combine, _PATH)


def parse_transcripts(found: DataFrame, model: ChatModel) -> DataFrame:
    """``conv_id, block, blocks, turns`` of each row ``conv_id, block, blocks, text``; ``found`` is read twice where ``blocks`` exceeds 1.

    A turn that goes on in the next block is ``continued`` there.  The task that combines the blocks of one conversation holds
    a few numbers a block.
    """
    shared, key = found.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # counted pairs of roles
    found = found.selectExpr("cast(conv_id as bigint) conv_id", "cast(block as bigint) block", "cast(blocks as bigint) blocks", "text")
    whole = found.where("not blocks > 1").selectExpr("*", "cast(null as int) entry", "cast(null as int) exit")
    ends = _ends(found, shared, key)
    parts = found.where("blocks > 1").join(ends, F.col("conv_id").eqNullSafe(F.col("p_id")) & (F.col("block") == F.col("p_block"))).drop("p_id", "p_block")

    def run(batches):
        model = worker_state(("chat", key), lambda: shared.value)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("continued", pa.bool_())]))
        for batch in batches:
            out = []
            for text, entry, end, blocks in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 2))):
                lines = model.observe(text) if text or blocks > 1 else []
                out.append([{"role": r, "text": t, "continued": c} for r, t, c in model.turns(lines, model.path(lines, entry, end))] if lines else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], ["conv_id", "block", "blocks", "turns"])

    return whole.union(parts.select(*whole.columns)).mapInArrow(run, TURNS)


def rendered(parsed: DataFrame) -> DataFrame:
    """With ``rendered``: the turns in canonical form; the blocks of a conversation, joined by line ends, are the whole."""
    close = F.lit("<|end|>")
    turn = lambda t: F.when(t["continued"], t["text"]).otherwise(F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"]))
    piece = lambda t, i: F.when(t["continued"] | ((i == 0) & (F.col("block") == 0)), turn(t)).otherwise(F.concat(close, F.lit("\n"), turn(t)))
    text = F.array_join(F.transform("turns", piece), "\n")
    last = (F.col("block") == F.col("blocks") - 1) & (F.size("turns") > 0)
    return parsed.withColumn("rendered", F.when(last, F.concat(text, F.lit("\n"), close)).otherwise(text))
