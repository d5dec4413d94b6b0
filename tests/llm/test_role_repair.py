"""Conversation repair against every possible edit, and against a plain run over whole conversations."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import role_repair
from lumenlake.llm.role_repair import PARSER, Part, closing

LEGAL = re.compile("(s?(ua)+)?")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def every_edit(turns):
    """(cost, audit) by trying all edits of a short conversation; at most two inserts stand together."""
    choices = []
    for initial, must_go, truncated in turns:
        options = [("D", "", 3)]
        if not must_go:
            options += [("K", initial, truncated), ("R", "u", 2 + truncated), ("R", "a", 2 + truncated)]
        choices.append(options)
    inserts = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(turns) + 1):
            roles = added[0] + "".join(e[1] + more for e, more in zip(edits, added[1:]))
            if LEGAL.fullmatch(roles):
                found = (sum(e[2] for e in edits) + 2 * sum(map(len, added)),
                         "I" * len(added[0]) + "".join(e[0] + "I" * len(more) for e, more in zip(edits, added[1:])))
                best = found if best is None or found < best else best
    return best


def parsed(turns):
    part = Part(0)
    for turn in turns:
        part.read(*turn)
    found = [(cost + 2 * (len(closing(s)) - 1), part.audit(s) + "I" * (len(closing(s)) - 1)) for s, (cost, _) in part.live.items()]
    return min(found)


def test_parser_accepts_the_grammar():
    for size in range(6):
        for roles in itertools.product("sua", repeat=size):
            stack = 0
            for r in roles:
                stack = PARSER.after[stack].get(r) if stack is not None else None
            assert (stack is not None and PARSER.accepts[stack]) == bool(LEGAL.fullmatch("".join(roles)))


def test_parse_equals_every_edit():
    rng = random.Random(2)
    for _ in range(60):
        turns = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(4))]
        turns = [(i, m, t and not m) for i, m, t in turns]
        assert parsed(turns) == every_edit(turns)


def plain(rows):
    """The contract over whole conversations, on strings."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for (state, (cost, audit, text)), role in itertools.product(list(best.items()), "ua"):
                if (to := steps.get((state, role))) is not None:
                    new = (cost + 2, audit + "I", (*text, f"{names[role]}:"))
                    best[to] = min(best.get(to, new), new, key=lambda v: v[:2])
        return best

    talks = {}
    for conv, *turn in rows:
        talks.setdefault(conv, []).append(turn)
    out = collections.Counter()
    for conv, turns in talks.items():
        left = []
        for turn, role, text in turns:
            role, text = (" " if v is None else v for v in (role, text))
            kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
        left.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        counts, seen, best = [0, 0, 0], set(), {"": (0, "", ())}
        for _, role, text in left:
            shown = text.strip(BLANKS)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            new = {}
            for state, (cost, audit, kept) in inserted(best).items():
                options = [(state, "D", 3, None)]
                if fault not in (0, 1):
                    options += [(steps[state, r], "R", 2 + (fault == 2), names[r]) for r in "ua" if (state, r) in steps]
                    if (state, role[:1]) in steps:
                        options.append((steps[state, role[:1]], "K", int(fault == 2), role))
                for to, letter, more, who in options:
                    value = (cost + more, audit + letter, kept if who is None else (*kept, f"{who}:{text}"))
                    new[to] = min(new.get(to, value), value, key=lambda v: v[:2])
            best = new
        cost, audit, kept = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        dated = [t for t, *_ in left if t is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        out[conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    texts = ["Hi.", "Yes?", "no", "a b!  ", "", " \t", None, "x" * 50, "日本。", "long text. " * 2000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, rng.choice([t] * 9 + [None]), rng.choice(roles), rng.choice(texts))
            for c in [*range(50), None] for t in rng.choices(range(-2, 8), k=rng.randrange(1, 9))]
    # One conversation that every range partition cuts, and many turns that are all the same.
    rows += [(99, t, rng.choice(["user", "assistant"]), f"{rng.choice(['a', 'b.'])}{t}.") for t in range(300)]
    return rows + [(98, None, "user", "same.")] * 50


def test_equals_plain_run(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "block", "seq", "kind", "digest", "audit")})
    partitions = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in partitions}
    try:
        for k, v in partitions.items():
            spark.conf.set(k, v)
        assert collections.Counter(tuple(r) for r in role_repair.repair_damaged(df).collect()) == plain(talks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "One?"), (1, 1, "user", "Two?"), (2, 0, "system", "Be short.")]
    done = role_repair.repair(spark.createDataFrame(rows, "conv long, turn long, role string, text string"))
    turns = [tuple(r) for r in done.turns().orderBy("conv", "block", "place").select("conv", "edit", "role", "text").collect()]
    assert turns == [(1, "K", "user", "One?"), (1, "R", "assistant", "Two?")]
    assert {(r.conv, r.cost, r.audit) for r in done.sums.collect()} == {(1, 2, "KR"), (2, 3, "D")}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert role_repair.repair_damaged(empty).count() == 0
