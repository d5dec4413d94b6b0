"""The template tree against a plain run of its rules, and its thresholds on literal lines."""

import collections
import random
import re

from lumenlake.llm import line_templates
from lumenlake.llm.line_templates import AGREE, FRAGMENT, LEADING, MAIL, MIN_TEXTS, MIN_TOKENS, NUMBER, URL


def shape(line):
    for form in (URL, MAIL, NUMBER):
        line = re.sub(form, "<*>", line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def join_most_common(texts, key):
    """Each wording that agrees with the most common one of its key, with that one."""
    groups = collections.defaultdict(list)
    for wording in texts:
        groups[key(wording.split(" "))].append(wording)
    moved = {}
    for group in groups.values():
        top = max(group, key=lambda w: (len(texts[w]), w.encode()))
        for w in group:
            a, b = w.split(" "), top.split(" ")
            if w != top and (sum(map(str.__eq__, a, b)) - LEADING) * 10 >= (len(a) - LEADING) * AGREE:
                moved[w] = top
    return moved


def plain(rows):
    texts = collections.defaultdict(set)
    for _, text in rows:
        for line in (text or "").split("\n"):
            if shape(line):
                texts[shape(line)].add(text)
    near = join_most_common(texts, lambda t: (len(t), *t[:LEADING], "|", t[-1]))
    wide = join_most_common({w: s for w, s in texts.items() if w not in near}, lambda t: (len(t), *t[:LEADING]))
    top = {w: wide.get(near.get(w, w), near.get(w, w)) for w in texts}
    held, first = collections.defaultdict(set), {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if shape(line):
                t = top[shape(line)]
                held[t].add(text)
                first[t] = min(first.get(t, i), i)

    def gone(i, line):
        t = top.get(shape(line))
        if t is None or first[t] == i:
            return False
        n, k = len(held[t]), len(t.split(" "))
        return (n >= MIN_TEXTS and k > FRAGMENT) or (n >= 2 and n * k >= MIN_TOKENS)

    return {i: "\n".join(line for line in (text or "").split("\n") if not gone(i, line)) for i, text in rows}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring(df).collect()}


def test_equals_plain_run(spark):
    rng = random.Random(1)
    models = [[rng.choice("abcd") + str.upper(rng.choice("xyz")) for _ in range(rng.choice([1, 3, 8, 14, 30, 60]))] for _ in range(14)]
    models += [models[i][:LEADING] + list(reversed(models[i][LEADING:])) for i in range(6)]

    def line():
        words = list(rng.choice(models))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(["this", "that", "12:30", "a@b.c", "é"])
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(5)))) for i in range(90)] + [(90, None), (91, ""), (92, " \n\t")]
    want = plain(rows)
    assert found(spark, rows) == want
    assert 0 < sum(len(t) for t in want.values()) < sum(len(t or "") for _, t in rows)


def test_fields_and_thresholds(spark):
    # A word that varies is a field.
    names = "Ann Bob Cy Dee Eve Flo Gus Hal Ida Jo Kim Lou".split()
    rows = [(i, f"kept {chr(97 + i)}\nPosted last night by the user {n} in the open forum") for i, n in enumerate(names)]
    want = dict(rows[:1]) | {i: f"kept {chr(97 + i)}" for i in range(1, 12)}
    # Unlike lines of one node stay apart.
    unlike = [(100 + i, "Written last night " + " ".join(f"w{chr(97 + i)}{j}x" for j in "abcdefgh")) for i in range(12)]
    # Nine texts are too few for a line of 11 tokens, two are enough for one of 51.
    few = [(200 + i, f"mine {chr(97 + i)}\nSent last week by the user {n} in the open forum") for i, n in enumerate(names[:9])]
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(51))
    long = [(301, f"one\n{passage}"), (302, "two\n" + passage.replace("wordkb ", "other ")), (303, passage[:300] + "\nfour")]
    # A fragment needs a hundred texts; a text with many lines of one template counts once.
    short = [(400 + i, f"{'And.' if i < 99 else 'x'}\nown {chr(97 + i % 26)}{chr(97 + i // 26)}\nThe.") for i in range(100)]
    once = [(600, "\n".join(f"A list of things: item {c} costs more than a book" for c in "abcdefghijklmnop"))]
    want |= dict(unlike) | dict(few) | dict(long) | {302: "two"} | dict(once)
    want |= {i: t if i == 400 else t[:-5] for i, t in short}
    assert found(spark, [*rows, *unlike, *few, *long, *short, *once]) == want
