import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quote_links
from ledgerlens.llm.quote_links import reply_ordered

MARKS = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?")


def level(line):
    m = MARKS.match(line)
    return m[1].count(">") if m else 0


def norm(line):
    return re.sub(r"[\s\xa0]+", " ", MARKS.sub("", line).lower()).strip(" ")


def lines_of(text):
    return re.split(r"\r?\n", text or "")


def brute(messages):
    """Rows by conversation in reply order, from (turn, role, text) lists."""
    messages = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2] or ""))
    parents, info = [], []
    own = [{norm(x) for x in lines_of(t) if level(x) == 0 and norm(x)} for _, _, t in messages]
    for r, (_, _, text) in enumerate(messages):
        passages, last = [], 0
        for x in lines_of(text):
            if level(x) and level(x) == last:
                passages[-1][1].append(norm(x))
            elif level(x):
                passages.append((level(x), [norm(x)]))
            last = level(x)
        found = []
        for n, (lev, quoted) in enumerate(passages):
            votes = {}
            for q in quoted:
                earlier = [e for e in range(r) if q and q in own[e]]
                if earlier:
                    votes[earlier[-1]] = votes.get(earlier[-1], 0) + 1
            if votes:
                found.append((lev, n, max(votes, key=lambda e: (votes[e], e))))
        parents.append(min(found)[2] if found else r - 1 if r else None)
        info.append((len(passages), len(found), max((p[0] for p in passages), default=0)))
    chain = [r if r == 0 or parents[r] != r - 1 else None for r in range(len(messages))]
    for r in range(len(messages)):
        chain[r] = chain[r - 1] if chain[r] is None else chain[r]
    out = []

    def visit(c, depth):
        members = [r for r in range(len(messages)) if chain[r] == c]
        out.extend((r, depth) for r in members)
        branches = [b for b in sorted(set(chain)) if b != 0 and chain[parents[b]] == c]
        for b in sorted(branches, key=lambda b: (-parents[b], b)):
            visit(b, depth + 1)
    if messages:
        visit(0, 0)
    result = []
    for place, (r, depth) in enumerate(out):
        kept = "\n".join(x for x in lines_of(messages[r][2]) if level(x) == 0)
        kept = re.sub(r"(?:\n[ \t]*)+\Z", "", re.sub(r"\A(?:[ \t]*\n)+", "", kept))
        result.append((messages[r][0], messages[r][1], kept, messages[parents[r]][0] if parents[r] is not None else None,
                       place, depth, *info[r]))
    return result


COLUMNS = ("turn", "role", "content", "reply_to", "position", "depth", "n_passages", "n_linked", "max_level")


def run(spark, conversations):
    rows = [(c, *m) for c, ms in conversations.items() for m in ms]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("r", F.lit(1)).withColumn(
        "chain", F.lit(2))
    got = {}
    for r in reply_ordered(df).collect():
        got.setdefault(r["conv_id"], []).append(tuple(r[c] for c in COLUMNS))
    return {c: sorted(x, key=lambda row: row[4]) for c, x in got.items()}


def thread(rng, n):
    """Messages of a few lines that quote earlier ones in part, some nested."""
    texts = []
    for i in range(n):
        body = [f"Line {rng.randrange(12)} of {rng.randrange(4)}" for _ in range(rng.randrange(3))]
        quoted = []
        if texts and rng.random() < 0.6:
            for x in lines_of(rng.choice(texts)):
                if rng.random() < 0.7:
                    quoted.append(rng.choice(["> ", ">", " > "]) + rng.choice([x, x.upper(), x.replace(" ", "  ")]))
            quoted = quoted[:4]
        texts.append("\n".join(rng.choice([quoted + body, body + quoted, quoted + [""] + body])))
    return [(i, rng.choice(["user", "assistant"]), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(quote_links, "BLOCK", block)
    rng = random.Random(7)
    conversations = {i: thread(rng, rng.randrange(1, 14)) for i in range(12)}
    got = run(spark, conversations)
    for c, messages in conversations.items():
        assert got[c] == brute(messages), c
    assert any(row[5] > 1 for rows in got.values() for row in rows)


def test_odd_rows(spark):
    conversations = {
        1: [(0, "u", None), (1, "a", ""), (2, "u", "> \n>>"), (3, "a", "> only quotes")],
        2: [(None, "u", "first"), (5, "a", "> first\nyes"), (5, "a", "> later\nno"), (9, "u", "later")],
        None: [(1, "u", "x\r\ny"), (2, "a", "> X\r\n> y\r\nz")],
    }
    got = run(spark, conversations)
    for c, messages in conversations.items():
        assert got[c] == brute(messages), c


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "u", "hello"), (1, 1, "a", "> hello\nhi"), (1, 1, "a", "> hello\nhi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["position"], r["content"], r["n_linked"]) for r in reply_ordered(df).collect())
    assert [g[0] for g in got] == [0, 1, 2] and sorted(g[1] for g in got) == ["hello", "hi", "hi"]
    assert reply_ordered(df.where("false")).count() == 0


def test_conversations_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    conversations = {}
    for r in table.collect():
        conversations.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = run(spark, conversations)
    assert {c: brute(m) for c, m in conversations.items()} == got


def most_lines(messages):
    """Turn of the source of every message's first passage (None: none), with
    the votes of all earlier messages."""
    own = [{norm(x) for x in lines_of(t) if level(x) == 0 and norm(x)} for _, _, t in messages]
    out = []
    for r, (_, _, text) in enumerate(messages):
        quoted = [norm(x) for x in lines_of(text) if level(x)]
        votes = [(sum(q in own[e] for q in quoted), e) for e in range(r)]
        out.append(max(votes)[1] if votes and max(votes)[0] else None)
    return out


def test_whole_passage_beats_later_lines(spark):
    messages = [(0, "u", "Hi\nthe plan is X\nregards"), (1, "a", "ok"), (2, "u", "Hi\nsomething else\nregards"),
                (3, "a", "> Hi\n> the plan is X\n> regards\nyes")]
    got = run(spark, {1: messages})[1]
    assert [(row[0], row[3], row[5]) for row in got] == [(0, None, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1)]


@pytest.mark.parametrize("common", [0, 2, 32])
@pytest.mark.parametrize("block", [4096, 3])
def test_every_earlier_message_votes(spark, common, block, monkeypatch):
    monkeypatch.setattr(quote_links, "COMMON", common)
    monkeypatch.setattr(quote_links, "BLOCK", block)
    rng = random.Random(3)
    conversations = {}
    for c in [*range(6), None]:
        texts = []
        for i in range(24):
            body = rng.sample(["hi", "regards", "thanks", "code", *(f"line {n}" for n in range(10))], rng.randrange(1, 6))
            quoted = ["> " + x for x in rng.choice(texts) if x[0] != ">" and rng.random() < 0.9] if texts and i % 3 else []
            texts.append(quoted + body)
        conversations[c] = [(i, "u", "\n".join(t)) for i, t in enumerate(texts)]
    got = run(spark, conversations)
    for c, messages in conversations.items():
        want = most_lines(messages)
        want = [(i, s if s is not None else i - 1 if i else None) for i, s in enumerate(want)]
        assert sorted((row[0], row[3]) for row in got[c]) == want, c
