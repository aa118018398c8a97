import random

import pytest

from marlstone.llm import linededup


def passages_left(before, after, over=50):
    """How many words of repeated runs of whole lines stay, by plain comparison: runs of more than ``over`` words that an earlier
    document had are looked for in what is left of the later one."""
    had, stay = set(), 0
    for i in sorted(before):
        lines = after[i].split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) > over:
                    stay += tuple(lines[a : b + 1]) in had
                    break
        lines = before[i].split("\n")
        had |= {tuple(lines[a : b + 1]) for a in range(len(lines)) for b in range(a, len(lines))}
    return stay


@pytest.mark.parametrize("k", range(1, 9))
def test_planted_passages_go_whole(spark, k):
    rnd = random.Random(k)
    passage = [" ".join(f"p{k}x{i}y{j}" for j in range(60 // k + 1 + i % 2)) for i in range(k)]
    docs = {}
    for i in range(24):
        own = [f"own {i} {j} " + " ".join(f"o{i}z{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 70))) for j in range(rnd.randrange(1, 6))]
        at = rnd.randrange(len(own) + 1)
        docs[i] = own[:at] + passage + own[at:], own
    given = [(i, "\n".join(text)) for i, (text, _) in docs.items()]
    got = {r["doc_id"]: r for r in linededup.without_repeats(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got[0]["text"] == given[0][1] and got[0]["removed_lines"] == 0
    for i in range(1, 24):
        assert got[i]["text"] == "\n".join(docs[i][1]) and got[i]["removed_lines"] == k
    assert passages_left(dict(given), {i: r["text"] for i, r in got.items()}) == 0


def test_a_line_stays_for_each_that_goes(spark):
    period = "\n".join(" ".join(f"w{j}" for j in range(20)) + f" line {i % 3}" for i in range(40))
    one = " ".join(f"v{j}" for j in range(51))
    given = [(1, period), (2, one), (3, one), (4, f"head\n{one}\ntail"), (5, " ".join(f"u{j}" for j in range(50))), (6, " ".join(f"u{j}" for j in range(50)))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs).collect()}
    assert {x for t in got.values() for x in t.split("\n") if x} == {x for _, t in given for x in t.split("\n")}
    assert (got[2], got[3], got[4]) == (one, "", "head\ntail") and got[5] == got[6] != ""
    rows = {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs, copies=False).collect()}
    assert (rows[2], rows[3], rows[4]) == (one, one, "head\ntail")
