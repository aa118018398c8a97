import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from marlstone.llm import lm


def side(i):
    return crc32(str(i).encode()) % 7


def bucket(c):
    return min(25, 1 + int(math.log2(c))) if c > 0 else 0


def coarse(p):
    """Learning sees probabilities in eighths of a power of two."""
    return 2.0 ** (-min(254, round(-math.log2(max(p, 1e-300)) * 8)) / 8) if p > 0 else 0.0


def plain_scores(docs):
    """Deleted interpolation with dictionaries of tuples, token by token."""
    texts = {i: ["<"] + t.lower().split() + [">"] for i, t in docs}
    c1, c2, c3 = Counter(), Counter(), Counter()
    n_docs = 0
    for i, t in texts.items():
        if side(i) != 2:
            n_docs += 1
            c1.update(t[1:])
            c2.update(zip(t, t[1:]))
            c3.update((*(t[max(0, k - 2) : k]), t[k]) if k > 1 else ("<", "<", t[k]) for k in range(1, len(t)))
    c1["<"] = n_docs
    n, v = sum(c1.values()) - n_docs, len(c1) - 1

    def parts(t, less):
        for k in range(1, len(t)):
            before = ("<", "<") if k == 1 else (t[k - 2], t[k - 1])
            pair = n_docs if k == 1 else c2[before]
            yield c3[(*before, t[k])] - less, pair - less, c2[t[k - 1], t[k]] - less, c1[t[k - 1]] - less, c1[t[k]] - less

    fold = [p for i, t in texts.items() if side(i) == 3 for p in parts(t, 1)]
    lam = [[0.0, 0.9, 0.1]] + [[1 / 3] * 3 for _ in range(25)]
    seen = {bucket(p[3]) for p in fold}
    for _ in range(60):
        sums = [[0.0] * 3 for _ in range(26)]
        for _, _, two, context, word in fold:
            b = bucket(context)
            own = [lam[b][0] * coarse(two / context if context else 0), lam[b][1] * coarse(word / (n - 1)), lam[b][2] / (v + 1)]
            for k in range(3):
                sums[b][k] += own[k] / sum(own)
        for b in seen:
            total = sum(sums[b]) + 0.02
            lam[b] = [sums[b][0] / total, (sums[b][1] + 0.01) / total, (sums[b][2] + 0.01) / total]
    for b in range(2, 26):
        if b not in seen and any(k < b for k in seen):
            lam[b] = lam[b - 1]

    def shorter(two, context, word, n):
        a, b, c = lam[bucket(context)]
        return a * two / max(context, 1) + b * word / n + c / (v + 1)

    three_of = [0.0] + [0.5] * 25
    learned = [(bucket(p[1]), coarse(p[0] / p[1] if p[1] else 0), coarse(shorter(p[2], p[3], p[4], n - 1))) for p in fold]
    for _ in range(60):
        share, total = [0.0] * 26, [0] * 26
        for b, p3, p2 in learned:
            share[b] += three_of[b] * p3 / (three_of[b] * p3 + (1 - three_of[b]) * p2)
            total[b] += 1
        three_of = [share[b] / (total[b] + 0.02) if total[b] else three_of[b] for b in range(26)]
    for b in range(2, 26):
        if not total[b]:
            three_of[b] = three_of[b - 1]

    def score(t):
        out = 0.0
        for three, pair, two, context, word in parts(t, 0):
            a = three_of[bucket(pair)]
            out += math.log10(a * three / max(pair, 1) + (1 - a) * shorter(two, context, word, n))
        return out

    return {i: score(t) for i, t in texts.items()}


def written(count, seed):
    """Texts whose words depend on the two before."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    follow = {}
    docs = []
    for i in range(count):
        text = [rnd.choice(words), rnd.choice(words)]
        for _ in range(rnd.randrange(60)):
            known = follow.setdefault(tuple(text[-2:]), rnd.sample(words, 2))
            text.append(rnd.choice(known) if rnd.random() < 0.8 else rnd.choice(words))
        docs.append((i, " ".join(text)))
    return docs


def test_scores_equal_a_plain_mixture(spark, monkeypatch):
    docs = written(140, 5) + [(900, ""), (901, "only"), (902, "never seen before at all")]
    want = plain_scores(docs)
    monkeypatch.setattr(lm, "RANGE", 1500)
    got = {r["id"]: r["score"] for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-6)


def test_sorted_hashes_come_back_whole():
    rnd = np.random.default_rng(3)
    for keys in (rnd.integers(0, 1 << 63, 5000, np.uint64), rnd.integers(0, 1 << 43, 5000, np.uint64), np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        keys = np.unique(keys)
        assert (lm.untight(lm.tight(keys)) == keys).all()


def test_shared_hashes_count_no_more_than_shorter_ngrams():
    own = lm.Counted([1, 3], ["a b c a b", "b c d"], 64)
    exact = [c.astype(np.int64) for c in own.counts]
    n_docs = int(sum(side(i) != 2 for i in (1, 3)))
    want = own.parts(exact, n_docs)
    three, pair, two, context, word = own.parts([exact[0], exact[1] + 50, exact[2] + 50], n_docs)
    assert (three <= np.minimum(pair, two)).all() and (two <= np.minimum(context, word)).all()
    assert all((a == b).all() for a, b in zip(own.parts([exact[0], exact[1], exact[2] + 50], n_docs)[1:], want[1:], strict=True))
    assert (want[0] == exact[2][own.of[2]]).all() and (want[2] == exact[1][own.of[1]]).all()
