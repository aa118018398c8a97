import random
from functools import reduce
from operator import or_

import xxhash

from marlstone.llm import simhash
from tests.llm.brute import groups


def plain(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}É" for i in range(300)] + ["Ünd", "a b", "X"]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  Words\x0b", "three little words", "x " * 3000]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append(" ".join(near))
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus()
    prints = [plain(t, 4) for _, t in rows]
    for distance in (4,):
        want = groups([i for i, _ in rows], lambda i, j: bin((prints[i] ^ prints[j]) % (1 << 64)).count("1") <= distance)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, node int")
        got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, shingle=4, distance=distance).collect()}
        assert got == {i: (p, c) for (i, _), p, c in zip(rows, prints, want, strict=True)}


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (None, None)], schema)).collect()
    assert sorted(((r["id"], r["component_id"]) for r in got), key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_partitions_cover_all_bits_and_thresholds_add_up(spark):
    prints = spark.createDataFrame([(plain(t, 4), 1) for _, t in corpus(8)], "fingerprint long, n long").dropDuplicates(["fingerprint"])
    parts = simhash.plan(prints, 4)
    assert sum(t + 1 for _, t in parts) == 5
    taken = [m % (1 << 64) for m, _ in parts]
    assert sum(taken) == reduce(or_, taken)


def test_allocation_is_the_least():
    costs = [[0, 5, 9, 99], [0, 1, 2, 3], [0, 4, 4, 50]]
    assert simhash.allocate(costs, 3) == (3, [0, 3, 0])
    assert simhash.allocate(costs, 5) == (7, [0, 3, 2])
