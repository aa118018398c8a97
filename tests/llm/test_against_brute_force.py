import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from marlstone.llm import embedjoin, linededup, lm, media, mixing, pii, piece_bpe, sharding, toxicity
from tests.llm.brute import groups


def test_piece_bpe_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    spm = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    library = spm.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        own = piece_bpe.encoder(f.read())
    rnd = random.Random(3)
    texts = ["", " ", "   ", "▁a", "\n\t", "a" * 3000, "ab" * 2000, "<s> </s><unk><0x41>", "Ünïcödé 漢字 \U0001f600\u0000 end ", "the thonder ering"]
    texts += ["".join(rnd.choice("aeith ▁\n0é漢\U0001f600xĀ<>s.,") for _ in range(rnd.randrange(80))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)


def test_piece_bpe_side_by_side_equals_the_library(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    spm = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    library = spm.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        own = piece_bpe.batch_encoder(f.read())
    rnd = random.Random(4)
    texts = [None, "", " ", "  ", "▁a ", "\n\t", "a" * 3000, "ab" * 2000, "<s> </s><unk><0x41>", "Ünïcödé 漢字 \U0001f600\u0000 end ", "\0", "x \0 y"]
    texts += ["".join(rnd.choice("aeith ▁\n0é漢\U0001f600xĀ<>s.,\0") for _ in range(rnd.randrange(120))) for _ in range(600)]
    want = [library.encode(t or "") for t in texts]
    for at_once, long in ((1 << 20, 64), (50, 64), (1 << 20, 6)):  # one portion, many, and most stretches one by one
        monkeypatch.setattr(piece_bpe, "AT_ONCE", at_once)
        monkeypatch.setattr(piece_bpe, "LONG", long)
        got = own.encode(texts)
        assert got.to_pylist() == want
        assert own.decode(got).to_pylist() == [library.decode(ids) for ids in want]
    a, b = ([rnd.randrange(own.n) for _ in range(3000)] for _ in range(2))
    plain = [own.own.merged(own.own.order[i] + own.own.order[j]) == [own.own.order[i], own.own.order[j]] for i, j in zip(a, b)]
    assert own.fit(np.array(a), np.array(b)).tolist() == plain
    assert [own.own.fit(own.own.order[i], own.own.order[j]) for i, j in zip(a, b)] == plain


def test_embedding_links(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 12))
    rows = np.concatenate([base, base[:20] + rnd.normal(scale=0.08, size=(20, 12)), base[:20] + rnd.normal(scale=0.12, size=(20, 12)), base[:5] * 3, base[:5]]).astype(np.float32)
    unit = rows.astype(float) / np.sqrt((rows.astype(float) ** 2).sum(1, keepdims=True))
    cos = unit @ unit.T
    ids = [int(i) for i in rnd.permutation(len(rows))]
    want_groups = groups(ids, lambda i, j: cos[i, j] >= 0.95)
    got = {r["id"]: r for r in embedjoin.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>")).collect()}
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == (cos[k] >= 0.95).sum() - 1
        assert got[i]["component_id"] == want_groups[k]
        assert got[i]["kept"] == (want_groups[k] == i)


def test_embedding_recursion_finds_all():
    """One block against itself and another, over several tiles."""
    rnd = np.random.default_rng(4)
    rows = rnd.normal(size=(1300, 6))
    axes = np.linalg.qr(rnd.normal(size=(6, 6)))[0][:, :3]
    eps = math.sqrt(2 - 2 * 0.95)
    for a, b, same in ((rows, rows, True), (rows[:700], rows[700:], False)):
        pack = lambda r, start: embedjoin.packed(np.arange(len(r)) + start, np.ones(len(r)), np.full(len(r), 6), r)
        nodes, links, _ = embedjoin.joined(pack(a, 0), pack(b, 0 if same else len(a)), same, axes, eps, 0.95)
        ua, ub = embedjoin.unit(a), embedjoin.unit(b)
        linked = ua @ ub.T >= 0.95
        want = linked.sum(1) - 1 if same else np.concatenate([linked.sum(1), linked.sum(0)])
        got = np.zeros(len(want), int)
        got[nodes] = links
        assert (got == want).all()


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_patterns_equal_the_plain_ones():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab.@-+ 1234567890()%é") for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111 and +1 (509) 555-6973", "a@b@c.de a..b@-.-", "1.2.3.4.5.6.7.8 0001.2.3.004", "+1234567890123456"]
    for t in texts:
        assert pii.patterns(t) == plain_spans(t)


def test_field_carries_labels_to_distant_tokens():
    train = [f"call +1 ({i:03d}) 555-{1000 + i} now" for i in range(40)] + [f"mail x{i}@mail.org at 10.0.0.{i} on line {i}" for i in range(40)]
    field = pii.fit(train)
    text = "ring +1 (111) 555-1011 today " + "word " * 50 + "again 555-1011 end"
    base, every = pii.spans([text], field)
    assert set(base[0]) <= set(every[0])
    assert any(text[a:b] == "555-1011" for a, _, b in every[0] if (a, 3, b) not in base[0])
    assert pii.spans(["no such thing here"], field) == ([[]], [[]])


def test_lm_counts_and_distributions(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["W1", "É"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(120)] + [(500, None), (501, "")]
    tokens = {i: (t or "").encode().lower().split() + [0] for i, t in docs}
    counts = Counter(t for i, own in tokens.items() if crc32(str(i).encode()) % 7 != 2 for t in own)
    n, v = sum(counts.values()), len(counts)
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens[r["id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(t in counts for t in own), n, crc32(str(r["id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), abs=1e-9)
        assert r["score"] < 0


def test_lm_weights_maximise_likelihood():
    codes = np.array([5 << 16 | 9 << 8 | 40, 5 << 16 | 0 << 8 | 17], np.int64)
    lam = lm.weights(codes, np.array([60.0, 40.0]), 1e-4)
    likelihood = lambda a: 60 * math.log(a * 0.5 + (1 - a) * 2 ** (-39 / 8)) + 40 * math.log((1 - a) * 0.25)
    best = max(np.linspace(0.01, 0.99, 99), key=likelihood)
    assert lam[5, 0] == pytest.approx(best, abs=0.02)
    assert lam.sum(1) == pytest.approx(np.ones(lm.BUCKETS))


def test_best_fit_equals_scanning_all_bins():
    rnd = random.Random(5)
    for _ in range(30):
        sizes = sorted((rnd.randrange(1, 60) for _ in range(80)), reverse=True)
        room: list[int] = []
        want = []
        for s in sizes:
            able = [(r, b) for b, r in enumerate(room) if r >= s]
            if able:
                b = min(able)[1]
                room[b] -= s
            else:
                b = len(room)
                room.append(100 - s)
            want.append(b)
        assert sharding.best_fit(sizes, 100) == want


def test_shards(spark):
    rnd = random.Random(6)
    docs = [(i, "é" * rnd.randrange(400) if i % 3 else "same text") for i in range(600)]
    got = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string"), bins=8).collect()
    text, sums, slots = dict(docs), Counter(), {}
    where = {}
    for r in got:
        t = text[r["id"]]
        assert (r["size"], r["crc"]) == (len(t.encode()) + 1, crc32(t.encode()))
        assert where.setdefault(t, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) <= 1.05 * min(sums.values())


def test_mix_reaches_targets(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["b", "a", "c", None])) for i in range(300)] + [(900, "w " * 5, "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.amounts(df).collect()
    sums, targets = Counter(), {}
    source = {i: s for i, _, s in docs}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[source[r["id"]]] += r["taken"]
        targets[source[r["id"]]] = r["target"]
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    # plain water-filling
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        assert targets[s] == pytest.approx(2 * sizes[s] if s in capped else weight[s] * level)
        assert abs(sums[s] - targets[s]) <= 1
    mix = mixing.mixed(df).collect()
    words = Counter()
    for r in mix:
        words[r["source"]] += len(r["text"].split())
    assert words == sums
    assert sorted(map(tuple, mixing.amounts(df.repartition(7)).collect())) == sorted(map(tuple, got))


def plain_dedup(docs, window=2, divisor=3, least=2):
    import hashlib

    chunks = []
    for i, text in docs:
        lines, start = text.split("\n"), 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        for k in range(len(lines)):
            if k == len(lines) - 1 or (k >= window - 1 and sum(h[k - j] * 31**j for j in range(window)) % divisor == 0):
                chunks.append((i, start, lines[start : k + 1]))
                start = k + 1
    seen, out = set(), {i: [] for i, _ in docs}
    for i, _, own in sorted(chunks, key=lambda c: c[:2]):
        body = "\n".join(own)
        if len(own) >= least and body.strip(" \n"):
            if body in seen:
                continue
            seen.add(body)
        out[i].append(body)
    return {i: "\n".join(own) for i, own in out.items()}


def test_line_dedup(spark):
    rnd = random.Random(12)
    passage = [f"shared line {k}" for k in range(12)]
    docs = []
    for i in range(40):
        lines = [f"own {i} {k}" for k in range(rnd.randrange(1, 8))]
        at = rnd.randrange(len(lines) + 1)
        docs.append((i, "\n".join(lines[:at] + (passage if i % 2 else []) + lines[at:])))
    docs += [(100, "\n\n\n"), (101, "\n\n\n"), (102, "")]
    got = {r["doc_id"]: (r["text"], r["lines"], r["removed_lines"]) for r in linededup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_dedup(docs)
    assert {i: t for i, (t, _, _) in got.items()} == want
    assert sum(r for _, _, r in got.values()) > 40  # most of the passage went from most documents
    assert all(n == text.count("\n") + 1 for (i, text) in docs for n in [got[i][1]])


def test_images_round_trip():
    rnd = np.random.default_rng(1)
    for shape in ((5, 7), (64, 64), (3, 200)):
        image = rnd.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.pgm(image)) == image).all()
        colour = rnd.integers(0, 256, (*shape, 3)).astype(np.uint8)
        assert (media.decode(media.pgm(colour)) == colour).all()
        assert (media.decode(media.as_bmp(colour)) == colour).all()
        # area means against a plain version on an enlarged image
        h, w = 4, 3
        big = np.repeat(np.repeat(image.astype(float), h, axis=0), w, axis=1)
        want = big.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
        assert media.area_resize(image, h, w) == pytest.approx(want)
    assert (media.decode(b"P2\n# note\n2 1\n9\n3 4") == [[3, 4]]).all()
    assert (media.decode(b"P4\n9 1\n\x80\x00") == [[0] + [255] * 8]).all()
    assert (media.decode(b"P1\n3 1\n101") == [[0, 255, 0]]).all()


def test_texts_as_images(spark):
    docs = [(1, "x" * 64), (2, "é" * 100), (3, None)]
    for r in media.text_media(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        data = (dict(docs)[r["id"]] or "").encode()
        assert r["n_bytes"] == len(data)
        assert bytes(r["samples"]) == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert media.decode(bytes(r["media"])).tobytes() == bytes(r["samples"])
        assert np.load(__import__("io").BytesIO(bytes(r["tile"]))).shape == (32, 32)


def test_broken_images_return_rows(spark):
    files = [(1, b"P5\n2 2\n255\n\x01"), (2, None), (3, b"GIF"), (4, media.pgm(np.zeros((2, 2), np.uint8)))]
    got = {r["id"]: r for r in media.images(spark.createDataFrame(files, "id long, data binary"), "id", "data").collect()}
    assert [got[i]["error"] is None for i in (1, 2, 3, 4)] == [False, False, False, True]


def test_classifier_learns_words_and_beginnings():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]

    def text(bad):
        own = [rnd.choice(words) for _ in range(60)]
        if bad:
            own[rnd.randrange(60)] = rnd.choice(["scum", "xylich" + rnd.choice(words)])
        return " ".join(own)

    labels = [i % 3 == 0 for i in range(900)]
    texts = [text(bad) for bad in labels]
    model = toxicity.fit(texts[:700], [int(b) for b in labels[:700]])
    got = model.scores(texts[700:], toxicity.Words()) >= 0.5
    assert (got == np.array(labels[700:])).mean() > 0.9
    one = model.scores([texts[3]], toxicity.Words())[0]
    assert model.scores(texts[:10], toxicity.Words())[3] == pytest.approx(one, abs=1e-6)


def test_labels_held_out_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if crc32(str(i).encode()) % 5 == 0 else 0) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert (model.scores([f"text {i}" for i in range(50)], toxicity.Words()) < 0.5).all()


def test_lm_does_not_depend_on_chunks_or_ranges(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(25)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))) for i in range(150)], "doc_id long, text string")
    one = {r["id"]: r for r in lm.scores(docs.coalesce(1)).collect()}
    monkeypatch.setattr(lm, "RANGE", 60)
    many = {r["id"]: r for r in lm.scores(docs.repartition(6)).collect()}
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert many[i]["n_known"] == r["n_known"]
        assert many[i]["base_score"] == pytest.approx(r["base_score"])
        assert many[i]["score"] == pytest.approx(r["score"], rel=1e-6)
