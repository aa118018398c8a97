"""Language-model scoring by deleted interpolation.

A word's probability after the two words before it mixes the trigram's, the bigram's, the word's and a uniform estimate. The mixture's
weights depend on how often the context was seen, in powers of two, and are learned by expectation-maximisation on one fold of the
training documents, each token's own occurrence deleted from the counts: first those of bigram, word and uniform estimate by the word
before, then that of the trigram against the mixture of these by the two words before.

Counts meet without a row for each token: documents are packed into chunks; every chunk sends its different n-grams, hashed, as sorted
arrays to ranges of the hash space, where they are added up; back come only totals that differ from what the chunk has itself. Words are
hashed to 64 bits; pairs and triples to 16 bits more than the tokens' number has, so that one in 65,536 at most shares its hash with
another, and a sorted hash costs some four bytes at any size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import cut, map_columns

#: Text bytes of a chunk (a longer text has one for itself), and tokens whose keys one range of the hash space adds up.
CHUNK, RANGE = 16 << 20, 4 << 20
#: The longest n-grams, and by how many bits the hashes of pairs and triples are wider than the number of tokens.
ORDERS, SPARE = 3, 16
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Context frequencies of 2**24 and more share a bucket; probabilities are put together in eighths of a power of two for learning.
BUCKETS, STEPS = 26, 8
CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("fold", T.BinaryType()), T.StructField("rest", T.BinaryType())])
SENT = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("range", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
BACK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("fold", T.BooleanType()), T.StructField("order", T.IntegerType()), T.StructField("range", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("totals", T.BinaryType()), T.StructField("all", T.LongType()), T.StructField("distinct", T.LongType())])
FITTING = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
SCORED = T.StructType([T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def side(id_: int | None) -> int:
    return crc32(str(id_).encode() if id_ is not None else b"") % 7


def squeezed(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on, compressed, as the later ones of counts are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def loose(data: bytes, kind=np.uint32) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def tight(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps after it, in as few bytes each as the widest needs, squeezed."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + squeezed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).ravel())


def untight(data: bytes) -> np.ndarray:
    raw = loose(data[9:], np.uint8).reshape(data[0], -1)
    gaps = np.zeros((raw.shape[1], 8), np.uint8)
    gaps[:, : data[0]] = raw.T
    return np.concatenate([np.frombuffer(data, np.uint64, 1, 1), gaps.view(np.uint64).ravel()]).cumsum(dtype=np.uint64)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (``id``, ``text``) to rows of CHUNKS: Arrow tables, compressed, the learning fold apart."""
    part, made = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list = []

    def table(keep: list[int]) -> bytes:
        out = io.BytesIO()
        own = pa.table({"id": pa.array([ids[i] for i in keep], pa.int64()), "text": pa.array([texts[i] for i in keep], pa.large_string())})
        with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as sink:
            sink.write_table(own)
        return out.getvalue()

    def full() -> pa.RecordBatch:
        nonlocal made
        fold = [i for i, k in enumerate(ids) if side(k) == 3]
        rest = [i for i, k in enumerate(ids) if side(k) != 3]
        tokens = sum(len(t) for t in texts) // 5 + len(texts)
        row = ([(part << 32) + made], [tokens], [table(fold)], [table(rest)])
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], [f.name for f in CHUNKS])

    size = 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            length = len(text.encode("utf-8", "replace"))
            if ids and size + length > CHUNK:
                yield full()
                ids.clear()
                texts.clear()
                size = 0
            ids.append(id_)
            texts.append(text)
            size += length
    if ids:
        yield full()


def tables(*blobs: bytes) -> tuple[list, list[str]]:
    ids: list = []
    texts: list[str] = []
    for blob in blobs:
        held = pa.ipc.open_stream(blob).read_all()
        ids += held["id"].to_pylist()
        texts += held["text"].to_pylist()
    return ids, texts


class Known(dict):
    """Numbers of words, given as they are first met; 0 is the end's."""

    def __init__(self):
        super().__init__()
        self.hashes = [int(END)]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


class Counted:
    """A chunk's tokens: for each order the different keys, sorted, and which of them each token has; training counts of the keys.
    Keys of pairs and triples have ``bits`` bits."""

    def __init__(self, ids: list, texts: list[str], bits: int):
        known, parts, lengths = Known(), [], []
        number, end = known.__getitem__, np.zeros(1, np.int32)
        for text in texts:
            out = np.array(list(map(number, text.encode("utf-8", "replace").lower().split())), np.int32)
            parts += [out, end]
            lengths.append(len(out) + 1)
        hashes = known.hashes
        del known, number
        self.ids, self.sides = ids, np.array([side(i) for i in ids], np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        hashes = np.array(hashes, np.uint64)
        train = np.repeat(self.sides != 2, self.lengths)
        self.fold = np.repeat(self.sides == 3, self.lengths)
        self.keys, self.of, self.counts, self.in_fold = [], [], [], []

        def add(keys: np.ndarray, of: np.ndarray) -> None:
            self.keys.append(keys)
            self.of.append(of)
            self.counts.append(np.bincount(of[train], minlength=len(keys)).astype(np.uint32))
            self.in_fold.append(np.bincount(of[self.fold], minlength=len(keys)) > 0)

        keys, place = np.unique(hashes, return_inverse=True)
        if len(numbers) == 0:
            keys = keys[:0]
        add(keys, place.astype(np.int32)[numbers])
        words = hashes[numbers]
        del numbers
        pairs = self.after(words, words)
        triples = self.after(pairs, words)
        del words
        drop = np.uint64(64 - bits)
        for held in (pairs, triples):
            held >>= drop
        keys, of = np.unique(pairs, return_inverse=True)
        del pairs, held
        add(keys, of.astype(np.int32))
        keys, of = np.unique(triples, return_inverse=True)
        del triples
        add(keys, of.astype(np.int32))

    def after(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For each token the hash of the context that ends with the token before it, and of its own word."""
        made = np.empty_like(words)
        made[1:] = contexts[:-1]
        made[self.starts] = START
        with np.errstate(over="ignore"):  # in place, since these are the largest arrays here
            made ^= made >> np.uint64(29)
            made *= np.uint64(0xBF58476D1CE4E5B9)
            made += words
            made ^= made >> np.uint64(32)
            made *= np.uint64(0x94D049BB133111EB)
        return made

    def totals(self, answers, ranges: int | None, bits: int) -> list[np.ndarray]:
        """Counts over all chunks: the chunk's own, but for those in ``answers``. With ``ranges`` an answer marks by bits which of the
        chunk's keys in its range it is about; without, it names them."""
        out = [c.astype(np.int64) for c in self.counts]
        edges = [np.searchsorted(in_range(k, ranges, b), np.arange(ranges + 1)) for k, b in zip(self.keys, widths(bits), strict=True)] if ranges else None
        for a in answers or []:
            k, totals = a["order"] - 1, loose(a["totals"], np.int64)
            if edges is None:
                out[k][np.searchsorted(self.keys[k], untight(a["keys"]))] = totals
            else:
                first, last = edges[k][a["range"]], edges[k][a["range"] + 1]
                out[k][first + np.flatnonzero(np.unpackbits(np.frombuffer(a["keys"], np.uint8), count=last - first))] = totals
        return out

    def parts(self, totals: list[np.ndarray], n_docs: int) -> tuple[np.ndarray, ...]:
        """For each token the counts of its trigram, of the two words before, of its bigram, of the word before and of the word.

        An n-gram is counted no more often than the shorter ones in it, which takes back most of what a shared hash adds."""
        word = totals[0][self.of[0]]
        context = self.before(word, n_docs)
        two = np.minimum(totals[1][self.of[1]], np.minimum(context, word))
        pair = self.before(two, n_docs)
        return np.minimum(totals[2][self.of[2]], np.minimum(pair, two)), pair, two, context, word

    def before(self, counts: np.ndarray, n_docs: int) -> np.ndarray:
        """The count of the token before; at a text's start that of the texts."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[self.starts] = n_docs
        return out


def widths(bits: int) -> list[int]:
    """The bits of the keys of each order."""
    return [64] + [bits] * (ORDERS - 1)


def in_range(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges of the hash space each key is in; rises with the keys."""
    return (keys >> np.uint64(bits - 32)).astype(np.int64) * ranges >> 32


def send(ranges: int, bits: int):
    """Chunks to rows of SENT: for each order and range of the hash space the chunk's keys there, training counts and fold marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(SENT)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, fold, rest = (batch.column(k)[i].as_py() for k in range(3))
                own = Counted(*tables(fold, rest), bits)
                for order, (keys, counts, in_fold, width) in enumerate(zip(own.keys, own.counts, own.in_fold, widths(bits), strict=True), 1):
                    at, first = np.unique(in_range(keys, ranges, width), return_index=True)
                    last = [*first[1:], len(keys)]
                    rows = [(order, r, chunk, tight(keys[a:b]), squeezed(counts[a:b] * 2 + in_fold[a:b])) for r, a, b in zip(at.tolist(), first, last, strict=True)]
                    for k in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows[k : k + 256]), wanted, strict=True)], schema=wanted)

    return run


def add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One range: totals of all keys, and for each chunk those that differ from its own; besides, those of its learning fold that are
    more than 1 (a key of the fold that occurs once occurs there). Sums over the words stand in a row of a chunk below zero."""
    order, which = int(key[0]), int(key[1])
    arrays = [untight(k) for k in frame["keys"]]
    marks = [loose(c).astype(np.int64) for c in frame["counts"]]
    keys, of = np.unique(np.concatenate(arrays), return_inverse=True)
    own = np.concatenate(marks)
    totals = np.bincount(of, weights=own >> 1, minlength=len(keys)).astype(np.int64)
    out: list[tuple] = []
    at = 0
    for chunk, held in zip(frame["chunk"], arrays, strict=True):
        every, mine = totals[of[at : at + len(held)]], own[at : at + len(held)]
        at += len(held)
        differs, learns = every != mine >> 1, (mine & 1 == 1) & (every > 1)
        if differs.any():
            out.append((chunk, False, order, which, np.packbits(differs).tobytes(), squeezed(every[differs]), 0, 0))
        if learns.any():
            out.append((chunk, True, order, which, tight(held[learns]), squeezed(every[learns]), 0, 0))
    if order == 1:
        out.append((-1 - which, False, 1, which, b"", b"", int(totals.sum()), int((totals > 0).sum())))
    return pd.DataFrame(out, columns=[f.name for f in BACK])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)), 0)


def step(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.minimum(254, np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS)).astype(np.int64), 0)


def weights(codes: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation: for each bucket the weights of bigram, word and uniform estimate; an empty bucket takes its lower
    neighbour's, an unseen context has no bigram estimate."""
    b, q2, q1 = codes >> 16, codes >> 8 & 255, codes & 255
    p = np.stack([np.where(q2 > 0, 2.0 ** (-(q2 - 1) / STEPS), 0), np.where(q1 > 0, 2.0 ** (-(q1 - 1) / STEPS), 0), np.full(len(codes), uniform)], axis=1)
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = (0, 0.9, 0.1)
    for _ in range(rounds):
        share = lam[b] * p
        share /= share.sum(axis=1, keepdims=True)
        sums = np.zeros((BUCKETS, 3))
        np.add.at(sums, b, share * n[:, None])
        for k in range(BUCKETS):
            total = sums[k].sum()
            if total > 0:
                lam[k] = (sums[k] + (np.array([0, 0.01, 0.01]))) / (total + 0.02)
    seen = np.bincount(b, weights=n, minlength=BUCKETS) > 0
    for k in range(1, BUCKETS):
        if not seen[k] and seen[:k].any():
            lam[k] = lam[k - 1] if k > 1 else lam[k]
    return lam


def weight(codes: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation: for each bucket the trigram's weight against the shorter n-grams' mixture; an empty bucket takes its
    lower neighbour's, an unseen context has none."""
    b, q3, q2 = codes >> 16, codes >> 8 & 255, codes & 255
    p3, p2 = (np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0) for q in (q3, q2))
    lam = np.full(BUCKETS, 0.5)
    lam[0] = 0
    total = np.bincount(b, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        share = lam[b] * p3 / np.maximum(lam[b] * p3 + (1 - lam[b]) * p2, 1e-300)
        lam = np.where(total > 0, np.bincount(b, weights=share * n, minlength=BUCKETS) / (total + 0.02), lam)
    for k in range(2, BUCKETS):
        if not total[k]:
            lam[k] = lam[k - 1]
    return lam


def mixture(lam: np.ndarray, two: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    """The probability of each token from its bigram, its word and the uniform estimate."""
    mix = lam[bucket(context)]
    return mix[:, 0] * two / np.maximum(context, 1) + mix[:, 1] * word / max(n, 1) + mix[:, 2] / (v + 1)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the text's words, A-Z lower-cased, and one end. Rows whose crc32(id as text) mod 7 is 2 are held out: nothing is counted
    from them. ``base_score`` is the add-one unigram score; ``score`` the interpolated model's, both log10. A null text counts as
    empty (one token, the end), a null id as the empty string; repeated rows count as often as they occur; an empty table returns no
    rows. Before a text's first token stands its start, whose count is that of the training rows.
    """
    session = docs.sparkSession
    chunks = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, CHUNKS))
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    ranges, bits = max(1, -(-tokens // RANGE)), min(64, max(40, int(tokens).bit_length() + SPARE))
    sent = chunks.select("chunk", "fold", "rest").mapInArrow(send(ranges, bits), SENT)
    merged = sent.groupBy("order", "range").applyInPandas(add_up, BACK)
    # Taken up as it runs: later plans share its shuffle files; a lost one is made anew.
    back = DataFrame(session._jsparkSession.internalCreateDataFrame(merged._jdf.queryExecution().toRdd(), merged._jdf.schema(), False), session)
    train = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 != 2
    n_docs = docs.where(train).count()
    answers = F.collect_list(F.struct("order", "range", "keys", "totals")).alias("answers")
    to_fold = back.where("fold or chunk < 0").groupBy("chunk").agg(answers, F.sum("all").alias("all"), F.sum("distinct").alias("distinct"))
    learning = cut(chunks.select("chunk", "fold").join(to_fold, "chunk", "full").select("fold", "answers", "all", "distinct"))
    sums = learning.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n, v = sums["n"], sums["v"]

    def fold_counts(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, ...]]:
        """``parts`` of each chunk's learning fold, each token's own occurrence deleted."""
        for blob, answers in zip(*(c.to_pylist() for c in columns), strict=True):
            own = Counted(*tables(blob), bits)
            if len(own.fold):
                yield tuple(c - 1 for c in own.parts(own.totals(answers, None, bits), n_docs))

    def counted(codes: list[np.ndarray]) -> list:
        return list(np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True))

    def shorter(columns: list[pa.Array]) -> list:
        codes = []
        for _, _, two, context, word in fold_counts(columns):
            codes.append(bucket(context) << 16 | step(np.where(context > 0, two / np.maximum(context, 1), 0)) << 8 | step(word / max(n - 1, 1)))
        return counted(codes)

    def longest(columns: list[pa.Array]) -> list:
        codes = []
        for three, pair, two, context, word in fold_counts(columns):
            codes.append(bucket(pair) << 16 | step(np.where(pair > 0, three / np.maximum(pair, 1), 0)) << 8 | step(mixture(lam, two, context, word, n - 1, v)))
        return counted(codes)

    def seen(run) -> tuple[np.ndarray, np.ndarray]:
        rows = map_columns(learning.where("fold is not null"), FITTING, run, "fold", "answers").groupBy("code").agg(F.sum("n").alias("n")).collect()
        return np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)

    lam = weights(*seen(shorter), 1 / (v + 1))
    of_three = weight(*seen(longest))

    def scored(columns: list[pa.Array]) -> list:
        out: list[list] = [[] for _ in SCORED]
        for fold, rest, answers in zip(*(c.to_pylist() for c in columns), strict=True):
            own = Counted(*tables(fold, rest), bits)
            three, pair, two, context, word = own.parts(own.totals(answers, ranges, bits), n_docs)
            mix = of_three[bucket(pair)]
            p = mix * three / np.maximum(pair, 1) + (1 - mix) * mixture(lam, two, context, word, n, v)
            made = (own.ids, own.sides == 2, own.lengths, np.add.reduceat(word > 0, own.starts, dtype=np.int64), np.add.reduceat(np.log10((word + 1) / (n + v + 1)), own.starts), np.add.reduceat(np.log10(p), own.starts))
            for held, x in zip(out, made, strict=True):
                held += list(x)
        return out

    whole = chunks.join(back.where("not fold and chunk >= 0").groupBy("chunk").agg(answers), "chunk", "left")
    found = map_columns(whole, SCORED, scored, "fold", "rest", "answers")
    return found.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
