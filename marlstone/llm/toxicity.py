"""A convolutional text classifier in numpy, for toxicity.

Words are hashed, with their beginnings, to rows of an embedding table; filters of several widths slide over the words, each keeps
its largest response in the whole text, and a logistic layer weighs these. Thresholds are set by language, which is told from the
text's own words.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import map_columns, pieces, release

LETTERS = re.compile(r"[^\W\d_]+")
#: Rows of the embedding table, its width, filter widths, filters of each width.
ROWS, WIDE, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 12
#: A word's features: itself and its beginnings of these lengths.
BEGINNINGS = (3, 4, 5, 6, 7)
PARTS = 1 + len(BEGINNINGS)
#: A feature of fewer training documents than this says nothing.
LEAST_DOCS = 4
#: Words that a worker remembers.
REMEMBERED = 60_000
#: Text bytes that are taken up at once, and places whose responses are held at once, however long a text is.
AT_ONCE, PLACES = 2 << 20, 1 << 17
#: Frequent words by which a text's language is told.
FREQUENT = {
    "en": "the and of to in is that it for was with as be this are on not he at by",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "fr": "le la les des et en un une du que est pour qui dans par au sur pas plus avec",
    "es": "el los las del que y un por con una su para es al lo como más o pero sus",
}
LANGUAGE_OF = {w: lang for lang in reversed(FREQUENT) for w in FREQUENT[lang].split()}


def language(words: list[str]) -> str:
    """The language most of whose frequent words a text has; "" if it has none."""
    counts: dict[str, int] = {}
    for w in words:
        if (lang := LANGUAGE_OF.get(w)) is not None:
            counts[lang] = counts.get(lang, 0) + 1
    return max(sorted(counts), key=counts.__getitem__) if counts else ""


def features(word: str) -> list[int]:
    """Rows of a word and its beginnings, 0 (the zero row) where it is too short for one."""
    own = [1 + crc32(f"={word}".encode()) % (ROWS - 1)]
    return own + [1 + crc32(f"^{word[:n]}".encode()) % (ROWS - 1) if len(word) >= n else 0 for n in BEGINNINGS]


class Words:
    """Numbers for words and a table of their features; 0 is the gap after a text, with no features."""

    def __init__(self, limit: int | None = REMEMBERED):
        self.limit, self.held = limit, np.zeros((0, WIDE), np.float32)
        self.number: dict[str, int] = {}
        self.rows = array("i", [0] * PARTS)

    def table(self, start: int = 0) -> np.ndarray:
        """Feature rows of the words from number ``start`` on."""
        return np.frombuffer(self.rows, np.int32).reshape(-1, PARTS)[start:].copy()

    def add(self, words: list[str], out: array) -> None:
        """Puts the numbers of a text's words after those in ``out``, and a gap as wide as the widest filter needs."""
        number, rows = self.number, self.rows
        for w in words:
            if (k := number.get(w)) is None:
                k = number[w] = len(rows) // PARTS
                rows.extend(features(w))
            out.append(k)
        out.extend([0] * max(WIDTHS))


def slots() -> list[tuple[int, int]]:
    """Width and offset of each word that the filters look at."""
    return [(w, j) for w in WIDTHS for j in range(w)]


def gaps(starts: np.ndarray, size: int) -> np.ndarray:
    """The places in the gaps after texts from which a filter would reach into the next text."""
    ends = np.append(starts[1:], size)
    return np.concatenate([ends - j for j in range(1, max(WIDTHS))])


@dataclass
class Classifier:
    """``embed``: feature rows; ``filters``: for each width and offset a (WIDE, FILTERS) matrix; ``bias`` of each filter; ``out``."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: dict[str, float] = field(default_factory=dict)

    def pooled(self, vectors: np.ndarray, flat: np.ndarray, starts: np.ndarray, where: bool = False):
        """The filters' largest responses, a row for each text, 0 at least; with ``where``, also the positions they come from."""
        made, at = [], []
        ends = np.append(starts[1:], len(flat))
        for k, w in enumerate(WIDTHS):
            first = sum(WIDTHS[:k])
            response = np.zeros((len(flat), FILTERS), np.float32)
            for j in range(w):
                table = vectors @ self.filters[first + j]
                response[: len(flat) - j] += table[flat[j:]]
            response += self.bias[k]
            response[gaps(starts, len(flat))] = 0
            made.append(np.maximum.reduceat(response, starts, axis=0))
            if where:
                at.append(np.array([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]))
        most = np.maximum(np.concatenate(made, axis=1), 0)
        return (most, at) if where else most

    def most(self, vectors: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest responses alone, some places at a time."""
        out = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        tables, beyond = [vectors @ f for f in self.filters], np.sort(gaps(starts, len(flat)))
        for a in range(0, len(flat), PLACES):
            b = min(a + PLACES, len(flat))
            first, after = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
            cuts = np.append(0, starts[first + 1 : after] - a)
            for k, w in enumerate(WIDTHS):
                response = np.repeat(self.bias[k][None], b - a, axis=0)
                for j in range(w):
                    seen = flat[a + j : b + j]
                    response[: len(seen)] += tables[sum(WIDTHS[:k]) + j][seen]
                response[beyond[np.searchsorted(beyond, a) : np.searchsorted(beyond, b)] - a] = 0
                own = out[first:after, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, np.maximum.reduceat(response, cuts, axis=0), out=own)
        return out

    def vectors(self, known: Words) -> np.ndarray:
        """All known words' vectors, grown as words are added."""
        new = known.table(len(known.held))
        if len(new):
            known.held = np.concatenate([known.held, *(self.embed[new[k : k + 20_000]].sum(axis=1) for k in range(0, len(new), 20_000))])
        return known.held

    def scores(self, texts: list[str | None], known: Words) -> np.ndarray:
        """A score for each text. Its words become numbers at once: as strings they would take many times its length."""
        if known.limit is not None and len(known.number) > known.limit:
            known.__init__(known.limit)
        flat, starts, shift = array("i"), [], []
        for t in texts:
            words = LETTERS.findall((t or "").lower())
            starts.append(len(flat))
            shift.append(self.shift.get(language(words), self.shift.get("", 0.0)))
            known.add(words, flat)
        z = self.most(self.vectors(known), np.frombuffer(flat, np.int32), np.array(starts, np.int64)) @ self.out[:-1] + self.out[-1] - np.array(shift)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], labels: list[int], seed: int = 7, passes: int = 8, batch: int = 24, rate: float = 0.1, forget: float = 0.3, hide: float = 0.5) -> Classifier:
    """A classifier from labelled texts, by Adagrad; every fifth text only sets the thresholds.

    Without texts, or with one label alone, nothing can be told apart: such a classifier scores every text alike, far below 0.5, so
    that no document is rejected for it. Empty texts are learned from as texts without words. Largest responses pass gradients to the one place they come from, so a step touches few rows of the table.
    """
    rnd = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    known, flats, langs = Words(limit=None), [], []
    for t in texts:  # a text's words are numbers at once: as strings they would fill the driver
        words = LETTERS.findall(t.lower())
        known.add(words, own := array("i"))
        flats.append(np.frombuffer(own, np.int32))
        langs.append(language(words))
    rows_of = known.table()
    counts = np.zeros(ROWS, np.int32)
    for flat in flats:
        counts[np.unique(rows_of[np.unique(flat)])] += 1
    kept = (counts >= LEAST_DOCS).astype(np.float32)[:, None]
    kept[0] = 0
    n_slots, n_out = len(slots()), len(WIDTHS) * FILTERS
    model = Classifier(
        (rnd.normal(0, 0.3, (ROWS, WIDE)) * kept).astype(np.float32), rnd.normal(0, 0.3, (n_slots, WIDE, FILTERS)).astype(np.float32),
        np.zeros((len(WIDTHS), FILTERS), np.float32), np.append(rnd.normal(0, 0.1, n_out), -1.0).astype(np.float32),
    )
    if not len(y) or y.min() == y.max():  # nothing to tell apart, so nothing to reject
        model.out[:] = 0
        model.out[-1] = -5
        return model
    held_out = np.arange(len(y)) % 5 == 0
    train = np.flatnonzero(~held_out)
    sums = [np.full_like(x, 1e-3) for x in (model.embed, model.filters, model.bias, model.out)]

    def step(which: int, at, gradient) -> None:
        value = (model.embed, model.filters, model.bias, model.out)[which]
        sums[which][at] += gradient**2
        value[at] -= rate * gradient / np.sqrt(sums[which][at])

    weight = np.where(y == 1, min(4.0, (y == 0).sum() / (y == 1).sum()), 1.0).astype(np.float32)
    for _ in range(passes):
        order = rnd.permutation(train)
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            starts = np.cumsum([0, *(len(flats[i]) for i in own[:-1])])
            flat = np.concatenate([flats[i] for i in own])
            flat = np.where(rnd.random(len(flat)) < hide, 0, flat)  # so that every telling word is learned, not the plainest alone
            seen_words, flat = np.unique(flat, return_inverse=True)
            table = rows_of[seen_words]
            table = np.where(rnd.random(table.shape) < forget, 0, table)  # so that a word's parts learn to do without each other
            vectors = model.embed[table].sum(axis=1) / (1 - forget)
            most, at = model.pooled(vectors, flat, starts, where=True)
            keep = (rnd.random(most.shape) > 0.2).astype(np.float32) / 0.8
            z = (most * keep) @ model.out[:-1] + model.out[-1]
            error = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)
            back = error[:, None] * model.out[:-1] * keep * (most > 0)
            step(3, slice(None), np.append((most * keep).T @ error, error.sum()).astype(np.float32) + 1e-4 * model.out)
            of_word = np.zeros_like(vectors)
            of_filters, of_bias = np.zeros_like(model.filters), np.zeros_like(model.bias)
            for i, w in enumerate(WIDTHS):
                first, g, places = sum(WIDTHS[:i]), back[:, i * FILTERS : (i + 1) * FILTERS], at[i]
                of_bias[i] = g.sum(axis=0)
                for j in range(w):
                    seen = flat[np.minimum(places + j, len(flat) - 1)]
                    of_filters[first + j] = np.einsum("dfe,df->ef", vectors[seen], g)
                    np.add.at(of_word, seen, g[..., None] * model.filters[first + j].T[None])
            step(1, slice(None), of_filters)
            step(2, slice(None), of_bias)
            moved = np.flatnonzero(np.abs(of_word).sum(axis=1))
            rows = table[moved].ravel()
            unique, back_to = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), WIDE), np.float32)
            np.add.at(total, back_to, np.repeat(of_word[moved], table.shape[1], axis=0))
            step(0, unique, total * kept[unique])
    check = np.flatnonzero(held_out)
    vectors = model.vectors(known)
    z = []
    for k in range(0, len(check), 64):
        own = [flats[i] for i in check[k : k + 64]]
        z.append(model.pooled(vectors, np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])) @ model.out[:-1] + model.out[-1])
    z, langs = np.concatenate(z), np.array(langs)[check]
    model.shift = {"": threshold(z, y[check])} | {lang: threshold(z[langs == lang], y[check][langs == lang]) for lang in FREQUENT}
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where to cut so that fewest labels are missed, a false alarm counting half as much again as a miss; ties go to the cut nearest
    0. Too few of either label: 0."""
    if (y == 1).sum() < 3 or (y == 0).sum() < 3:
        return 0.0
    points = np.sort(z)
    cuts = np.concatenate([[0.0], (points[1:] + points[:-1]) / 2])
    cuts = cuts[np.abs(cuts) < 6]
    wrong = np.array([1.5 * ((z >= c) & (y == 0)).sum() + ((z < c) & (y == 1)).sum() for c in cuts])
    best = cuts[wrong <= wrong.min()]
    return float(best[np.abs(best).argmin()])


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether a row's label may not be learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (6000, 3000)) -> Classifier:
    """A classifier from the labelled rows that are not held out; of label 0 and 1 at most ``most`` each, by a hash of their ids.

    Rows whose id, label or text is null are passed over; an id with several labels counts as the highest, several texts of an id as the
    first in order. Tables without labels to learn from, or with one label alone, give a classifier that scores everything below 0.5.
    """
    wanted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    order = F.md5(F.col(id_col).cast("string"))
    picked = [r for k in (0, 1) for r in wanted.where(F.col("_label") == k).orderBy(order, id_col).limit(most[k]).collect()]
    if not picked:
        return fit([], [])
    few = docs.sparkSession.createDataFrame(picked, wanted.schema)
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(few), id_col).groupBy(id_col, "_label").agg(F.min(text_col).alias("_text"))
    rows = sorted((r["_text"], r["_label"]) for r in texts.select("_text", "_label").toLocalIterator())
    np.random.default_rng(3).shuffle(rows := [tuple(r) for r in rows])
    return fit([t for t, _ in rows], [int(k) for _, k in rows])


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of each row: the model on the whole text and nothing else. A null text counts as empty."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    known = Words()

    def run(columns: list[pa.Array]) -> list:
        return [columns[0].cast(pa.int64()), model.scores(columns[1].to_pylist(), known).astype(np.float64)]

    return map_columns(docs, schema, run, id_col, text_col, most=AT_ONCE)


def clean(docs: DataFrame, model: Classifier, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with all their columns. Null and empty texts score as the model finds them."""
    names, schema, known = docs.columns, docs.schema, Words()
    place = names.index(text_col)

    def run(batches):
        for batch in (p for whole in batches for p in pieces(whole, AT_ONCE)):
            yield batch.filter(pa.array(model.scores(batch.column(place).to_pylist(), known) < at))
        release()

    return docs.mapInArrow(run, schema)
