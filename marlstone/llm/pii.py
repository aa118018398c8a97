"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to distant similar tokens.

The field's variables are a document's tokens with a digit or an at sign. Neighbouring ones share chain potentials; tokens with equal
or similar content anywhere in the document are tied to one entity each, a variable without evidence of its own, by skip potentials. So
any two of them are two edges apart, however far they stand in the text. Potentials are trained piece by piece on spans that the
patterns find; loopy belief propagation over chain and skip edges gives each token's label. Its spans are added where no pattern
found one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import map_columns

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds what the plain one of its kind finds, but starts a run of digits once: long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def emails(text: str) -> list[Span]:
    """Leftmost matches that don't overlap: every at sign with what may stand before and after it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, 0, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
        free = max(free, 0)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(len, DIGIT.findall(m[0]))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


OUT = len(KINDS)
LABELS = OUT + 1
#: How many observations each token has.
OBSERVED = 8


def observations(token: str, before: str, after: str) -> list[str]:
    """What a token's own potential sees: its shape and its neighbours', roughly."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), token))[:24]
    digits = sum(c.isdigit() for c in token)
    return [f"s{shape}", f"d{min(digits, 20)}", f"@{'@' in token}", f".{min(token.count('.'), 4)}", f"f{token[0] if not token[0].isalnum() else 'x'}", f"b{before}", f"a{after}", "1"]


def content(token: str) -> list[str]:
    """Keys that similar tokens share: all its letters and digits, the part before an at sign, and its last seven digits. A key of fewer
    than five characters ties nothing: single digits stand everywhere."""
    plain = lambda x: re.sub(r"[\W_]+", "", x).lower()
    digits = re.sub(r"[^0-9]+", "", token)
    keys = {plain(token), plain(token.split("@")[0])} | ({f"#{digits[-7:]}"} if len(digits) >= 7 else set())
    return sorted(k for k in keys if len(k) >= 5)


@dataclass
class Graph:
    """Tokens of some documents: which document, start, end, what each sees; ``chain`` edges between tokens, ``skip`` edges from a token
    to an entity, the entities numbered after the tokens."""

    where: list[tuple[int, int, int]]
    seen: list[list[str]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    entities: int = 0


def graph(texts: list[tuple[int, str]]) -> Graph:
    """An entity stands for each key that two tokens or more of a document share."""
    g = Graph([], [], [], [])
    shared: list[list[int]] = []
    for doc, text in texts:
        keys: dict[str, list[int]] = {}
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        for k, (a, b) in enumerate(found):
            me, token = len(g.where), text[a:b]
            near = lambda i, j: 0 <= i and j < len(found) and found[j][0] - found[i][1] <= 1
            before = text[found[k - 1][0]][:1] if near(k - 1, k) else ""
            after = text[found[k + 1][0]][:1] if near(k, k + 1) else ""
            g.where.append((doc, a, b))
            g.seen.append(observations(token, "9" if before.isdigit() else before, "9" if after.isdigit() else after))
            if near(k - 1, k):
                g.chain.append((me - 1, me))
            for key in content(token):
                keys.setdefault(key, []).append(me)
        shared += [own for own in keys.values() if len(own) > 1]
    g.skip = [(i, len(g.where) + e) for e, own in enumerate(shared) for i in own]
    g.entities = len(shared)
    return g


@dataclass
class Field:
    """Log potentials: of each observation (``own``), of labels of neighbours (``chain``) and of similar tokens (``skip``)."""

    own: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, g: Graph) -> np.ndarray:
        zero = np.zeros(LABELS)
        return np.array([sum((self.own.get(o, zero) for o in seen), zero) for seen in g.seen]).reshape(-1, LABELS)

    def marginals(self, g: Graph, rounds: int = 300, damp: float = 0.3, settled: float = 1e-4) -> np.ndarray:
        """The tokens' beliefs by loopy propagation: all messages at once, damped, until they settle. A chain or cycle that has not
        settled after ``rounds`` is taken as it is then; near each token messages have long met."""
        unary = np.concatenate([self.unary(g), np.zeros((g.entities, LABELS))])
        edges = np.array([*g.chain, *g.skip], np.int64).reshape(-1, 2)
        if not len(edges):
            return softmax(unary)  # no edge, so no entity
        potential = np.concatenate([np.repeat(self.chain[None], len(g.chain), axis=0), np.repeat(self.skip[None], len(g.skip), axis=0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        opposite = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            cavity = belief[source] - message[opposite]
            new = np.logaddexp.reduce(cavity[:, :, None] + potential, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = damp * message + (1 - damp) * new
            if moved < settled:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        return softmax(belief[: len(g.where)])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def labels_of(g: Graph, spans: dict[int, list[Span]]) -> np.ndarray:
    """Each token's label by the pattern spans that it overlaps, the first of them; OUT if there is none."""
    out = np.full(len(g.where), OUT)
    for i, (doc, a, b) in enumerate(g.where):
        hits = [s for s in spans.get(doc, ()) if s[0] < b and s[2] > a]
        if hits:
            out[i] = hits[0][1]
    return out


def fit(texts: list[str], passes: int = 30, rate: float = 0.5) -> Field:
    """Piecewise training on pattern spans: the tokens' own potentials by logistic regression, edges by how much oftener two labels
    meet there than by chance.

    A token outside all spans that shares an entity with one inside is no example of either label: that it is personal data as well is
    what the field is there to find out. Texts without tokens, and no texts, give a field that labels nothing.
    """
    g = graph(list(enumerate(texts)))
    y = labels_of(g, {i: patterns(t) for i, t in enumerate(texts)})
    members: dict[int, list[int]] = {}
    for i, entity in g.skip:
        members.setdefault(entity, []).append(i)
    open_ = np.zeros(len(y), bool)
    for own in members.values():
        if (y[own] != OUT).any():
            open_[[i for i in own if y[i] == OUT]] = True
    names = sorted({o for seen in g.seen for o in seen})
    number = {o: i for i, o in enumerate(names)}
    own = np.zeros((len(names), LABELS))
    x = np.array([[number[o] for o in seen] for seen in g.seen], np.int64).reshape(len(g.seen), OBSERVED)[~open_]
    known = y[~open_]
    sums = np.full_like(own, 1e-2)
    for _ in range(passes if len(x) else 0):
        error = softmax(own[x].sum(axis=1))
        error[np.arange(len(known)), known] -= 1
        slope = 1e-3 * own * len(known) / max(len(names), 1)
        np.add.at(slope, x.ravel(), np.repeat(error, x.shape[1], axis=0))
        sums += slope**2
        own -= rate * slope / np.sqrt(sums)
    share = (np.bincount(known, minlength=LABELS) + 1) / (len(known) + LABELS)

    def pair(met: np.ndarray, alike: float) -> np.ndarray:
        # What wasn't seen counts as by chance; similar tokens are taken to agree nearly always from the start.
        met = met + 5 * (np.outer(share, share) * (1 - alike) + np.diag(share) * alike)
        return np.clip(np.log(met / met.sum()) - np.log(np.outer(share, share)), -4, 4)

    beside, together = np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    for i, j in g.chain:
        if not (open_[i] or open_[j]):
            beside[y[i], y[j]] += 0.5
            beside[y[j], y[i]] += 0.5
    for group in members.values():  # of each entity the pairs of its tokens, as many as it has tokens in all
        n = np.bincount(y[[i for i in group if not open_[i]]], minlength=LABELS)
        if n.sum() > 1:
            together += (np.outer(n, n) - np.diag(n)) / (n.sum() - 1)
    return Field(dict(zip(names, own, strict=True)), pair(beside, 0.0), pair(together, 0.95))


def learn(docs: DataFrame, text_col: str = "text", most: int = 2000) -> Field:
    """A field from at most ``most`` different texts with a digit or an at sign, those whose hash comes first. Null texts are passed over;
    an empty table gives a field that adds nothing."""
    # Hashes first: were texts ranked, every task would send the driver its own first ones.
    able = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("o"), F.col(text_col).alias("t"))
    first = docs.sparkSession.createDataFrame(able.select("o").distinct().orderBy("o").limit(most).collect(), "o long")
    texts = able.join(F.broadcast(first), "o").groupBy("o").agg(F.min("t").alias("t")).orderBy("o")
    return fit([r["t"] for r in texts.collect()])


def spans(texts: list[str], field: Field, sure: float = 0.5) -> tuple[list[list[Span]], list[list[Span]]]:
    """For each text the pattern spans, and all: also runs of tokens that the field labels alike, where no pattern span overlaps them
    and nothing in them speaks against their kind."""
    base = [patterns(t) for t in texts]
    g = graph([(i, t) for i, t in enumerate(texts) if DIGIT.search(t) or "@" in t])
    added: list[list[Span]] = [[] for _ in texts]
    if g.where:
        p = field.marginals(g)
        chained = {b: a for a, b in g.chain}
        label = np.where(p[:, :OUT].max(axis=1) >= sure, p[:, :OUT].argmax(axis=1), OUT)
        open_: Span | None = None
        at = -1
        for i, (doc, a, b) in enumerate(g.where):
            if open_ and chained.get(i) == at and label[i] == open_[1] and not any(s[0] < b and s[2] > a for s in base[doc]):
                open_ = added[doc][-1] = (open_[0], open_[1], b)
                at = i
                continue
            open_ = None
            if label[i] != OUT and not any(s[0] < b and s[2] > a for s in base[doc]):
                open_, at = (a, int(label[i]), b), i
                added[doc].append(open_)
    every = [sorted([*b, *(s for s in (trimmed(t, x) for x in own) if able(t[s[0] : s[2]], s[1]))]) for t, b, own in zip(texts, base, added, strict=True)]
    return base, every


def able(said: str, kind: int) -> bool:
    """Whether a span could be of its kind: a card's digits pass the check sum, an address has four parts, a phone number seven digits."""
    digits = "".join(DIGIT.findall(said))
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "ip":
        return bool(IP.search(said)) and all(int(x) <= 255 for x in IP.search(said)[0].split(".")[:4] if len(x) < 9)
    if KINDS[kind] == "phone":
        return 7 <= len(digits) <= 15
    return sum(c.isalnum() for c in said) >= 5


def trimmed(text: str, span: Span) -> Span:
    """A span without the punctuation around it."""
    a, kind, b = span
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
        b -= 1
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    return a, kind, b


FOUND = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))) for n in ("base", "spans")]])


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``spans`` of each row: arrays of (kind, start, end), in code points, the end exclusive, by start and kind.

    ``base`` are the patterns' spans, ``spans`` these and the field's. A null text counts as empty and has none; texts are searched
    whole; null ids, repeated rows and other columns change nothing; an empty table returns no rows.
    """

    def run(columns: list[pa.Array]) -> list:
        base, every = spans([t or "" for t in columns[1].to_pylist()], field)
        rows = lambda found: [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in found]
        return [columns[0].cast(pa.int64()), rows(base), rows(every)]

    return map_columns(docs, FOUND, run, id_col, text_col)
