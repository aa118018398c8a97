"""SentencePiece BPE, encoded exactly by backtracking over longest matches, and decoded.

A token sequence is what merging would give if and only if every two adjacent tokens, merged again on their own, come out as those
two. So the encoder takes the longest piece that matches (Aho-Corasick), steps to its next shorter prefix while it doesn't fit the
token before it, and goes back where nothing fits; a bit field holds the positions from which the rest was found to fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import map_columns

SPACE = "▁"
#: Pairs of tokens whose check is remembered while one long stretch is encoded; forgetting them changes nothing but the time.
REMEMBERED = 30_000
#: Characters that are encoded at once; a text is cut for that between words only.
AT_ONCE = 1 << 20
#: Stretches of more characters than this are encoded one by one, all others side by side.
LONG = 64
#: Where a word ends and spaces follow.
BETWEEN = re.compile(f"[^{SPACE}]{SPACE}")
#: Ends a stretch; it is in no piece.
END = "\0"
#: A rank later than all.
NEVER = (1 << 31) - 1


def _fields(data: bytes):
    """The fields of a protocol-buffer message: number and value, an int or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Pieces:
    """A model's pieces: ``rank`` orders merges (lower first), ``byte_ids`` are the ids of the 256 bytes."""

    texts: list[str]
    rank: dict[str, int]
    byte_ids: list[int]
    prefix: bool
    ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        import struct

        texts, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
            elif number == 3:
                norm = dict(_fields(value))
                prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only models without normalisation, with escaped spaces, are supported")
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only BPE models are supported")
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == 1}
        by_byte = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == 6}
        order = sorted(normal, key=lambda t: (-scores[normal[t]], normal[t]))
        return cls(texts, {t: r for r, t in enumerate(order)}, [by_byte[f"<0x{b:02X}>"] for b in range(256)], prefix, normal)


class Encoder:
    """Encodes and decodes with one model. A character that is no piece becomes its bytes and never merges.

    ``split`` holds the last merge of every reachable piece (the two it is made of, none for a character) and ``formed`` the rank of
    that merge (-1 for a character). ``plain`` holds pieces that have a part of a later rank than their own; with one of them, two
    tokens are merged again step by step.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.rank = pieces, pieces.rank
        self.split: dict[str, tuple[str, str] | None] = {}
        self.formed: dict[str, int] = {}
        self.plain: set[str] = set()
        for t in sorted(pieces.ids, key=len):
            self._form(t)
        self.reachable = self.split.keys()
        self.ids = {t: pieces.ids[t] for t in self.split}
        self.order = list(self.split)
        self.matcher = ahocorasick.Automaton()
        for k, t in enumerate(self.order):
            self.matcher.add_word(t, k)
        self.matcher.make_automaton()
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.split), None) for t in self.split}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Pairs of characters that stand side by side in some piece; pieces' characters that are no piece themselves never merge.
        self.beside = {t[i : i + 2] for t in self.split for i in range(len(t) - 1)}
        self.byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
        #: Whether no piece has a space after another character: then such places separate words that can be encoded one by one.
        self.by_word = END not in self.split and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in pieces.ids)

    def _form(self, t: str) -> None:
        """Notes how merging makes ``t`` of its characters, if it does; shorter pieces are known."""
        if len(t) == 1:
            self.split[t], self.formed[t] = None, -1
            return
        halves = [(t[:k], t[k:]) for k in range(1, len(t)) if t[:k] in self.split and t[k:] in self.split]
        rank, late = self.rank[t], False
        for a, b in halves:
            if a in self.plain or b in self.plain or max(self.formed[a], self.formed[b]) >= rank:
                late = True
            elif self._meet(a, b, rank):
                self.split[t], self.formed[t] = (a, b), rank
                return
        if late:
            parts, last = list(t), None
            while len(parts) > 1 and (i := self._best(parts)) is not None:
                last = parts[i], parts[i + 1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                self.split[t], self.formed[t] = last, rank
                self.plain.add(t)

    def _best(self, parts: list[str]) -> int | None:
        """Where the pair stands that merges next: the best of all, the leftmost of equals."""
        return min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=(0, None))[1]

    def merged(self, text: str) -> list[str]:
        """Plain merging, step by step."""
        parts = list(text)
        while len(parts) > 1 and (i := self._best(parts)) is not None:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _meet(self, a: str, b: str, until: int) -> bool:
        """Whether ``a`` and ``b`` come to stand side by side when their characters merge, up to merges of rank ``until``.

        Only a merge across their border could prevent it. So the merges at the border are taken back, the latest first: x and y are
        what stands at its two sides, x_until and y_until the ranks at which they merge on. Of equal ranks the left one merges first.
        """
        rank, formed, split = self.rank, self.formed, self.split
        x, y, x_until, y_until = a, b, until, until
        while True:
            across = rank.get(x + y)
            if across is not None and across < x_until and across <= y_until and not (x is a and y is b and across == until):
                return False
            fx, fy = formed[x], formed[y]
            if fx > fy:
                x_until, x = fx, split[x][1]
            elif fy >= 0:
                y_until, y = fy, split[y][0]
            else:
                return True

    def fit(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay these two tokens when they are merged again from their characters."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            plain = a in self.plain or b in self.plain
            known = self.fits[a, b] = self.merged(a + b) == [a, b] if plain else self._meet(a, b, NEVER)
        return known

    def backtrack(self, text: str) -> list[str]:
        """The tokens of a text all of whose characters are pieces."""
        fits, shorter = self.fits, self.shorter
        tokens: list[str] = []
        at, last, size = 0, "", len(text)
        order = self.order
        for _, k in self.matcher.iter_long(text):  # the longest matches, as long as they fit
            piece = order[k]
            if last and not (fit if (fit := fits.get((last, piece))) is not None else self.fit(last, piece)):
                break
            tokens.append(piece)
            at, last = at + len(piece), piece
        else:
            return tokens
        longest: list[str | None] = [None] * size
        for end, k in self.matcher.iter(text):
            longest[end - len(order[k]) + 1] = order[k]  # of those that start at one place, the longest ends last
        failed = 0  # bit i: the text from i on can't be finished with the token before it
        piece = shorter[piece]
        while True:
            while piece is not None:
                then = at + len(piece)
                if not (failed and failed >> then & 1) and (not last or (fit if (fit := fits.get((last, piece))) is not None else self.fit(last, piece))):
                    break
                piece = shorter[piece]
            if piece is None:
                failed |= 1 << at
                tokens.pop()
                at -= len(last)
                piece, last = shorter[last], tokens[-1] if tokens else ""
                continue
            tokens.append(piece)
            if then == size:
                return tokens
            at, last, piece = then, piece, longest[then]

    def part(self, text: str) -> list[int]:
        """The ids of a stretch that no piece reaches over the ends of."""
        own = self.ids
        if (whole := own.get(text)) is not None:
            return [whole]  # a piece that merging makes of its characters is its own token
        if len(text) == 1:
            return [self.pieces.byte_ids[b] for b in text.encode("utf-8", "replace")]
        return [own[t] for t in self.backtrack(text)]

    def encode(self, text: str) -> list[int]:
        """The ids of one text: it is cut wherever two characters stand side by side in no piece."""
        if not text:
            return []
        text = (SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE)
        out, start = [], 0
        for i, two in enumerate(map(add, text, text[1:] + END), 1):
            if two not in self.beside:
                out += self.part(text[start:i])
                start = i
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes that are no UTF-8 become U+FFFD, control pieces nothing, the first space is the added one."""
        texts, byte_of = self.pieces.texts, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([texts[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                else:
                    if run:
                        out.append(run.decode("utf-8", "replace"))
                        run = bytearray()
                    out.append(texts[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        if self.pieces.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


class Table:
    """Numbers under keys, looked up many at once: open addressing, four places or more for each key."""

    def __init__(self, keys: list[int], values: list[int], none: int):
        self.none, self.bits = none, max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, none, np.int32)
        left, held = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self.slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            mine = self.keys[slot] == left
            self.values[slot[mine]] = held[mine]
            left, held, slot = left[~mine], held[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        found = self.keys[slot]
        values = np.where(found == keys, self.values[slot], np.int32(self.none))
        look = np.flatnonzero((found != keys) & (found >= 0))
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[look]]
            hit = found == keys[look]
            values[look[hit]] = self.values[slot[look[hit]]]
            look = look[~hit & (found >= 0)]
        return values


class Batch:
    """The same encoding for many texts at once, with whole arrays in place of single steps.

    Texts are cut into stretches that no piece reaches over the ends of, and each different stretch is encoded once. All of them
    backtrack side by side: a step tries the next piece of each, and those that are done drop out.
    """

    def __init__(self, own: Encoder):
        self.own = own
        at = {t: k for k, t in enumerate(own.order)}
        self.n = len(at)
        get = lambda f, kind=np.int32: np.array([f(t) for t in own.order], kind)
        self.id, self.length, self.formed = get(own.ids.__getitem__), get(len), get(own.formed.__getitem__)
        self.shorter = get(lambda t: at.get(own.shorter[t], -1))
        self.left = get(lambda t: at[own.split[t][0]] if own.split[t] else -1)
        self.right = get(lambda t: at[own.split[t][1]] if own.split[t] else -1)
        self.plain = get(own.plain.__contains__, bool)
        self.pieces = pa.array(own.order, pa.string())
        #: Characters by number, 0 for those that no piece has beside another, and which numbers stand side by side.
        chars = sorted({c for two in own.beside for c in two})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in own.beside:
            self.beside[self.char[ord(a)], self.char[ord(b)]] = True
        # What two pieces merge to: the rank of the merge under the key of both.
        keys, ranks = [], []
        for t, r in own.rank.items():
            for k in range(1, len(t)):
                if (a := at.get(t[:k])) is not None and (b := at.get(t[k:])) is not None:
                    keys.append(a * self.n + b)
                    ranks.append(r)
        self.ranks = Table(keys, ranks, NEVER)
        self._automaton()
        texts = [t.replace(SPACE, " ").encode() if i not in own.byte_of else bytes([own.byte_of[i]]) for i, t in enumerate(own.pieces.texts)]
        self.said = np.frombuffer(b"".join(texts), np.uint8)
        self.said_len = np.array([len(t) for t in texts], np.int64)
        self.said_at = np.cumsum(self.said_len) - self.said_len
        self.begins = np.array([t.startswith(SPACE) for t in own.pieces.texts])

    def _automaton(self) -> None:
        """Aho and Corasick's automaton of all pieces: ``step``, ``fail``, and the pieces that end at each node, the longest first."""
        step: dict[int, int] = {}
        piece, size, parent = [-1], [0], [(0, 0)]
        for k, t in enumerate(self.own.order):
            node = 0
            for n, c in enumerate(t, 1):
                key = node << 16 | int(self.char[ord(c)])
                if (node := step.get(key, -1)) < 0:
                    node = step[key] = len(piece)
                    piece.append(-1)
                    size.append(n)
                    parent.append((key >> 16, key & 0xFFFF))
            piece[node] = k
        fail, link = [0] * len(piece), [0] * len(piece)
        for node in sorted(range(1, len(piece)), key=size.__getitem__):
            above, c = parent[node]
            if above:
                f = fail[above]
                while f and (f << 16 | c) not in step:
                    f = fail[f]
                fail[node] = step.get(f << 16 | c, 0)
            link[node] = fail[node] if piece[fail[node]] >= 0 else link[fail[node]]
        self.step = Table(list(step), list(step.values()), 0)
        self.fail, self.link, self.piece = (np.array(x, np.int32) for x in (fail, link, piece))
        self.ending = np.where(self.piece >= 0, np.arange(len(piece), dtype=np.int32), self.link)

    def longest(self, kinds: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each place of the stretches, which run through the automaton side by side."""
        out = np.full(len(kinds), -1, np.int32)
        at, state = start, np.zeros(len(start), np.int32)
        while len(at):
            c = kinds[at]
            then = self.step.get(state.astype(np.int64) << 16 | c)
            while len(lost := np.flatnonzero((then == 0) & (state > 0))):
                state[lost] = self.fail[state[lost]]
                then[lost] = self.step.get(state[lost].astype(np.int64) << 16 | c[lost])
            state = then
            ending = self.ending[state]
            where = at
            while len(some := np.flatnonzero(ending)):
                ending, where = ending[some], where[some]
                piece = self.piece[ending]
                out[where - self.length[piece] + 1] = piece  # of those that start at one place, the longest ends last
                ending = self.link[ending]
            at = at + 1
            go = np.flatnonzero(at < end)
            at, end, state = at[go], end[go], state[go]
        return out

    def across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two pieces merge with each other; ``NEVER`` if they don't."""
        return self.ranks.get(a.astype(np.int64) * self.n + b)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays these two when merged again; see ``Encoder._meet``."""
        out = np.zeros(len(a), bool)
        odd = self.plain[a] | self.plain[b]
        for i in np.flatnonzero(odd):
            out[i] = self.own.fit(self.own.order[a[i]], self.own.order[b[i]])
        left = np.flatnonzero(~odd)
        x, y = a[left], b[left]
        x_until, y_until = np.full(len(left), NEVER, np.int32), np.full(len(left), NEVER, np.int32)
        while len(left):
            across = self.across(x, y)
            stays = (across >= x_until) | (across > y_until) | (across == NEVER)
            fx, fy = self.formed[x], self.formed[y]
            over = np.maximum(fx, fy) < 0
            out[left[stays & over]] = True
            go = np.flatnonzero(stays & ~over)
            left, x, y, fx, fy, x_until, y_until = (v[go] for v in (left, x, y, fx, fy, x_until, y_until))
            later = fx > fy
            x_until, y_until = np.where(later, fx, x_until), np.where(later, y_until, fy)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return out

    def backtrack(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all stretches in a row, and how many each has."""
        joined = END.join(stretches) + END
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        end = np.cumsum(size + 1) - 1
        start = end - size
        longest = self.longest(self.char[np.frombuffer(joined.encode("utf-32-le"), np.uint32)], start, end)
        failed = np.zeros(len(joined), bool)  # the rest from here on can't be finished with the token before it
        token, before = np.full(len(joined), -1, np.int32), np.full(len(joined), -1, np.int32)
        at, stop = start, end
        last, piece = np.full(len(at), -1, np.int32), longest[at]
        while len(at):
            none = piece < 0
            then = np.where(none, at, at + self.length[piece])
            takes = ~none & ~failed[then]
            ask = np.flatnonzero(takes & (last >= 0))
            takes[ask] = self.fit(last[ask], piece[ask])
            back = np.flatnonzero(none)
            failed[at[back]] = True
            token[at[takes]], before[at[takes]] = piece[takes], last[takes]
            # Those that take the piece go on behind it, those that don't try a shorter one, those without one go back a token.
            next_piece = np.where(takes, longest[then], self.shorter[piece])
            next_last = np.where(takes, piece, last)
            next_at = np.where(takes, then, at)
            came = at[back] - self.length[last[back]]
            next_piece[back], next_last[back], next_at[back] = self.shorter[last[back]], before[came], came
            go = np.flatnonzero(~takes | (then < stop))
            at, stop, last, piece = next_at[go], stop[go], next_last[go], next_piece[go]
        own = np.zeros(len(joined), bool)
        at, stop = start, end
        while len(at):
            own[at] = True
            at = at + self.length[token[at]]
            go = np.flatnonzero(at < stop)
            at, stop = at[go], stop[go]
        counts = np.add.reduceat(own.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        return self.id[token[own]], counts

    def flat(self, portions: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, their spaces replaced, in a row, and how many each has."""
        text = "".join(portions)
        until = np.cumsum([len(t) for t in portions]) - 1
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.char[codes]
        ends = np.append(~self.beside[kind[:-1], kind[1:]], True)
        ends[until] = True
        wide = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        offsets = np.append(np.int32(0), np.cumsum(wide, dtype=np.int32)[ends])
        cut = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(text.encode())).dictionary_encode()
        of_text = np.cumsum(ends)[until] - 1
        del codes, kind, ends, wide, offsets
        each, values = cut.indices.to_numpy(), cut.dictionary
        whole = pc.fill_null(pc.index_in(values, value_set=self.pieces), -1).to_numpy()
        size = pc.utf8_length(values).to_numpy()
        many, few = np.flatnonzero((whole < 0) & (size > 1) & (size <= LONG)), np.flatnonzero((whole < 0) & ((size == 1) | (size > LONG)))
        counts = np.ones(len(values), np.int64)
        ids, counts[many] = self.backtrack(values.take(pa.array(many)).to_pylist())
        singly = [self.own.part(t) for t in values.take(pa.array(few)).to_pylist()]
        counts[few] = [len(x) for x in singly]
        # Each different stretch's tokens once, then each stretch of the texts takes its own.
        first = np.cumsum(counts) - counts
        held = np.empty(int(counts.sum()), np.int32)
        held[first[whole >= 0]] = self.id[whole[whole >= 0]]
        held[spread(first[many], counts[many])] = ids
        held[spread(first[few], counts[few])] = [i for x in singly for i in x]
        sums = np.cumsum(counts[each])
        return held[spread(first[each], counts[each])], np.diff(sums[of_text], prepend=0)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text, a null one taken as empty; long ones are cut between words meanwhile."""
        flats, sizes = [], np.zeros(len(texts) + 1, np.int64)
        waiting: list[tuple[int, str]] = []

        def flush() -> None:
            ids, counts = self.flat([t for _, t in waiting])
            flats.append(ids)
            np.add.at(sizes, np.array([n for n, _ in waiting]) + 1, counts)
            waiting.clear()

        room = 0
        for n, text in enumerate(texts):
            if not text:
                continue
            for portion in self.portions((SPACE if self.own.pieces.prefix else "") + text.replace(" ", SPACE)):
                waiting.append((n, portion))
                room += len(portion)
                if room >= AT_ONCE:
                    flush()
                    room = 0
        if waiting:
            flush()
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flats]), pa.int32()))

    def portions(self, text: str) -> Iterator[str]:
        """``text`` in pieces of about ``AT_ONCE`` characters that end between words."""
        start = 0
        while self.own.by_word and len(text) - start > AT_ONCE and (found := BETWEEN.search(text, start + AT_ONCE)):
            yield text[start : found.start() + 1]
            start = found.start() + 1
        yield text[start:]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids that ``encode`` gave, as ``Encoder.decode`` gives it."""
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        lengths = self.said_len[flat]
        if self.own.pieces.prefix:
            first = offsets[:-1][np.diff(offsets) > 0]
            first = first[self.begins[flat[first]]]
            lengths[first] -= 1
        starts = self.said_at[flat]
        if self.own.pieces.prefix:
            starts[first] += 1
        data = self.said[spread(starts, lengths)]
        bounds = np.append(0, np.cumsum(lengths))[offsets].astype(np.int32)
        texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(bounds), pa.py_buffer(data))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.own.decode(x) for x in ids.to_pylist()], pa.string())
        return texts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, in a row."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[int, Batch] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model."""
    return batch_encoder(model).own


def batch_encoder(model: bytes) -> Batch:
    """The encoder of a model for many texts at once, built once in each worker; it remembers no texts."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Batch(Encoder(Pieces.parse(model)))
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (array of int) and ``decoded`` (string) of each row, by the SentencePiece BPE model at ``model_path``.

    The driver reads the model (a vocabulary file, under 1 MB) and sends it along with the function. No begin or end ids. A null or
    empty text has no ids and decodes to the empty text; texts of any length are encoded whole; null ids, repeated rows and other
    columns pass unseen; an empty table returns no rows.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(columns: list[pa.Array]) -> list:
        own = batch_encoder(model)
        ids = own.encode(columns[1].to_pylist())
        return [columns[0].cast(pa.int64()), ids, own.decode(ids)]

    return map_columns(docs, schema, run, id_col, text_col, most=AT_ONCE)
