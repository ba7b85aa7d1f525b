"""SentencePiece encoding and decoding for models of merge type (BPE), exact: words by merging many at once, long ones by backtracking.

A sequence of tokens is the encoding of a text just if every two neighbours are: if merging their joint text anew gives
the two. So for a long run the encoder takes the longest piece at each place, found by one Aho-Corasick pass, that
fits its predecessor, and falls back on shorter ones; a place from which nothing led on is marked in a bitfield and never
tried again, as the encoding of what precedes it is unique. No merge crosses a place where a word ends and white space
begins unless some piece does; where none does, words are encoded apart and kept in a cache of bounded size. Short words
that the cache lacks are collected and merged side by side in arrays, one merge of each word a step, the very steps of the
plain algorithm.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import common
from palisade.llm.blobs import HELD, enter
from palisade.llm.hashing import U, ranges, starts_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_NEVER = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[i : i + size]
            i += size
        else:
            size = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + size]
            i += size


@dataclass
class Vocabulary:
    """What a model file says: pieces with scores and kinds, and how texts are normalised."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = True
    byte_fallback: bool = False

    @classmethod
    def parse(cls, model: bytes) -> Vocabulary:
        out = cls([], [], [])
        kind = 1
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                kind, out.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models that map characters are not supported")
                out.dummy_prefix, out.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind != 2:
            raise ValueError("the model is not of merge type (BPE)")
        if set(out.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        return out


class Merges:
    """Which two symbols merge into which, and how well: pieces under their numbers, then characters that are only parts of pieces."""

    def __init__(self, score: dict[str, float], number: dict[str, int]) -> None:
        symbol = dict(number)
        after = max(number.values(), default=-1) + 1
        for c in sorted({c for p in score if len(p) > 1 for c in p} - symbol.keys()):
            symbol[c] = after
            after += 1
        self.symbols, self.none = list(symbol), after  # none: a symbol that merges with nothing
        self.numbers = np.array(list(symbol.values()), np.int64)
        chars = {ord(p): k for p, k in symbol.items() if len(p) == 1}
        self.of_char = np.full(max(chars, default=0) + 2, -1, np.int64)
        self.of_char[list(chars)] = list(chars.values())
        levels = {s: k for k, s in enumerate(sorted({s for s in score.values() if s > _NEVER}), 1)}
        self.rank = np.zeros(after + 2, np.int32)  # the last one is that of no merge, -1
        self.rank[[number[p] for p in score]] = [levels.get(s, 0) for s in score.values()]
        pairs = [(a, b, number[p]) for p in score for i in range(1, len(p)) if (a := symbol.get(p[:i])) is not None and (b := symbol.get(p[i:])) is not None]
        left, right, whole = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left * (after + 1) + right
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slots, self.wholes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[at] < 0)
            taken = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[taken]], self.wholes[at[taken]] = keys[taken], whole[taken]
            keys, whole, at = (np.delete(x, taken) for x in (keys, whole, (at + 1) & self.mask))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def into(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that neighbours merge into, -1 for none."""
        keys = left * (self.none + 1) + right
        at = self._slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.wholes[at], -1)
        more = np.flatnonzero((held != keys) & (held >= 0))
        at = at[more]
        while len(more):
            at = (at + 1) & self.mask
            held, wanted = self.slots[at], keys[more]
            found = held == wanted
            out[more[found]] = self.wholes[at[found]]
            on = ~found & (held >= 0)
            more, at = more[on], at[on]
        return out

    def merge(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of about one length, which start at ``starts``, merged as ``Encoder.merge`` does: their symbols one after the other, and how many each has."""
        width = int(sizes.max()) + 2
        column = np.arange(-1, width - 1)
        inside = (column >= 0) & (column < sizes[:, None])
        table = np.full(inside.shape, self.none)
        table[inside] = symbols[ranges(starts, sizes)]
        whole = np.full(inside.shape, -1, np.int64)
        whole[:, :-1] = self.into(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(sizes), -1)
        score = self.rank[whole]
        base = np.arange(len(sizes)) * width
        before, after = np.arange(table.size) - 1, np.arange(table.size) + 1
        flat, wholes, scores = table.ravel(), whole.ravel(), score.ravel()
        while True:
            at = base + score.argmax(axis=1)  # the first of equals
            at = at[scores[at] > 0]
            if not len(at):
                break
            gone, left = after[at], before[at]
            right = after[gone]
            made = wholes[at]
            flat[at], flat[gone], scores[gone] = made, -1, 0
            after[at], before[right] = right, at
            wholes[at] = new = self.into(made, flat[right])
            scores[at] = self.rank[new]
            wholes[left] = new = self.into(flat[left], made)
            scores[left] = self.rank[new]
        kept = (table >= 0) & (table < self.none)
        return table[kept], kept.sum(axis=1)


#: Characters up to which words are merged many at once, words of one table, and words that are prepared together.
SHORT, TABLE_WORDS, BATCH_WORDS = 64, 2048, 1 << 15


class Encoder(dict):
    """Encodes texts; as a dict it maps a word to its number in the cache of encoded words."""

    def __init__(self, model: bytes, cached_words: int = 150_000, cached_chars: int = 2_500_000) -> None:
        super().__init__()
        v = self.vocabulary = Vocabulary.parse(model)
        self.most_words, self.most_chars = cached_words, cached_chars
        self.score = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k == NORMAL}
        self.number = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == NORMAL}
        self.unknown = v.kinds.index(UNKNOWN) if UNKNOWN in v.kinds else 0
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        self.finder = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                self.finder.add_word(piece, (1 - len(piece), piece))
        self.finder.make_automaton()
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        joined = "".join(sorted({c for p in self.score if len(p) > 1 for c in p} - {SPACE}))
        self.words = re.compile(r"(?s).+" if crossing else rf"(?s){SPACE}*[{re.escape(joined)}]+|{SPACE}+|." if joined else r"(?s).")
        self.fits: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, tuple | None] = {}
        self.strings = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(v.pieces, v.kinds, strict=True)]
        for b, i in self.byte.items():
            if b < 128:
                self.strings[i] = chr(b)
        self.high = np.zeros(len(v.pieces), bool)
        self.high[[i for b, i in self.byte.items() if b >= 128]] = True
        self.value = {i: b for b, i in self.byte.items()}
        self.merges = Merges(self.score, self.number)
        ids = [self.ids_of(p) for p in self.merges.symbols]
        self.spelled = np.array([i for x in ids for i in x], np.int32)
        self.spells = np.zeros((2, self.merges.none), np.int64)  # of each symbol: its first id in spelled, and how many it has
        self.spells[1, self.merges.numbers] = [len(x) for x in ids]
        self.spells[0, self.merges.numbers] = starts_of(self.spells[1, self.merges.numbers])
        self._renew()

    def _renew(self) -> None:
        self.clear()
        self.wanted: list[str] = []
        self.chars = 0
        self.flat, self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def turn(self) -> None:
        """To be called between texts: the cache holds at most the allowed size, and what one call adds."""
        if len(self) > self.most_words or self.chars > self.most_chars:
            self._renew()

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.wanted.append(word)
        return k

    def _settle(self) -> None:
        """Encode the words that have got a number only."""
        wanted, self.wanted = self.wanted, []
        flat, begin, sizes, total = [self.flat], [self.begin], [self.sizes], len(self.flat)
        for low in range(0, len(wanted), BATCH_WORDS):
            ids, counts, order = self.encode_words(wanted[low : low + BATCH_WORDS])
            at = np.empty(len(order), np.int64)
            at[order] = starts_of(counts) + total
            size = np.empty(len(order), np.int64)
            size[order] = counts
            flat.append(ids)
            begin.append(at)
            sizes.append(size)
            total += len(ids)
        self.chars += sum(map(len, wanted))
        self.flat, self.begin, self.sizes = np.concatenate(flat), np.concatenate(begin), np.concatenate(sizes)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words one after the other, how many each has, and which words they are: short ones come by length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero(lengths <= SHORT)
        points = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32)
        of_char = self.merges.of_char
        symbols = of_char[np.minimum(points, len(of_char) - 1)]
        starts = starts_of(lengths[some])
        if len(some):
            known = np.minimum.reduceat(symbols, starts) >= 0
            some, starts = some[known], starts[known]
        by_length = np.argsort(lengths[some], kind="stable")
        some, starts = some[by_length], starts[by_length]
        ids, counts = [], []
        for low in range(0, len(some), TABLE_WORDS):
            rows = slice(low, low + TABLE_WORDS)
            made, parts = self.merges.merge(symbols, starts[rows], lengths[some[rows]])
            spelt = self.spells[1, made]
            ids.append(self.spelled[ranges(self.spells[0, made], spelt)])
            counts.append(np.add.reduceat(spelt, starts_of(parts)))
        rest = np.setdiff1d(np.arange(len(words)), some)
        for i in rest.tolist():
            own = [x for piece in self.backtrack(words[i]) for x in self.ids_of(piece)]
            ids.append(np.array(own, np.int32))
            counts.append(np.array([len(own)]))
        return np.concatenate(ids), np.concatenate(counts), np.concatenate([some, rest])

    def ids_of(self, piece: str) -> list[int]:
        i = self.number.get(piece)
        if i is not None:
            return [i]
        if self.vocabulary.byte_fallback:
            return [self.byte[b] for b in piece.encode()]
        return [self.unknown]

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """The plain algorithm: merge the two neighbours whose piece scores best, the leftmost of equals, until none is left.

        ``steps`` gets the score of each merge with the first and the last part after it.
        """
        parts = list(text)
        scores = [self.score.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(scores):
                scores[i] = self.score.get(parts[i] + parts[i + 1], _NEVER)
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    def history(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece is merged from its characters: scores, and the first and last parts over time; None if it never is."""
        if piece not in self.histories:
            steps: list = []
            whole = self.merge(piece, steps) == [piece]
            self.histories[piece] = ([x[0] for x in steps] + [_NEVER], [piece[0], *(x[1] for x in steps)], [piece[-1], *(x[2] for x in steps)]) if whole else None
        return self.histories[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` ('' at the start): whether merging both anew gives the two again.

        Both are merged side by side, best score first; they don't fit once a merge across the border would come next.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 100_000:
                self.fits.clear()
            known = self.fits[left, right] = self._remerge(left, right)
        return known

    def _remerge(self, left: str, right: str) -> bool:
        if left + right in self.score and left:
            return False
        r = self.history(right)
        if r is None or not left:
            return r is not None
        a, _, ends = self.history(left)
        b, heads, _ = r
        i = j = 0
        get = self.score.get
        across = get(ends[0] + heads[0], _NEVER)
        while True:
            if across > a[i] and across >= b[j]:
                return False
            if a[i] >= b[j]:
                if a[i] == _NEVER:
                    return True
                i += 1
            else:
                j += 1
            across = get(ends[i] + heads[j], _NEVER)

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text, as ``merge`` would find them."""
        n = len(text)
        if not n:
            return []
        longer: dict[int, list[str]] = {}
        for end, (back, piece) in self.finder.iter(text) if len(self.finder) else ():
            if end + back in longer:
                longer[end + back].append(piece)
            else:
                longer[end + back] = [piece]
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        tried: list[int] = []
        fits, pos, last = self.fits, 0, ""
        options = longer.get(0, ())
        k = len(options)  # how many options are left beside the single character
        while True:
            while k >= 0:
                piece = options[k - 1] if k else text[pos]
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    good = fits.get((last, piece))
                    if good if good is not None else self.compatible(last, piece):
                        break
                k -= 1
            if k >= 0:
                out.append(piece)
                tried.append(k)
                pos, last = end, piece
                if pos == n:
                    return out
                options = longer.get(pos, ())
                k = len(options)
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                k = tried.pop() - 1
                last = out[-1] if out else ""
                options = longer.get(pos, ())

    def normal(self, text: str) -> str:
        if self.vocabulary.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)

    def codes(self, text: str) -> np.ndarray:
        """The cache numbers of the words of a text."""
        return np.fromiter(map(self.__getitem__, self.words.findall(self.normal(text))), np.int64)

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that cache numbers stand for, and how many each has."""
        if self.wanted:
            self._settle()
        counts = self.sizes[codes]
        return self.flat[ranges(self.begin[codes], counts)], counts

    def encode(self, text: str) -> list[int]:
        self.turn()
        return self.expand(self.codes(text))[0].tolist()

    def decode(self, ids: list[int], high: bool | None = None) -> str:
        """The text of ids. Bytes that aren't UTF-8 become U+FFFD each, as does no other id."""
        if high is None:
            high = bool(self.high[ids].any()) if len(ids) else False
        if not high:
            text = "".join(map(self.strings.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in [*ids, -1]:
                if i in self.value:
                    held.append(self.value[i])
                    continue
                if held:
                    parts.append(_utf8(bytes(held)))
                    held.clear()
                if i >= 0:
                    parts.append(self.strings[i])
            text = "".join(parts)
        first = next((self.vocabulary.pieces[i] for i in ids if self.vocabulary.kinds[i] != CONTROL), "")
        return text[1:] if self.vocabulary.dummy_prefix and first.startswith(SPACE) else text


def _utf8(data: bytes) -> str:
    out = []
    while data:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


def encoder(model: bytes) -> Encoder:
    """The encoder of a model, made once in each process and kept until the process serves another operator."""
    held = HELD.setdefault("pieces", {})
    if model not in held:
        held[model] = Encoder(model)
    return held[model]


#: Rows and bytes of text that are encoded at once, but for a single longer text.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 19


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where to cut a batch: first row and number of rows of each slice."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        before = ends[row - 1] if row else 0
        rows = min(max(1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - row), SLICE_ROWS, len(ends) - row)
        yield row, rows
        row += rows


def _run(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces")
        e = encoder(model.value)
        for whole in batches:
            for low, rows in _slices(whole.column(1)):
                batch = whole.slice(low, rows)
                e.turn()
                texts = batch.column(1).to_pylist()
                codes = [e.codes(t or "") for t in texts]
                sizes = np.array([len(c) for c in codes])
                ids, counts = e.expand(np.concatenate(codes))
                ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                high = np.concatenate([[0], np.cumsum(e.high[ids])])[ends]
                every = ids.tolist()
                decoded = [None if t is None else e.decode(every[ends[i] : ends[i + 1]], bool(high[i + 1] > high[i])) for i, t in enumerate(texts)]
                null = pa.array([t is None for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=null), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, the token ``ids`` of the whole text, and the text ``decoded`` from them again.

    A null text gives null in both, an empty one no ids and an empty text. Every row is encoded by itself, so repeated rows
    give equal results; other columns are ignored, whatever their names; an empty table gives no rows. Ids must be whole
    numbers. A run of characters without a break, some hundred bytes of memory each, has to fit into a task; texts of any
    length with breaks do. Models that map characters or have user-defined pieces are refused. The driver reads the model
    and sends it to the tasks.
    """
    common.ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    Vocabulary.parse(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_run(shared), "doc_id long, ids array<int>, decoded string")
