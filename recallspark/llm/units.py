"""Token ids of many texts at once, given by the tokenizer libraries unit by unit.

Both libraries cut a text into units that never share a token (a word with its leading space, a run
of digits, ...). The units of a batch are found and hashed with array operations; each distinct unit
is given to the library once and kept in a table, and a unit found by its hash is compared with the
kept one character by character. Texts whose units the rules below do not settle go to the library
whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points below this have had the same classes in every Unicode version in use.
SETTLED = 0x530
_MULT, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _classes() -> np.ndarray:
    out = np.full(SETTLED, OTHER, np.uint8)
    for c in range(SETTLED):
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if chr(c) in "\t\n\v\f\r \xa0" else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return out


CLASSES = _classes()


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def byte_level_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the units of byte-level BPE start. ``first`` marks the first character of each text."""
    n = len(cp)
    kind = CLASSES[np.minimum(cp, SETTLED - 1)]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = run & ~first & (kind != SPACE)
    after[1:] &= kind[:-1] == SPACE
    after = np.flatnonzero(after)  # words behind white space: its last character opens a unit
    start[after[cp[after - 1] == 0x20]] = False
    start[after - 1] = True
    tick = np.flatnonzero(start & (cp == 0x27))
    tick = tick[tick + 1 < n]
    tick = tick[~first[tick + 1] & (kind[tick + 1] == LETTER)]
    if len(tick):
        one = cp[tick + 1]
        at2 = np.minimum(tick + 2, n - 1)
        two = np.where((tick + 2 < n) & ~first[at2], cp[at2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | \
               ((one == ord("l")) & (two == ord("l")))
        for at, k in ((tick[short], 1), (tick[pair & ~short], 2)):
            start[at + 1] = False
            end = at + 1 + k
            end = end[end < n]
            start[end[~first[end] & (kind[end] == LETTER)]] = True
    return start


def space_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the units of SentencePiece BPE start: at runs of the space sign."""
    gap = cp == 0x20
    start = gap.copy()
    start[1:] &= ~gap[:-1]
    return start | first


class Units:
    """Distinct units of text and the ids that the library gives them."""

    def __init__(self, encode, starts, max_units: int = 1 << 20):
        self.encode, self.starts, self.max_units = encode, starts, max_units
        self.bits = max(4, (2 * max_units - 1).bit_length())
        self.powers = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.hash = np.zeros(1024, np.uint64)
        self.at = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.id_at = np.zeros(1024, np.int64)
        self.id_size = np.zeros(1024, np.int64)
        self.chars, self.n_chars = np.zeros(4096, np.uint32), 0
        self.ids, self.n_ids = np.zeros(4096, np.uint32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), a.dtype)
        out[:len(a)] = a
        return out

    def _hashes(self, cp: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(cp):
            n = len(cp) + 1
            step = np.full(n, _MULT, np.uint64)
            step[0] = 1
            self.powers = np.cumprod(step)
            step[1:] = pow(_MULT, -1, 1 << 64)
            self.back = np.cumprod(step)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(0x1F3)) * np.uint64(_MIX) * self.powers[:len(cp)], out=total[1:])
        h = (total[at + size] - total[at]) * self.back[at]
        h ^= size.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return h * np.uint64(_MIX)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            unit = self.slot[at[todo]]
            hit = (unit >= 0) & (self.hash[unit] == h[todo])
            out[todo[hit]] = unit[hit]
            todo = todo[(unit >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, first_unit: int) -> None:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = (first_unit + free).astype(np.int32)
            todo = todo[self.slot[at[todo]] != first_unit + todo]
            at[todo] = (at[todo] + 1) & mask

    def _add(self, h: np.ndarray, cp: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        whole = cp.tobytes().decode("utf-32-le", "surrogatepass")
        words = [whole[a:b] for a, b in zip(at.tolist(), (at + size).tolist())]
        got = self.encode(words)
        n, k = self.n, len(words)
        for name in ("hash", "at", "size", "id_at", "id_size"):
            setattr(self, name, self._room(getattr(self, name), n + k))
        lengths = np.fromiter(map(len, got), np.int64, k)
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(lengths.sum()))
        self.ids = self._room(self.ids, self.n_ids + len(flat))
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.id_at[n:n + k], self.id_size[n:n + k] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.n_ids += len(flat)
        chars = cp[_ranges(at, size)]
        self.chars = self._room(self.chars, self.n_chars + len(chars))
        self.chars[self.n_chars:self.n_chars + len(chars)] = chars
        self.at[n:n + k], self.size[n:n + k] = self.n_chars + np.cumsum(size) - size, size
        self.n_chars += len(chars)
        self.hash[n:n + k] = h
        self.n += k
        self._insert(h, n)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where the ids of each text start (one more at the end)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = code_points(texts)
        begin = np.cumsum(lengths) - lengths
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(len(cp), bool)
        first[begin[lengths > 0]] = True
        at = np.flatnonzero(self.starts(cp, first))
        size = np.diff(np.append(at, len(cp)))
        h = self._hashes(cp, at, size)
        unit = self._find(h)
        if (unit < 0).any():
            if self.n + len(np.unique(h[unit < 0])) > self.max_units:
                self.clear()
                unit[:] = -1
            new = np.flatnonzero(unit < 0)
            _, pick = np.unique(h[new], return_index=True)
            new = new[np.sort(pick)]
            if len(new) > self.max_units:  # a batch with more units than the table holds
                self.max_units = len(new)
                self.bits = (2 * len(new)).bit_length()
                self.clear()
            self._add(h[new], cp, at[new], size[new])
            unit = self._find(h)
        same = self.size[unit] == size
        if same.all():
            same = np.logical_and.reduceat(self.chars[_ranges(self.at[unit], size)] == cp, at)
        elif same.any():
            long = np.flatnonzero(same)
            equal = self.chars[_ranges(self.at[unit[long]], size[long])] == cp[_ranges(at[long], size[long])]
            same[long] = np.logical_and.reduceat(equal, np.cumsum(size[long]) - size[long])
        counts = self.id_size[unit]
        ids = self.ids[_ranges(self.id_at[unit], counts)]
        ends = np.cumsum(counts)
        # units before each text give where its ids start
        of = np.searchsorted(at, begin, side="left")
        offsets = np.append(np.where(of > 0, ends[np.maximum(of, 1) - 1], 0), ends[-1])
        if not same.all():  # two units with one hash: the library takes the texts that hold them
            bad = np.unique(np.searchsorted(begin + lengths, at[~same], side="right"))
            return self._mended(texts, ids, offsets, bad)
        return ids, offsets

    def _mended(self, texts, ids, offsets, bad):
        """Each unit of the texts ``bad`` is given to the library alone."""
        own = []
        for i in bad.tolist():
            cp = code_points([texts[i]])
            first = np.zeros(len(cp), bool)
            first[0] = True
            cut = np.append(np.flatnonzero(self.starts(cp, first)), len(cp)).tolist()
            own.append([x for y in self.encode([texts[i][a:b] for a, b in zip(cut, cut[1:])]) for x in y])
        return _with_own(len(texts), ids, offsets, bad.tolist(), own)


def _with_own(n: int, ids: np.ndarray, offsets: np.ndarray, which: list[int], own: list) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts ``which`` exchanged for ``own``."""
    if not which:
        return ids, offsets
    got = {i: np.asarray(x, np.uint32) for i, x in zip(which, own)}
    parts = [got[i] if i in got else ids[offsets[i]:offsets[i + 1]] for i in range(n)]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ..., at[1], ... : ``size[i]`` numbers from each ``at[i]``."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class ByteBpe:
    """Ids of the ``tokenizers`` library for a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str, max_units: int = 1 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units = Units(self._encode, byte_level_starts, max_units)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Words of letters with a leading space are encoded many to a text, the rest each alone."""
        plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        out: list = [None] * len(words)
        for k in range(0, len(plain), 500):
            part = plain[k:k + 500]
            e = self.library.encode("".join(words[i] for i in part), add_special_tokens=False)
            ids, word = e.ids, np.array(e.word_ids)
            cut = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(ids)).tolist()
            if len(cut) != len(part) + 1:
                continue
            for j, i in enumerate(part):
                out[i] = ids[cut[j]:cut[j + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([words[i] for i in rest])):
            out[i] = x
        return out

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp = code_points(texts)
        odd = set(np.flatnonzero([any(s in t for s in self.special) for t in texts]).tolist())
        strange = np.flatnonzero((cp >= SETTLED) | ((cp >= 0x1C) & (cp < 0x20)) | (cp == 0x85))
        if len(strange):
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            odd |= set(np.unique(np.searchsorted(ends, strange, side="right")).tolist())
        if not odd:
            return self.units.ids_of(texts)
        ids, offsets = self.units.ids_of(["" if i in odd else t for i, t in enumerate(texts)])
        order = sorted(odd)
        return _with_own(len(texts), ids, offsets, order, self._whole([texts[i] for i in order]))


class SentencePieceBpe:
    """Ids of the ``sentencepiece`` library for a BPE model with a dummy prefix and no other rewriting."""

    def __init__(self, path: str, max_units: int = 1 << 18):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.units = Units(self._units, space_starts, max_units)
        self.space = [self.library.piece_to_id("▁")]

    def _units(self, words: list[str]) -> list[list[int]]:
        """The library puts a space before what it gets, but not before nothing."""
        return [x if w != " " else self.space for w, x in zip(words, self._whole([w[1:] for w in words]))]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if "▁" in t]  # the library's own sign for a space
        ids, offsets = self.units.ids_of([" " + t if t and "▁" not in t else "" for t in texts])
        return _with_own(len(texts), ids, offsets, odd, self._whole([texts[i] for i in odd]))


_MADE: dict = {}


def tokenizer(kind: type, path: str):
    """One tokenizer for each Python worker and file."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]
