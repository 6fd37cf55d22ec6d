"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a byte string the encoding is unique, and so is its last
token.  It is enough to keep that one token per prefix: the encoding is read
off backwards, appended bytes only need new table entries, and after an edit
the tables of the untouched prefix stay valid.

A token may follow another one exactly when no merge across their border would
have happened before the merges that build the two tokens.  ``follows`` decides
that from the merge trees alone and remembers its answers.
"""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np
import pandas as pd
import regex

# The pattern that cuts a text before the merges.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The endings that pattern keeps together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
NEVER = 1 << 60
#: Remembered pieces and pairs of tokens of one worker; beyond it the memory is emptied.
REMEMBERED = 400_000
#: Characters that are cut at a time; bounds a worker's memory whatever the batch.
CHUNK_CHARS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its id in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixEncoder:
    """Encodes bytes without special tokens, exactly as repeated lowest-rank merging does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.texts = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}
        self._pieces: dict[bytes, tuple[int, ...]] = {}
        self._kinds = _ascii_kinds()

    # -- the merge trees ---------------------------------------------------
    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token in self._parts:
            return self._parts[token]
        text, found = self.texts[token], None
        if len(text) > 1:
            pieces = [text[i : i + 1] for i in range(len(text))]
            while len(pieces) > 2:
                best, at = NEVER, -1
                for k in range(len(pieces) - 1):
                    rank = self.ranks.get(pieces[k] + pieces[k + 1], NEVER)
                    if rank < best and rank < token:
                        best, at = rank, k
                if at < 0:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            if len(pieces) == 2:
                found = (self.ranks[pieces[0]], self.ranks[pieces[1]])
        self._parts[token] = found
        return found

    def reachable(self, token: int) -> bool:
        """Whether merging can make this token at all."""
        return len(self.texts[token]) == 1 or self.parts(token) is not None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) along one edge of the tree."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            both = self.parts(token)
            if both is None:
                return out
            taken, token = token, both[side]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left right`` stays two tokens when their bytes are encoded together."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is not None:
            return known
        rights = [x for x in self._spine(left, 1)]
        lefts = [x for x in self._spine(right, 0)]
        i, j, ok = len(rights) - 1, len(lefts) - 1, True
        while True:
            (a, a_taken), (b, b_taken) = rights[i], lefts[j]
            rank = self.ranks.get(self.texts[a] + self.texts[b])
            # Equal ranks merge from the left: a is taken up before the border
            # merges, but the border merges before b is taken up.
            if rank is not None and rank < a_taken and rank <= b_taken:
                ok = False
                break
            if i == 0 and j == 0:
                break
            if a_taken <= b_taken and i > 0:
                i -= 1
            else:
                j -= 1
        if len(self._follows) > 4 * REMEMBERED:
            self._follows.clear()
        self._follows[key] = ok
        return ok

    # -- the table of last tokens -------------------------------------------
    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Appends to ``last`` the last token of each prefix of ``data`` that it lacks."""
        get, follows, texts, longest = self.ranks.get, self.follows, self.texts, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if self.reachable(token):
                        break
                elif follows(last[start - 1], token) and self.reachable(token):
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
            last.append(token)
        return last

    def read(self, last: list[int]) -> tuple[int, ...]:
        """The encoding, from the table of last tokens."""
        out, at, texts = [], len(last), self.texts
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(texts[token])
        return tuple(reversed(out))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece, remembered."""
        ids = self._pieces.get(data)
        if ids is None:
            ids = self.read(self.extend(data, []))
            if len(self._pieces) > REMEMBERED:
                self._pieces.clear()
            if len(data) <= 64:
                self._pieces[data] = ids
        return ids

    @cached_property
    def _cut(self):
        return regex.compile(CUT)

    def encode(self, text: str) -> list[int]:
        """One text by the plain pattern; ``encode_many`` gives the same for many."""
        return [i for p in self._cut.findall(text) for i in self.piece(p.encode())]

    # -- many texts at once --------------------------------------------------
    def _classes(self, points: np.ndarray) -> np.ndarray:
        top = int(points.max(initial=0))
        if top >= len(self._kinds):
            grown = np.full(top + 1, 255, np.uint8)
            grown[: len(self._kinds)] = self._kinds
            self._kinds = grown
        kinds = self._kinds[points]
        if (unknown := kinds == 255).any():
            for c in np.unique(points[unknown]).tolist():
                self._kinds[c] = _kind(chr(c))
            kinds = self._kinds[points]
        return kinds

    def cuts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts in ``points`` begin; ``firsts``: where the texts do."""
        n = len(points)
        kind = self._classes(points)
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        text_start = np.zeros(n + 1, bool)
        text_start[firsts] = True
        text_start[n] = True
        begins |= text_start[:n]
        # White space before something else in the same text: its last character
        # stands alone, or goes with what follows if it is a blank.
        gap = kind == SPACE
        last = np.flatnonzero(gap[:-1] & ~gap[1:] & ~text_start[1:n])
        run_start = begins.copy()
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
        # An apostrophe alone, not after a blank, keeps some endings.
        quote = np.flatnonzero(points == 39)
        if len(quote):
            quote = quote[begins[quote] & run_start[quote]]
            quote = quote[quote + 1 < n]
            quote = quote[(kind[quote + 1] == LETTER) & run_start[quote + 1] & ~text_start[quote + 1]]
            if len(quote):
                one = points[quote + 1]
                far = np.minimum(quote + 2, n - 1)
                two = np.where((quote + 2 < n) & ~text_start[far], points[far], 0)
                size = np.zeros(len(quote), np.int64)
                for e in ENDINGS:
                    hit = (one == ord(e[0])) & ((two == ord(e[1])) if len(e) == 2 else True)
                    size[hit & (size == 0)] = len(e)
                quote, size = quote[size > 0], size[size > 0]
                begins[quote + 1] = False
                after = quote + 1 + size
                inside = after[after < n]
                inside = inside[kind[inside] == LETTER]
                begins[inside] = True
        return np.flatnonzero(begins)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = joined.encode()
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        firsts = bounds[:-1][sizes > 0]
        starts = self.cuts(points, firsts)
        if len(data) == len(points):
            offsets = np.append(starts, len(data))
        else:
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(wide, out=at[1:])
            offsets = np.append(at[starts], len(data))
        codes, pieces = _distinct_pieces(data, offsets)
        encoded = [self.piece(p) for p in pieces]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.int32, int(lengths.sum()))
        place = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.cumsum(each)
        ids = flat[np.repeat(place[codes] - (ends - each), each) + np.arange(int(ends[-1]))]
        # ids of a text: those of its pieces
        piece_bound = np.searchsorted(starts, bounds)
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[piece_bound])


class LiveText:
    """A text that is appended to or edited, with ids that are always exact.

    Only pieces from shortly before the change to the next common cut are
    encoded again; within the last piece appending extends the table.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.piece_ids: list[tuple[int, ...]] = []
        self._open: tuple[bytes, list[int]] = (b"", [])
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for p in self.piece_ids for i in p]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Puts ``text`` in the place of the characters from start to end."""
        import bisect

        old_ends, old_ids = self.ends, self.piece_ids
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        # A cut depends on at most the white space and the piece before it.
        keep = max(0, bisect.bisect_left(old_ends, start) - 2)
        at = old_ends[keep - 1] if keep else 0
        ends, ids = old_ends[:keep], old_ids[:keep]
        old_cuts = {e + shift: k for k, e in enumerate(old_ends) if e >= end}
        settled = 0
        for m in self.encoder._cut.finditer(self.text, at):
            data = m.group().encode()
            done, last = self._open
            if m.end() == len(self.text) and data.startswith(done) and done:
                last = self.encoder.extend(data, list(last))
                piece = self.encoder.read(last)
            else:
                last = None
                piece = self.encoder.piece(data)
            ends.append(m.end())
            ids.append(piece)
            if m.end() == len(self.text):
                self._open = (data, last if last is not None else self.encoder.extend(data, []))
            # the same cut as before, and all text since is the old one
            if m.end() in old_cuts and m.start() >= start + len(text):
                settled += 1
                if settled == 2:
                    k = old_cuts[m.end()] + 1
                    ends += [e + shift for e in old_ends[k:]]
                    ids += old_ids[k:]
                    break
            else:
                settled = 0
        self.ends, self.piece_ids = ends, ids


def _kind(c: str) -> int:
    if regex.match(r"\s", c):
        return SPACE
    if regex.match(r"\p{L}", c):
        return LETTER
    return NUMBER if regex.match(r"\p{N}", c) else OTHER


def _ascii_kinds() -> np.ndarray:
    kinds = np.full(0x3000, 255, np.uint8)
    kinds[:128] = [_kind(chr(c)) for c in range(128)]
    return kinds


def _distinct_pieces(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(the number of each piece among the distinct ones, the distinct ones); exact.

    Pieces of up to 7 and 15 bytes are told apart as one or two machine words
    that hold all their bytes and their length, longer ones as byte strings.
    """
    starts, sizes = offsets[:-1], np.diff(offsets)
    padded = data + bytes(16)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    codes = np.empty(len(starts), np.int64)
    pieces: list[bytes] = []

    def settle(where: np.ndarray, code: np.ndarray, count: int) -> None:
        example = np.empty(count, np.int64)
        example[code] = where
        codes[where] = code + len(pieces)
        pieces.extend(data[a : a + s] for a, s in zip(starts[example].tolist(), sizes[example].tolist()))

    short = np.flatnonzero(sizes <= 7)
    if len(short):
        size = sizes[short]
        key = (words[starts[short]] & masks[size]) | (size.astype(np.uint64) << np.uint64(56))
        code, found = pd.factorize(key)
        settle(short, code, len(found))
    middle = np.flatnonzero((sizes > 7) & (sizes <= 15))
    if len(middle):
        size = sizes[middle] - 8
        a, _ = pd.factorize(words[starts[middle]])
        b, _ = pd.factorize((words[starts[middle] + 8] & masks[size]) | (size.astype(np.uint64) << np.uint64(56)))
        code, found = pd.factorize(a << 32 | b)
        settle(middle, code, len(found))
    long = np.flatnonzero(sizes > 15)
    if len(long):
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(data[a : a + s], len(known)) for a, s in zip(starts[long].tolist(), sizes[long].tolist())), np.int64, len(long))
        settle(long, code, len(known))
    return codes, pieces
