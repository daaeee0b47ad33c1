"""Byte-level BPE as finite-state machines.

Two machines share one vocabulary file:

* :class:`SplitMachine` cuts a text into pieces ("pretokens").  It is a
  deterministic transducer of 12 states over 11 character classes; a
  transition says whether a piece ends before the character just read, or
  before the one ahead of it.  Texts are cut into short chunks; for every chunk
  the map *state in -> state out* is computed for all 12 states at once, the
  maps are composed along the text, and only then are the cuts read off, so all
  chunks of a batch advance together.
* :class:`MergeMachine` turns one piece into token ids.  Pieces no longer than
  the lookahead are merged at their end; longer ones go through
  :class:`StreamingMerger`, which emits a token once no continuation of the text
  can change it.

Neither needs the tokenizers library; that is only the yardstick of the tests.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import struct
import sys
import unicodedata
from collections import deque

import numpy as np

# The white space of Unicode, which the split pattern calls \s.
WHITE_SPACE = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Letters and numbers that Unicode 16 added, for an older Python.
LATE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# Character classes.
STMD, CHAR_R, CHAR_V, CHAR_L, CHAR_E, LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, PAD = range(12)
N_CLASSES = 12
# States: inside a run of letters, numbers, others; one blank; one other white
# space; two or more white spaces ending in a blank or in another; a quote that
# starts a piece; the same with r, v or l; at the start of a piece.
(IN_L, IN_N, IN_O, ONE_B, ONE_S, MANY_B, MANY_S, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, FRESH) = range(12)
N_STATES = 12
CUT_HERE, CUT_BEFORE = 1, 2  # before this character; before the previous one


def _after(state: int, cls: int) -> tuple[int, int]:
    """The state after ``cls`` and the cuts that this character reveals."""
    if cls == PAD:
        return state, 0
    letter = cls <= LETTER
    begin = {NUMBER: IN_N, OTHER: IN_O, QUOTE: QUOTED, BLANK: ONE_B, SPACE: ONE_S}.get(cls, IN_L)
    glued = IN_O if cls == QUOTE else begin  # after a blank a quote opens no contraction
    white = cls in (BLANK, SPACE)
    longer = MANY_B if cls == BLANK else MANY_S
    if state == IN_L:
        return (IN_L, 0) if letter else (begin, CUT_HERE)
    if state == IN_N:
        return (IN_N, 0) if cls == NUMBER else (begin, CUT_HERE)
    if state == IN_O:
        return (IN_O, 0) if cls in (OTHER, QUOTE) else (begin, CUT_HERE)
    if state == ONE_B:
        return (longer, 0) if white else (glued, 0)
    if state == ONE_S:
        return (longer, 0) if white else (begin, CUT_HERE)
    if state == MANY_B:
        return (longer, 0) if white else (glued, CUT_BEFORE)
    if state == MANY_S:
        return (longer, 0) if white else (begin, CUT_BEFORE | CUT_HERE)
    if state == QUOTED:
        if cls == STMD:
            return FRESH, 0
        if cls in (CHAR_R, CHAR_V, CHAR_L):
            return {CHAR_R: QUOTED_R, CHAR_V: QUOTED_V, CHAR_L: QUOTED_L}[cls], 0
        return (IN_O, 0) if cls in (OTHER, QUOTE) else (begin, CUT_HERE)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if cls == (CHAR_L if state == QUOTED_L else CHAR_E):
            return FRESH, 0
        return (IN_L, CUT_BEFORE) if letter else (begin, CUT_BEFORE | CUT_HERE)
    return begin, CUT_HERE  # FRESH


@functools.cache
def _class_table() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(point))[0]
        if first == "L":
            kinds[point] = LETTER
        elif first == "N":
            kinds[point] = NUMBER
    for ranges, kind in ((LATE_LETTERS, LETTER), (LATE_NUMBERS, NUMBER)):
        for low, high in ranges:
            kinds[low : high + 1] = kind
    kinds[WHITE_SPACE] = SPACE
    for chars, kind in (("stmd", STMD), ("r", CHAR_R), ("v", CHAR_V), ("l", CHAR_L), ("e", CHAR_E), ("'", QUOTE), (" ", BLANK)):
        for c in chars:
            kinds[ord(c)] = kind
    return kinds


#: A piece always starts at a blank between two characters that are no white space.
SAFE = re.compile(r"(?<=[^\s\x85\x1c-\x1f]) (?=[^\s\x85\x1c-\x1f])")


class SplitMachine:
    """The pretokenizer: ``cuts(texts)`` gives each text's piece boundaries."""

    CHUNK = 64
    AT_ONCE = 1 << 18  # characters of a batch held as arrays

    def __init__(self):
        steps = [[_after(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)]
        self.next = np.array([[n * N_CLASSES for n, _ in row] for row in steps], np.int64).ravel()
        self.emit = np.array([[e for _, e in row] for row in steps], np.uint8).ravel()

    def _states(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Entry state of each chunk, from the chunks' state maps composed along each text.

        ``classes`` is chunks x CHUNK, padded with class PAD; ``first`` marks
        the chunks that start a text.
        """
        n = len(classes)
        maps = np.repeat((np.arange(N_STATES) * N_CLASSES)[:, None], n, 1)
        for column in classes.T:
            maps = self.next.take(maps + column)
        entry = FRESH * N_CLASSES
        ends = (maps // N_CLASSES).T
        # prefix scan by doubling: maps of ever longer stretches of chunks
        reach, origin = ends.copy(), np.flatnonzero(first)
        start_of = np.repeat(origin, np.diff(np.append(origin, n)))
        span = 1
        while span < n:
            tail = np.flatnonzero(np.arange(n) - span >= start_of)
            if not len(tail):
                break
            reach[tail] = np.take_along_axis(reach[tail], reach[tail - span], 1)
            span *= 2
        states = np.full(n, entry, np.int64)
        later = np.flatnonzero(~first)
        states[later] = reach[later - 1, FRESH] * N_CLASSES
        return states

    def cuts(self, texts: list[str]) -> list[list[int]]:
        """For each non-empty text the positions where pieces start, then its length."""
        table, out = _class_table(), []
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = table[points]
        chunks = -(-sizes // self.CHUNK)
        total = int(chunks.sum())
        base = np.concatenate(([0], np.cumsum(chunks)))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        row_of = np.repeat(base[:-1] * self.CHUNK - starts[:-1], sizes) + np.arange(len(points))
        grid = np.full(total * self.CHUNK, PAD, np.uint8)
        grid[row_of] = kinds
        grid = grid.reshape(total, self.CHUNK)
        first = np.zeros(total, bool)
        first[base[:-1]] = True
        state = self._states(grid, first)
        marks = np.empty((self.CHUNK, total), np.uint8)
        for j, column in enumerate(grid.T):
            at = state + column
            marks[j] = self.emit.take(at)
            state = self.next.take(at)
        flat = marks.T.ravel()[row_of]
        cut = (flat & CUT_HERE) != 0
        cut[:-1] |= (flat[1:] & CUT_BEFORE) != 0
        # a contraction left open at the end of a text: quote, then one letter
        last = state[base[1:] - 1] // N_CLASSES
        hanging = (last >= QUOTED_R) & (last <= QUOTED_L)
        cut[(starts[1:] - 1)[hanging]] = True
        cut[starts[:-1]] = True
        where = np.flatnonzero(cut)
        bounds = np.searchsorted(where, starts)
        for k in range(len(texts)):
            out.append((where[bounds[k] : bounds[k + 1]] - starts[k]).tolist() + [int(sizes[k])])
        return out

    def blocks(self, text: str):
        """A long text in blocks that split alike alone and together."""
        at = 0
        while len(text) - at > self.AT_ONCE:
            found = SAFE.search(text, at + self.AT_ONCE)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; batches of bounded size, long texts alone."""
        out: list[list[str]] = []
        group: list[str] = []
        held = 0

        def flush():
            nonlocal group, held
            full = [t for t in group if t]
            found = iter(self.cuts(full) if full else [])
            for t in group:
                if t:
                    b = next(found)
                    out.append([t[i:j] for i, j in zip(b, b[1:])])
                else:
                    out.append([])
            group, held = [], 0

        for t in texts:
            group.append(t)
            held += len(t)
            if held >= self.AT_ONCE:
                flush()
        flush()
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def border(left: int, right: int) -> int:
    """Two tokens side by side as one number."""
    return left << 32 | right


class MergeMachine:
    """Token ids of single pieces, learned from a vocabulary file's merge list."""

    KEPT = 200_000  # pieces remembered per worker

    def __init__(self, spec: dict):
        model = spec["model"]
        letter = byte_letters()
        back = {c: b for b, c in letter.items()}
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.vocab = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.text_of = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = to_bytes(a), to_bytes(b)
            self.rank[self.vocab[a], self.vocab[b]] = len(self.made)
            self.made.append(self.vocab[a + b])
        self.parts = {m: pair for pair, m in zip(self.rank, self.made)}
        #: No token is longer, so a token that ends later than this many bytes
        #: after a position cannot start at or before it.
        self.lookahead = max(map(len, self.vocab))
        self.size = {i: len(b) for b, i in self.vocab.items()}
        #: Length of the longest token that starts with these four bytes.
        self.reach: dict[bytes, int] = {}
        #: The lengths of the tokens of four bytes or more that end with these four, longest first.
        self.ends: dict[bytes, tuple[int, ...]] = {}
        for token in self.vocab:
            if len(token) > 3:
                self.reach[token[:4]] = max(len(token), self.reach.get(token[:4], 0))
                self.ends[token[-4:]] = tuple(sorted({len(token), *self.ends.get(token[-4:], ())}, reverse=True))
        self._edges: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}  # by border(): half the memory of pairs
        self._own: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Apply the merge list to a short piece: the lowest rank first, left to right."""
        ids = [self.single[b] for b in raw]
        rank, made = self.rank, self.made
        none = len(made)
        while len(ids) > 1:
            best = min([rank.get(p, none) for p in zip(ids, ids[1:])])
            if best == none:
                break
            new, out, i, n = made[best], [], 0, len(ids)
            while i < n:
                if i + 1 < n and rank.get((ids[i], ids[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one end of a token while it is built, each
        with the rank of the merge that takes it up."""
        found = self._edges[side].get(token)
        if found is None:
            found, at, none = [(token, len(self.made))], token, len(self.made)
            while at in self.parts:
                pair = self.parts[at]
                taken, at = self.rank[pair], pair[side]
                found.append((at, taken))
            self._edges[side][token] = found = found[::-1]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether these two tokens can stand side by side in an encoding: no merge
        across their border comes before the merges that build them."""
        found = self._fits.get(border(left, right))
        if found is None:
            if len(self._fits) > self.KEPT:
                self._fits.clear()
            ends, begins = self._edge(left, 1), self._edge(right, 0)
            none, i, j, found = len(self.made), 0, 0, True
            while True:
                (a, a_taken), (b, b_taken) = ends[i], begins[j]
                across = self.rank.get((a, b), none)
                if across < none and across < a_taken and across <= b_taken:
                    found = False
                    break
                if a_taken == none and b_taken == none:
                    break
                if a_taken <= b_taken:
                    i += 1
                else:
                    j += 1
            self._fits[border(left, right)] = found
        return found

    def alone(self, token: int) -> bool:
        """Whether a token's own text encodes to it."""
        found = self._own.get(token)
        if found is None:
            found = self._own[token] = self.merge(self.text_of[token]) == [token]
        return found

    def walk(self, raw: bytes) -> list[int]:
        """Ids of a piece that the lookahead covers.

        Longest tokens first, each beside one that it fits; a place from which
        nothing goes on is left for good, as one chain of tokens leads to it.
        """
        n, vocab, fits, reach = len(raw), self.vocab, self.fits, self.reach
        out: list[int] = []
        dead: set[int] = set()
        at, most = 0, n
        while at < n:
            size = min(most, n - at, reach.get(raw[at : at + 4], 3))
            while size:
                token = vocab.get(raw[at : at + size])
                if token is not None and at + size not in dead and (fits(out[-1], token) if out else self.alone(token)):
                    break
                size -= 1
            if size:
                out.append(token)
                at, most = at + size, n
            elif out:
                dead.add(at)
                most = self.size[out.pop()]
                at, most = at - most, most - 1
            else:
                raise ValueError("the merge list gives no encoding")
        return out

    def ids_of(self, piece: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        found = self._known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) <= self.lookahead:
                ids = self.walk(raw)
            else:
                stream = StreamingMerger(self)
                ids = [t for i in range(0, len(raw), 4096) for t in stream.feed(raw[i : i + 4096])]
                ids += stream.finish()
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self._known) >= self.KEPT:
                self._known.clear()
            if len(raw) <= self.lookahead:
                self._known[piece] = found
        return found


class StreamingMerger:
    """BPE of one unbounded piece, left to right, in memory that its length doesn't change.

    For every prefix of the input exactly one token can be the last one of the
    prefix's encoding: the one whose predecessor (the last token of the shorter
    prefix) fits beside it.  A token that ends in the future starts less than
    ``lookahead`` bytes before the end read so far, so every future encoding
    runs through one of those last prefixes.  Where their chains of predecessors
    meet, the tokens before are stable and are emitted.
    """

    def __init__(self, machine: MergeMachine):
        self.m = machine
        self.tail = b""  # the last `lookahead` bytes
        self.read = 0
        self.sent = 0  # bytes whose tokens have been emitted
        self.last: deque[int] = deque()  # last token of each prefix after `sent`
        self.before: int | None = None  # last token of the prefix of `sent` bytes
        self.deepest = 0

    def _last_at(self, end: int) -> int | None:
        return self.before if end == self.sent else self.last[end - self.sent - 1]

    def feed(self, data: bytes) -> list[int]:
        m, out = self.m, []
        for byte in data:
            self.tail = (self.tail + bytes([byte]))[-m.lookahead :]
            self.read += 1
            most = self.read - self.sent
            for size in (*m.ends.get(self.tail[-4:], ()), 3, 2, 1):
                token = m.vocab.get(self.tail[-size:]) if size <= most else None
                if token is None:
                    continue
                start = self.read - size
                before = self._last_at(start)
                if m.alone(token) if before is None else m.fits(before, token):
                    self.last.append(token)
                    break
            else:
                raise ValueError("the merge list gives no encoding")
            if self.read - self.sent >= 4 * m.lookahead:
                out += self._stable()
        self.deepest = max(self.deepest, len(self.last))
        return out

    def _chain(self, end: int) -> list[int]:
        """Tokens from what has been sent to the prefix of ``end`` bytes."""
        out = []
        while end > self.sent:
            out.append(self._last_at(end))
            end -= self.m.size[out[-1]]
        return out[::-1]

    def _stable(self) -> list[int]:
        heads = set(range(max(self.sent, self.read - self.m.lookahead + 1), self.read + 1))
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(far - self.m.size[self._last_at(far)])
        return self._send(heads.pop())

    def _send(self, end: int) -> list[int]:
        out = self._chain(end)
        if end > self.sent:
            self.before = self._last_at(end)
            for _ in range(end - self.sent):
                self.last.popleft()
            self.sent = end
        return out

    def finish(self) -> list[int]:
        return self._send(self.read)


class CountMachine:
    """The merge list as a deterministic transducer whose transitions carry token counts.

    A state stands for the bytes of a piece read so far: which token ends there, and
    in which state it began.  Reading a byte moves to the next state and adds the
    change in the number of tokens, which may be nothing or negative: the count of a
    piece is the sum along its path.  States are made when they are first reached.
    A piece longer than the lookahead has too many states to keep; its last
    ``lookahead`` of them say all that the future needs, and older ones are let go.
    """

    STATES, KEPT = 300_000, 400_000  # states, and counts of whole pieces

    def __init__(self, machine: MergeMachine):
        self.m = machine
        self._known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        #: of each state: its last token, and its transitions by byte as (state, tokens added)
        self.last: list[int | None] = [None]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        found = self._known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) > self.m.lookahead:
                return self._long(raw)
            if len(self.last) > self.STATES:
                self._clear()
            if len(self._known) >= self.KEPT:
                self._known.clear()
            found = self._known[piece] = self._walk(raw)
        return found

    def _walk(self, raw: bytes) -> int:
        next_, last = self.next, self.last
        path, counts, state = [0], [0], 0
        for at, byte in enumerate(raw):
            step = next_[state].get(byte)
            if step is None:
                token, size = self._ending(raw, at + 1, path, last)
                step = next_[state][byte] = (len(last), counts[at + 1 - size] + 1 - counts[at])
                last.append(token)
                next_.append({})
            state = step[0]
            path.append(state)
            counts.append(counts[at] + step[1])
        return counts[-1]

    def _ending(self, raw: bytes, end: int, path, last) -> tuple[int, int]:
        """The last token of the first ``end`` bytes, and its size: the one that fits what was last where it begins."""
        m = self.m
        vocab, known = m.vocab, m._fits
        for size in (*m.ends.get(raw[max(0, end - 4) : end], ()), 3, 2, 1):
            if size > end:
                continue
            token = vocab.get(raw[end - size : end])
            if token is None:
                continue
            before = last[path[end - size]]
            if before is None:
                if m.alone(token):
                    return token, size
            else:
                fit = known.get(border(before, token))
                if m.fits(before, token) if fit is None else fit:
                    return token, size
        raise ValueError("the merge list gives no encoding")

    def _long(self, raw: bytes) -> int:
        """A piece beyond the lookahead: only what its last ``lookahead`` bytes have led to is kept."""
        window = self.m.lookahead
        last: list[int | None] = [None]
        counts, base = [0], 0  # from the prefix of ``base`` bytes on
        for end in range(1, len(raw) + 1):
            if len(last) > 4 * window:
                cut = len(last) - window - 1
                last, counts, base = last[cut:], counts[cut:], base + cut
            own = raw[max(base, end - window) : end]
            token, size = self._ending(own, len(own), range(len(last) - len(own), len(last)), last)
            counts.append(counts[len(counts) - size] + 1)
            last.append(token)
        return counts[-1]


#: Bytes of text whose pieces are held at once: many more small strings among the kept ones keep memory from going back.
TEXT_BYTES = 1 << 17


class Tokenizer:
    """Encoding, counting and decoding of whole texts."""

    def __init__(self, spec: str | bytes):
        self.merger = MergeMachine(json.loads(spec))
        self.split = SplitMachine()
        self.counter = CountMachine(self.merger)

    def _segments(self, text: str) -> list[str | int]:
        """The text cut at special strings, each of which is one token."""
        parts: list[str | int] = [text]
        for mark, token in self.merger.special.items():
            cut: list[str | int] = []
            for p in parts:
                if isinstance(p, str) and mark in p:
                    for k, piece in enumerate(p.split(mark)):
                        cut += [token] * (k > 0) + [piece]
                else:
                    cut.append(p)
            parts = cut
        return [b for p in parts for b in (self.split.blocks(p) if isinstance(p, str) else [p])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        plan = [self._segments(t) for t in texts]
        runs = iter(self.split.pieces([p for parts in plan for p in parts if isinstance(p, str)]))
        ids_of, out = self.merger.ids_of, []
        for parts in plan:
            out.append(b"".join(np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(ids_of, next(runs))) for p in parts))
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """Each text's number of tokens, from the counting machine; no ids are made."""
        plan = [self._segments(t) for t in texts]
        runs = iter(self.split.pieces([p for parts in plan for p in parts if isinstance(p, str)]))
        count = self.counter.count
        return [sum(1 if isinstance(p, int) else sum(map(count, next(runs))) for p in parts) for parts in plan]

    def decode(self, ids: bytes, step: int = 1 << 15) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text_of = self.merger.text_of
        numbers = np.frombuffer(ids, "<u4")
        out = [machine.decode(b"".join(map(text_of.__getitem__, numbers[i : i + step].tolist()))) for i in range(0, len(numbers), step)]
        return "".join(out) + machine.decode(b"", True)


class Vocabulary:
    """A vocabulary file to broadcast: a worker builds its tokenizer once, and it goes when the worker drops the broadcast.

    Workers are used again by other stages, which a tokenizer of the process would burden for good.
    """

    def __init__(self, spec: str | bytes):
        self.spec = spec
        self._made: Tokenizer | None = None

    def __getstate__(self):
        return {"spec": self.spec, "_made": None}

    def tokenizer(self) -> Tokenizer:
        if self._made is None:
            self._made = Tokenizer(self.spec)
        return self._made


@functools.lru_cache(maxsize=2)
def tokenizer_of(spec: bytes) -> Tokenizer:
    """One tokenizer for each process and vocabulary, which stays; tasks take theirs from a :class:`Vocabulary`."""
    return Tokenizer(spec)
