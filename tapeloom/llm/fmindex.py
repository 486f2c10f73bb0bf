"""A compressed FM-index over a shard of texts, and matching statistics by backward search.

What the index holds: the Burrows-Wheeler transform as a wavelet tree in its level-wise layout (a bit vector per
level with a popcount directory, so about log2 of the alphabet bits a character), the alphabet's cumulative counts,
and one more bit vector that marks where the rows' first ``width`` symbols change. Neither the texts nor the suffix
array stay: no row is ever located, since the streamed texts themselves say where they are.

Every text is streamed backwards through the index, all of them in lockstep, so a step is a few numpy operations
for the whole shard. The range of rows is narrowed by each symbol; at ``width`` symbols the matching statistic has
reached the threshold, and the range is widened again to the rows that share those symbols before the next symbol
is read. The range is then the occurrences of the window that begins here: windows with one range are equal.

Suffixes are sorted by a bounded number of symbols only, the power of two above ``width`` (prefix doubling). For
patterns up to that length the ranges of a backward search are the same as with a full sort.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEPARATOR, FIRST = 1, 2
#: Windows of one text that are streamed as one pattern, so that a long text is many short streams.
STREAM = 512


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:], dtype=np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


def sorted_suffixes(codes: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes' first ``depth`` symbols, and which of them differ in their first
    ``width`` (4 or more) symbols from the one before."""
    n, bits = len(codes), 8 * codes.itemsize
    have, at_width = 64 // bits, None
    packed = np.zeros(n + have, np.uint64)
    packed[:n] = codes
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = (key << np.uint64(bits)) | packed[k : n + k]
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step + 1
        if have <= width:
            # The widest power of two below: two windows of it, one at either end, cover ``width`` symbols.
            at_width, shift = rank, width - have
        if have >= depth or step[-1] == n - 1:
            break
        key = rank << 32
        key[: n - have] |= rank[have:]
        have *= 2
    far = np.zeros(n, np.int64)
    far[: n - shift] = at_width[shift:]
    edge = np.ones(n, bool)
    edge[1:] = (at_width[order[1:]] != at_width[order[:-1]]) | (far[order[1:]] != far[order[:-1]])
    return order, edge


class Index:
    """The FM-index of texts given as one array of symbols, each text followed by a separator.

    Symbols are dense codes from FIRST up, of 16 or 32 bits. ``width`` is the threshold of the matching statistics.
    """

    def __init__(self, codes: np.ndarray, width: int):
        text = np.append(codes, np.zeros(1, codes.dtype))
        order, edge = sorted_suffixes(text, 1 << width.bit_length(), width)
        self.rows, self.width = len(text), width
        self.edges, self.edge_rows = Bits(edge), np.append(np.flatnonzero(edge), len(text)).astype(np.int32)
        bwt = text[order - 1]
        top = int(text.max()) + 1
        self.starts = np.zeros(top + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=top), out=self.starts[1:])
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(bwt) - ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.base = self._descend(np.arange(top), np.zeros(top, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with the symbols ``c`` put before them; empty where low >= high."""
        both = self._descend(np.concatenate([c, c]), np.concatenate([low, high]))
        at = self.starts[c] - self.base[c]
        return at + both[: len(c)], at + both[len(c) :]

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all rows whose first ``width`` symbols are those of the rows ``low``."""
        k = self.edges.rank(low + 1) - 1
        return self.edge_rows[k].astype(np.int64), self.edge_rows[k + 1].astype(np.int64)

    def windows(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For every position from ``first`` to before ``last`` of each stream, one after the other, the least row that
        begins with the window there. The windows lie inside the texts of the index, so no range is ever empty."""
        count = last - first
        out = np.zeros(count.sum(), np.int64)
        place = np.cumsum(count) - count
        turn = np.argsort(-count, kind="stable")
        first, last, place, count = first[turn], last[turn], place[turn], count[turn]
        steps = count + self.width - 1
        low, high = np.zeros(len(turn), np.int64), np.full(len(turn), self.rows, np.int64)
        for step in range(int(steps[0]) if len(turn) else 0):
            n = int(np.searchsorted(-steps, -step, side="left"))  # streams that are longer than this step
            at = last[:n] + self.width - 2 - step
            low[:n], high[:n] = self.extend(codes[at].astype(np.int64), low[:n], high[:n])
            if step + 1 >= self.width:
                low[:n], high[:n] = self.widened(low[:n])
                out[place[:n] + (at - first[:n])] = low[:n]
        return out


def classes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The spans of at least ``width`` characters that stand in two or more of the texts, as classes of equal spans.

    Returns arrays (text, start, class) with a row per place and, per class, (length, 128-bit hash of its characters).
    Windows with the same occurrences that follow each other are one span, so a window is in one class only, and
    there are as many rows as places: no pair of places is ever formed.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    fits = lengths >= width
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if fits.sum() < 2:
        return nothing
    first = np.cumsum(lengths + 1) - lengths - 1
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, codes = np.unique(points, return_inverse=True)
    codes = (codes + FIRST).astype(np.uint16 if len(symbols) + FIRST < 1 << 16 else np.uint32)
    codes[first + lengths] = SEPARATOR
    index = Index(codes, width)
    n_windows = np.where(fits, lengths - width + 1, 0)
    # Streams: every text's windows in stretches of STREAM, in the order of the texts.
    parts = -(-n_windows // STREAM)
    of = np.repeat(np.arange(len(texts)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[of] + k * STREAM
    row = index.windows(codes, begin, np.minimum(begin + STREAM, first[of] + n_windows[of]))
    owner = np.repeat(np.arange(len(texts)), n_windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    _, group, size = np.unique(row, return_inverse=True, return_counts=True)
    # The window after each, -1 at a text's end. A group goes on in another where all its windows do and no others are there.
    after = np.full(len(row), -1, np.int64)
    inner = owner[1:] == owner[:-1]
    after[:-1][inner] = group[1:][inner]
    order = np.argsort(group, kind="stable")
    heads = np.cumsum(size) - size
    least, most = np.minimum.reduceat(after[order], heads), np.maximum.reduceat(after[order], heads)
    goes_on = (least == most) & (least >= 0)
    goes_on &= size[np.where(goes_on, least, 0)] == size
    many = np.minimum.reduceat(owner[order], heads) != np.maximum.reduceat(owner[order], heads)
    head = np.ones(len(row), bool)
    head[1:] = ~(goes_on[group[:-1]] & inner)
    starts = np.flatnonzero(head)
    length = np.diff(np.append(starts, len(row))) + width - 1
    keep = many[group[starts]]
    starts, length = starts[keep], length[keep]
    _, one, which = np.unique(group[starts], return_index=True, return_inverse=True)
    text, at = owner[starts], place[starts]
    hashes = [hashlib.blake2b(texts[t][a : a + n].encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, a, n in zip(text[one], at[one], length[one])]
    return text, at, which, length[one], hashes
