"""Burrows-Wheeler transform and common prefixes of a collection of strings,
built column by column.

Round j inserts, for every string at once, its suffix of length j: the
symbol that precedes the suffix of length j - 1 tells (through the counts of
the transform so far) where the longer suffix belongs. The transform and the
array of common-prefix lengths are two files that every round reads from
front to back and writes anew, block by block, so memory holds one block and
a few numbers per string, never the collection. Files are spooled: they stay
in memory up to ``SPOOL_BYTES`` and go to the task's temporary folder beyond.

Strings are byte strings; every string ends with its own end mark, smaller
than all bytes, ordered by string number, so common prefixes never run over
an end. Common prefixes are counted up to ``depth`` (at most 255): longer
ones are written as ``depth``.
"""

from __future__ import annotations

import tempfile

import numpy as np

SPOOL_BYTES = 8 << 20
BLOCK = 1 << 19


class _File:
    """A sequential file of symbols (0 is the end mark) or lengths."""

    def __init__(self, kind):
        self.kind = np.dtype(kind)
        self.f = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.n = 0

    def append(self, values: np.ndarray) -> None:
        self.f.write(values.astype(self.kind, copy=False).tobytes())
        self.n += len(values)

    def blocks(self, size: int):
        self.f.seek(0)
        while raw := self.f.read(size * self.kind.itemsize):
            yield np.frombuffer(raw, self.kind)

    def close(self) -> None:
        self.f.close()


class Collection:
    """The transform of ``strings``: ``flat`` holds them one after the other,
    ``lengths`` their lengths."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, depth: int, block: int = BLOCK):
        if not 0 < depth <= 255:
            raise ValueError("common prefixes are counted up to 255")
        self.depth, self.block = depth, block
        self.m = len(lengths)
        self.lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(np.bincount(flat, minlength=256)) if len(flat) else np.zeros(0, np.int64)
        self.kind = np.uint8 if len(used) < 256 else np.uint16  # UTF-8 never uses all byte values
        self.symbols = len(used) + 1
        dense = np.zeros(256, self.kind)  # bytes in use, numbered from 1 in their order
        dense[used] = np.arange(1, len(used) + 1)
        self.flat = dense[flat]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if self.m else \
            np.zeros(0, np.int64)
        self._build()

    def _symbol(self, which: np.ndarray, j: int) -> np.ndarray:
        """Symbol before the suffix of length j (0: the string begins there)."""
        left = self.lengths[which] - j
        out = np.zeros(len(which), self.kind)
        more = left > 0
        out[more] = self.flat[self.starts[which[more]] + left[more] - 1]
        return out

    def _build(self) -> None:
        who = np.arange(self.m)
        symbols = self._symbol(who, 0)
        self.bwt, self.lcp = _File(self.kind), _File(np.uint8)
        self.bwt.append(symbols)  # the empty suffixes, in the order of the strings
        self.lcp.append(np.zeros(self.m, np.uint8))
        counts = np.bincount(symbols, minlength=self.symbols)
        at, j = who.copy(), 0
        while True:
            grow = symbols > 0
            who, at = who[grow], at[grow]
            if not len(who):
                break
            j += 1
            place, prefix, following = self._targets(at, counts)
            order = np.argsort(place, kind="stable")
            who, at = who[order], place[order]
            symbols = self._symbol(who, j)
            self._insert(at, symbols, prefix[order], following[order])
            counts += np.bincount(symbols, minlength=self.symbols)

    def _targets(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the suffixes at positions ``at`` (ascending), whose next symbol
        is about to be put in front: the position of the longer suffix, its
        common prefix with the one before it, and the one after it with it."""
        first = self.m + np.cumsum(counts) - counts - counts[0]  # suffixes before those that begin with a symbol
        place = np.empty(len(at), np.int64)
        prefix, following = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
        seen = np.zeros(self.symbols, np.int64)
        low = np.full(self.symbols, -1, np.int64)        # per symbol: least length since its last place, -1: none yet
        waiting: dict[int, tuple[int, int]] = {}  # per symbol: entry of `at` without a successor yet, least length so far
        base, total = 0, self.bwt.n
        for bwt, lcp in zip(self.bwt.blocks(self.block), self.lcp.blocks(self.block), strict=True):
            n = len(bwt)
            a, b = np.searchsorted(at, [base, base + n])
            by = np.argsort(bwt, kind="stable")
            size = np.bincount(bwt, minlength=self.symbols)
            tails = np.cumsum(size) - 1
            heads = tails - size + 1
            here_symbols = np.flatnonzero(size)
            rank = np.empty(n, np.int32)
            rank[by] = np.arange(n, dtype=np.int32)
            pad = np.append(lcp, np.uint8(0))
            earlier, later = base > 0, base + n < total
            running = np.minimum.accumulate(lcp) if earlier or waiting else None
            here = at[a:b] - base
            if later:  # least length behind each symbol's last place in this block
                suffix = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
                after = np.full(self.symbols, 255, np.int64)
                after[here_symbols] = suffix[by[tails[here_symbols]] + 1]
            if b > a:
                r = rank[here].astype(np.int64)
                c = bwt[here].astype(np.int64)
                place[a:b] = first[c] + seen[c] + (r - heads[c])
                # least length over (previous place of the symbol, this one]
                inside = r > heads[c]
                value = np.full(b - a, -1, np.int64)
                if inside.any():
                    pairs = np.stack([by[r[inside] - 1] + 1, here[inside] + 1], 1).ravel()
                    value[inside] = np.minimum.reduceat(pad, pairs)[::2]
                if earlier and not inside.all():
                    out = ~inside
                    before = low[c[out]]
                    value[out] = np.where(before < 0, -1, np.minimum(before, running[here[out]]))
                prefix[a:b] = np.minimum(value + 1, self.depth)
                # least length over (this place, next place of the symbol]
                inside = r < tails[c]
                if inside.any():
                    pairs = np.stack([here[inside] + 1, by[r[inside] + 1] + 1], 1).ravel()
                    following[a:b][inside] = np.minimum(np.minimum.reduceat(pad, pairs)[::2].astype(np.int64) + 1,
                                                        self.depth)
            if waiting:
                for x in here_symbols.tolist():
                    if x in waiting:
                        i, least = waiting.pop(x)
                        following[i] = min(min(least, int(running[by[heads[x]]])) + 1, self.depth)
                for x, (i, least) in waiting.items():
                    waiting[x] = (i, min(least, int(running[-1])))
            if later:
                if earlier:
                    low[low >= 0] = np.minimum(low[low >= 0], int(running[-1]))
                low[here_symbols] = after[here_symbols]
                if b > a:
                    for i in np.flatnonzero(r == tails[c]):
                        waiting[int(c[i])] = (a + int(i), int(after[c[i]]))
            seen += size
            base += n
        return place, prefix, following

    def _insert(self, at: np.ndarray, symbols: np.ndarray, prefix: np.ndarray, following: np.ndarray) -> None:
        """Write both files anew with the new suffixes at ``at`` (ascending);
        a suffix right behind a new one gets its new common prefix."""
        bwt, lcp = _File(self.kind), _File(np.uint8)
        done = 0   # entries of the new files so far
        k = 0      # new suffixes so far
        carry = -1  # common prefix for the first old suffix of the next block
        for old_bwt, old_lcp in zip(self.bwt.blocks(self.block), self.lcp.blocks(self.block), strict=True):
            n = len(old_bwt)
            # this block's old entries end at new position done + n + (new ones before it)
            e = k
            while True:
                f = int(np.searchsorted(at, done + n + (e - k), side="left"))
                if f == e:
                    break
                e = f
            size = n + (e - k)
            fresh = np.zeros(size, bool)
            fresh[at[k:e] - done] = True
            b = np.empty(size, self.kind)
            v = np.empty(size, np.uint8)
            old = ~fresh
            b[at[k:e] - done] = symbols[k:e]
            b[old] = old_bwt
            v[old] = old_lcp
            if carry >= 0 and size and not fresh[0]:
                v[0] = carry
            behind = at[k:e] - done + 1
            ok = behind < size
            v[behind[ok]] = following[k:e][ok]
            v[at[k:e] - done] = prefix[k:e]
            carry = int(following[e - 1]) if e > k and not ok[-1] else -1
            bwt.append(b)
            lcp.append(v)
            done += size
            k = e
        if k < len(at):
            v = prefix[k:].copy()
            bwt.append(symbols[k:])
            lcp.append(v)
        self.bwt.close()
        self.lcp.close()
        self.bwt, self.lcp = bwt, lcp

    def repeats(self, k: int):
        """Groups of equal substrings of length ``k`` <= depth: yields
        ``(group, string, offset)`` arrays over all places; equal substrings
        share a group number. Walks the transform from the ends of all
        strings at once."""
        symbols = np.concatenate(list(self.bwt.blocks(self.block))) if self.m else np.zeros(0, self.kind)
        lcp = np.concatenate(list(self.lcp.blocks(self.block))) if self.m else np.zeros(0, np.uint8)
        group = np.cumsum(lcp < k)
        by = np.argsort(symbols, kind="stable")
        ends = int((symbols == 0).sum())
        step = np.empty(len(symbols), np.int64)
        step[by] = np.arange(len(symbols)) - ends + self.m
        who, at, j = np.arange(self.m), np.arange(self.m), 0
        out = []
        while len(who):
            if j >= k:
                out.append((group[at], who, self.lengths[who] - j))
            more = symbols[at] > 0
            who, at = who[more], step[at[more]]
            j += 1
        self.bwt.close()
        self.lcp.close()
        z = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (z, z, z)

