"""Exact Viterbi decoding of character lattices under a 4-gram model.

An observed token is a lattice: look-alike signs stand for letters,
separators and repeats may vanish, blanks may vanish or stay. ``restore``
finds its cheapest reading over all paths. A state is the last three letters
written, so behind three letters in a row that have one reading all paths
are in the same state: the token falls apart into cores, stretches from a
sign with several readings to the third such letter, and each core is decided
alone, given the three letters before it. Signs that can but vanish are in no
core. Cores are short and recur (the end of a word and its punctuation, a
doubled letter and its neighbours), so their readings are remembered.

A short core keeps its paths, the cheapest one per state once there are
several. A long core keeps one cost per state and back pointers; where all live
paths share their beginning it is written out and its pointers go, so time and
memory are linear in the length of a token.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

SYMBOLS = 28  # 0 boundary, 1-26 letters, 27 any other letter
STATES = SYMBOLS ** 3

# Look-alikes: observed sign -> letters it may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x", "µ": "u"}
SEPARATORS = set(".-_*~'`^,:;/\\=#")
BLANKS = set(" \t\n\r\v\f")
COST_LEET, COST_DROP, COST_REPEAT, COST_KEEP_SIGN, COST_SPACE, COST_THIRD, COST_ANY = 0.7, 0.6, 0.3, 6.0, 1.5, 3.0, 2.5
COST_DOUBLE = 3.0  # one of two equal letters

_RUN = re.compile(r"(.)\1+|[^a-z]", re.DOTALL)
# A sign with several readings is a character of a private plane; the others are the letter they write.
_OPEN = 0xF0000
_P = f"{chr(_OPEN)}-{chr(0x10FFFF)}"
_CORE = re.compile(f"[{_P}](?:[^{_P}]{{0,2}}+[{_P}])*+[^{_P}]{{0,3}}")
_PART = re.compile(f"([{_P}])([^{_P}]*)")


class _Folded(dict):
    """Character number -> its letter without accents, for ``str.translate``."""

    def __missing__(self, number: int) -> str:
        c = chr(number)
        if number >= _OPEN:  # a private character is a sign, whichever it is
            c = "\ue000"
        got = self[number] = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        return got


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Letters without accents."""
    return text if text.isascii() else text.translate(_FOLDED)


def letter_class(c: str) -> int:
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27


class _Classes(dict):
    """Character -> ``letter_class``."""

    def __missing__(self, c: str) -> int:
        got = self[c] = letter_class(c)
        return got


_CLASSES = _Classes()


def readings(c: str, run: int, length: int, drop: float, space: float, doubles: bool) -> list[tuple[str, float]]:
    """What the sign ``c``, number ``run`` of ``length`` equal ones, may
    stand for, with costs."""
    out: list[tuple[str, float]] = []
    if c.isalpha():
        out.append((c, 0.0 if run < 2 else COST_THIRD))
    elif c in LEET:
        out += [(x, COST_LEET) for x in LEET[c]]
    if c in BLANKS:
        out += [("", drop), (" ", space)]
    elif not c.isalpha():
        if c in SEPARATORS or not c.isalnum():
            out.append(("", COST_DROP))
        if c == "*":
            out += [(x, COST_ANY) for x in "aeiou"]
        if c.isdigit():
            out.append(("", COST_KEEP_SIGN))
    if run and (length > 2 or doubles and c.isalpha()):
        out.append(("", COST_REPEAT if length > 2 else COST_DOUBLE))
    return out


class Recent(dict):
    """The last ``size`` to 2 * ``size`` entries that were asked for or set:
    when the younger half is full it becomes the older one."""

    def __init__(self, size: int = 100_000):
        super().__init__()
        self.size, self.older = size, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is not None:
            self[key] = got
        return got

    def __setitem__(self, key, value):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        super().__setitem__(key, value)


class Lattice:
    """Decoder for one way to price blanks and doubled letters."""

    SHORT = 64  # signs of a core that is remembered
    COMMIT = 512  # signs between two tries to write out what is settled
    NUMBERS = 0x110000 - _OPEN  # kinds of open signs that have a character
    MERGED = 4  # paths from which those in the same state are compared

    def __init__(self, model: np.ndarray, drop: float = COST_DROP, space: float = COST_SPACE, doubles: bool = False):
        """``model``: log P(next | three before), flat."""
        self.cost: list[float] = (-model.astype(np.float64)).tolist()
        self.how = (drop, space, doubles)
        self.numbers: dict[tuple, str] = {}  # readings of a sign -> its character
        self.options: dict[str, tuple] = {}  # and back
        self.runs: Recent = Recent(10_000)
        self.memo: Recent = Recent()  # cores

    def _sign(self, c: str, run: int, length: int) -> str:
        """Empty for a sign that can but vanish, the letter of one with one
        reading, a private character for the others."""
        options = tuple((x, letter_class(x) if x else -1, p) for x, p in readings(c, run, length, *self.how))
        written = {x for x, _, _ in options}
        if len(written) < 2:  # what all paths pay alike decides nothing
            return "".join(written)
        got = self.numbers.get(options)
        if got is None:
            if len(self.numbers) == self.NUMBERS:
                raise OverflowError
            got = self.numbers[options] = chr(_OPEN + len(self.numbers))
            self.options[got] = options
        return got

    def _run(self, m: re.Match) -> str:
        """Signs of a run of equal characters."""
        run = m.group(0)
        got = self.runs[run]
        if got is None:
            c, n = run[0], len(run)
            length = min(n, 3)
            got = "".join([self._sign(c, i, length) for i in range(min(n, 2))])
            if n > 2:
                got += self._sign(c, 2, length) * (n - 2)
            if n <= self.SHORT:
                self.runs[run] = got
        return got

    def restore(self, token: str) -> str:
        """Cheapest reading of a token over all paths of its lattice."""
        text = fold(token)
        try:
            return _CORE.sub(self._core, _RUN.sub(self._run, text))
        except OverflowError:  # undivided
            lattice = [tuple((x, letter_class(x) if x else -1, p) for x, p in
                             readings(m.group(0)[0], i, m.end() - m.start(), *self.how) or [("", 0.0)])
                       for m in re.finditer(r"(.)\1*", text, re.DOTALL) for i in range(m.end() - m.start())]
            return self._decide("", lattice, True)

    def _core(self, m: re.Match) -> str:
        """Reading of a core. The key holds the context: three letters with
        one reading, fewer at the beginning of the token."""
        begin, end = m.span()
        key = m.string[max(0, begin - 3):end]
        got = self.memo[key]
        if got is None:
            if end - begin <= self.SHORT:
                got = self.memo[key] = self._choose(m.string[max(0, begin - 3):begin], m.group(0))
            else:
                lattice = [self.options.get(c) or ((c, letter_class(c), 0.0),) for c in m.group(0)]
                got = self._decide(m.string[max(0, begin - 3):begin], lattice, key[-3:-2] in self.options
                                   or key[-2:-1] in self.options or key[-1:] in self.options)
        return got

    def keeps(self, word: str) -> bool:
        """Whether the cheapest reading of a word is the word itself."""
        return self.restore(word) == word

    def _choose(self, context: str, core: str) -> str:
        """Cheapest output of a short core; one with fewer than three letters
        behind its last open sign ends the token."""
        cost, number, state = self.cost, _CLASSES, 0
        for c in context:
            state = state * SYMBOLS + number[c]
        paths = [(0.0, state, "")]
        for sign, letters in _PART.findall(core):
            options, classes = self.options[sign], [number[c] for c in letters]
            if len(paths) > self.MERGED:
                least: dict[int, tuple] = {}
                for path in paths:
                    other = least.get(path[1])
                    if other is None or path < other:
                        least[path[1]] = path
                paths = least.values()
            step = []
            for spent, state, out in paths:
                for x, c, price in options:
                    t, total = state, spent + price
                    if c >= 0:
                        t = t * SYMBOLS + c
                        total += cost[t]
                        t %= STATES
                    for c in classes:
                        t = t * SYMBOLS + c
                        total += cost[t]
                        t %= STATES
                    step.append((total, t, out + x + letters))
            paths = step
        if len(letters) < 3:
            paths = [(spent + cost[state * SYMBOLS], out) for spent, state, out in paths]
            return min(paths)[1]
        return min(paths)[2]

    def _decide(self, context: str, lattice: list[tuple], ends: bool) -> str:
        """Cheapest output of a core; ``ends``: the token ends with it."""
        state = 0
        for c in context:
            state = (state * SYMBOLS + letter_class(c)) % STATES
        cost, live, links, written = self.cost, {state: 0.0}, [], []
        for options in lattice:
            step: dict[int, float] = {}
            link: dict[int, tuple[int, str]] = {}
            for s, spent in live.items():
                for x, c, price in options:
                    if c < 0:
                        t, total = s, spent + price
                    else:
                        t = s * SYMBOLS + c
                        total = spent + price + cost[t]
                        t %= STATES
                    if t not in step or total < step[t]:
                        step[t] = total
                        link[t] = (s, x)
            live = step
            links.append(link)
            if len(links) % self.COMMIT == 0:
                links = self._settle(live, links, written)
        end = {s: spent + cost[s * SYMBOLS] for s, spent in live.items()} if ends else live
        least = min(end.values())
        return "".join(written) + min(self._trace(s, links) for s, spent in end.items() if spent == least)

    @staticmethod
    def _trace(state: int, links: list[dict]) -> str:
        out = []
        for link in reversed(links):
            state, x = link[state]
            out.append(x)
        return "".join(reversed(out))

    def _settle(self, live: dict, links: list[dict], written: list[str]) -> list[dict]:
        """Write out what all live paths begin with; the links behind it."""
        states = set(live)
        for k in range(len(links) - 1, -1, -1):
            states = {links[k][s][0] for s in states}
            if len(states) == 1:
                written.append(self._trace(states.pop(), links[:k]))
                return links[k:]
        return links
