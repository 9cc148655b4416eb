"""Byte-pair encoding as a path search over prefixes.

A sequence of pieces is what the merge rules make of a string exactly if each pair of neighbours is what
they make of the two neighbours' own text. So every prefix of a string has one last piece: the only one
that ends there and agrees with the last piece of the prefix before it. The search below keeps, for each
prefix, that back pointer and the number of pieces; nothing is merged over the whole string, so the work
is linear in its length and a window of the longest piece's length is enough state.
"""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Entries that each generation of a memo keeps at most.
MEMO = 1 << 17
#: Gives free memory back, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
NEVER = float("inf")


_MEMOS: weakref.WeakSet = weakref.WeakSet()
_OWNER = [""]


def claim(owner: str) -> None:
    """Tell what a worker works for. When it turns to another operator, what it remembers for the last one is dropped, and
    memory that is free goes back to the system."""
    if _OWNER[0] != owner:
        for memo in list(_MEMOS):
            memo.clear()
            memo.old = {}
        _OWNER[0] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


class Memo(dict):
    """A dictionary that works out missing values and holds two generations of `limit` entries at most.

    When a generation is full, it becomes the old one; what is asked for again moves to the new one. Keys of more than `longest`
    letters are worked out each time, so the entries bound the bytes.
    """

    def __init__(self, make: Callable, limit: int = MEMO, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}
        _MEMOS.add(self)

    __hash__ = object.__hash__

    def __eq__(self, other) -> bool:
        return self is other

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.turn()
            self[key] = value
        return value

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def found(self, keys: set) -> tuple[dict, list]:
        """What is known of these keys, and the keys that aren't."""
        known = {k: self[k] for k in keys & self.keys()}
        rest = keys - known.keys()
        again = {k: self.old[k] for k in rest & self.old.keys()}
        self.take(again)
        return known | again, list(rest - again.keys())

    def take(self, values: dict) -> None:
        if any(len(k) > self.longest for k in values):
            values = {k: v for k, v in values.items() if len(k) <= self.longest}
        if len(self) + len(values) > self.limit:
            self.turn()
        self.update(values)


class Pieces:
    """Pieces and their merge rules.

    `vocabulary`: the pieces; `rank(left, right)`: the place of that merge in the order of merges, or None.
    Strings are sequences of units (characters, or bytes written as Latin-1 characters).
    """

    def __init__(self, vocabulary, rank: Callable[[str, str], int | None]):
        self.vocabulary = frozenset(vocabulary)
        self.rank = rank
        self.longest = max(map(len, self.vocabulary), default=1)
        #: By the last four units, or fewer: the lengths that pieces with this end can have, longest first.
        #: Up to four they are known to be pieces.
        longer: dict[str, set[int]] = {}
        for piece in self.vocabulary:
            for n in range(1, min(len(piece), 4) + 1):
                longer.setdefault(piece[-n:], set())
            if len(piece) > 4:
                longer[piece[-4:]].add(len(piece))
        self.tails = {
            end: (*sorted(more, reverse=True), *(n for n in range(len(end), 0, -1) if end[-n:] in self.vocabulary)) for end, more in longer.items()
        }
        #: Neighbours that stand together in some piece.
        self.joints = frozenset(piece[i : i + 2] for piece in self.vocabulary for i in range(len(piece) - 1))
        self.edges = Memo(self.edges_of)
        self.agrees = Memo(self.agree)

    def merged(self, text: str, seen: Callable[[list[str], int], None] | None = None) -> list[str]:
        """The merge rules applied step by step; `seen` gets the parts and the rank before each merge."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not ranks:
                break
            r, i = min(ranks)
            if seen:
                seen(parts, r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges_of(self, piece: str):
        """What stands at the left and right edge of a piece while it forms, each with the rank at which it
        is taken up into something longer; None if the rules never form this piece."""
        steps: list[tuple[str, str, int]] = []
        if self.merged(piece, lambda parts, r: steps.append((parts[0], parts[-1], r))) != [piece]:
            return None
        sides = []
        for k in (0, 1):
            edge = []
            for n, step in enumerate(steps):
                after = steps[n + 1][k] if n + 1 < len(steps) else piece
                if after != step[k]:
                    edge.append((step[k], step[2]))
            sides.append([*edge, (piece, NEVER)])
        return sides

    def agree(self, pair: tuple[str, str]) -> bool:
        """Do the rules keep the border between these two pieces?

        Both sides form on their own unless, at some time, the two edges have a merge that comes before
        the next merge of either; of equal ranks the one further left comes first. Before the first piece
        of a string stands the empty string.
        """
        left, right = pair
        b = self.edges[right]
        if b is None or not left:
            return b is not None
        a, b = self.edges[left][1], b[0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            r = self.rank(x, y)
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if x_ends is NEVER and y_ends is NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def candidates(self, text: str, end: int) -> tuple[int, ...]:
        """Lengths of the pieces that can end here."""
        for n in (4, 3, 2, 1):
            if n <= end and (found := self.tails.get(text[end - n : end])):
                return found
        raise ValueError(f"{text[end - 1]!r} is no piece")

    def walk(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Last pieces and numbers of pieces of all prefixes of each text.

        What a text shares at its start with the one before is not worked out again, so sorted texts cost
        what a tree of them would. The lists are reused: take what is needed before the next step.
        """
        known, agrees, tails = self.vocabulary, self.agrees, self.tails.get
        last, counts, before = [""], [0], ""
        for text in texts:
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                ways = end > 3 and (tails(text[end - 4 : end]) or tails(text[end - 3 : end]) or tails(text[end - 2 : end])) or self.candidates(text, end)
                for n in ways:
                    if n <= end and ((piece := text[end - n : end]) in known or n < 5) and agrees[last[end - n], piece]:
                        last.append(piece)
                        counts.append(counts[end - n] + 1)
                        break
            before = text
            yield last, counts

    def prefix_counts(self, text: str) -> list[int]:
        """How many pieces each prefix has, from the empty one to the whole text."""
        return next(self.walk([text]))[1]

    def stream(self, text: str) -> Iterator[str]:
        """Pieces of the text, each as soon as no later text can change it."""
        return Search(self).pieces(text)


class Search:
    """The streaming search, over one text after another.

    It keeps the back pointers of a window only: the last `longest` prefixes can be extended, older ones matter as far as a
    surviving path leads through them. Whenever the window has twice that many, the paths of the last `longest` prefixes are
    followed back to the boundary in which all meet; what lies before it is final, is given out and leaves the window. As long as
    nothing has left it, the window of a text serves the next one as far as they begin alike, so sorted texts cost what a tree of
    them would.
    """

    def __init__(self, owner: Pieces):
        self.owner, self.last, self.before, self.done = owner, [""], "", 0

    def pieces(self, text: str) -> Iterator[str]:
        owner, same = self.owner, 0
        known, agrees, tails, longest = owner.vocabulary, owner.agrees, owner.tails.get, owner.longest
        if self.done:
            self.last, self.done = [""], 0
        else:
            most = min(len(text), len(self.before))
            while same < most and text[same] == self.before[same]:
                same += 1
        last, done, end, size = self.last, 0, same, len(text)  # last[n]: last piece of the prefix of done + n units
        del last[same + 1 :]
        self.before, full = text, 2 * longest
        while end < size:
            stop = min(size, max(end + 1, done + full))
            for end in range(end + 1, stop + 1):
                ways = end > 3 and (tails(text[end - 4 : end]) or tails(text[end - 3 : end]) or tails(text[end - 2 : end])) or owner.candidates(text, end)
                for n in ways:
                    if n <= end - done and ((piece := text[end - n : end]) in known or n < 5) and agrees[last[end - n - done], piece]:
                        last.append(piece)
                        break
            if end < size:
                meet = self.meet(end, done, longest)
                if meet > done:
                    yield from self.path(meet, done)
                    del last[: meet - done]
                    self.done = done = meet
                full = 2 * longest if end - done < 2 * longest else end - done + longest  # paths that don't meet yet need a longer window
        yield from self.path(size, done)

    def meet(self, end: int, done: int, longest: int) -> int:
        """The last boundary through which the paths of all of the last `longest` prefixes lead."""
        last = self.last
        alive = set(range(max(done, end - longest + 1), end + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(last[top - done]))
        return alive.pop()

    def path(self, at: int, done: int) -> list[str]:
        """The pieces between `done` and this boundary."""
        out = []
        while at > done:
            out.append(self.last[at - done])
            at -= len(out[-1])
        out.reverse()
        return out
