"""External suffix sorting by induction, with common prefixes, in numpy.

The suffixes of a text of integers are sorted by the induced-sorting recursion: suffixes that start a rise after a
fall (S*) are sorted first, by sorting the substrings between them, naming equal ones alike and sorting the string
of names in the same way; from them, one ascending pass through a priority queue induces the order of all falling
(L) suffixes, and one descending pass that of all rising (S) ones.

The queues carry (key, position, common prefix) tuples. The common prefix is that with the tuple before it of the
same key, in symbols of the first text, up to ``most``. Two suffixes that are induced one after the other into one
key have the length of their first symbol in common, and the least common prefix of all tuples that came out between
the two that induced them (``Minima``); so common prefixes pass from level to level of the recursion and through both
passes of each. Only where keys meet, once for each symbol and type, are texts compared.

Queues are monotone and work in bulk: they hold ranges of keys, in files beyond the memory budget; a range is cut
again until it is small enough to be sorted in memory or is one key, whose tuples are taken as they came. Of the
front, the longest run is taken at once whose induced tuples all come after it. Texts, types, positions, names,
orders and results beyond the budget are memory-mapped files, made and read in pieces of ``STEP``; their pages are given
back every ``BREATH`` tuples, and files are unlinked as soon as they are mapped. The recursion ends in memory below ``SMALL`` symbols. Names are equal where substrings
are: neighbours are compared symbol by symbol, not by hashes.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import weakref
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

RANGES = 64
BUDGET = 8 << 20
#: Tuples between two times that mapped pages are given back.
BREATH = 1 << 20
STEP = 1 << 17
#: A range of at most so many tuples is sorted in memory.
LOAD = 1 << 15
#: Strings of at most so many symbols are sorted in memory, by doubling: there the recursion ends.
SMALL = 1 << 18
PAD = 264


class Workspace:
    """A folder of the task's own for what does not fit in memory; gone when the task is done with it."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.path, self.files = budget, None, 0
        self.maps: list[weakref.ref] = []

    def mapped(self, path: str, dtype, mode: str, n: int | None = None) -> np.ndarray:
        out = np.memmap(path, dtype, mode, shape=n)
        os.unlink(path)
        self.maps = [m for m in self.maps if m() is not None] + [weakref.ref(out._mmap)]
        return out

    def breathe(self) -> None:
        """Give the mapped pages back: they are in their files, and what is read again comes from there."""
        for ref in self.maps:
            if (own := ref()) is not None:
                own.madvise(mmap.MADV_DONTNEED)

    def file(self) -> str:
        if self.path is None:
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.path = tempfile.mkdtemp(prefix="induced-", dir=local if local and os.path.isdir(local) else None)
        self.files += 1
        return os.path.join(self.path, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        """Zeros; a mapped file if they are many."""
        if n * np.dtype(dtype).itemsize <= self.budget:
            return np.zeros(n, dtype)
        return self.mapped(self.file(), dtype, "w+", n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.path is not None:
            shutil.rmtree(self.path, ignore_errors=True)


class Spool:
    """Arrays appended one after another, in a file beyond the budget."""

    def __init__(self, space: Workspace, dtype=np.int64, budget: int | None = None):
        self.space, self.dtype, self.budget = space, dtype, space.budget if budget is None else budget
        self.parts: list[np.ndarray] = []
        self.size, self.n, self.path = 0, 0, None

    def append(self, array: np.ndarray) -> None:
        self.parts.append(array)
        self.size += array.nbytes
        self.n += len(array)
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.path = self.path or self.space.file()
        with open(self.path, "ab") as f:
            for x in self.parts:
                np.ascontiguousarray(x, self.dtype).tofile(f)
        self.parts, self.size = [], 0

    def take(self) -> np.ndarray:
        """Everything, in order; the spool is empty then."""
        if self.path is None:
            out = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        else:
            if self.parts:
                self._spill()
            out = self.space.mapped(self.path, self.dtype, "r")
        self.parts, self.size, self.n, self.path = [], 0, 0, None
        return out


class _Sorted:
    """A range of keys, in order in memory; equal keys in order of insertion."""

    def __init__(self, both: np.ndarray):
        order = np.argsort(both[:, 0], kind="stable")
        self.keys, self.values = both[order, 0], both[order, 1]

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        if not len(self.keys) or keys[0] >= self.keys[-1]:
            self.keys, self.values = np.concatenate((self.keys, keys)), np.concatenate((self.values, values))
        else:
            to = np.searchsorted(self.keys, keys, "right")
            self.keys, self.values = np.insert(self.keys, to, keys), np.insert(self.values, to, values)

    def front(self, look: int) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[:look], self.values[:look]

    def drop(self, n: int) -> None:
        self.keys, self.values = self.keys[n:], self.values[n:]


class _Line:
    """One key: first in, first out."""

    def __init__(self, both: np.ndarray):
        self.parts = deque([both] if len(both) else [])

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append(np.stack((keys, values), 1))

    def front(self, look: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.asarray(self.parts[0][:look])
        return both[:, 0], both[:, 1]

    def drop(self, n: int) -> None:
        self.parts[0] = self.parts[0][n:]
        if not len(self.parts[0]):
            self.parts.popleft()


class Queue:
    """A monotone bulk priority queue over keys from ``lo`` on, ``span`` of them. Equal keys come out in order of insertion."""

    def __init__(self, space: Workspace, span: int, lo: int = 0, both: np.ndarray | None = None):
        self.space, self.lo, self.width = space, lo, max(1, -(-span // RANGES))
        self.ranges = [Spool(space, np.int64, max(1 << 12, space.budget // RANGES)) for _ in range(-(-span // self.width))]
        self.now, self.active = -1, None
        for k in range(0, 0 if both is None else len(both), STEP):
            part = np.asarray(both[k : k + STEP])
            self.push(part[:, 0], part[:, 1])

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys):
            return
        of = (keys - self.lo) // self.width
        if len(keys) > 1 and (of[0] != of[-1] or (of != of[0]).any()):
            order = np.argsort(of, kind="stable")
            of, keys, values = of[order], keys[order], values[order]
            bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        else:
            bounds = [0, len(of)]
        both = np.stack((keys, values), 1)
        for lo, hi, r in zip(bounds, bounds[1:], of[bounds[:-1]].tolist()):
            if r == self.now:
                self.active.push(keys[lo:hi], values[lo:hi])
            else:
                self.ranges[r].append(both[lo:hi])

    def front(self, look: int) -> tuple[np.ndarray, np.ndarray]:
        """Some of the least tuples, at most ``look``; none if nothing is left."""
        while True:
            if self.active is not None:
                keys, values = self.active.front(look)
                if len(keys):
                    return keys, values
            if self.now + 1 == len(self.ranges):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            self.now += 1
            both = self.ranges[self.now].take().reshape(-1, 2)
            if self.width == 1:
                self.active = _Line(both)
            elif len(both) <= LOAD:
                self.active = _Sorted(np.asarray(both))
            else:
                self.active = Queue(self.space, self.width, self.lo + self.now * self.width, both)

    def drop(self, n: int) -> None:
        self.active.drop(n)


_LOG = np.array([0, 0, *(k.bit_length() - 1 for k in range(2, 64))], np.intp)


class Minima:
    """Least values of ranges of a sequence that grows: windows of 1 to 32 values, and the same over blocks of 32, and of these."""

    def __init__(self, space: Workspace, n: int):
        self.rows, self.n = [], []
        while True:
            self.rows.append([space.array(n + 1, np.uint8) for _ in range(6)])
            self.n.append(0)
            if n < 32:
                return
            n //= 32

    def append(self, values: np.ndarray, level: int = 0) -> None:
        rows, base = self.rows[level], self.n[level]
        end = base + len(values)
        rows[0][base:end] = values
        for j in range(1, 6):
            h = 1 << (j - 1)
            s = max(base, h)
            rows[j][base:end] = rows[j - 1][base:end]
            if s < end:
                np.minimum(rows[j - 1][s:end], rows[j - 1][s - h : end - h], out=rows[j][s:end])
        self.n[level] = end
        if level + 1 < len(self.rows) and end // 32 > self.n[level + 1]:
            self.append(np.asarray(rows[5][32 * self.n[level + 1] + 31 : end : 32]), level + 1)

    def after(self, a: np.ndarray, k: np.ndarray, level: int = 0) -> np.ndarray:
        """The least of the values behind place a, up to place k; a < k."""
        rows, size = self.rows[level], k - a
        out = np.empty(len(a), np.uint8)
        log = _LOG[np.minimum(size, 63)]
        for j in range(6):
            at = np.flatnonzero(log == j)
            if len(at):
                out[at] = np.minimum(rows[j][k[at]], rows[j][a[at] + (1 << j)])
        far = np.flatnonzero(size >= 64)
        if len(far):
            lo, hi = (a[far] + 32) // 32, (k[far] + 1) // 32 - 1
            some = hi >= lo
            far = far[some]
            if len(far):
                out[far] = np.minimum(out[far], self.after(lo[some] - 1, hi[some], level + 1))
        return out


class Level:
    """A text of the recursion. ``data`` has ``n`` symbols, of which the last is the only 0; ``where`` says where in the first text each begins."""

    def __init__(self, space: Workspace, data: np.ndarray, n: int, top: int, where: np.ndarray | None, common: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int):
        self.space, self.data, self.n, self.top, self.where, self.common, self.most = space, data, n, top, where, common, most
        self.rising = self._types()

    def _types(self) -> np.ndarray:
        """Whether each suffix rises: its first symbol is less than the next other one."""
        out = self.space.array(self.n, bool)
        out[self.n - 1] = True
        for hi in range(self.n - 1, 0, -STEP):
            lo = max(0, hi - STEP)
            t = np.asarray(self.data[lo : hi + 1])
            m = hi - lo
            turn = np.minimum.accumulate(np.where(t[:-1] != t[1:], np.arange(m), m)[::-1])[::-1]
            out[lo:hi] = np.append(t[:-1] < t[1:], out[hi])[turn]
        return out

    def at_first(self, at: np.ndarray) -> np.ndarray:
        return at if self.where is None else self.where[at]

    def width(self, at: np.ndarray) -> np.ndarray:
        """How many symbols of the first text those at ``at`` stand for, up to ``most``."""
        return np.ones(len(at), np.int64) if self.where is None else np.minimum(self.where[at + 1] - self.where[at], self.most)

    def prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.common(self.at_first(a), self.at_first(b))


def _chunks(*arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for lo in range(0, len(arrays[0]), STEP):
        yield tuple(np.asarray(x[lo : lo + STEP]) for x in arrays)


def _backwards(*arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for hi in range(len(arrays[0]), 0, -STEP):
        yield tuple(np.asarray(x[max(0, hi - STEP) : hi])[::-1] for x in arrays)


def _induce(level: Level, seeds: Iterator[tuple[np.ndarray, np.ndarray]], n_out: int, to_rising: bool, carry: bool, stars_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Take everything out in order of keys, pushing the suffix before each if it is of the type that is induced. Of the
    suffixes of this type: their positions in the order in which they come out, and (with ``carry``) the common prefix of
    each with the one that came out before it, where both are of one key.

    seeds: positions, and common prefixes with the seed before, of the other type, in the order of this pass."""
    space, text, rising = level.space, level.data, level.rising
    limit = 2 * (level.top + 1)

    def keys_of(symbols: np.ndarray, rises: bool) -> np.ndarray:
        return limit - 1 - (2 * symbols + rises) if to_rising else 2 * symbols + rises

    queue, n_seeds = Queue(space, limit), 0
    for at, common in seeds:
        queue.push(keys_of(text[at].astype(np.int64), not to_rising), at << 8 | common)
        n_seeds += len(at)
    out, out_common = Spool(space), Spool(space, np.uint8)
    minima = Minima(space, n_seeds + n_out) if carry else None
    last = space.array(level.top + 1, np.int64) if carry else None  # 1 more than the place of the last tuple that induced into a symbol
    done, key_before, at_before = 0, -1, 0
    look = 1 << 12
    while True:
        keys, values = queue.front(look)
        if not len(keys):
            return out.take(), out_common.take()
        at = values >> 8
        before = at - 1
        known = np.maximum(before, 0)
        induced = (before >= 0) & (rising[known] == to_rising)
        symbols = text[known].astype(np.int64)
        new = np.where(induced, keys_of(symbols, to_rising), limit)
        late = np.minimum.accumulate(new)[:-1] < keys[1:]
        n = int(late.argmax()) + 1 if late.any() else len(keys)
        look = min(STEP, max(1 << 10, 4 * n)) if n < len(keys) else min(STEP, 2 * look)
        keys, values, at = keys[:n], values[:n], at[:n]
        of_type = rising[at] == to_rising
        wanted = of_type & (at > 0) & ~rising[np.maximum(at - 1, 0)] if stars_only else of_type
        if carry:
            common = (values & 255).astype(np.uint8)
            border = np.flatnonzero(np.diff(np.concatenate(([key_before], keys))) != 0)
            if done == 0:
                common[0], border = 0, border[1:]
            if len(border):
                common[border] = level.prefixes(np.concatenate(([at_before], at))[border], at[border])
            minima.append(common)
            key_before, at_before = int(keys[-1]), int(at[-1])
        mine = at[wanted]
        if len(mine):
            out.append(mine)
            if carry:
                out_common.append(common[wanted])
        push = np.flatnonzero(induced[:n])
        new, target = new[push], before[push]
        shared = 0
        if carry and len(push):
            symbols = symbols[push]
            order = np.argsort(symbols, kind="stable")
            own, place = symbols[order], push[order] + done + 1
            first = np.concatenate(([True], own[1:] != own[:-1]))
            previous = np.concatenate(([0], place[:-1]))
            previous[first] = last[own[first]]
            last[own[np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)]] = place[np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)]
            some = np.flatnonzero(previous > 0)
            shared = np.zeros(len(push), np.int64)
            shared[order[some]] = minima.after(previous[some] - 1, place[some] - 1)
            shared[order[some]] = np.minimum(shared[order[some]] + level.width(target[order[some]]), level.most)
        queue.drop(n)
        if done // BREATH != (done + n) // BREATH:
            space.breathe()
        done += n
        queue.push(new, target << 8 | shared)


def _all(level: Level, stars: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix of each with the one before it, from those of the S* suffixes."""
    space, n = level.space, level.n
    n_rising = sum(int(np.count_nonzero(x)) for (x,) in _chunks(level.rising))
    falls, falls_common = _induce(level, _chunks(stars, common), n - n_rising, False, True)
    # Backwards, the common prefix of a suffix with the one behind it is the other's with the one before it.
    shifted = Spool(space, np.uint8)
    shifted.append(np.zeros(1, np.uint8))
    down = (x for x in _backwards(falls_common))
    for (x,) in down:
        shifted.append(x)
    shifted = shifted.take()[: len(falls)]
    rises, rises_common = _induce(level, _zip(_backwards(falls), _chunks(shifted)), n_rising, True, True)
    del shifted
    # Falling suffixes of a symbol come before its rising ones; the end comes before all.
    counts = [space.array(level.top + 2, np.int64) for _ in range(2)]
    for (at,), count in ((x, c) for source, c in ((falls, counts[0]), (rises, counts[1])) for x in _chunks(source)):
        symbols, size = np.unique(level.data[at], return_counts=True)
        count[symbols.astype(np.int64) + 1] += size
    counts[1][1] += 1
    for count in counts:
        total = 0
        for lo in range(0, len(count), STEP):
            count[lo : lo + STEP] = np.cumsum(count[lo : lo + STEP]) + total
            total = int(count[min(lo + STEP, len(count)) - 1])
    order, prefix = space.array(n, np.int64), space.array(n, np.uint8)
    order[0] = n - 1
    done = 0
    for at, shared in _chunks(falls, falls_common):
        to = np.arange(done, done + len(at)) + counts[1][level.data[at].astype(np.int64)]
        order[to], prefix[to] = at, shared
        done += len(at)
    done = len(rises)
    carried = np.zeros(1, np.uint8)  # of the greater neighbour, which came out before
    for at, shared in _chunks(rises, rises_common):
        symbols = level.data[at].astype(np.int64)
        to = np.arange(done, done - len(at), -1) + counts[0][symbols + 1]
        order[to] = at
        prefix[to[:-1]] = shared[1:]
        if done < len(rises):
            prefix[to[0] + 1] = shared[0] if before == symbols[0] else prefix[to[0] + 1]
        before = symbols[-1]
        done -= len(at)
    del carried
    space.breathe()
    # Where another symbol or type begins, suffixes are compared.
    for lo in range(1, n, STEP):
        at = np.asarray(order[lo - 1 : lo + STEP])
        kind = 2 * level.data[at].astype(np.int64) + level.rising[at]
        border = np.flatnonzero(np.diff(kind))
        if len(border):
            prefix[lo + border] = level.prefixes(at[border], at[border + 1])
    return order, prefix


def _zip(a: Iterator, b: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two sequences of chunks as one of pairs of chunks of equal lengths."""
    x = y = np.empty(0, np.int64)
    while True:
        if not len(x):
            x = next(a, (None,))[0]
        if not len(y):
            y = next(b, (None,))[0]
        if x is None or y is None:
            return
        m = min(len(x), len(y))
        yield x[:m], y[:m].astype(np.int64)
        x, y = x[m:], y[m:]


def _named(level: Level, stars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """From S* suffixes by their substrings in order: the name of each by half its position, one more than it, and how many names there are.
    sizes: lengths of substrings, by half their positions, end included."""
    space, data = level.space, level.data
    names = space.array(level.n // 2 + 1, np.int64)
    name, last = 1, int(stars[0])
    names[last >> 1] = 1
    for (at,) in _chunks(stars[1:]):
        a, b = np.concatenate(([last], at[:-1])), at
        size = sizes[b >> 1]
        same = sizes[a >> 1] == size
        cuts = np.cumsum(np.where(same, size, 0))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + 4 * STEP, "right")))
            rows = np.flatnonzero(same[lo:hi]) + lo
            if len(rows):
                n = size[rows]
                first = np.cumsum(n) - n
                along = np.arange(int(n.sum())) - np.repeat(first, n)
                equal = data[np.repeat(a[rows], n) + along] == data[np.repeat(b[rows], n) + along]
                same[rows] = np.logical_and.reduceat(equal, first)
            lo = hi
        own = name + np.cumsum(~same)
        names[b >> 1] = own
        name, last = int(own[-1]), int(b[-1])
    return names, name


def _doubled(names: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a short string in order, by sorting on ever longer prefixes."""
    n, rank, k = len(names), np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] + 1 == n:
            return order
        k *= 2


def _compared(level: Level, order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in an order, by comparing them."""
    out = level.space.array(len(order), np.uint8)
    for lo in range(1, len(order), STEP):
        at = np.asarray(order[lo - 1 : lo + STEP])
        out[lo : lo + len(at) - 1] = level.prefixes(at[:-1], at[1:])
    return out


def _sorted_level(level: Level) -> tuple[np.ndarray, np.ndarray]:
    space, n = level.space, level.n
    if n < 3 or n <= SMALL:
        order = _doubled(np.asarray(level.data[:n])) if n > 1 else np.zeros(n, np.int64)
        return order, _compared(level, order)
    found, last = Spool(space), -1
    sizes = space.array(n // 2 + 1, np.int32)
    for lo in range(1, n, STEP):
        types = np.asarray(level.rising[lo - 1 : lo + STEP])
        at = np.flatnonzero(types[1:] & ~types[:-1]) + lo
        if len(at):
            ends = np.concatenate(([last] if last >= 0 else [], at))
            sizes[ends[:-1].astype(np.int64) >> 1] = np.diff(ends) + 1
            last = int(at[-1])
            found.append(at)
    sizes[last >> 1] = 1
    stars = found.take()
    if len(stars) == 1:
        return _all(level, stars, np.zeros(1, np.uint8))
    zeros = (np.zeros(min(STEP, len(stars) - lo), np.uint8) for lo in range(0, len(stars), STEP))
    n_rising = sum(int(np.count_nonzero(x)) for (x,) in _chunks(level.rising))
    falls, _ = _induce(level, _zip(_chunks(stars), ((z,) for z in zeros)), n - n_rising, False, False)
    zeros = (np.zeros(min(STEP, len(falls) - lo), np.uint8) for lo in range(0, len(falls), STEP))
    down, _ = _induce(level, _zip(_backwards(falls), ((z,) for z in zeros)), n_rising, True, False, stars_only=True)
    del falls
    by_substring = Spool(space)
    by_substring.append(np.array([n - 1]))
    for (x,) in _backwards(down):
        by_substring.append(x)
    by_substring = by_substring.take()
    del down
    space.breathe()
    names, count = _named(level, by_substring, sizes)
    space.breathe()
    del sizes
    if count == len(stars):
        del names
        return _all(level, by_substring, _compared(level, by_substring))
    del by_substring
    reduced, where = space.array(len(stars) + PAD, np.uint32), space.array(len(stars), np.int64)
    done = 0
    for (at,) in _chunks(stars):
        reduced[done : done + len(at)] = names[at >> 1] - 1
        where[done : done + len(at)] = level.at_first(at)
        done += len(at)
    del names
    below = Level(space, reduced, len(stars), count - 1, where, level.common, level.most)
    order, common = _sorted_level(below)
    del below, reduced, where
    placed = Spool(space)
    for (at,) in _chunks(order):
        placed.append(np.asarray(stars[at]))
    del order
    return _all(level, placed.take(), common)


def common_prefixes(data: np.ndarray, most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Common prefixes of suffixes of a text of 16-bit symbols, up to ``most``. ``data`` has ``PAD`` more zeros behind."""
    words = np.ndarray(len(data) - 3, np.dtype("<u8"), buffer=data, strides=(2,))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(0, most, 4):
            differ = words[a[alive] + k] ^ words[b[alive] + k]
            odd = differ != 0
            same = np.full(len(alive), 4)
            low = differ[odd] & (~differ[odd] + np.uint64(1))
            # The lowest symbol that differs is the first one in the text.
            same[odd] = (np.frexp(low.astype(np.float64))[1] - 1) // 16
            out[alive] = k + same
            alive = alive[~odd]
            if not len(alive):
                break
        return np.minimum(out, most).astype(np.uint8)

    return common


def suffix_order(data: np.ndarray, n: int, most: int, space: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes of a text in order, and the common prefix of each with the one before it, up to ``most`` < 256.
    data: uint16, ``n`` symbols, of which the last is the only 0, and ``PAD`` more zeros."""
    top = max((int(np.max(x)) for (x,) in _chunks(data[:n])), default=0)
    return _sorted_level(Level(space, data, n, top, None, common_prefixes(data, most), most))
