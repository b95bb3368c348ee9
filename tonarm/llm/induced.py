"""External induced suffix sorting with common prefixes, for one shard in one task.

Suffixes are L or S by comparison with their right neighbour; S suffixes to the right of an L are seeds. The seeds'
substrings are sorted by induction and named, the string of names is sorted by recursion, and from the sorted seeds
two passes induce the rest: each extracts suffix tuples from a priority queue in ascending order and inserts their
left neighbours. The queue's keys never fall behind what was extracted, so it is a row of buckets, each first in,
first out; buckets beyond a memory bound are on disk. Common-prefix values, capped, travel with the tuples: those
of neighbours in a bucket are one more than the least value between the suffixes that induced them.

All steps run over numpy blocks; arrays larger than a bound are files in a temporary folder of the task, gone at the end.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of queue blocks held in memory, and of an array held in memory rather than mapped from a file.
QUEUE_MEMORY, ARRAY_MEMORY = 64 << 20, 256 << 20
#: Tuples extracted at a time where symbols are many.
BATCH = 1 << 16
#: Alphabets up to this size have a bucket for each symbol.
FEW = 1 << 10


class Scratch:
    def __init__(self, limit: int | None = None):
        self.limit, self.folder = ARRAY_MEMORY if limit is None else limit, None

    def path(self) -> str:
        if self.folder is None:
            # In a task the disks that Spark spills to; they go with the executor.
            local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.folder = tempfile.TemporaryDirectory(prefix="induced-", dir=local if os.path.isdir(local) else None)
        return self.folder.name

    def empty(self, n: int, kind):
        if n * np.dtype(kind).itemsize <= self.limit:
            return np.empty(n, kind)
        return np.memmap(tempfile.NamedTemporaryFile(dir=self.path(), delete=False).name, kind, "w+", shape=(max(n, 1),))  # noqa: SIM115

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class BucketQueue:
    """A monotone priority queue of (position, rank of its inducer) by bucket; within a bucket in order of arrival."""

    def __init__(self, buckets: int, scratch: Scratch, memory: int | None = None):
        self.blocks: list[list] = [[] for _ in range(buckets)]
        self.scratch, self.memory, self.held = scratch, QUEUE_MEMORY if memory is None else memory, 0

    def push(self, at: int, pos, rank) -> None:
        self.blocks[at].append((pos, rank))
        self.held += pos.nbytes + rank.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        with tempfile.NamedTemporaryFile(dir=self.scratch.path(), delete=False) as f:
            for i, blocks in enumerate(self.blocks):
                for j, b in enumerate(blocks):
                    if len(b) == 2:
                        both = np.concatenate([b[0], b[1]]).astype(np.int64)
                        blocks[j] = (f.name, f.tell(), len(both))
                        both.tofile(f)
                self.blocks[i] = blocks
        self.held = 0

    def pop(self, at: int):
        found, self.blocks[at] = self.blocks[at], []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for b in found:
            if len(b) == 3:
                both = np.fromfile(b[0], np.int64, b[2], offset=b[1])
                out.append((both[: b[2] // 2], both[b[2] // 2 :]))
            else:
                self.held -= b[0].nbytes + b[1].nbytes
                out.append(b)
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def deal(self, buckets, pos, rank) -> None:
        """Pushes blocks in their order, each to its bucket."""
        if not len(pos):
            return
        by = np.argsort(buckets, kind="stable")
        sorted_ = buckets[by]
        cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(by)], strict=True):
            self.push(int(sorted_[a]), pos[by[a:b]], rank[by[a:b]])


class Lows:
    """Minima of ranges of a growing array of bytes."""

    def __init__(self, n: int, scratch: Scratch):
        self.rows = [scratch.empty(n, np.uint8) for _ in range(max(1, n.bit_length()))]
        self.n = 0

    def append(self, values) -> None:
        a, b = self.n, self.n + len(values)
        self.rows[0][a:b] = values
        for j in range(1, len(self.rows)):
            half, first = 1 << (j - 1), max(a, (1 << j) - 1)
            if first >= b:
                break
            self.rows[j][first:b] = np.minimum(self.rows[j - 1][first:b], self.rows[j - 1][first - half : b - half])
        self.n = b

    def least(self, a, b):
        """Over [a, b], each a <= b."""
        out = np.empty(len(a), np.uint8)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            row = self.rows[j]
            out[at] = np.minimum(row[b[at]], row[a[at] + (1 << int(j)) - 1])
        return out


def seeds_and_types(text):
    """S types of a text that ends in a unique least symbol, and the seeds' positions."""
    n = len(text)
    step = np.sign(np.diff(text)).astype(np.int8)  # of text[i + 1] - text[i]
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    small = np.empty(n, bool)
    small[:-1] = step[np.minimum(nxt, n - 2)] > 0 if n > 1 else False
    small[-1] = True
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, seeds


def prefixes(words, a, b, cap: int):
    """Common prefixes of suffixes a and b, up to cap (a multiple of 4): words[i] is four 16-bit symbols from i on."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 4):
        x = words[a[live] + at] ^ words[b[live] + at]
        same = x == 0
        ended = live[~same]
        low = x[~same] & (~x[~same] + np.uint64(1))
        out[ended] = at + (np.bitwise_count(low - np.uint64(1)) >> 4)
        live = live[same]
        if not len(live):
            return out
    out[live] = cap
    return out


def induce_few(symbols, induced, given, scratch, low=None):
    """One pass over an alphabet of few symbols: the induced suffixes of each symbol, then its given ones, in order.

    low: (cap, values of neighbours among the given, compare(a, b)) carries common prefixes; then they are returned too.
    """
    k = int(symbols.max()) + 1
    queue = BucketQueue(k, scratch)
    cuts = np.searchsorted(symbols[given], np.arange(k + 1))
    order, values, rank = [], [], 0
    lows = Lows(len(symbols) + 1, scratch) if low else None

    def take(pos, value):
        """Appends to the order, and lets the suffixes induce those to their left."""
        nonlocal rank
        ranks = np.arange(rank, rank + len(pos))
        rank += len(pos)
        order.append(pos)
        if low:
            values.append(value)
            lows.append(value)
        some = pos > 0
        left, ranks = pos[some] - 1, ranks[some]
        right_kind = induced[left]
        left, ranks = left[right_kind], ranks[right_kind]
        queue.deal(symbols[left].astype(np.uint16), left, ranks)

    for c in range(k):
        last = last_rank = None
        while True:
            pos, by = queue.pop(c)
            if not len(pos):
                break
            value = None
            if low:
                value = np.zeros(len(pos), np.uint8)
                a = np.r_[by[0] if last_rank is None else last_rank, by[:-1]]
                at = slice(1 if last_rank is None else 0, None)
                value[at] = np.minimum(lows.least(a[at] + 1, by[at]).astype(np.int64) + 1, low[0])
            take(pos, value)
            last, last_rank = pos[-1], by[-1]
        own = given[cuts[c] : cuts[c + 1]]
        if len(own):
            value = None
            if low:
                value = low[1][cuts[c] : cuts[c + 1]].copy()
                value[0] = 0 if last is None else low[2](np.array([last]), own[:1])[0]
            take(own, value)
    order = np.concatenate(order)
    return (order, np.concatenate(values)) if low else order


def induce_many(symbols, induced, given, scratch):
    """The same pass over many symbols, a batch of neighbouring symbols at a time.

    Within a batch a suffix may be induced by another of the batch; its place follows from the other's, so places are
    sorted again until they stay, as often as such chains are long.
    """
    k = int(symbols.max()) + 1
    counts = np.bincount(symbols[induced], minlength=k) + np.bincount(symbols[given], minlength=k)
    batch_of = (np.cumsum(counts) - 1) // BATCH
    batch_of = np.maximum(batch_of, 0)
    batches = int(batch_of[-1]) + 1
    queue = BucketQueue(batches, scratch)
    cuts = np.searchsorted(batch_of[symbols[given]], np.arange(batches + 1))
    order, base = [], 0
    for b in range(batches):
        pos, by = queue.pop(b)
        own = given[cuts[b] : cuts[b + 1]]
        all_pos, outer = [own, pos], [np.arange(len(own)), by]
        inner = [np.full(len(own), -1), np.full(len(pos), -1)]
        first, size = 0, len(own) + len(pos)
        front = np.concatenate([own, pos])
        while len(front):
            index = np.arange(first, first + len(front))
            ok = front > 0
            left, index = front[ok] - 1, index[ok]
            ok = induced[left]
            left, index = left[ok], index[ok]
            ok = batch_of[symbols[left]] == b
            front = left[ok]
            all_pos.append(front)
            outer.append(np.zeros(len(front), np.int64))
            inner.append(index[ok])
            first, size = size, size + len(front)
        pos, outer, inner = np.concatenate(all_pos), np.concatenate(outer), np.concatenate(inner)
        if not len(pos):
            continue
        sym = symbols[pos]
        kind = np.zeros(len(pos), np.int8)
        kind[: len(own)] = 1
        place = np.zeros(len(pos), np.int64)
        inside = inner >= 0
        while True:
            second = outer.copy()
            second[inside] = base + place[inner[inside]]
            by_place = np.lexsort((second, kind, sym))
            new = np.empty_like(place)
            new[by_place] = np.arange(len(pos))
            if not inside.any() or np.array_equal(new, place):
                break
            place = new
        pos = pos[by_place]
        order.append(pos)
        ranks = np.arange(base, base + len(pos))
        base += len(pos)
        some = pos > 0
        left, ranks = pos[some] - 1, ranks[some]
        ok = induced[left]
        left, ranks = left[ok], ranks[ok]
        at = batch_of[symbols[left]]
        later = at > b
        queue.deal(at[later], left[later], ranks[later])
    return np.concatenate(order)


def induce_all(text, small, seeds_sorted, scratch, low=None):
    """Order of all suffixes from the sorted seeds (the sentinel is one): L ascending, then S descending."""
    top = int(text.max())
    few = top < FEW
    if low:
        cap, between, compare = low
        up, up_low = induce_few(text, ~small, seeds_sorted, scratch, (cap, between, compare))
    else:
        up = (induce_few if few else induce_many)(text, ~small, seeds_sorted, scratch)
    large = ~small[up]
    given = up[large][::-1]
    flipped = top - text
    if not low:
        down = (induce_few if few else induce_many)(flipped, small, given, scratch)
        return np.r_[len(text) - 1, down[::-1]]
    # Within a symbol the L suffixes come first and together, so values between them stay; others are of no use here.
    value = up_low[large]
    same = np.r_[False, text[up[large][1:]] == text[up[large][:-1]]]
    value = np.where(same, value, 0)
    turned = np.r_[np.zeros(1, np.uint8), value[1:][::-1]].astype(np.uint8) if len(value) else value
    down, down_low = induce_few(flipped, small, given, scratch, (cap, turned, compare))
    order = np.r_[len(text) - 1, down[::-1]]
    return order, np.r_[0, 0, down_low[1:][::-1]].astype(np.uint8)


def name_seeds(text, seeds, sorted_seeds):
    """Names of the seeds' substrings in text order, equal ones named alike; seeds end with the sentinel."""
    ends = np.r_[seeds[1:], seeds[-1]]
    end_of = np.zeros(len(text), np.int64)
    end_of[seeds] = ends
    a, b = sorted_seeds[:-1], sorted_seeds[1:]
    size = end_of[a] - a
    same = size == end_of[b] - b
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        equal = text[a[live] + step] == text[b[live] + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal]
        live = live[step <= size[live]]
    names = np.zeros(len(text), np.int64)
    names[sorted_seeds] = np.r_[0, np.cumsum(~same)]
    return names[seeds]


def sort_seeds(text, scratch):
    """Types and seeds of a text that ends in its unique least symbol, the seeds sorted as suffixes."""
    small, seeds = seeds_and_types(text)
    if len(seeds) == 0 or seeds[-1] != len(text) - 1:
        seeds = np.r_[seeds, len(text) - 1]
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    rough = induce_all(text, small, by_symbol, scratch)
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    sorted_ = rough[is_seed[rough]]
    names = name_seeds(text, seeds, sorted_)
    if int(names.max()) + 1 == len(names):
        return small, sorted_
    return small, seeds[suffix_order(names, scratch)]


def suffix_order(text, scratch):
    if len(text) == 1:
        return np.zeros(1, np.int64)
    small, sorted_ = sort_seeds(text, scratch)
    return induce_all(text, small, sorted_, scratch)


def repeated_windows(strings, length: int, marks=None):
    """For each of the strings, a bool array of the starts of `length` bytes that also start elsewhere in them.

    marks: (place, number) for each string: the three bytes from its place on stand for a number below 2^24, and
    are symbols of their own.
    """
    cap = -(-length // 4) * 4
    if cap > 252:
        raise ValueError("windows of up to 252 bytes")
    sizes = np.array([len(s) for s in strings], np.int64)
    if not len(sizes):
        return []
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    n = int(sizes.sum()) + len(sizes)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = raw[:n].astype(np.int64) + 2
    text[starts + sizes] = 1  # between strings
    if marks:
        at, number = (np.array(x, np.int64) for x in zip(*marks, strict=True))
        if number.max() >= 1 << 24:
            raise ValueError("more than 2^24 cores in a shard")
        for i in range(3):
            text[starts + at + i] = 258 + (number >> 8 * i & 255)
    text = np.r_[text, 0]
    padded = np.zeros((len(text) + cap + 8) // 4 * 4, np.uint16)
    padded[: len(text)] = text
    words = np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(text) + cap,), (2,))

    def compare(a, b):
        return prefixes(words, a, b, cap).astype(np.uint8)

    scratch = Scratch()
    try:
        small, sorted_ = sort_seeds(text, scratch)
        between = np.zeros(len(sorted_), np.uint8)
        if len(sorted_) > 1:
            between[1:] = compare(sorted_[:-1], sorted_[1:])
        order, low = induce_all(text, small, sorted_, scratch, (cap, between, compare))
        far = low >= length
        hit = np.zeros(len(text), bool)
        hit[order[far]] = True
        hit[order[np.flatnonzero(far) - 1]] = True
    finally:
        scratch.close()
    return [hit[a : a + max(0, s - length + 1)] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]
