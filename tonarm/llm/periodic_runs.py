"""Periodic run detection (operator 12): an online sparse diagonal DP over the words of each text.

A run of period q is a diagonal: words that equal the word q before them, one after another. Each word's earlier
occurrences increment the lengths of the active lags; a lag that is not incremented ends, and if its diagonal is long
enough its run is emitted at once. The DP is kept sparse by counting only earlier occurrences that can matter. A run has
at least four periods, so from each of its words on but the last, the next m words, 2q <= m <= 3q, also stand q before;
and because m holds two whole periods, no nearer place has them. So for every m of a list that grows by half (2, 3, 4, 6,
9, ...) a word needs only the nearest earlier place that goes on alike for m words, and counts for a lag between m / 3
and m / 2. Such places come from sorted numbers of m-word strings, made exactly, without hashes, of the numbers of
shorter ones; words whose strings occur once in their text drop out. That takes n log n steps for any text, one repeated
word included, and leaves little more than the runs themselves to the DP.

Texts are handled where they lie: nothing is shuffled, and a text's runs need memory in proportion to its words.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; with a null doc_id the rule that
plants periods (see `planted`) leaves the words alone; repeated rows are handled each; an empty table gives no rows; only
doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

from pyspark.sql import DataFrame

from .common import binary, spread, table

#: The least length of a run: LEAST words, and TIMES periods.
LEAST, TIMES = 6, 4
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Bytes of texts whose words are numbered together, but for a single longer text.
TOGETHER = 2 << 20


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of a tenth of the documents, told by doc_id, the words from a place on are repeated with a period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def earlier(numbers, at, stop):
    """For places `at`, sorted: the distance to the nearest earlier place with the same number in the same text, 0 for none; and whether any place has it."""
    import numpy as np

    order = np.lexsort((at, numbers, stop))
    p, x, s = at[order], numbers[order], stop[order]
    same = np.r_[False, (x[1:] == x[:-1]) & (s[1:] == s[:-1])]
    back = np.zeros(len(at), np.int64)
    back[order] = np.where(same, p - np.r_[0, p[:-1]], 0)
    shared = np.zeros(len(at), bool)
    shared[order] = same | np.r_[same[1:], False]
    return back, shared


def occurrences(numbers, stop):
    """numbers: those of all texts' words; stop: the end of each word's text. Rows (place, lag, m): from place on, m words equal those lag before, 2 * lag <= m <= 3 * lag."""
    import numpy as np

    at, m = np.arange(len(numbers)), 1
    known = numbers.astype(np.int64)  # numbers of the m-word strings, -1 where one occurs once in its text or passes its end
    found = []
    while len(at):
        back, shared = earlier(known[at], at, stop[at])
        hit = (back > 0) & (2 * back <= m) & (3 * back >= m)
        # Each lag belongs to the least m that holds it twice.
        hit &= 2 * back > before if m > 1 else False
        found.append(np.stack([at[hit], back[hit], np.full(hit.sum(), m)], axis=1))
        keep = np.full(len(known), -1, np.int64)
        keep[at[shared]] = known[at[shared]]
        at, before, longer = at[shared], m, max(m + 1, m * 3 // 2)
        at = at[at + longer <= stop[at]]
        left, right = keep[at], keep[at + longer - m]
        both = right >= 0
        at, left, right = at[both], left[both], right[both]
        _, pair = np.unique(left << 32 | right, return_inverse=True)
        known = np.full(len(known), -1, np.int64)
        known[at] = pair
        m = longer
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(places) -> list[tuple[int, int, int]]:
    """places: rows (place, lag, m), sorted. Runs (start, length, period) by the online DP over them."""
    runs, active = [], {}  # lag: the first place of its diagonal, the end of what matches

    def emit(lag, first, end):
        if end - first + lag >= max(LEAST, TIMES * lag):
            runs.append((first - lag, end - first + lag, lag))

    now, last = {}, None
    for place, lag, m in places:
        if place != last:
            for x in active.keys() - now.keys():
                emit(x, *active[x])
            if last is not None and place > last + 1:
                for x in now:
                    emit(x, *now[x])
                now = {}
            active, now, last = now, {}, place
        first = active[lag][0] if lag in active else place
        now[lag] = (first, place + m)
    for held in ({k: v for k, v in active.items() if k not in now}, now):
        for x in held:
            emit(x, *held[x])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def detect(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    import numpy as np

    names: dict[bytes, int] = {}
    numbers = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
    ends = np.cumsum([len(words) for words in texts])
    places = occurrences(numbers, np.repeat(ends, [len(words) for words in texts]))
    places = places[np.argsort(places[:, 0], kind="stable")]
    cuts = np.searchsorted(places[:, 0], np.r_[0, ends])
    starts = np.r_[0, ends]
    return [[(s - base, n, q) for s, n, q in runs_of(places[i:j].tolist())] if j > i else [] for base, i, j in zip(starts[:-1].tolist(), cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs) -> list[bytes]:
    """words without those that any run contains after its first period."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep, strict=True) if k] if runs else words


def row(doc_id, words, runs) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    said = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *values, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def periodic_runs(docs: DataFrame, plant=planted) -> DataFrame:
    """Rows of OUT, one per input row (doc_id, text); plant(doc_id, words) gives the words that count."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [x.split()[0] for x in OUT.split(", ")]

        def out(ids, texts):
            rows = [row(*x) for x in zip(ids, texts, detect(texts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                if size and size + len(text) > TOGETHER:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(plant(doc_id, text.split()))  # at white space of ASCII
                size += len(text)
            if ids:
                yield out(ids, texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: In SQL every word would meet all its earlier occurrences, quadratic in long texts; tested against brute force instead.
SQL = None
