"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(LEAST, POWER * q)`` words that no
neighbouring word extends. Whole texts of a task are laid end to end, longest first, with a word of its own
behind each, so that nothing matches across them. For each period ``p`` only every ``p``-th place is looked at (a harmonic grid: about
``n log n`` places in all), and only among texts of at least ``POWER * p`` words. A run with period ``p`` holds two neighbouring grid places at
least; the first of them whose words agree with those ``p`` and ``2 * p`` further on is extended to the right by one longest common extension, and to the
left by bisection, since "all words from here to the grid place agree" can be asked as one extension too.

Extensions: only suffixes that begin at places of a difference cover modulo ``STEP`` are sorted (by ``STEP``-word blocks,
then by doubling). For any two places there is a shift below ``STEP`` at which both are in the cover; up to there words are compared one by
one, and from there the common prefix is a range minimum over the sorted suffixes, from a sparse table.

Work stays in the task that reads the text; nothing is shuffled. Memory is bounded by ``BATCH_WORDS`` words, or by the longest text.

Defined cases: a null, empty or blank text has no words, no runs and the empty collapsed text; words are compared as bytes, upper and lower
case apart; a text of one repeated word is one run of period 1; repeated rows are treated each for itself; a very long text is
taken whole; ids may be null or repeated; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A perfect difference set: every difference modulo STEP but 0 occurs once.
STEP, COVER = 31, (0, 1, 3, 8, 12, 18)
LEAST, POWER = 24, 3
BATCH_WORDS = 300_000
#: Grid places treated at once.
CHUNK = 1 << 20
RUN = "array<struct<start: long, length: long, period: long>>"


def _shift_table() -> np.ndarray:
    """For a difference modulo STEP: a residue of the cover that it leads to another one from."""
    table = np.zeros(STEP, np.int64)
    for a in COVER:
        for b in COVER:
            table[(b - a) % STEP] = a
    return table


class Extensions:
    """Longest common extensions of a word sequence in which no two suffixes are equal."""

    def __init__(self, words: np.ndarray):
        size = len(COVER)
        blocks = len(words) // STEP + 1
        self.words = np.zeros((blocks + 2) * STEP, np.uint32)
        self.words[: len(words)] = words
        self.shift = _shift_table()
        self.place = np.full(STEP, -1, np.int64)
        self.place[list(COVER)] = np.arange(size)
        starts = (np.arange(blocks)[:, None] * STEP + np.array(COVER)).ravel()
        starts = starts[starts < len(words)]
        n = len(starts)
        # Big-endian words compare as byte strings do.
        keys = self.words[starts[:, None] + np.arange(STEP)].astype(">u4").view(f"S{4 * STEP}").ravel()
        rank = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
        levels, ahead = [], 1
        while True:
            levels.append(np.append(rank, 0))
            if rank.max() == n:
                break
            later = np.zeros(n, np.int64)
            if ahead * size < n:
                later[: n - ahead * size] = rank[ahead * size :]
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
            ahead *= 2
        self.rank = rank - 1
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        one, two = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][one] == levels[k][two]
            common += same * (STEP << k)
            one, two = (np.minimum(x + same * (size << k), n) for x in (one, two))
        rest = np.flatnonzero((one < n) & (two < n))
        common[rest] += self._compared(starts[one[rest]], starts[two[rest]], np.full(len(rest), STEP))[0]
        self.table = [common.astype(np.int32)]
        width = 1
        while 2 * width < n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compared(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from two places on, ``most`` at most; and which pairs came that far."""
        equal = np.minimum(most, 0)
        going = np.flatnonzero(most > 0)
        a, b, left = one[going], two[going], most[going]
        while len(going):
            same = self.words[a] == self.words[b]
            going, a, b, left = going[same], a[same] + 1, b[same] + 1, left[same] - 1
            equal[going] += 1
            more = left > 0
            if not more.all():
                going, a, b, left = going[more], a[more], b[more], left[more]
        return equal, equal == most

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Number of equal words from ``one`` and from ``two`` (different places) on."""
        first = (self.shift[(two - one) % STEP] - one) % STEP
        equal, met = self._compared(one, two, first)
        far = np.flatnonzero(met)
        a, b = (self._sample(x[far] + first[far]) for x in (one, two))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.table[k]
            equal[far[at]] += np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return equal

    def _sample(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // STEP * len(COVER) + self.place[places % STEP]]


def _grid(words: np.ndarray, sizes: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods where three words a period apart agree, in chunks; ``sizes`` fall."""
    ends = np.cumsum(sizes + 1)
    places, periods, held = [], [], 0
    longest = int(sizes[0]) if len(sizes) else 0
    for period in range(1, longest // power + 1):
        end = ends[np.searchsorted(-sizes, -power * period, "right") - 1]
        every = words[:end:period]
        same = every[:-1] == every[1:]
        found = np.flatnonzero(same[:-1] & same[1:])
        if len(found):
            places.append(found * period)
            periods.append(np.full(len(found), period))
            held += len(found)
        if held >= CHUNK:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows of start, length and period, sorted; ``words`` has texts of falling ``sizes``, each with a word of its own behind it."""
    if power < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    found = [np.zeros((0, 3), np.int64)]
    extensions = None
    for place, period in _grid(words, sizes, power):
        extensions = extensions or Extensions(words)
        right = extensions.common(place, place + period)
        far = right > period
        place, period, right = place[far], period[far], right[far]
        # If all words of the period before agree too, an earlier grid place finds the run.
        early = np.flatnonzero(place >= period)
        first = np.ones(len(place), bool)
        first[early] = extensions.common(place[early] - period[early], place[early]) < period[early]
        place, period, right = place[first], period[first], right[first]
        # The smallest start from which all words up to the place agree with those a period on.
        low, high = np.maximum(place - period, 0), place.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            agree = extensions.common(middle, middle + period[open_]) >= place[open_] - middle
            high[open_[agree]] = middle[agree]
            low[open_[~agree]] = middle[~agree] + 1
        length = right + place - high + period
        own = length >= np.maximum(least, power * period)
        found.append(np.stack([high[own], length[own], period[own]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The same stretch with a multiple of its period is not a run of its own.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _treated(texts: list[list[bytes]], least: int, power: int) -> list[tuple[list, bytes]]:
    """Runs and collapsed text of each list of words."""
    numbers = _Numbers()
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    parts = []
    for k in order:
        parts.append(np.fromiter(map(numbers.__getitem__, texts[k]), np.int64, len(texts[k])))
        parts.append(None)
    for at in range(len(order)):
        parts[2 * at + 1] = np.array([len(numbers) + at], np.int64)
    rows = runs_of(np.concatenate(parts) if parts else np.zeros(0, np.int64), sizes, least, power)
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(begins, rows[:, 0], "right") - 1
    out: list = [None] * len(texts)
    cuts = np.searchsorted(owner, np.arange(len(order) + 1))
    for at, k in enumerate(order):
        own = rows[cuts[at] : cuts[at + 1]] - [begins[at], 0, 0]
        words = texts[k]
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            words = compress(words, (np.cumsum(change)[:-1] == 0).tolist())
        out[k] = [dict(zip(("start", "length", "period"), run)) for run in own.tolist()], b" ".join(words)
    return out


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER
) -> DataFrame:
    """``id, n_words, runs`` (start, length, period; words from 0; by start, then period) and ``collapsed`` of every row.

    ``collapsed`` is the text with each run cut to its first period: a word is left out if any run has it behind its first period.
    """
    schema = f"id long, n_words long, runs {RUN}, collapsed string"

    def treat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            done = _treated(texts, least, power)
            arrays = [
                pa.array(ids, pa.int64()), pa.array([len(words) for words in texts], pa.int64()),
                pa.array([runs for runs, _ in done], pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                pa.array([text for _, text in done], pa.binary()).cast(pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for at, number in enumerate(batch.column(0).to_pylist()):
                words = (column[at].as_py() or b"").split()
                ids.append(number)
                texts.append(words)
                held += len(words) + 1
                if held >= BATCH_WORDS:
                    yield flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(treat, schema)


def greatest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equals that with the smallest start, then period."""

    def better(a: Column, b: Column) -> Column:
        more, as_much = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (more > as_much), b).otherwise(a)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def as_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")
