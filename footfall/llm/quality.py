"""Quality rules as a short-circuit cascade.

Each rule reads some counts of a text and says whether the text fails. What a rule costs and what it rejects is measured
on a sample, each rule alone and from the bytes of the texts on: ``SAMPLE_ROWS`` documents of each task over at most ``SAMPLE_FILES`` files.
Rules are then ordered by rejections per second, the greatest first, which is the cheapest order for rules that reject
independently, and a rule sees only texts that all rules before it let pass. The order decides how much is computed and which rule is named as the
one that failed; whether a text is kept does not depend on it.

Texts are read in slices of some two megabytes, their counts taken from the byte buffer of the whole slice with numpy;
nothing is shuffled, and only a few numbers of each rule and task come to the driver. Lines and windows of words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and fails ``few_words``; rules about shares pass where there is nothing to take a share
of; texts that sit exactly on a limit pass; repeated rows are judged each; a very long text is judged whole; rules that reject nothing on
the sample come last, cheapest first; an empty table gives no rows, and the order of its rules is that of ``RULES``; only the id and text columns are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footfall.llm import hashing
from footfall.llm.rows import addressed

SAMPLE_FILES = 32
SAMPLE_ROWS = 64
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Begins a code point and is not white space.
_CHAR = ~_SPACE
_CHAR[0x80:0xC0] = False


class Counts:
    """Counts of some texts, each taken when it is asked for the first time."""

    def __init__(self, texts: pa.Array, known: dict[str, np.ndarray] | None = None):
        self.texts = texts
        self.known = known or {}
        self._bytes = None

    def among(self, rows: np.ndarray) -> Counts:
        """Of the texts in ``rows``; counts already taken stay."""
        return Counts(self.texts.take(pa.array(rows)), {name: values[rows] for name, values in self.known.items()})

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known |= _TAKEN[name](self)
        return self.known[name]

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each text begins, with the end of the last."""
        if self._bytes is None:
            texts = self.texts.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            buffer = texts.buffers()[2]
            data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
            self._bytes = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        return self._bytes

    def per_text(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        begins = self.bytes()[1]
        return sums[begins[1:]] - sums[begins[:-1]]


def _class(name: str, table: np.ndarray) -> Callable[[Counts], dict[str, np.ndarray]]:
    return lambda c: {name: c.per_text(table[c.bytes()[0]])}


def _n_words(c: Counts) -> dict[str, np.ndarray]:
    data, begins = c.bytes()
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = begins[:-1][begins[:-1] < len(data)]
    first[at] = inside[at]
    return {"n_words": c.per_text(first)}


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of owner and hash, and whether each has the same owner and hash as the place before it."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order[1:]] == owner[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    return order, same


def _lines(c: Counts) -> dict[str, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one."""
    data, begins = c.bytes()
    words = hashing.words(c.texts, lower=False)
    n = len(c.texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([begins[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(begins, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    ends[last] = begins[owner[last] + 1]
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    hashes = hashing.Words(words.data, starts, ends, words.first, words.sums).hashes()
    order, same = _repeated(owner, hashes)
    return {
        "n_lines": np.bincount(owner, minlength=n), "n_dup_lines": np.bincount(owner[order[same]], minlength=n),
    }


def _n_repeat_words(c: Counts) -> dict[str, np.ndarray]:
    """Words in windows of WINDOW words that the text has twice or more, the first one included."""
    words = hashing.words(c.texts, lower=False)
    hashes, n, size = words.hashes(), len(c.texts), WINDOW
    owner = np.repeat(np.arange(n), np.diff(words.first))
    count = max(0, len(hashes) - size + 1)
    whole = np.flatnonzero(owner[:count] == owner[size - 1 :]) if count else np.zeros(0, np.int64)
    window = np.full(len(whole), hashing.U(size), hashing.U)
    for k in range(size):
        window = hashing.mix(window * hashing._FACTOR + hashes[whole + k])
    order, same = _repeated(owner[whole], window)
    again = same.copy()
    again[:-1] |= same[1:]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, whole[order[again]], 1)
    np.add.at(change, whole[order[again]] + size, -1)
    covered = np.cumsum(change)[:-1] > 0
    return {"n_repeat_words": np.bincount(owner[covered], minlength=n)}


_TAKEN = {
    "n_words": _n_words, "word_chars": _class("word_chars", _CHAR), "n_symbols": _class("n_symbols", _SYMBOL),
    "n_capitals": _class("n_capitals", _CAPITAL), "n_letters": _class("n_letters", _LETTER),
    "n_lines": _lines, "n_dup_lines": _lines, "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Counts], np.ndarray]


#: The rules and their limits.
RULES = (
    Rule("few_words", lambda c: c["n_words"] < 10),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("short_or_long_words", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"])),
    Rule("repeated_lines", lambda c: 100 * c["n_dup_lines"] > 30 * c["n_lines"]),
    Rule("capitals", lambda c: 2 * c["n_capitals"] > c["n_letters"]),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: int
    documents: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> list[Estimate]:
    """What each rule costs and rejects on the sample, in the order of the cascade."""
    docs = addressed(docs)
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        step = len(files) / SAMPLE_FILES
        docs = docs.filter(F.col("_metadata.file_path").isin([files[int(k * step)] for k in range(SAMPLE_FILES)]))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            if held < SAMPLE_ROWS:
                texts.append(batch.column(0).slice(0, SAMPLE_ROWS - held))
                held += len(texts[-1])
        sample = pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string())
        rows = []
        for rule in rules:
            for timed in (False, True):  # what a rule needs only once is not part of its price
                began = time.thread_time()
                rejected = sum(int(rule.fails(Counts(sample.slice(a, b - a))).sum()) for a, b in hashing.slices(sample))
                if timed:
                    rows.append((rule.name, time.thread_time() - began, rejected, len(sample)))
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], ["rule", "seconds", "rejected", "documents"])

    measured = docs.select(text_col).mapInArrow(measure, "rule string, seconds double, rejected long, documents long")
    by_rule = {r["rule"]: r for r in measured.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "documents"))).collect()}
    found = [Estimate(r.name, *(by_rule[r.name][1:] if r.name in by_rule else (0.0, 0, 0))) for r in rules]
    return sorted(found, key=lambda e: (-e.worth, e.seconds))


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, counts: tuple[str, ...] = (),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, failed`` (the first rule in the order that the text fails; null: none) and ``kept`` of every row.

    Without ``order`` it is estimated. ``counts`` names counts to be taken of every text, as further columns; rules then read these.
    """
    order = [e.rule for e in estimate(docs, rules, text_col)] if order is None else order
    cascade = sorted(rules, key=lambda r: order.index(r.name))
    names = ["id", *counts, "failed", "kept"]
    schema = "id long, " + "".join(f"{name} long, " for name in counts) + "failed string, kept boolean"

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in hashing.slices(batch.column(1)):
                whole = Counts(batch.column(1).slice(begin, end - begin))
                taken = [whole[name] for name in counts]
                failed = np.full(end - begin, -1, np.int32)
                left, rows = whole, np.arange(end - begin)
                for number, rule in enumerate(cascade):
                    fails = rule.fails(left)
                    if fails.any():
                        failed[rows[fails]] = number
                        rows = rows[~fails]
                        if not len(rows):
                            break
                        left = left.among(np.flatnonzero(~fails))
                reason = pa.array([r.name for r in cascade] + [None], pa.string()).take(pa.array(np.where(failed < 0, len(cascade), failed)))
                arrays = [batch.column(0).slice(begin, end - begin), *(pa.array(t, pa.int64()) for t in taken), reason, pa.array(failed < 0)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(decide, schema)
