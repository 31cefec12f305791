"""Best-fit decreasing packing of token sequences into fixed-size training sequences.

Texts are tokenized in the tasks; documents longer than a sequence are cut into full pieces and a
rest. Best-fit decreasing depends on lengths only, so it runs over the histogram of piece lengths (at
most one row per length, whatever the corpus): a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and all bins with the same remaining capacity take equal
lengths together. The result is a list of ranges ("pieces of length L ranked a to b fill these
bins"), and every piece finds its place from its length and its rank among equal lengths, without
a shuffle of texts or tokens.

The plan has at most one row per length and open range of bins, so its size depends on the square
of ``sequence`` at most and never on the number of documents; it is broadcast.

Defined cases: a null or empty text is the closing token alone; repeated rows and ids are packed as
often as they occur; pieces of equal length are taken in the order of id, row number and piece; a very long text is cut into as many pieces
as it needs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import string
import sys
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from footfall.llm.hashing import lean, slices
from footfall.llm.rows import addressed, row_number
from footfall.session import stage

SEQUENCE = 2048
END_ID = 0
CACHED_WORDS = 700_000
#: Parts in which the pieces of a length are ranked: more where a length is common.
LEAST_BUCKETS = 64
RANKED_AT_ONCE = 200_000
PIECES = "row long, id long, piece int, start long, length long, ids_crc32 long"
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = string.punctuation


_tokenizers: dict = {}


def tokenizer_of(file: str):
    """One tokenizer for each file and worker process; the words learnt with it go with the task.

    It starts no threads of its own, each of which would keep memory: Spark's tasks are as many as there are cores.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if file not in _tokenizers:
        _tokenizers[file] = Tokenizer.from_file(file)
    return _tokenizers[file]


def _little(ids: array) -> array:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class WordEncoder:
    """Ids of texts, word by word, as little-endian 32-bit bytes.

    The tokenizer never joins characters across white space, so each word is encoded once and kept
    in a dictionary that is emptied at ``CACHED_WORDS``, though all that one call learns stays in it, however much
    that is. Plain Latin letters are exactly one unit of the tokenizer's model, whatever their case, and so are
    ASCII marks after them; the model is asked once for each unit. Any other word goes through the whole tokenizer.
    Arrow splits the texts and puts their ids together, so Python sees each different word of a call only once.
    """

    def __init__(self, file: str):
        self.tokenizer = tokenizer_of(file)
        # The byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in prints]
        self.byte_chars = {b: 256 + k for k, b in enumerate(others)}
        self.known: dict[bytes, bytes] = {}

    def _unit(self, text: str) -> bytes:
        """Ids of one unit in lower case: a run of plain Latin letters, or of ASCII marks."""
        key = text.encode()
        ids = self.known.get(key)
        if ids is None:
            if not text.isascii():
                text = key.decode("latin-1").translate(self.byte_chars)
            found = [token.id for token in self.tokenizer.model.tokenize(text)]
            ids = self.known[key] = _little(array("I", found)).tobytes()
        return ids

    def _learn(self, new: list[bytes]) -> None:
        known, other = self.known, []
        for word in new:
            text = word.decode()
            stem = text.rstrip(_MARKS)
            if not (stem.isascii() and stem.isalpha() or _PLAIN.fullmatch(stem)):
                other.append((word, text))
                continue
            ids = self._unit(stem.lower())
            known[word] = ids if stem == text else ids + self._unit(text[len(stem) :])
        for (word, _), found in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
            known[word] = np.array(found.ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        new = [place for place, found in enumerate(ids) if found is None]
        if len(self.known) + len(new) > CACHED_WORDS:
            # What these texts need of it is in hand.
            self.known.clear()
        self._learn([words[place] for place in new])
        for place in new:
            ids[place] = self.known[words[place]]
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        whole = joined.buffers()[2].to_pybytes()
        return [whole[begin:end] for begin, end in zip(ends, ends[1:])]


def token_pieces(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``ids`` (little-endian 32-bit) only if asked for."""
    closing = np.array([end_id], "<u4").tobytes()
    schema = PIECES + (", ids binary" if with_ids else "")

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for begin, end in slices(batch.column(2)):
                part = batch.slice(begin, end - begin)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                out: dict[str, list] = {name: [] for name in ("row", "id", "piece", "start", "length", "ids_crc32", "ids")}
                for row, ident, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoder(texts)):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                        own = ids[at : at + 4 * sequence]
                        for name, value in zip(out, (row, ident, piece, at // 4, len(own) // 4, zlib.crc32(own), own)):
                            out[name].append(value)
                if not with_ids:
                    del out["ids"]
                kinds = {"piece": pa.int32(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=list(out))

    source = addressed(docs).select(
        row_number().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    return source.mapInArrow(encode, schema)


class CapacityTree:
    """Counts of open bins by remaining capacity; finds the smallest capacity that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, capacity: int, open_: bool) -> None:
        node = capacity + self.leaves
        self.any[node] = open_
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(histogram: dict[int, int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, copies in a bin, first bin, offset)``, as packing one by one gives.

    Pieces of a length are taken in the order of their rank, lengths from the largest on. The tightest
    open bin keeps being the tightest while the length fits, so it takes ``remaining // length``
    copies before the next bin does.
    """
    tree, open_bins = CapacityTree(sequence), defaultdict(deque)
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            open_bins[capacity].append((first, count))
            tree.mark(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = sequence, bins
                count = -(-left // (sequence // length))
                bins += count
            else:
                first, count = open_bins[capacity].popleft()
                if not open_bins[capacity]:
                    tree.mark(capacity, False)
            copies = capacity // length
            full = min(count, left // copies)
            rest = left - full * copies if full < count else 0
            plan.append((length, rank, copies, first, sequence - capacity))
            put(capacity - copies * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            put(capacity, first + full + (rest > 0), count - full - (rest > 0))
            rank += full * copies + rest
            left -= full * copies + rest
    return plan


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Rank of every piece among those of its length; a common length is counted in ``buckets`` parts."""
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "row", "piece")
    return (
        spread.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("bucket", "before", "nth")
    )


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` (written, with row, id, piece, length) with ``sequence_id`` and ``offset``."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(best_fit(histogram, sequence) or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        for lengths, ranks in parts:
            length, rank = lengths.to_numpy(), ranks.to_numpy()
            at = rows[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            nth = rank - at[:, 1]
            yield pd.DataFrame({"sequence_id": at[:, 3] + nth // at[:, 2], "offset": at[:, 4] + nth % at[:, 2] * length})

    buckets = max(LEAST_BUCKETS, max(histogram.values(), default=0) // RANKED_AT_ONCE + 1)
    return ranked(pieces, buckets).withColumn("at", place("length", "rank")).select("*", "at.*").drop("at", "rank")


def pack_documents(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places; with ``with_ids`` the tokens as well."""
    pieces = stage(token_pieces(docs, tokenizer, sequence, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, sequence)
