"""What the operators leave behind in Python workers, which Spark keeps from task to task."""

import os

import pyarrow as pa
import pytest

from footfall.llm import hashing, jaccard, packing, toxicity
from footfall.llm.queries import tokenizer_file


@pytest.mark.parametrize("parts", [
    lambda batch: (part for part, _ in toxicity._parts(iter([batch]), 0)),
    lambda batch: (part for part, _ in jaccard._each_set(iter([batch]), 0, 5)),
])
def test_arrays_are_made_from_half_a_megabyte_of_texts(parts):
    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 900] * 300)], ["text"])
    found = list(parts(batch))
    assert sum(len(p) for p in found) == 300
    assert max(sum(map(len, p.column(0).to_pylist())) for p in found) <= 1 << 19


def test_unused_memory_goes_back_when_the_work_no_longer_holds_its_batches():
    pool = pa.default_memory_pool()
    held, calls = [], []

    class Pool:
        def release_unused(self):
            calls.append(pool.bytes_allocated())

    @hashing.lean
    def work(batches):
        for batch in batches:
            held.append(pool.bytes_allocated())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    def batches():
        for _ in range(3):
            yield pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 10_000)], ["text"])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pa, "default_memory_pool", Pool)
        assert [b.column(0)[0].as_py() for b in work(batches())] == [10_000] * 3
    assert len(calls) == 1 and calls[0] < min(held) - 9_000_000


def test_a_worker_starts_no_threads_for_the_tokenizer(spark):
    file = tokenizer_file()

    def threads(batches):
        encoder = packing.WordEncoder(file)
        before = len(os.listdir("/proc/self/task"))
        for batch in batches:
            encoder([f"{n}-{n}é{n} x{n}_y{n}".encode() for n in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([len(os.listdir("/proc/self/task")) - before])], ["started"])

    assert [r.started for r in spark.range(0, 4000, 1, 2).mapInArrow(threads, "started long").collect()] == [0, 0]
