import random
import uuid

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, id string, sig string, size string, curve string, keep_id string, toxic_score string, shard string"
)


def small_texts():
    """Plain words, copies, near copies, white space of all kinds, nulls, ties, a very long text."""
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "te", "ru") for b in ("ba", "no", "sé", "X", "")]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 5, 6, 40, 80, 300)]
    near = []
    for text in base[3:]:
        for _ in range(6):
            own = text.split()
            own[rng.randrange(len(own))] = "changed"
            near.append(" ".join(own))
    odd = [None, "", " \t\n", "a", "a ", " a\x0bA", "CC by the\nGNU General Public License, all rights reserved. cc BY", "x" * 50_000, "é\u3000ü Kelvin"]
    long = " ".join(rng.choice(words) for _ in range(12_000))
    return base + near + base[:3] + odd + [long, long.upper()] + ["released under the MIT license, all rights reserved"] * 3


@pytest.fixture(scope="session")
def texts():
    return small_texts()


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A documents table from texts: repeated ids, null ids and sources, and columns with the operators' own names."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *["clash"] * 8)
            for k, (i, t) in enumerate(zip(ids, texts))
        ]
        path = str(tmp_path_factory.mktemp("docs") / uuid.uuid4().hex)
        spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def docs(table, texts):
    return table(texts)


@pytest.fixture(scope="session")
def empty(spark, table):
    return table([])


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The odd documents and some labels as a folder of tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1), (10**6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
