"""Tables with a commit log, for several writers, from which tenants can be removed.

Data files are written first, to a folder of their own under ``data``; they count once an entry of ``log`` names them. Entries are numbered, and
an entry is put in place only if no other has its number (a hard link on a local disk, a rename that doesn't replace on other file systems;
object stores need a file system that keeps this promise). A writer that finds its number taken reads the log again and takes
the next one, so appends never get lost and never wait. A rewrite names the files that it replaces, and gives up if another one
has replaced any of them.

Removed tenants are a table too. All tables of a site share it: readers leave these tenants' rows out at once, whatever the table. Their
bytes go when ``rewrite`` replaces the files that hold such rows; the log knows each file's least and greatest tenant, and files are cut by
tenant, so files of others are neither read nor written. Ids of removed tenants are not used again.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall.operators.lookup import is_small, lookup

ATTEMPTS = 1000
REMOVED = T.StructType([T.StructField("tenant_id", T.StringType())])


class Conflict(RuntimeError):
    """Another writer has replaced a file that this one wanted to replace."""


@dataclass(frozen=True)
class State:
    number: int
    files: dict[str, dict]
    keys: frozenset[str]


class Table:
    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, tenant_column: str = "tenant_id", gone: Table | None = None
    ):
        self.spark, self.root, self.schema, self.tenant_column, self.gone = spark, root, schema, tenant_column, gone
        self._known = State(0, {}, frozenset())

    # The log

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> State:
        """What the log says by now; entries read before are not read again."""
        folder, files = self._hadoop(f"{self.root}/log")
        if not files.exists(folder):
            return self._known
        names = {status.getPath().getName(): status.getPath() for status in files.listStatus(folder)}
        for name in sorted(n for n in names if n.endswith(".json") and int(n.split(".")[0]) > self._known.number):
            stream = files.open(names[name])
            entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            left = {path: file for path, file in self._known.files.items() if path not in entry["removed"]}
            added = {file["path"]: file for file in entry["added"]}
            self._known = State(int(name.split(".")[0]), left | added, self._known.keys | ({entry["key"]} - {None}))
        return self._known

    def _put(self, number: int, entry: dict) -> bool:
        """Put an entry in place unless there is one of that number."""
        draft, files = self._hadoop(f"{self.root}/drafts/{uuid.uuid4().hex}")
        target, _ = self._hadoop(f"{self.root}/log/{number:020}.json")
        files.mkdirs(target.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if files.getScheme() == "file":
                local = lambda path: jvm.java.nio.file.Paths.get(path.toUri().getPath(), self._none("java.lang.String"))
                jvm.java.nio.file.Files.createLink(local(target), local(draft))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(files.makeQualified(draft), files.makeQualified(target), self._none("org.apache.hadoop.fs.Options$Rename"))
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _none(self, name: str):
        """No further arguments of a Java method that takes any number."""
        jvm = self.spark._jvm
        return jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName(name), 0)

    def _commit(self, make: Callable[[State], dict | None]) -> int:
        """Log what ``make`` says of the newest state, under the first free number; None says there is nothing to log."""
        for _ in range(ATTEMPTS):
            state = self.state()
            entry = make(state)
            if entry is None:
                return state.number
            if self._put(state.number + 1, {"added": [], "removed": [], "key": None} | entry):
                return state.number + 1
        raise RuntimeError(f"no free number in {ATTEMPTS} attempts")

    # Rows

    def _written(self, rows: DataFrame) -> list[dict]:
        """Write rows cut by tenant; the new files with their tenants' range."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        order = [self.tenant_column, *(c for c in ("time", "hour", "started_at") if c in self.schema.names)]
        rows.select(self.schema.names).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        tenant = F.col(self.tenant_column)
        found = self.spark.read.schema(self.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min(tenant).alias("low"), F.max(tenant).alias("high"), F.count("*").alias("rows")
        )
        return [row.asDict() for row in found.collect()]

    def append(self, rows: DataFrame, key: str | None = None) -> int:
        """Add rows; returns the entry's number. A ``key`` that the log has already adds nothing."""
        if key is not None and key in self.state().keys:
            return self._commit(lambda state: None)
        added = self._written(rows)
        return self._commit(lambda state: None if key in state.keys else {"added": added, "key": key})

    def _scan(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _removed(self) -> DataFrame | None:
        """Ids of removed tenants, if there are any."""
        if self.gone is None or not self.gone.state().files:
            return None
        return self.gone.read().select(F.col(self.gone.tenant_column).alias(self.tenant_column)).distinct()

    def read(self) -> DataFrame:
        """All rows but those of removed tenants."""
        rows, removed = self._scan(list(self.state().files)), self._removed()
        return rows if removed is None else lookup(rows, removed, self.tenant_column, "left_anti").select(self.schema.names)

    def rewrite(self) -> int:
        """Replace the files that hold rows of removed tenants by files without them; returns how many were replaced."""
        removed, state = self._removed(), self.state()
        if removed is None:
            return 0
        paths = sorted(state.files)
        if is_small(removed):  # else any file may hold one
            ids = sorted(row[0] for row in removed.collect())
            paths = [path for path in paths if state.files[path]["low"] is not None and self._meets(ids, state.files[path])]
        if not paths:
            return 0
        rows = self._scan(paths)
        hit = lookup(rows.select(self.tenant_column, F.col("_metadata.file_path").alias("path")), removed, self.tenant_column, "left_semi")
        replaced = sorted(row[0] for row in hit.select("path").distinct().collect())
        if not replaced:
            return 0
        added = self._written(lookup(self._scan(replaced), removed, self.tenant_column, "left_anti"))

        def entry(newest: State) -> dict:
            if missing := set(replaced) - newest.files.keys():
                raise Conflict(f"{len(missing)} files were replaced by another writer")
            return {"added": added, "removed": replaced}

        self._commit(entry)
        return len(replaced)

    @staticmethod
    def _meets(ids: list[str], file: dict) -> bool:
        at = bisect_left(ids, file["low"])
        return at < len(ids) and ids[at] <= file["high"]


class Site:
    """The tables of tenants' data, which lose a removed tenant together."""

    def __init__(self, spark: SparkSession, root: str, **schemas: T.StructType):
        self.removed = Table(spark, f"{root}/removed", REMOVED)
        self.tables = {name: Table(spark, f"{root}/{name}", schema, gone=self.removed) for name, schema in schemas.items()}

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def remove(self, tenants: DataFrame) -> None:
        """Leave tenants (tenant_id) out of all tables from now on."""
        self.removed.append(tenants.select("tenant_id").where("tenant_id IS NOT NULL").distinct())

    def rewrite(self) -> dict[str, int]:
        """Let the bytes of removed tenants go; how many files each table had to replace."""
        return {name: table.rewrite() for name, table in self.tables.items()}
