"""Curated tables in the session catalog, replaced as a whole and never half-written.

A new state is written to a folder of its own; the table is then pointed at it. A reader sees the old rows or
the new ones, a failed write changes nothing, and a merge never writes where it reads. The newest states are kept
for readers that are still at work; older folders go once the table points past them.

A table named in ``rows_per_part`` is kept as parts instead, files in key order with an index (``file_index``). A merge
rewrites the parts that its feed can hit and adds parts for new keys; the next state names all other parts again. Such a
table is a view over the parts its newest state names, and the view is replaced in one step.

Beside its rows a state says which batch of which stream it holds last, in a folder that readers of the table pass
over. Rows and record become visible together, so a batch that is run again is known to be there.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.operators.upsert import upsert_curated
from millrace.session import cut_lineage, shared_dir
from millrace.sources import file_index

#: States of a table that stay on disk: the published one and those before it.
KEEP_STATES = 3
_APPLIED, _PARTS, _DATA, _STAGED = "_applied", "_parts", "data", "_staged"

#: The stored rows and a feed to the rows that take their place.
Combine = Callable[[DataFrame, DataFrame], DataFrame]

SCHEMAS = ["raw", "inventory", "sales", "crm", "supply_chain", "finance"]


@dataclass
class Warehouse:
    """Databases of the catalog, by their plain names or with ``prefix`` in front, and the folder they live in.

    A table named in ``buckets`` is stored in that many buckets by its key, so that a merge reads it without a shuffle;
    one named in ``rows_per_part`` in parts of about so many rows, of which a merge rewrites only those it can hit.
    """

    spark: SparkSession
    prefix: str = ""
    root: str = field(default="")
    keep_states: int = KEEP_STATES
    buckets: dict[str, int] = field(default_factory=dict)
    rows_per_part: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = self.root or f"{shared_dir(self.spark)}/{self.prefix or 'main'}"

    def create_schemas(self) -> None:
        for name in SCHEMAS:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.prefix}{name} LOCATION '{self.root}/{name}.db'")

    def use(self, schema: str) -> None:
        self.spark.sql(f"USE {self.prefix}{schema}")

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.prefix + name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def raw(self, feed: str) -> DataFrame:
        """A raw feed by its name, ``raw_erp_products``, from the raw schema."""
        return self.table("raw." + feed.removeprefix("raw_"))

    def _files(self, path: str):
        """File system and path object of a folder."""
        jvm = self.spark._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), found

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` written once, in columns, for as long as a merge reads them; nothing that is lazy may outlive it."""
        folder = f"{self.root}/{_STAGED}/{uuid.uuid4().hex}"
        fs, path = self._files(folder)
        try:
            rows.write.parquet(folder)
            yield self.spark.read.schema(rows.schema).parquet(folder)
        finally:
            fs.delete(path, True)

    def _states(self, name: str) -> list[str]:
        """Folders of the states of a table, oldest first; unfinished ones are among them."""
        fs, home = self._files(f"{self.root}/{name.replace('.', '.db/')}")
        if not fs.exists(home):
            return []
        found = [str(s.getPath().toString()) for s in fs.listStatus(home) if s.isDirectory()]
        return sorted(f for f in found if not f.endswith(f"/{_DATA}"))

    def _location(self, name: str) -> str:
        """The folder of the published state."""
        if name in self.rows_per_part:
            return self.spark.sql(f"SHOW TBLPROPERTIES {self.prefix}{name} ('state')").first()["value"]
        found = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.prefix}{name}").where("col_name = 'Location'")
        return found.first()["data_type"]  # one row

    def applied(self, name: str) -> dict[str, int]:
        """The last batch of each stream that the published state holds."""
        if not self.exists(name):
            return {}
        path = f"{self._location(name)}/{_APPLIED}"
        fs, folder = self._files(path)
        return {r.stream: r.batch for r in self.spark.read.parquet(path).collect()} if fs.exists(folder) else {}

    def _write(self, name: str, rows: DataFrame, folder: str) -> None:
        n = self.buckets.get(name)
        if n is None:
            rows.write.parquet(folder)
            return
        staging = f"{self.prefix}{name}_{uuid.uuid4().hex}"  # a bucketed write needs a table; its files stay
        keys = schemas.KEYS[name]
        rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", folder).format("parquet").saveAsTable(staging)
        if not self.exists(name):
            self.spark.sql(f"ALTER TABLE {staging} RENAME TO {self.prefix}{name}")
        else:
            self.spark.sql(f"DROP TABLE {staging}")

    def _next_state(self, name: str) -> tuple[list[str], str]:
        """The folders of earlier states, and one for the next."""
        before = self._states(name)
        nth = 1 + (int(before[-1].rsplit("/", 1)[1].split("-")[0]) if before else 0)
        return before, f"{self.root}/{name.replace('.', '.db/')}/{nth:012d}-{uuid.uuid4().hex}"

    def _record(self, name: str, folder: str, stream: str, batch: int) -> None:
        applied = self.applied(name) | ({stream: batch} if stream else {})
        if applied:
            record = self.spark.createDataFrame(list(applied.items()), "stream string, batch bigint")
            record.coalesce(1).write.parquet(f"{folder}/{_APPLIED}")  # one row per stream

    def parts(self, name: str) -> DataFrame:
        """The index of the published state of a table kept in parts."""
        return self._parts_of(self._location(name))

    def _parts_of(self, state: str) -> DataFrame:
        return self.spark.read.schema(file_index.INDEX).parquet(f"{state}/{_PARTS}")

    def _replace_parts(self, name: str, rows: DataFrame, gone: list[str] | None, stream: str, batch: int) -> DataFrame:
        """The next state: the parts of the published one without ``gone`` (None: without all), and ``rows`` as new parts.

        ``rows`` must be written already, so that counting, sampling and writing them do not work them out each time.
        """
        before, folder = self._next_state(name)
        data, keys, schema = self._data(name), schemas.stored_keys(name), rows.schema
        count, own = rows.count(), uuid.uuid4().hex
        index = self.spark.createDataFrame([], file_index.INDEX)
        if count:
            tasks = -(-count // self.rows_per_part[name])
            file_index.write_parts(rows, data, keys, tasks, own)
            index = file_index.index_of(file_index.read_parts(self.spark, data, schema, self._named(data, own)), keys)
        if gone is not None:
            index = index.union(self.parts(name).where(~F.col("part").isin(gone)) if gone else self.parts(name))
        index.coalesce(8).write.parquet(f"{folder}/{_PARTS}")  # a row per file
        self._record(name, folder, stream, batch)
        columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema)
        if self._parts_of(folder).isEmpty():
            columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema)
            source = "(SELECT 1) WHERE false"
        else:
            source = f"parquet.`{data}` WHERE {file_index.PART} IN (SELECT part FROM parquet.`{folder}/{_PARTS}`)"
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.prefix}{name} TBLPROPERTIES ('state' = '{folder}') AS SELECT {columns} FROM {source}")
        self._drop_states(before[: max(0, len(before) + 1 - self.keep_states)], [*before[len(before) + 1 - self.keep_states :], folder], data)
        return self.table(name)

    def _named(self, data: str, own: str) -> list[str]:
        """The parts that one write has made."""
        fs, home = self._files(data)
        found = [s.getPath().getName().removeprefix(f"{file_index.PART}=") for s in fs.listStatus(home) if s.isDirectory()]
        return [p for p in found if p.startswith(f"{own}-")]

    def _drop_states(self, old: list[str], kept: list[str], data: str) -> None:
        """Remove old states of a table kept in parts, and the parts that no kept state names."""
        def named(states: list[str]) -> set[str]:
            return {r.part for s in states for r in self._parts_of(s).select("part").collect()}  # names only

        for part in (named(old) - named(kept) if old else ()):
            fs, path = self._files(f"{data}/{file_index.PART}={part}")
            fs.delete(path, True)
        for state in old:
            fs, path = self._files(state)
            fs.delete(path, True)

    def _data(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '.db/')}/{_DATA}"

    def _stored(self, name: str, feed: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows of the parts that can hold a key of ``feed``, and the names of these parts."""
        hit = file_index.hit_parts(feed, self.parts(name), schemas.stored_keys(name))
        rows = file_index.read_parts(self.spark, self._data(name), schemas.stored_schema(name), hit)
        return rows.drop(file_index.PART), hit

    def rows_of(self, name: str, feed: DataFrame, written: bool = False) -> DataFrame:
        """The rows of a table whose key comes in ``feed``, NULL keys too; of a table kept in parts no other part is read.

        A feed that is not ``written`` already is asked for its keys once.
        """
        keys = schemas.stored_keys(name)
        came = feed.select(*[F.col(k).alias(f"came_{k}") for k in keys])
        came = came if written else cut_lineage(came.distinct())
        asked = came.toDF(*keys)
        rows = self._stored(name, asked)[0] if name in self.rows_per_part else self.table(name)
        same = [F.col(k).eqNullSafe(F.col(f"came_{k}")) for k in keys]
        return rows.join(came, same, "left_semi")

    def stored(self, name: str, feed: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """All rows of a table, or of the parts that can hold a key of ``feed``, and what ``put`` needs to replace them."""
        return self._stored(name, feed) if name in self.rows_per_part else (self.table(name), None)

    def put(self, name: str, rows: DataFrame, hit: list[str] | None, stream: str = "", batch: int = -1) -> DataFrame:
        """The table after ``rows``, written already, have taken the place of those that ``stored`` gave."""
        if name in self.rows_per_part:
            return self._replace_parts(name, rows, hit, stream, batch)
        return self.replace(name, rows, stream, batch)

    def update(self, name: str, feed: DataFrame, combine: Combine, stream: str = "", batch: int = -1, written: bool = False) -> DataFrame:
        """The table after ``combine(stored rows, feed)`` has taken the place of the stored rows.

        ``combine`` gets all rows of the table, or of the parts that can hold a key of the feed, and must give back those
        that it leaves as they are. A batch of a stream that the table already holds changes nothing. A feed is read more
        than once, so one that is not ``written`` already is written first.
        """
        if stream and self.applied(name).get(stream, -1) >= batch:
            return self.table(name)
        if name not in self.rows_per_part:
            return self.replace(name, combine(self.table(name), feed), stream, batch)
        if not written:
            with self.staged(feed) as own:
                return self.update(name, own, combine, stream, batch, True)
        old, hit = self._stored(name, feed)
        with self.staged(combine(old, feed)) as rows:
            return self._replace_parts(name, rows, hit, stream, batch)

    def replace(self, name: str, rows: DataFrame, stream: str = "", batch: int = -1, written: bool = False) -> DataFrame:
        """Create the table from ``rows``, or point it at a fresh copy of them; with the batch of a stream they hold."""
        if name in self.rows_per_part:
            if written:
                return self._replace_parts(name, rows, None, stream, batch)
            with self.staged(rows) as own:
                return self._replace_parts(name, own, None, stream, batch)
        before, folder = self._next_state(name)
        new = not self.exists(name)
        self._write(name, rows, folder)
        self._record(name, folder, stream, batch)
        if not new:
            self.spark.sql(f"ALTER TABLE {self.prefix}{name} SET LOCATION '{folder}'")
        elif not self.exists(name):
            self.spark.catalog.createTable(self.prefix + name, path=folder, source="parquet", schema=rows.schema)
        self.spark.catalog.refreshTable(self.prefix + name)
        for old in before[: max(0, len(before) + 1 - self.keep_states)]:
            fs, path = self._files(old)
            fs.delete(path, True)
        return self.table(name)

    def create_curated(self, name: str) -> DataFrame:
        """The curated table, or one beside it, empty and with its contract if it is new."""
        if self.exists(name):
            return self.table(name)
        return self.replace(name, self.spark.createDataFrame([], schemas.stored_schema(name)))

    def merge_into(self, name: str, source: DataFrame, stream: str = "", batch: int = -1, written: bool = False) -> DataFrame:
        """The table after merging ``source``; a batch of a stream that the table already holds changes nothing."""
        self.create_curated(name)
        if name in self.rows_per_part:
            source = schemas.conform(source, name)
        return self.update(name, source, lambda target, feed: upsert_curated(target, feed, name), stream, batch, written)

    def full_refresh(self, name: str, rows: DataFrame, run_at: dt.datetime) -> DataFrame:
        """Replace all rows. Where the rows bring no ``enriched_at``, it takes its default, the run time."""
        if "enriched_at" not in rows.columns and "enriched_at" in schemas.curated_schema(name).names:
            rows = rows.withColumn("enriched_at", F.lit(run_at.isoformat(sep=" ")).cast("timestamp_ntz"))
        return self.replace(name, schemas.conform(rows, name))
