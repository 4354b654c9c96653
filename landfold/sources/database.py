"""Tables of a database: scans that push filters down, and upserts by policy, all or nothing.

A database is reached through a DB-API module by name (sqlite3 is at hand; psycopg or pymysql work alike where they are
installed) and the arguments of its connect. For a file database the path must be one that all executors share.

An upsert collapses a batch to a row per key on Spark, loads it into a staging table from all tasks at once, and merges
that into the table by one transaction when all tasks are done: the columns that the policy overwrites are updated where
the key is there, and new keys are inserted. A task that is tried again loads its rows under another mark; only the marks
of the tasks that Spark committed are merged, and a failed job leaves the table as it was. The merge itself runs in the
database. Beyond what SQL types hold, arrays, maps and structs are stored as JSON, times as text.

Defined results: rows with a null key are left out; an empty batch makes the table if it isn't there; columns that the table
lacks are added to it; names of columns may hold any character; of rows of a key the policy decides (see operators/keyed).
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import asdict, dataclass, field, replace
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import keyed

#: Rows that a task sends at once.
CHUNK = 1_000
#: SQL types of Spark's.
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "DOUBLE PRECISION", "float": "DOUBLE PRECISION", "boolean": "INTEGER", "binary": "BLOB"}
#: Modules whose databases speak another dialect of updates from a table.
MYSQL = {"pymysql", "MySQLdb", "mysql.connector"}
MARK, KIND, GIVEN = "__task", "__kind", "__given_"
#: Staged rows: what updates a key that is there, and what inserts a new one.
UPDATES, INSERTS = 0, 1


@dataclass(frozen=True)
class Database:
    module: str
    arguments: dict = field(default_factory=dict)

    @staticmethod
    def sqlite(path: str) -> Database:
        """A file; writers wait for each other."""
        scheme, _, rest = path.rpartition(":")
        if scheme not in ("", "file"):
            raise ValueError(f"{path} is not a path of a shared file system")
        path = "/" + rest.lstrip("/") if scheme else rest
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        return Database("sqlite3", {"database": path, "timeout": 600})

    def connect(self):
        return importlib.import_module(self.module).connect(**self.arguments)

    def mark(self) -> str:
        return "?" if importlib.import_module(self.module).paramstyle == "qmark" else "%s"

    def name(self, c: str) -> str:
        q = "`" if self.module in MYSQL else '"'
        return q + c.replace(q, q + q) + q

    def names(self, columns: list[str]) -> str:
        return ", ".join(map(self.name, columns))


def _sql_type(db: Database, kind: str) -> str:
    if kind.startswith("decimal"):
        return kind.upper()
    out = SQL_TYPES.get(kind, "TEXT")
    return "BYTEA" if out == "BLOB" and db.module.startswith("psycopg") else out


def plain(df: DataFrame) -> DataFrame:
    """Columns as databases hold them."""
    c = lambda name: F.col("`" + name.replace("`", "``") + "`")
    kinds = {"array": F.to_json, "map": F.to_json, "struct": F.to_json, "timestamp": lambda x: x.cast("string"), "date": lambda x: x.cast("string"), "boolean": lambda x: x.cast("int"), "decimal": lambda x: x.cast("string")}
    return df.select(*((next((f(c(n)) for k, f in kinds.items() if t.startswith(k)), c(n))).alias(n) for n, t in df.dtypes))


def columns(db: Database, table: str) -> list[str]:
    """A table's columns; none if there is no such table."""
    with closing(db.connect()) as con:
        cur = con.cursor()
        try:
            cur.execute(f"select * from {db.name(table)} where 1 = 0")
        except Exception:
            return []
        return [d[0] for d in cur.description]


def make_table(db: Database, table: str, schema: T.StructType, keys: list[str]) -> None:
    """The table with a unique key, if it isn't there, and the columns that it lacks."""
    known, kinds = columns(db, table), {f.name: _sql_type(db, f.dataType.simpleString()) for f in schema}
    if db.module in MYSQL:  # a key needs a bounded length there
        kinds |= {k: "VARCHAR(255)" for k in keys if kinds[k] == "TEXT"}
    with closing(db.connect()) as con:
        cur = con.cursor()
        if not known:
            cur.execute(f"create table {db.name(table)} ({', '.join(f'{db.name(c)} {t}' for c, t in kinds.items())}{f', unique ({db.names(keys)})' if keys else ''})")
        for c in kinds.keys() - set(known) if known else ():
            cur.execute(f"alter table {db.name(table)} add column {db.name(c)} {kinds[c]}")
        con.commit()


def drop_table(db: Database, table: str) -> None:
    with closing(db.connect()) as con:
        con.cursor().execute(f"drop table if exists {db.name(table)}")
        con.commit()


@dataclass
class Loaded(WriterCommitMessage):
    mark: str
    rows: int


class StageWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.db, self.plan = Database(**json.loads(options["database"])), json.loads(options["plan"])
        self.columns = schema.names

    def write(self, iterator: Iterator) -> Loaded:
        """A task's rows, under a mark of this attempt."""
        mark, n, db = uuid.uuid4().hex, 0, self.db
        sql = f"insert into {db.name(self.plan['stage'])} ({db.names([MARK, *self.columns])}) values ({', '.join([db.mark()] * (len(self.columns) + 1))})"
        rows = ((mark, *(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in iterator)
        with closing(db.connect()) as con:
            cur = con.cursor()
            while chunk := list(islice(rows, CHUNK)):
                cur.executemany(sql, chunk)
                con.commit()
                n += len(chunk)
        return Loaded(mark, n)

    def commit(self, messages: list[Loaded | None]) -> None:
        with closing(self.db.connect()) as con:
            cur = con.cursor()
            try:
                self._merge(cur, [m.mark for m in messages if m is not None])
                con.commit()
            except BaseException:
                con.rollback()
                raise

    def abort(self, messages: list[Loaded | None]) -> None:
        """Nothing was merged; `upsert` drops the staging table whatever happens."""

    def _merge(self, cur, marks: list[str]) -> None:
        db, plan = self.db, self.plan
        stage, table, keys, given = db.name(plan["stage"]), db.name(plan["table"]), plan["keys"], plan["given"]
        kept = db.name(plan["stage"] + "_marks")
        cur.execute(f"create temporary table {kept} (mark TEXT)")
        cur.executemany(f"insert into {kept} values ({db.mark()})", [(m,) for m in marks])
        cur.execute(f"delete from {stage} where {db.name(MARK)} not in (select mark from {kept})")
        cur.execute(f"drop table {kept}")
        same = " and ".join(f"{table}.{db.name(k)} = s.{db.name(k)}" for k in keys)

        def value(c: str) -> str:
            new, old = f"s.{db.name(c)}", f"{table}.{db.name(c)}"
            if not plan["skip_null"] or c in plan["seq"]:
                return new
            told = f"{new} is not null" + (f" or s.{db.name(given[c])} = 1" if c in given else "")
            return f"case when {told} then {new} else {old} end"

        if plan["overwrite"]:
            mysql = db.module in MYSQL
            sets = ", ".join(f"{table + '.' if mysql else ''}{db.name(c)} = {value(c)}" for c in plan["overwrite"])
            cur.execute(f"update {table} join {stage} s on {same} set {sets} where s.{KIND} = {UPDATES}" if mysql else f"update {table} set {sets} from {stage} s where {same} and s.{db.name(KIND)} = {UPDATES}")
        names = db.names(plan["columns"])
        rows = f"select {names} from {stage} where {db.name(KIND)} = {INSERTS}"
        cur.execute(f"insert ignore into {table} ({names}) {rows}" if db.module in MYSQL else f"insert into {table} ({names}) {rows} on conflict ({db.names(keys)}) do nothing")


@dataclass
class Part(InputPartition):
    where: str
    values: tuple


class TableReader(DataSourceReader):
    #: Comparisons that a database makes as Spark does (text and numbers; nulls never compare).
    COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options: dict, schema: T.StructType):
        self.db, self.table, self.schema = Database(**json.loads(options["database"])), options["table"], schema
        self.by, self.parts, self.limit = options.get("partitioncolumn"), int(options.get("partitions", "1")), int(options.get("limit", "0"))
        self.filters: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            c = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if c is None or not isinstance(self.schema[c].dataType, (T.StringType, T.IntegralType, T.DoubleType)):
                yield f
            elif type(f) in self.COMPARED and f.value is not None and f.value == f.value:
                self.filters.append((f"{self.db.name(c)} {self.COMPARED[type(f)]} {self.db.mark()}", (f.value,)))
            elif isinstance(f, In) and f.value and None not in f.value and len(f.value) <= 500:
                self.filters.append((f"{self.db.name(c)} in ({', '.join([self.db.mark()] * len(f.value))})", tuple(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.filters.append((f"{self.db.name(c)} is {'not ' if isinstance(f, IsNotNull) else ''}null", ()))
            else:
                yield f

    def partitions(self) -> list[Part]:
        """One, or as many ranges of a whole-number column, open at both ends; nulls are in the first."""
        if not self.by or self.parts < 2 or self.limit:
            return [Part("1 = 1", ())]
        by = self.db.name(self.by)
        with closing(self.db.connect()) as con:
            cur = con.cursor()
            cur.execute(f"select min({by}), max({by}) from {self.db.name(self.table)}")
            low, high = cur.fetchone()
        if low is None:
            return [Part("1 = 1", ())]
        cuts = sorted({low + (high - low + 1) * i // self.parts for i in range(1, self.parts)} - {low})
        m = self.db.mark()
        if not cuts:
            return [Part("1 = 1", ())]
        middle = [Part(f"{by} >= {m} and {by} < {m}", (a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [Part(f"{by} is null or {by} < {m}", (cuts[0],)), *middle, Part(f"{by} >= {m}", (cuts[-1],))]

    def read(self, partition: Part) -> Iterator[tuple]:
        where = " and ".join(f"({w})" for w in [partition.where, *(w for w, _ in self.filters)])
        sql = f"select {self.db.names(self.schema.names)} from {self.db.name(self.table)} where {where}" + (f" limit {self.limit}" if self.limit else "")
        flags = {i for i, f in enumerate(self.schema) if isinstance(f.dataType, T.BooleanType)}
        with closing(self.db.connect()) as con:
            cur = con.cursor()
            cur.execute(sql, [*partition.values, *(v for _, values in self.filters for v in values)])
            while rows := cur.fetchmany(CHUNK):
                for r in rows:
                    yield tuple(bool(v) if i in flags and v is not None else v for i, v in enumerate(r)) if flags else tuple(r)


class DatabaseSource(DataSource):
    """Options: database (JSON of Database), table; to read: partitionColumn, partitions, limit; to write: plan, by `upsert`."""

    @classmethod
    def name(cls) -> str:
        return "landfold_database"

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StageWriter:
        return StageWriter(self.options, schema)


def scan(spark: SparkSession, db: Database, table: str, schema: str | T.StructType, **options: str | int) -> DataFrame:
    """A table's columns that the schema names. Filters on text and whole numbers run in the database. Options: partitionColumn and
    partitions for a scan by several tasks; limit for the first rows that come."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(DatabaseSource.name()).schema(schema).options(database=json.dumps(asdict(db)), table=table, **options).load()


def upsert(df: DataFrame, db: Database, table: str, keys: list[str], seq: list[str], policy: keyed.Policy = keyed.OVERWRITE_ALL) -> None:
    """Rows of a batch, put into the table one after the other in order of seq, as the policy says. The batch is later than what is there."""
    flags = dict(policy.given)
    stored = [c for c in df.columns if c not in flags.values()]
    loose = replace(policy, insert_if=None)
    updates, inserts = keyed.collapse(df, keys, seq, loose), keyed.collapse(df, keys, seq, policy)
    staged = updates.withColumn(KIND, F.lit(UPDATES)).unionByName(inserts.withColumn(KIND, F.lit(INSERTS)))
    staged = plain(staged)
    stage = f"{table}__stage_{uuid.uuid4().hex}"
    make_table(db, table, staged.select(*(f"`{c}`" for c in stored)).schema, keys)
    make_table(db, stage, T.StructType([T.StructField(MARK, T.StringType()), *staged.schema.fields]), [])
    overwrite = [c for c in stored if c not in keys and (policy.takes_new(c) or c in seq)]  # seq tells what was stored last
    plan = {"stage": stage, "table": table, "keys": keys, "seq": seq, "columns": stored, "overwrite": overwrite, "skip_null": policy.skip_null, "given": flags}
    df.sparkSession.dataSource.register(DatabaseSource)
    try:
        staged.write.format(DatabaseSource.name()).options(database=json.dumps(asdict(db)), table=table, plan=json.dumps(plan)).mode("append").save()
    finally:
        drop_table(db, stage)
