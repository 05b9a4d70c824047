"""Tables of a tenant: points reads, listings, upserts, deletes, and read-only SQL."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an ad-hoc query at most; one more is read to see whether there are more.
MOST = 100


_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir, or a local one where that is unset
    and Spark runs on this machine alone (tests). All of an application's are removed when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = base or f"file://{tempfile.gettempdir()}/loomgraph"
        _own[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _own[app])
    return f"{_own[app]}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def written(df: DataFrame) -> DataFrame:
    """Stores the rows in the shared folder and reads them back, which cuts lineage for good."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contains(columns: list[Column], needle: str | None) -> Column:
    """Case-insensitive containment in any of the columns; nothing asked passes. No pattern, so nothing to escape."""
    if not needle:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(needle.lower())) for c in columns])


def listing(rows: DataFrame, columns: list[str], needle: str | None = None, equal: dict[str, str] | None = None, any_of: tuple[str, list[str]] | None = None) -> DataFrame:
    """Rows by text in columns, equality of metadata entries and overlap of an array column."""
    test = contains([F.col(c) for c in columns], needle)
    clean = lambda c: F.lower(F.trim(c))
    for k, v in (equal or {}).items():
        entry = F.struct(F.lit(k.strip().lower()).alias("key"), F.lit(v.strip().lower()).alias("value"))
        held = F.transform(F.map_entries("metadata"), lambda e: F.struct(clean(e["key"]).alias("key"), clean(e["value"]).alias("value")))
        test &= F.coalesce(F.array_contains(held, entry), F.lit(False))
    if any_of and any_of[1]:
        test &= F.arrays_overlap(F.col(any_of[0]), F.array(*map(F.lit, any_of[1])))
    return rows.filter(test)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: of rows with one key, the new ones before the old, the largest `order` stays."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = [c for c in old.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_new", order)).alias("r"))
    return best.select(key, *[F.col(f"r.{n}").alias(n) for n in names]).select(*old.columns)


class Sink:
    """A table in a folder that merges what is written to it: each write reads the last whole version, merges, and leaves
    a new one beside it, so that readers keep theirs and a write that dies leaves nothing behind that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Whole versions, in order."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/version={done[-1]:08d}") if done else None

    def write(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        old = self.read()
        old = new.limit(0) if old is None else old
        to = (self.versions() or [0])[-1] + 1
        merge(old, new).write.mode("overwrite").parquet(f"{self.path}/version={to:08d}")
        return self.read()

    def keep(self, most: int = 2) -> None:
        """Removes all but the last `most` versions."""
        conf, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        for n in self.versions()[:-most]:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={n:08d}")
            at.getFileSystem(conf).delete(at, True)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes in gone (uuid) and the edges at them."""
    left = edges.join(gone.select(F.col("uuid").alias("src")), "src", "left_anti").join(gone.select(F.col("uuid").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "uuid", "left_anti"), left.select(*edges.columns)


def edges_from_vectors(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """The edges, or if there are none those that relationship vectors carry in their metadata."""
    if not edges.isEmpty():
        return edges
    rows = vectors.filter("store = 'relationships' and size(metadata.node_ids) = 2")
    cols = {"uuid": F.col("metadata.uuid"), "src": F.col("metadata.node_ids")[0], "dst": F.col("metadata.node_ids")[1], "name": F.col("metadata.predicate")}
    return rows.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema])


class ReadOnlySql:
    """Ad-hoc SQL over named tables: one statement that only reads these, with built-in functions, its rows capped, with a
    mark if more were there, and a deadline in seconds."""

    #: What the analysed plan may have as leaves beside the named tables: constants, ranges, references within the query.
    LEAVES = frozenset({"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "EmptyRelation"})
    BUILT_IN = "org.apache.spark.sql.catalyst.expressions."
    #: Built-in functions that run any code, or tell where files lie.
    REFUSED = frozenset({"CallMethodViaReflection", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "FileSourceMetadataAttribute"})

    #: Expressions with a plan of their own.
    PLANS = frozenset({"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"})

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], deadline: float = 10.0):
        self.spark, self.deadline, self.names = spark, deadline, {n.lower() for n in tables}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def check(self, sql: str) -> DataFrame:
        """The statement, analysed and found to read only. Spark's own parser is asked first, so that comments and strings
        can't hide a command and nothing runs; then the analysed plan, where every name has become what it stands for."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        bad = [n for n in map(_kind, _tree(plan)) if n.endswith(("Command", "Statement")) or any(x in n for x in ("Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "SetCatalog", "SetNamespace", "Replace", "Cache", "Load"))]
        bad += [n.getClass().getName() for n in _tree(plan) if ".command." in n.getClass().getName()]
        if bad:
            raise ValueError(f"only reading statements are allowed, not {bad[0].rsplit('.', 1)[-1]}")
        rows = self.spark.sql(sql)
        self._relations(rows._jdf.queryExecution().analyzed())
        return rows

    def _relations(self, plan) -> None:
        if _kind(plan) == "View":
            if not plan.isTempView() or plan.desc().identifier().table().lower() not in self.names:
                raise ValueError(f"only the named tables may be read, not {plan.desc().identifier().unquotedString()}")
            return
        below = _each(plan.children())
        if not below and _kind(plan) not in self.LEAVES:
            raise ValueError(f"only the named tables may be read, not {_kind(plan)}")
        for e in _each(plan.expressions()):
            self._functions(e)
        for p in below + _each(plan.innerChildren() if _kind(plan) == "WithCTE" else plan.children().take(0)):
            self._relations(p)

    def _functions(self, expression) -> None:
        for e in _tree(expression):
            name = e.getClass().getName()
            if not name.startswith(self.BUILT_IN) or _kind(e) in self.REFUSED:
                raise ValueError(f"only built-in functions may be called, not {_kind(e)}")
            if _kind(e) in self.PLANS:
                self._relations(e.plan())

    def run(self, sql: str, most: int = MOST) -> tuple[DataFrame, bool]:
        """At most `most` rows, and whether there are more. TimeoutError past the deadline; what runs for it is stopped."""
        rows = self.check(sql).limit(most + 1)
        tag, spark = f"read-only-{uuid.uuid4().hex}", self.spark
        context, began = spark.sparkContext, time.monotonic()
        late = threading.Timer(self.deadline, context.cancelJobsWithTag, [tag])  # a session's tags are its thread's alone
        context.addJobTag(tag)
        late.start()
        try:
            found = rows.collect()  # most + 1 at most
        except Exception as e:
            if time.monotonic() - began >= self.deadline:
                raise TimeoutError(f"the query took more than {self.deadline:g} seconds") from e
            raise
        finally:
            late.cancel()
            context.removeJobTag(tag)
        return spark.createDataFrame(found[:most], rows.schema), len(found) > most


def _kind(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1].split("$")[0]


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _tree(node) -> list:
    out, todo = [], [node]
    while todo:
        out.append(todo.pop())
        todo += _each(out[-1].children())
    return out


# -- readers


def json_lines(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None) -> DataFrame:
    """JSON lines without those that lack a required field."""
    rows = spark.read.schema(schema).json(path)
    return rows.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in required or []], F.lit(True)))


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of a corpus file; a line of another type is an error."""
    rows = spark.read.schema("type string, doc_id string, text string, title string, qid string, query string, gold_doc_ids array<string>, gold_grades map<string,double>, slice string").json(path)
    # one expression, so that no filter on the type can run before the error
    is_doc = F.when(F.col("type") == "doc", True).when(F.col("type") == "query", False).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("null")))).cast("boolean"))
    return rows.filter(is_doc).select("doc_id", "text", "title"), rows.filter(~is_doc).select("qid", "query", "gold_doc_ids", "gold_grades", "slice")


def tab_separated(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def packed(rows: DataFrame, columns: list[str], sep: str = "_") -> DataFrame:
    """Columns of lists packed into strings as rows: pos and one value of each list."""
    lists = [F.split(F.coalesce(F.col(c), F.lit("")), F.lit(sep)).alias(c) for c in columns]
    zipped = rows.withColumn("_z", F.arrays_zip(*lists))
    others = [c for c in rows.columns if c not in columns]
    return zipped.select(*others, F.posexplode("_z").alias("pos", "_v")).select(*others, "pos", *[F.col(f"_v.{c}").alias(c) for c in columns])


def packed_terms(column: Column) -> Column:
    """Terms packed with the control character 24, as a text."""
    return F.array_join(F.filter(F.split(column, "\x18"), lambda t: t != ""), " ")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, rating, ts of a tab-separated rating file without header."""
    rows = spark.read.option("sep", "\t").schema("user_id string, item_id string, rating double, seconds long").csv(path)
    return rows.select("user_id", "item_id", "rating", F.timestamp_seconds("seconds").alias("ts"))
