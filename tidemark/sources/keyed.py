"""Tables by key whose rows change in batches, each batch once, without rewriting the table.

Rows lie in `buckets` by a hash of the key. A batch reads and writes the buckets that it touches alone; all
others keep their files. What a version of the table consists of is one small manifest, which names each
bucket's folder and the last batch; a version exists once its manifest does, and that is made by a rename
that never replaces one. So a batch that stops half-way changes nothing (its files are not named
anywhere until `vacuum`), a batch that is run again is recognised by its number and left out, and of two writers
at a time one gets an error. Readers keep the version that they began with.

A bucket is the unit of rewriting: choose as many as make a bucket some hundred megabytes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS, DATA, BUCKET = "_manifests", "data", "_bucket"


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Manifest:
    """A version: the folder of each bucket that has rows, the schema, and the last batch."""

    version: int
    key: list[str]
    n: int
    schema: str
    epoch: int | None = None
    buckets: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """What a batch does to rows, in terms of `old.<column>` and `new.<column>`.

    where: which rows that are there already are changed (others stay as they are); update: their new values, by
    column (columns not named take the batch's); insert: values of rows that are not there, by column. With
    `inserts` False such rows are left out. `replace` False keeps columns that `update` does not name.
    """

    where: Column | None = None
    update: dict[str, Column] = field(default_factory=dict)
    insert: dict[str, Column] = field(default_factory=dict)
    inserts: bool = True
    replace: bool = True


def keep_last(order: str) -> Rule:
    """The later row by `order` stays; of equals the new one. Rows without an order come first."""
    old, new = F.col(f"old.{order}"), F.col(f"new.{order}")
    return Rule(where=old.isNull() | F.coalesce(new >= old, F.lit(False)))


def keep_first() -> Rule:
    """Rows that are there stay."""
    return Rule(where=F.lit(False))


def merged(old: DataFrame, new: DataFrame, key: list[str], rule: Rule) -> DataFrame:
    """old with the rows of new put in by the rule; the keys of each are distinct (null equals null)."""
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]
    both = old.withColumn("_old", F.lit(True)).alias("old").join(new.withColumn("_new", F.lit(True)).alias("new"), on, "full")
    there, given = F.col("old._old").isNotNull(), F.col("new._new").isNotNull()
    changed = given if rule.where is None else given & F.coalesce(rule.where, F.lit(False))

    def value(c: str) -> Column:
        if c in key:
            return F.when(there, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
        own = F.col(f"new.{c}") if c in new.columns else F.lit(None)
        after = rule.update.get(c, own if rule.replace and c in new.columns else F.col(f"old.{c}"))
        fresh = rule.insert.get(c, own)
        kind = old.schema[c].dataType
        return F.when(there & changed, after.cast(kind)).when(there, F.col(f"old.{c}")).otherwise(fresh.cast(kind)).alias(c)

    return both.where(there if not rule.inserts else F.lit(True)).select(*map(value, old.columns))


class KeyedTable:
    """A table at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def create(self, rows: DataFrame, key: str | list[str], *, buckets: int = 32) -> "KeyedTable":
        """Version 0, with these rows; keys must be distinct."""
        key = [key] if isinstance(key, str) else list(key)
        folders = self._write(rows, key, buckets)
        self._publish(Manifest(0, key, buckets, rows.schema.json(), None, folders))
        return self

    def versions(self) -> list[int]:
        at = self._path(MANIFESTS)
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version, or the one that is named."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{self.path}: no version {'' if version is None else version}")
        stream = self._fs.open(self._path(MANIFESTS, f"{found[-1] if version is None else version:012d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._rows(m, m.buckets)

    def merge(self, batch: DataFrame, rule: Rule, *, epoch: int | None = None, order: str | None = None) -> bool:
        """Puts a batch in; False if it was there already (its epoch is not above the last one). Of rows of one
        key in the batch the last by `order` counts; without it, keys must be distinct."""
        m = self.manifest()
        if epoch is not None and m.epoch is not None and epoch <= m.epoch:
            return False
        if order:
            rest = [c for c in batch.columns if c not in m.key]
            last = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
            batch = batch.groupBy(*m.key).agg(last.alias("_last")).select(*m.key, "_last.*")
        # read more than once, so written first: a stream's batch must not be computed twice
        stage = f"{self.path}/{DATA}/{uuid.uuid4().hex}"
        batch.withColumn(BUCKET, _bucket(m.key, m.n)).write.parquet(stage)
        staged = self.spark.read.parquet(stage)
        touched = {r[0] for r in staged.select(BUCKET).distinct().collect()}  # at most n numbers
        old = self._rows(m, {b: at for b, at in m.buckets.items() if int(b) in touched})
        folders = self._write(merged(old, staged.drop(BUCKET), m.key, rule), m.key, m.n) if touched else {}
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(stage), True)
        self._publish(Manifest(m.version + 1, m.key, m.n, m.schema, m.epoch if epoch is None else epoch, m.buckets | folders))
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions and the files that none of them names; how many folders went.
        Not while a batch is on its way, whose files no version names yet."""
        found = self.versions()
        last = [self.manifest(v) for v in found[-keep:]]
        named = {at.split("/")[1] for m in last for at in m.buckets.values()}
        for v in found[:-keep]:
            self._fs.delete(self._path(MANIFESTS, f"{v:012d}.json"), False)
        at, gone = self._path(DATA), 0
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in named:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    def _rows(self, m: Manifest, buckets: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{at}" for _, at in sorted(buckets.items())))

    def _write(self, rows: DataFrame, key: list[str], n: int) -> dict[str, str]:
        """The rows in a folder of their own; the folder of each bucket."""
        at = f"{DATA}/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, _bucket(key, n)).repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{at}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(at))]
        return {name.split("=")[1]: f"{at}/{name}" for name in names if name.startswith(f"{BUCKET}=")}

    def _publish(self, m: Manifest) -> None:
        draft, final = self._path(MANIFESTS, f".{uuid.uuid4().hex}"), self._path(MANIFESTS, f"{m.version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        if m.version in self.versions():
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path}: version {m.version} is there already")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, no_options)  # fails where the name is taken
        except Exception as error:
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path}: version {m.version}") from error


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias(BUCKET)
