"""A warehouse of Parquet tables with commits over several tables.

Rows of a table lie in buckets by the hash of their key. A commit stages what it writes in new folders; one manifest file then names,
for every table, the folders of each bucket. Readers follow the newest manifest, so that the tables of a commit appear together
or, if anything fails before, not at all. An upsert rewrites only buckets that its rows touch; an append adds a folder to them, and a
bucket with many folders is written as one again. Manifests are made by an exclusive rename: of two writers that began from the same
manifest, the second fails and can begin again.

A manifest also keeps how far streams have come, so a repeated batch of a stream is known as such. Folders that neither of the last two
manifests names are deleted after a commit; readers of those two go on undisturbed. The driver handles a few numbers a bucket, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: folders of a bucket from which an append writes it as one again
MANY = 16
BUCKETS = 16
_BUCKET = "__bucket"


class ConflictError(RuntimeError):
    """Another writer has committed since this commit began."""


class Warehouse:
    """tables: DDL by name; keys: the column whose hash deals a table's rows to buckets (id where it is not said)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], keys: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.keys, self.buckets = spark, path.rstrip("/"), tables, keys or {}, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"_manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest commit: its number, {table: {bucket: folders}}, how many buckets there are, and {stream: batch}."""
        names = [n for n in self.names("_manifests") if n.isdigit()]
        return self._load(names[-1]) if names else {"n": 0, "buckets": self.buckets, "tables": {}, "batches": {}}

    def _publish(self, manifest: dict) -> None:
        own, final = f"_manifests/_{uuid.uuid4().hex}", f"_manifests/{manifest['n']:012d}"
        out = self._fs.create(self._path(own), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(own), self._path(final), none)  # fails where the file exists
        except Exception as e:
            self._fs.delete(self._path(own), False)
            if self._fs.exists(self._path(final)):
                raise ConflictError(f"commit {manifest['n']} was made by another writer") from e
            raise

    # Reading

    def schema(self, name: str) -> S.StructType:
        return S.StructType.fromDDL(self.tables[name])

    def _key(self, name: str) -> str:
        return self.keys.get(name, "id")

    def _folders(self, paths: list[str], schema: S.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, manifest: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """A table as of a manifest (the newest), or some of its buckets."""
        held = (manifest or self.manifest())["tables"].get(name, {})
        return self._folders([p for b, ps in held.items() if buckets is None or b in buckets for p in ps], self.schema(name))

    # Writing

    @contextmanager
    def commit(self) -> Iterator[Commit]:
        """All that is done with the commit is published at the end of the block; nothing is if the block fails."""
        c = Commit(self)
        try:
            yield c
        except BaseException:
            c.discard()
            raise
        c.clear_unnamed()
        if c.changed:
            try:
                self._publish(c.manifest)
            except BaseException:
                c.discard()
                raise
            self.vacuum()

    def replace(self, name: str, df: DataFrame) -> None:
        """A commit of its own that puts a table's rows in place of all before."""
        with self.commit() as c:
            c.replace(name, df)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last, and folders that were written before the first of these and that none of them names. What
        commits under way have staged is in no manifest yet and stays."""
        names = [n for n in self.names("_manifests") if n.isdigit()]
        kept = [self._load(n) for n in names[-keep:]]
        named = {p for m in kept for t in m["tables"].values() for ps in t.values() for p in ps}
        for n in names[:-keep]:
            for p in {p for t in self._load(n)["tables"].values() for ps in t.values() for p in ps} - named:
                self._fs.delete(self._path(p), True)
                above = p.rsplit("/", 1)[0]
                if not [x for x in self.names(above) if not x.startswith(("_", "."))]:
                    self._fs.delete(self._path(above), True)
            self._fs.delete(self._path(f"_manifests/{n}"), False)


class Commit:
    """What a block of Warehouse.commit() does; `written` tells the rows put in by table, counted as they were written."""

    def __init__(self, wh: Warehouse):
        self.wh, old = wh, wh.manifest()
        self.base = old
        self.manifest = json.loads(json.dumps(old)) | {"n": old["n"] + 1}
        self.changed, self._made, self.written = False, [], {}
        self.rewritten: dict[str, set[str]] = {}

    def read(self, name: str, buckets: set[str] | None = None) -> DataFrame:
        """A table as this commit leaves it so far."""
        return self.wh.read(name, self.manifest, buckets)

    def _write(self, name: str, df: DataFrame, key: str, top: str) -> dict[str, str]:
        """Rows dealt to folders by bucket; the buckets that got any, and their folders."""
        folder, n = f"{top}/v-{uuid.uuid4().hex}", self.manifest["buckets"]
        self._made.append(folder)
        dealt = df.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n))).repartition(n, _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.wh.path}/{folder}")
        return {x.split("=")[1]: f"{folder}/{x}" for x in self.wh.names(folder) if x.startswith(_BUCKET)}

    def stage(self, name: str, df: DataFrame) -> Staged:
        """Rows for a table, written once and counted while they are."""
        seen = Observation()
        key = self.wh._key(name)
        folders = self._write(name, df.observe(seen, F.count(F.lit(1)).alias("n")), key, "_staged")
        # a plan known to be empty is not run, and observes nothing
        self.written[name] = self.written.get(name, 0) + (seen.get["n"] if folders else 0)
        return Staged(self.wh._folders(list(folders.values()), df.schema), set(folders))

    def upsert(self, name: str, source: DataFrame | Staged, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> set[str]:
        """merge(rows of the touched buckets, source) in place of these buckets; the others stay as they are. Gives the buckets."""
        staged = source if isinstance(source, Staged) else self.stage(name, source)
        if staged.buckets:
            merged = merge(self.read(name, staged.buckets), staged.rows).select(*[f.name for f in self.wh.schema(name)])
            new = self._write(name, merged, self.wh._key(name), name)
            held = self.manifest["tables"].setdefault(name, {})
            for b in staged.buckets:
                held.pop(b, None)
            held |= {b: [p] for b, p in new.items()}
            self.rewritten[name] = self.rewritten.get(name, set()) | staged.buckets
            self.changed = True
        return staged.buckets

    def append(self, name: str, df: DataFrame, new: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Rows beside those there are; new(rows of the touched buckets, rows) can leave some out."""
        if new is not None:
            staged = self.stage(name, df)
            if not staged.buckets:
                return
            df = new(self.read(name, staged.buckets), staged.rows)
        held = self.manifest["tables"].setdefault(name, {})
        for b, p in self._write(name, df.select(*[f.name for f in self.wh.schema(name)]), self.wh._key(name), name).items():
            held.setdefault(b, []).append(p)
            self.changed = True
        many = {b for b, ps in held.items() if len(ps) >= MANY}
        if many:
            held |= {b: [p] for b, p in self._write(name, self.read(name, many), self.wh._key(name), name).items()}

    def replace(self, name: str, df: DataFrame) -> None:
        self.manifest["tables"][name] = {b: [p] for b, p in self._write(name, df.select(*[f.name for f in self.wh.schema(name)]), self.wh._key(name), name).items()}
        self.changed = True

    def batch(self, stream: str, number: int) -> bool:
        """Note that a stream's batch is in this commit; False if it, or a later one, has been committed before."""
        if self.base["batches"].get(stream, -1) >= number:
            return False
        self.manifest["batches"][stream] = number
        self.changed = True
        return True

    def discard(self) -> None:
        for folder in self._made:
            self.wh._fs.delete(self.wh._path(folder), True)

    def clear_unnamed(self) -> None:
        """Delete what this commit has staged, or written and then written anew."""
        named = {p for t in self.manifest["tables"].values() for ps in t.values() for p in ps}
        for folder in self._made:
            buckets = [f"{folder}/{x}" for x in self.wh.names(folder) if x.startswith(_BUCKET)]
            unnamed = [p for p in buckets if p not in named]
            for p in unnamed if len(unnamed) < len(buckets) else [folder]:
                self.wh._fs.delete(self.wh._path(p), True)


class Staged:
    def __init__(self, rows: DataFrame, buckets: set[str]):
        self.rows, self.buckets = rows, buckets


def last_of(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row a key: the last by an order; rows that agree in it, and all rows without one, are ordered by all they hold that can be."""
    plain = [c for c, k in rows.dtypes if "map<" not in k and "variant" not in k]
    by = F.struct(*([order.alias("__o")] if order is not None else []), *plain)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("__x")).select("__x.*")
