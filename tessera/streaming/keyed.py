"""A keyed Parquet table that merges: buckets of key hashes, delta files, and a manifest.

A batch writes its own rows only, one delta file for each bucket that its keys fall
into, and then a manifest that names the files of every bucket.  The manifest is what
commits: files that none names are not there, and a batch that is run again after its
commit changes nothing.  Readers fold a bucket's files by key; a bucket with many
deltas is folded into a new base file by the batch that finds it so, the others stay
as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.files import shared_folder

BUCKETS = 32
MOST_DELTAS = 8  # of a bucket, before they are folded into its base
_MANIFEST = "buckets map<int,array<string>>, applied map<string,long>"


@dataclass
class KeyedTable:
    """A table with one row for each key, in the folder ``at``.

    ``order`` is the column that tells newer rows from older ones.  Each other column
    has the newest value that is not null, so that a row that comes late with one
    column joins what is there; with ``whole`` the newest row holds as a whole.  Equal
    ``order``: the larger value.  One writer at a time; readers see the last commit.
    """

    spark: SparkSession
    at: str
    schema: StructType
    keys: list[str]
    order: str
    whole: bool = False
    buckets: int = BUCKETS
    most_deltas: int = MOST_DELTAS

    def _values(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.keys and c != self.order]

    def _stamped(self, rows: DataFrame) -> DataFrame:
        """Keys, bucket, the newest ``order``, and each value with the order that it came with."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        stamped = lambda value: F.struct(F.col(self.order).alias("at"), value.alias("v"))
        if self.whole:
            given = [stamped(F.struct(*self._values())).alias("_row")] if self._values() else []
        else:
            given = [F.when(F.col(c).isNotNull(), stamped(F.col(c))).alias(c) for c in self._values()]
        return rows.select(*self.keys, bucket.alias("_bucket"), F.col(self.order), *given)

    def _folded(self, stamped: DataFrame) -> DataFrame:
        """One row for each key: everything that is newest."""
        rest = [c for c in stamped.columns if c not in self.keys and c != "_bucket"]
        return stamped.groupBy(*self.keys, "_bucket").agg(*[F.max(c).alias(c) for c in rest])

    def _files(self, kind: StructType, names: list[str]) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*[f"{self.at}/{n}" for n in names]) if names else self.spark.createDataFrame([], kind)

    def _kind(self) -> StructType:
        return self._stamped(self.spark.createDataFrame([], self.schema)).schema

    def _write(self, folded: DataFrame, folder: str) -> list[int]:
        """Write a file for each bucket; the buckets that were written."""
        folded.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.at}/{folder}")
        return sorted(int(p.rpartition("=")[2]) for p in self._listed(folder) if p.startswith("_bucket="))

    def _listed(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _newest(self) -> int:
        """The number of the last manifest that was written to its end; 0 for none."""
        numbers = sorted((int(n) for n in self._listed("manifest") if n.isdigit()), reverse=True)
        return next((n for n in numbers if "_SUCCESS" in self._listed(f"manifest/{n}")), 0)

    def manifest(self) -> tuple[int, dict[int, list[str]], dict[str, int]]:
        """Number, files by bucket (base first), and the last batch applied by source."""
        n = self._newest()
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.at}/manifest/{n}").first() if n else None
        return n, dict(row.buckets) if row else {}, dict(row.applied) if row else {}

    def upsert(self, batch: DataFrame, number: int, source: str = "batch") -> None:
        """Merge a batch; one whose number ``source`` has applied already is passed by."""
        n, files, applied = self.manifest()
        if applied.get(source, -1) >= number:
            return
        folder = f"delta/{source}-{number}"
        for b in self._write(self._folded(self._stamped(batch.select(*self.schema.names))), folder):
            files[b] = files.get(b, []) + [f"{folder}/_bucket={b}"]
        full = [b for b, f in files.items() if len(f) > self.most_deltas]
        if full:
            base = f"base/{source}-{number}"
            kind = self._kind()
            inner = StructType([f for f in kind.fields if f.name != "_bucket"])
            read = [self._files(inner, files[b]).withColumn("_bucket", F.lit(b)) for b in full]
            rows = read[0]
            for more in read[1:]:
                rows = rows.unionByName(more)
            self._write(self._folded(rows), base)
            files |= {b: [f"{base}/_bucket={b}"] for b in full}
        self.spark.createDataFrame([(files, applied | {source: number})], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/{n + 1}")

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """The table; with ``keys`` (a few rows) only theirs, from their buckets' files."""
        _, files, _ = self.manifest()
        if keys is not None:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            wanted = {r.b for r in keys.select(bucket.alias("b")).distinct().collect()}  # no more than there are buckets
            files = {b: f for b, f in files.items() if b in wanted}
        inner = StructType([f for f in self._kind().fields if f.name != "_bucket"])
        found = self._folded(self._files(inner, [f for names in files.values() for f in names]).withColumn("_bucket", F.lit(0)))
        if keys is not None:
            found = found.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        value: dict[str, Column] = {c: F.col(f"_row.v.{c}") if self.whole else F.col(f"{c}.v") for c in self._values()}
        value |= {c: F.col(c) for c in [*self.keys, self.order]}
        return found.select(*[value[c].alias(c) for c in self.schema.names])

    def vacuum(self) -> int:
        """Delete files and manifests that the last commit doesn't need; how many folders went."""
        n, files, _ = self.manifest()
        needed = {f.rpartition("/")[0] for names in files.values() for f in names} | {f"manifest/{n}"}
        jvm = self.spark.sparkContext._jvm
        gone = 0
        for kind in ("delta", "base", "manifest"):
            for name in self._listed(kind):
                if f"{kind}/{name}" not in needed:
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{kind}/{name}")
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                    gone += 1
        return gone

    def follow(self, stream: DataFrame, source: str = "stream") -> None:
        """Merge a stream into the table until there is no more input; a later call goes on where this one stopped."""
        put = lambda batch, n: self.upsert(batch, n, source)
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.at}/checkpoint-{source}").trigger(availableNow=True).start()
        query.awaitTermination()


def keyed_table(spark: SparkSession, schema: StructType, keys: list[str], order: str, name: str = "keyed", at: str | None = None, **options) -> KeyedTable:
    """A table in the folder ``at``, or in a new one in the shared folder."""
    return KeyedTable(spark, at or shared_folder(spark, name), schema, keys, order, **options)
