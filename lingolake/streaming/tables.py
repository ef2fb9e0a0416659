"""Tables that streams write by key: rows are put in buckets by a hash of their key, a folder for each batch, and the last row of a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """A folder bucket=B/part=P of Parquet files with the key, other columns and _epoch, the batch that wrote a row.

    A batch replaces its own parts, so a batch that runs again changes nothing. Readers and lookups name the buckets they want, so a lookup
    opens those of its keys only; within them Spark filters by the keys it joins. `compact` puts a bucket's closed parts together once there
    are many; parts are deleted after the one that replaces them is whole, and rows that are there twice are the same row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.columns = [f.name for f in T._parse_datatype_string(schema).fields]
        self.schema = f"{schema}, _epoch long, bucket int, part string"
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._store = self._hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), self.buckets).cast("int")

    def _parts(self) -> dict[int, list[str]]:
        """Names of parts by bucket: at most a few for each bucket, as they are put together."""
        found: dict[int, list[str]] = {}
        for place in self._store.globStatus(self._hadoop.suffix("/bucket=*/part=*")) or []:
            name = place.getPath()
            found.setdefault(int(name.getParent().getName().removeprefix("bucket=")), []).append(name.getName().removeprefix("part="))
        return found

    def _load(self, chosen: list[tuple[int, str]]) -> DataFrame:
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/bucket={b}/part={p}" for b, p in chosen]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)

    def upsert(self, rows: DataFrame, epoch: int) -> None:
        """Add the rows of a batch, one for each key; whatever the same batch wrote before is replaced."""
        out = rows.select(*self.columns, F.lit(epoch).cast("long").alias("_epoch"), self.bucket().alias("bucket"), F.lit(f"{epoch:012d}").alias("part"))
        for b, parts in self._parts().items():  # of an attempt that did not end
            if f"{epoch:012d}" in parts:
                self._store.delete(self._hadoop.suffix(f"/bucket={b}/part={epoch:012d}"), True)
        out.repartition("bucket").write.mode("append").partitionBy("bucket", "part").parquet(self.path)

    def _latest(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in self.columns if c not in self.keys])
        return rows.groupBy(*self.keys).agg(F.max_by(row, "_epoch").alias("_row"), F.max("_epoch").alias("_epoch")).select(*self.keys, "_row.*", "_epoch")

    def read(self) -> DataFrame:
        """The last row of every key."""
        return self._latest(self._load([(b, p) for b, parts in self._parts().items() for p in parts])).select(*self.columns)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The last row of each key that occurs in rows; other buckets are not opened."""
        touched = {r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}  # `buckets` at most
        found = self._load([(b, p) for b, parts in self._parts().items() if b in touched for p in parts])
        return self._latest(found.join(rows.select(*self.keys).distinct(), self.keys, "left_semi")).select(*self.columns)

    def compact(self, before: int, most: int = 8) -> int:
        """Put together the parts of batches before `before` in buckets that have more than `most`; how many buckets."""
        names = {b: sorted(p for p in parts if int(p[:12]) < before) for b, parts in self._parts().items()}
        names = {b: parts for b, parts in names.items() if len(parts) > most}
        if not names:
            return 0
        rows = self._latest(self._load([(b, p) for b, parts in names.items() for p in parts]))
        target = F.create_map(*[F.lit(x) for b, parts in names.items() for x in (b, f"{parts[-1][:12]}-{len(parts)}")])
        out = rows.select(*self.columns, "_epoch", self.bucket().alias("bucket")).withColumn("part", target[F.col("bucket")])
        out.repartition("bucket").write.mode("append").partitionBy("bucket", "part").parquet(self.path)
        for b, parts in names.items():
            for p in parts:
                self._store.delete(self._hadoop.suffix(f"/bucket={b}/part={p}"), True)
        return len(names)
