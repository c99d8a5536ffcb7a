"""A versioned store of chunks: writers add files and publish them by one rename, readers see one version or the next, never half.

    <path>/data/<version>/bucket=<k>/...   chunks of the documents of bucket k, as of that version
    <path>/versions/<version>.json         for each bucket the version whose files hold it, and the schema

A write reads and rewrites only the buckets that its documents touch. Nothing is changed in place: a job that dies leaves files that no version
names. Two writers that start from one version race for the same name; the later one starts again from the new version.
`vacuum` removes what old versions alone name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times that a write starts again because another one was published first.
ATTEMPTS = 5


class ChunkStore:
    """Chunks (document_id, ...) below a path that all executors share; buckets: parts of the documents that are rewritten at once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- files

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._place("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._files().globStatus(self._place("versions/*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def _manifest(self, version: int | None) -> dict:
        """Buckets and schema of a version; of none an empty store's."""
        if version is None:
            return {"buckets": {}, "schema": None}
        rows = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def _publish(self, version: int, manifest: dict, attempt: str) -> bool:
        """Whether the version was free: the manifest is written aside and renamed, which fails if the name is taken."""
        aside = self._place(f"aside/{version}-{attempt}.json")
        out = self._files().create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        jvm, target = self.spark._jvm, self._place(f"versions/{version}.json")
        self._files().mkdirs(self._place("versions"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, target, plain)
        except Exception:
            if self._files().exists(target):
                return False
            raise
        return True

    # -- reading

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        places = [f"{self.path}/data/{v}/bucket={k}" for k, v in manifest["buckets"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version's chunks, or an older one's."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path}: nothing was written")
        return self._read(self._manifest(known[-1] if version is None else version))

    # -- writing

    def _bucket(self):
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _replace(self, gone: DataFrame, new: DataFrame | None) -> int:
        import uuid

        ids = gone.select("document_id").distinct()
        touched = {r[0] for r in ids.select(self._bucket()).distinct().collect()}  # `buckets` at most
        for _ in range(ATTEMPTS):
            known, attempt = self.versions(), uuid.uuid4().hex
            manifest = self._manifest(known[-1] if known else None)
            old = self._read(manifest, touched)
            if old is None and new is None:
                raise ValueError(f"{self.path}: nothing was written")
            kept = None if old is None else old.join(ids, old["document_id"].eqNullSafe(ids["document_id"]), "left_anti")
            rows = new if kept is None else kept if new is None else new.unionByName(kept.select(new.columns))
            version = f"{(known[-1] if known else 0) + 1}-{attempt}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            # every touched bucket is in the new files or has no row left
            names = [f.getPath().getName() for f in self._files().globStatus(self._place(f"data/{version}/bucket=*")) or []]
            buckets = {k: v for k, v in manifest["buckets"].items() if int(k) not in touched} | {n.removeprefix("bucket="): version for n in names}
            number = (known[-1] if known else 0) + 1
            if self._publish(number, {"buckets": buckets, "schema": rows.schema.jsonValue()}, attempt):
                return number
            self._files().delete(self._place(f"data/{version}"), True)
        raise RuntimeError(f"{self.path}: other writers were published first {ATTEMPTS} times")

    def write(self, chunks: DataFrame) -> int:
        """Replace all chunks of the given documents; the number of the new version."""
        return self._replace(chunks, chunks)

    def delete(self, ids: DataFrame) -> int:
        """Remove all chunks of the documents (document_id); the number of the new version."""
        return self._replace(ids, None)

    def vacuum(self, keep: int = 2) -> None:
        """Forget all versions but the last `keep`, and delete files that none of those names. Not while others write."""
        known = self.versions()
        named = {v for n in known[-keep:] for v in self._manifest(n)["buckets"].values()}
        for n in known[:-keep]:
            self._files().delete(self._place(f"versions/{n}.json"), False)
        for f in self._files().globStatus(self._place("data/*")) or []:
            if f.getPath().getName() not in named:
                self._files().delete(f.getPath(), True)
