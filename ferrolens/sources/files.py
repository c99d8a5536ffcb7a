"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "`@t` timestamp, `@mt` string, `@l` string, `@x` string, ServiceName string, CorrelationId string"


def read_service_logs(spark: SparkSession, path: str, service: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Log lines in JSON with all other fields as a map `extra`; malformed and blank lines are skipped.

    Service and date are read from names like api-20240131.json; files out of range are pruned by
    name, undated ones always stay.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_name"))
    date = F.try_to_date(F.regexp_extract("file", r"-(\d{8})\.", 1), "yyyyMMdd")
    name = F.regexp_extract("file", r"^(.*?)(?:-\d{8})?\.[^.]*$", 1)
    if service:
        lines = lines.filter(F.lower(name) == service.lower())
    if start:
        lines = lines.filter(date.isNull() | (date >= F.lit(start).cast("date")))
    if end:
        lines = lines.filter(date.isNull() | (date <= F.lit(end).cast("date")))
    fields = [c.strip("`").split("` ")[0].split(" ")[0].strip("`") for c in LOG_SCHEMA.split(", ")]
    parsed = lines.filter(F.trim("value") != "").withColumn("row", F.from_json("value", LOG_SCHEMA)).withColumn("all", F.from_json("value", "map<string, string>"))
    return parsed.filter(F.col("row.`@t`").isNotNull()).select(
        F.col("row.`@t`").alias("ts"), F.col("row.`@mt`").alias("template"), F.col("row.`@l`").alias("level"), F.col("row.`@x`").alias("exception"), F.coalesce("row.ServiceName", name).alias("service"),
        F.col("row.CorrelationId").alias("correlation_id"), F.map_filter("all", lambda k, v: ~k.isin(fields)).alias("extra"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text): whole .md and .txt files below the path; the id is the lower-cased relative path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    root = path.rstrip("/").removeprefix("file://")
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^[a-z]+:(//)?", "")
    return files.select(F.lower(F.regexp_replace(F.substring_index(full, root, -1), r"^/", "")).alias("document_id"), F.col("value").alias("text"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _replace(new: DataFrame | None, gone: DataFrame, path: str, buckets: int) -> None:
    """Write anew the buckets of the documents `gone` (document_id): without these, with the rows of `new`."""
    spark = gone.sparkSession
    if _exists(spark, path):
        old = spark.read.parquet(path) if new is None else spark.read.schema(new.schema).parquet(path)
        ids = gone.select("document_id").distinct()
        kept = old.join(F.broadcast(ids.select(_bucket(buckets).alias("bucket")).distinct()), "bucket", "left_semi").join(ids, "document_id", "left_anti").select(old.columns)
        rows = kept if new is None else new.unionByName(kept.select(new.columns))
        staged = f"{path.rstrip('/')}__staged"
        touched = sorted(r[0] for r in ids.select(_bucket(buckets)).distinct().collect())  # `buckets` at most
        rows.write.mode("overwrite").parquet(staged)
        new = spark.read.schema(rows.schema).parquet(staged)
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        for k in touched:  # dynamic overwriting leaves partitions alone that have no row
            if k not in left:
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/bucket={k}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if new is not None:
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """Replace all chunks of the given documents: buckets of documents that they touch are written anew, others stay.

    What a bucket held of other documents is read, kept and staged before it is overwritten.
    """
    _replace(chunks.withColumn("bucket", _bucket(buckets)), chunks, path, buckets)


def delete_chunks(documents: DataFrame, path: str, buckets: int = 16) -> None:
    """Remove all chunks of the given documents (document_id)."""
    if _exists(documents.sparkSession, path):
        _replace(None, documents, path, buckets)


ENTRY = "id string, query string, language string, intent string, expected_docs array<string>, expected_keywords array<string>, expected_answer string"


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, language, intent, documents, keywords, answer): the entries of an evaluation file in JSON."""
    file = spark.read.schema(f"entries array<struct<{ENTRY}>>").json(path, multiLine=True)
    e = file.select(F.explode("entries").alias("e")).select("e.*")
    return e.select(F.col("id").alias("query_id"), "query", "language", "intent", F.col("expected_docs").alias("documents"), F.col("expected_keywords").alias("keywords"), F.col("expected_answer").alias("answer"))


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, place, term): groups of terms, a JSON array of arrays; blank terms don't count."""
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("group_id", "terms"))
    return groups.select("group_id", F.posexplode("terms").alias("place", "term")).filter(F.trim("term") != "")


def write_report(measures: DataFrame, report: DataFrame, path: str, failed: int = 20) -> None:
    """An evaluation as JSON below the path: its measures, its report, and a text of it with the first failed queries."""
    measures.write.mode("overwrite").json(f"{path}/measures")
    report.write.mode("overwrite").json(f"{path}/report")
    lines = report.select(F.lit(0).alias("part"), F.format_string("%s/%s: n=%d recall=%.3f mrr=%.3f ndcg=%.3f hit=%.3f passed=%s", *(F.coalesce(c, F.lit("all")) for c in ("intent", "language")), "n", "recall", "mrr", "ndcg", "hit_rate", "passed").alias("value"))
    missed = measures.filter(~F.col("hit")).orderBy("query_id").limit(failed).select(F.lit(1).alias("part"), F.format_string("failed: %s", F.col("query_id").cast("string")).alias("value"))
    lines.unionByName(missed).coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(f"{path}/summary")


class IndexAlias:
    """Two tables of chunks under one name: searches read the active one, a new index is written beside it, then promoted.

    The state is a one-row table of its own, so that every session sees the same; it is replaced as a whole by a new version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self):
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def state(self) -> dict:
        """The active side, whether the standby side is ready, and the side before; nothing is active at first."""
        versions = self._versions()
        if not versions:
            return {"active": None, "ready": False, "before": None}
        return self.spark.read.schema("active string, ready boolean, before string").json(f"{self.path}/state/{versions[-1]}").first().asDict()

    def _write(self, **state) -> None:
        version = (self._versions() or [0])[-1] + 1
        self.spark.createDataFrame([state], "active string, ready boolean, before string").coalesce(1).write.json(f"{self.path}/state/{version}")

    @property
    def standby(self) -> str:
        return "green" if self.state()["active"] == "blue" else "blue"

    def prepare(self, chunks: DataFrame) -> None:
        """Write the standby side anew; searches go on with the active one."""
        state = self.state()
        chunks.write.mode("overwrite").parquet(f"{self.path}/{self.standby}")
        self._write(active=state["active"], ready=True, before=state["before"])

    def promote(self) -> None:
        """The prepared side becomes active."""
        state = self.state()
        if not state["ready"]:
            raise ValueError("no side is prepared")
        self._write(active=self.standby, ready=False, before=state["active"])

    def rollback(self) -> None:
        """The side before the last promotion becomes active again."""
        state = self.state()
        if state["before"] is None:
            raise ValueError("there is nothing to go back to")
        self._write(active=state["before"], ready=False, before=state["active"])

    def read(self) -> DataFrame:
        """The active side."""
        active = self.state()["active"]
        if active is None:
            raise ValueError("nothing is active")
        return self.spark.read.parquet(f"{self.path}/{active}")

    def view(self, name: str) -> None:
        """A view of the active side under the name."""
        self.read().createOrReplaceTempView(name)
