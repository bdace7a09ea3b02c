"""Exact deduplication against a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import concurrent.futures as futures
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import HadoopStore, Log, Stale
from .common import ascii_lower, bucket_count, fresh_path, fresh_table, own, stage

#: Files that are moved at a time.
MOVES = 16
#: A digest with this share of all rows counts as hot; there are at most ``HOT_SHARE`` such digests.
HOT_SHARE = 1000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the lower-case hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return docs.select("doc_id", digest().alias("digest"))


def digest() -> Column:
    return F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)


class DigestIndex:
    """A Parquet table (digest, keep_id) in buckets sorted by digest, at ``location``, for any number of handles and sessions.

    A log of numbered commits says which folder has the rows, in how many buckets, and which additions are part of it; every
    row carries the mark of its addition, so rows of one that failed or is not yet committed are not read. ``add`` groups new
    rows by digest, drops those whose digest is there by a sort-merge anti-join that reads the index bucket by bucket without
    a shuffle, and appends the rest; if another handle has committed meanwhile, its rows are looked at again, so a digest is
    never there twice. Every ``add`` leaves a file a bucket, and several files of a bucket are sorted again when read;
    ``compact`` makes them one. Each use begins with the newest commit, so no handle is stale. The first handle of a location
    sets the bucket count; ``name`` only begins the names of the tables in the session's catalog, which are always new ones.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = 32) -> None:
        self.spark, self.name, self.location = spark, name, location.rstrip("/")
        self.log, self.files = Log(f"{self.location}/log", spark), HadoopStore(spark)
        self._opened: tuple[str, str] = ("", "")
        self._version, self.state = self.log.change(lambda state: None if state else {"buckets": buckets, "rows": _folder(), "batches": []})
        self._sync()

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _sync(self) -> None:
        """Follow the newest commit: another folder gets a table of its own, other files of the same one are listed anew."""
        self._version, self.state = self.log.newest()
        folder, table = self._opened
        if folder == self.state["rows"]:
            self.spark.catalog.refreshTable(table)
            return
        table = fresh_table(self.spark, self.name)
        self.spark.sql(
            f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/{self.state['rows']}'"
        )
        self._opened = self.state["rows"], table

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> str:
        """``rows`` in buckets below ``folder``, marked; the mark."""
        mark, table = uuid.uuid4().hex, fresh_table(self.spark, self.name)
        marked = rows.select("digest", "keep_id", F.lit(mark).alias("batch"))
        marked.write.option("path", f"{self.location}/{folder}").option("compression", "zstd").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay
        return mark

    def table(self) -> DataFrame:
        """The rows of the newest commit."""
        self._sync()
        committed = F.col("batch").isin(self.state["batches"]) if self.state["batches"] else F.lit(False)
        return self.spark.table(self._opened[1]).filter(committed).select("digest", "keep_id")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """One row per digest of ``rows`` (doc_id, digest) that the index lacks, with its largest doc_id."""
        grouped = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return grouped.hint("merge").join(self.table(), "digest", "left_anti")

    def add(self, rows: DataFrame, attempts: int = 20) -> None:
        """Add the digests of ``rows`` (doc_id, digest) that are new."""
        for _ in range(attempts):
            fresh = self.unseen(rows)
            before, staged = self.state, f"adding-{uuid.uuid4().hex}"
            mark = self._write(fresh, staged, before["buckets"])
            names = [n for n in self.files.names(f"{self.location}/{staged}") if n.startswith("part-")]
            # A file a bucket and task; its name has the bucket.
            with futures.ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda n: self.files.move(f"{self.location}/{staged}/{n}", f"{self.location}/{before['rows']}/{n}"), names))
            self.files.delete(f"{self.location}/{staged}")
            if self._commit(before, before | {"batches": [*before["batches"], mark]}):
                return
            for name in names:
                self.files.delete(f"{self.location}/{before['rows']}/{name}")
        raise Stale(f"{self.location}: {attempts} additions in a row met those of others")

    def _commit(self, before: dict, after: dict) -> bool:
        """Whether ``after`` could follow ``before``, which another handle may have replaced."""
        same = False

        def make(state: dict) -> dict | None:
            nonlocal same
            same = state == before
            return after if same else None

        self._version, self.state = self.log.change(make)
        return same

    def compact(self, buckets: int | None = None, attempts: int = 20) -> None:
        """Write the rows anew, one file a bucket, in ``buckets`` buckets (as before unless given), then point to them.

        The old folder stays until its owner deletes it, so readers that are under way do not fail.
        """
        for _ in range(attempts):
            rows = self.table()
            before, folder = self.state, _folder()
            count = buckets or before["buckets"]
            mark = self._write(rows.repartition(count, "digest"), folder, count)
            if self._commit(before, {"buckets": count, "rows": folder, "batches": [mark]}):
                self._sync()
                return
            self.files.delete(f"{self.location}/{folder}")
        raise Stale(f"{self.location}: {attempts} compactions in a row met changes of others")


def _folder() -> str:
    return f"rows-{uuid.uuid4().hex}"


#: Digests of a bucket: some 40 MB.
BUCKET_ROWS = 500_000


def new_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An empty index for about so many rows; a bucket is at most a task's share, so a task that adds rows writes one file."""
    return DigestIndex(spark, fresh_table(spark, "digest_index"), fresh_path(spark, "digest-index"), bucket_count(spark, rows, BUCKET_ROWS))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows come to an index (a new one unless given) in two batches, larger doc_ids first, so the largest doc_id of equal
    texts stays; with an index that has seen the text, its older keep_id stays. Rows without doc_id come last. Rows that
    repeat both doc_id and text share one decision. Only doc_id and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(digests(docs), "digests")
    total, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5)).first()
    index = index or new_index(spark, total)
    late = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    index.add(rows.filter(late))
    index.add(rows.filter(~late))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stage(sizes.hint("merge").join(index.table(), "digest"), "digest-groups")
    # Groups of at least total / HOT_SHARE rows: at most HOT_SHARE of them, so they fit a broadcast at any size.
    limit = max(2, total // HOT_SHARE + 1)
    hot = F.broadcast(groups.filter(F.col("group_size") >= limit))
    rest = groups.filter(F.col("group_size") < limit)
    joined = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, each text once, with all their columns.

    Rows meet their decision by doc_id and digest, so rows without doc_id are told apart by text, a text's copies are not
    one group of the join, and of rows that repeat both one stays.
    """
    kept = deduplicate(docs).filter("kept").select("doc_id", "text_sha256")
    again = kept.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count()
    mark = own(docs, "digest")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{mark}") == F.col("k.text_sha256"))
    out = docs.withColumn(mark, digest()).alias("d").join(kept.distinct().alias("k"), same, "left_semi")
    return (out.dropDuplicates(["doc_id", mark]) if again else out).drop(mark)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
