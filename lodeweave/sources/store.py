"""A chunk store on Parquet: immutable slices, and a pointer per tenant and version.

Layout: root/slices/<id> holds a tenant's rows, root/pointers/<digest of the
tenant>/<version> names the slice of a version. A writer writes a whole new slice
and then claims the next version by renaming a finished pointer to its place, which
fails if another writer was first; it then starts over from that one's slice. So
readers see the old or the new state, no write is lost, and a lost job leaves
nothing half done. The claim is atomic where a rename that mustn't replace is (HDFS
and the like); on a local disk look and rename are two steps. Object stores that
only imitate renames need a table format with its own commit log.

Superseded slices stay readable until vacuum() removes them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators import retrieval
from lodeweave.operators.tabular import scope

TRIES = 10


class Files:
    """The few file operations of the store, on whatever file system a path is."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self.at(path)
        stream = fs.create(p, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def claim(self, source: str, target: str) -> bool:
        """Rename source to target unless that exists."""
        fs, p = self.at(source)
        t = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(t.getParent())
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(p), fs.makeQualified(t), plain)
        except Exception:
            if self.exists(target):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # --- pointers ---------------------------------------------------------------

    def _pointers(self, tenant: str) -> str:
        return f"{self.root}/pointers/{hashlib.sha256(tenant.encode()).hexdigest()}"

    def _current(self, tenant: str) -> tuple[int, str]:
        """(version, slice path) of one tenant; (0, '') if it has never been written, '' also after its deletion."""
        names = [n for n in self.files.names(self._pointers(tenant)) if re.fullmatch(r"\d{20}", n)]
        return (int(names[-1]), self.files.read(f"{self._pointers(tenant)}/{names[-1]}")) if names else (0, "")

    def version(self, tenant: str) -> int:
        return self._current(tenant)[0]

    # --- reading ------------------------------------------------------------------

    def slice(self, tenant: str) -> DataFrame | None:
        return self._read(self._current(tenant)[1])

    def _read(self, path: str) -> DataFrame | None:
        return self.spark.read.parquet(path) if path else None

    def fetch(self, tenant: str, where: Column | None = None, limit: int | None = None) -> DataFrame | None:
        """Rows in (document_id, chunk_index) order; sorted, then limited. A blank tenant raises."""
        own = scope(tenant)
        rows = self.slice(tenant)
        if rows is None:
            return None
        rows = rows.where(own if where is None else own & where).orderBy("document_id", "chunk_index")
        return rows.limit(limit) if limit else rows

    def count(self, tenant: str, document: str | None = None) -> int:
        rows = self.slice(tenant)
        if rows is None:
            return 0
        return (rows.where(F.col("document_id") == document) if document is not None else rows).count()

    def statistics(self, tenant: str) -> DataFrame | None:
        rows = self.slice(tenant)
        return None if rows is None else rows.groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))

    # --- writing -------------------------------------------------------------------

    def change(self, tenant: str, make: Callable[[DataFrame | None], DataFrame | None]) -> int:
        """Put make(the tenant's rows, or None) in their place; None empties the tenant. Returns the new version.

        Where another writer was first, make is called again with that one's rows."""
        scope(tenant)
        for _ in range(TRIES):
            version, path = self._current(tenant)
            rows, new, draft = make(self._read(path)), "", f"{self.root}/drafts/{uuid.uuid4().hex}"
            if rows is not None:
                new = f"{self.root}/slices/{uuid.uuid4().hex}"
                rows.write.parquet(new)
            self.files.write(draft, new)
            if self.files.claim(draft, f"{self._pointers(tenant)}/{version + 1:020d}"):
                return version + 1
            for left in filter(None, (draft, new)):
                self.files.remove(left)
        raise RuntimeError(f"{TRIES} writers were faster")

    def upsert(self, tenant: str, rows: DataFrame, order: str | None = None) -> int:
        """Rows keyed by (tenant, chunk_id); the last of a key wins (by order, if given). Returns the new version."""
        scope(tenant)
        own = rows.where(F.col("tenant_id") == tenant)
        nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(order) if order else F.desc(F.monotonically_increasing_id())))
        own = own.withColumn("__n", nth).where("__n = 1").drop("__n")
        return self.change(tenant, lambda old: own if old is None else old.join(own.select("chunk_id"), "chunk_id", "left_anti").unionByName(own, allowMissingColumns=True))

    def replace_documents(self, tenant: str, documents: DataFrame, rows: DataFrame) -> int:
        """All chunks of documents (document_id) give way to rows; other documents stay."""
        gone = documents.select("document_id").distinct()
        return self.change(tenant, lambda old: rows if old is None else old.join(gone, "document_id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete_document(self, tenant: str, document: str) -> int:
        gone = self.count(tenant, document)
        if gone:
            self.change(tenant, lambda old: None if old is None else old.where(~F.col("document_id").eqNullSafe(document)))
        return gone

    def delete_tenant(self, tenant: str) -> int:
        gone = self.count(tenant)
        if gone:
            self.change(tenant, lambda old: None)
        return gone

    def vacuum(self, tenant: str, keep: int = 1) -> int:
        """Remove the slices and stored indexes of all but the last versions, whose readers must have ended. Returns how many versions went."""
        folder = self._pointers(tenant)
        old = [n for n in self.files.names(folder) if re.fullmatch(r"\d{20}", n)][: -max(1, keep)]
        for name in old:
            path = self.files.read(f"{folder}/{name}")
            for left in filter(None, (path, f"{self.root}/keywords/{folder.rsplit('/', 1)[1]}/{int(name)}", f"{folder}/{name}")):
                self.files.remove(left)
        return len(old)

    # --- stored keyword index --------------------------------------------------------

    def keywords(self, tenant: str, section: str | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(postings, corpus statistics) of the tenant's present version, written upon first use and read by term after that.

        Postings are sorted by term, so a search reads the row groups of its terms only. k1
        and b weigh postings when they are read, so one index serves all their values."""
        version, path = self._current(tenant)
        if not path:
            return None
        place = f"{self.root}/keywords/{self._pointers(tenant).rsplit('/', 1)[1]}/{version}/{section or 'text'}"
        if not self.files.exists(place):
            rows, draft = self._read(path), f"{self.root}/drafts/{uuid.uuid4().hex}"
            write_index(rows, draft, section)
            if not self.files.claim(draft, place):  # another reader was first, with the same rows
                self.files.remove(draft)
        return read_index(self.spark, place)


BACKENDS: dict[str, Callable[[SparkSession, str], ChunkStore]] = {"parquet": ChunkStore}


def register_backend(name: str, build: Callable[[SparkSession, str], ChunkStore]) -> None:
    """build: (session, root) -> an object with the methods of ChunkStore."""
    BACKENDS[name] = build


def open_store(spark: SparkSession, root: str, backend: str = "parquet") -> ChunkStore:
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[backend](spark, root)


def write_index(chunks: DataFrame, path: str, section: str | None = None) -> None:
    """Postings of chunks, range-partitioned and sorted by tenant and term, and the statistics of each tenant."""
    retrieval.postings(chunks, section, ranged=True).sortWithinPartitions("tenant_id", "term").write.parquet(f"{path}/postings")
    retrieval.corpus_stats(chunks, section).write.parquet(f"{path}/statistics")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics")


def search_index(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, most: int = 1000) -> DataFrame:
    """keyword_search on a stored index; up to most distinct terms of the queries are pushed to the scan."""
    rows, stats = index
    asked = [r["term"] for r in queries.select(F.explode("terms").alias("term")).distinct().limit(most + 1).collect()]
    return retrieval.keyword_search(rows.where(F.col("term").isin(asked)) if len(asked) <= most else rows, stats, queries, k)


def unchanged(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """Incoming (tenant_id, document_id, digest) rows that are indexed as they are."""
    return incoming.join(indexed.select("tenant_id", "document_id", "digest").distinct(), ["tenant_id", "document_id", "digest"], "left_semi")


def changed(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    return incoming.join(indexed.select("tenant_id", "document_id", "digest").distinct(), ["tenant_id", "document_id", "digest"], "left_anti")


def same_content(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """(tenant_id, document_id, twin): another document of the tenant with equal content."""
    twins = indexed.groupBy("tenant_id", "digest").agg(F.min("document_id").alias("least"), F.max("document_id").alias("most"))
    x = incoming.join(twins, ["tenant_id", "digest"])
    twin = F.when(F.col("least") != F.col("document_id"), F.col("least")).when(F.col("most") != F.col("document_id"), F.col("most"))
    return x.select("tenant_id", "document_id", twin.alias("twin")).where("twin is not null")


def indexed_twins(store: ChunkStore, tenant: str, docs: DataFrame) -> DataFrame:
    """same_content of docs (tenant_id, document_id, text) and what the tenant has stored: documents to report before they are indexed again under another id."""
    from lodeweave.functions.ids import digest

    own = docs.where(scope(tenant)).select("tenant_id", "document_id", digest(F.col("text"), None).alias("digest"))
    old = store.slice(tenant)
    known = own.where("false") if old is None or "digest" not in old.columns else old.select("tenant_id", "document_id", "digest").distinct()
    return same_content(own, known)


def index_documents(store: ChunkStore, tenant: str, docs: DataFrame, sizes=None) -> dict[str, int]:
    """Skip what is unchanged, chunk the rest, replace their slices in one step. docs: (tenant_id, document_id, text)."""
    from lodeweave.functions.ids import digest
    from lodeweave.operators import chunking

    docs = docs.where(F.col("tenant_id") == tenant).withColumn("digest", digest(F.col("text"), None))
    old = store.slice(tenant)
    fresh = changed(docs, old) if old is not None and "digest" in old.columns else docs
    n, total = fresh.count(), docs.count()
    if n:
        made = chunking.chunk_documents(fresh, sizes or chunking.Sizes())
        store.replace_documents(tenant, fresh, made.join(fresh.select("tenant_id", "document_id", "digest"), ["tenant_id", "document_id"]))
    return {"indexed": n, "unchanged": total - n, "version": store.version(tenant)}
