"""A collection of documents in a folder: upload, parse, translate, check, publish, list, delete, ask, and the model's configuration.

Every step is a DataFrame over the documents that it is given. A table consists of buckets of documents. A step writes the buckets that it
changes as a run of their own, and then, in one append, the row that names the run of each bucket: readers see the run before or
the run after, and a step that fails leaves the table as it was. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import flow
from quillspark.operators import quality
from quillspark.operators import translate as M
from quillspark.operators.parse import parse

#: Buckets of documents of a table: what a step over one document rewrites.
BUCKETS = 64


def _bucket(column: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BUCKETS)).cast("int")


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, *names: str) -> str:
        return "/".join((self.root, *names))

    # ---- tables

    def _runs(self, name: str) -> dict[int, tuple[int, str, int]]:
        """Of each bucket the latest run: its number, name and rows. At most BUCKETS rows."""
        try:
            rows = self.spark.read.parquet(self._at(name, "runs"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["bucket"]: (r["last"]["seq"], r["last"]["run"], r["last"]["n"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("seq", "run", "n")).alias("last")).collect()}

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; None if there is nothing in it."""
        paths = [self._at(name, f"run={run}", f"bucket={b}") for b, (_, run, n) in sorted(self._runs(name).items()) if n and (buckets is None or b in buckets)]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def _write(self, rows: DataFrame | None, name: str, buckets: list[int]) -> None:
        """Makes rows what the buckets hold."""
        run, seq, sizes = uuid.uuid4().hex, 1 + max((s for s, _, _ in self._runs(name).values()), default=0), {}
        if rows is not None:
            at = self._at(name, f"run={run}")
            rows.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(at)
            try:
                sizes = {r["bucket"]: r["n"] for r in self.spark.read.parquet(at).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
            except AnalysisException as e:  # no row, no schema
                if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                    raise
        self.spark.createDataFrame([(b, seq, run, sizes.get(b, 0)) for b in buckets], "bucket int, seq long, run string, n long").coalesce(1).write.mode("append").parquet(self._at(name, "runs"))

    def _put(self, name: str, ids: DataFrame, new: DataFrame | None) -> None:
        """The rows of documents ids (doc_id) become new; the rest of their buckets stays."""
        ids = ids.select("doc_id").distinct()
        buckets = [r["b"] for r in ids.select(_bucket().alias("b")).distinct().collect()]
        if not buckets:
            return
        old = self._read(name, buckets)
        old = None if old is None else old.join(ids, "doc_id", "left_anti")
        self._write(new if old is None else old if new is None else old.unionByName(new, allowMissingColumns=True), name, buckets)

    def _of(self, name: str, doc_id: int) -> DataFrame:
        bucket = self.spark.range(doc_id, doc_id + 1).select(_bucket("id").alias("b")).first()["b"]
        rows = self._read(name, [bucket])
        if rows is None:
            raise LookupError(f"{name} has nothing of document {doc_id}")
        return rows.where(F.col("doc_id") == doc_id)

    # ---- documents

    def add_pages(self, pages: DataFrame, filenames: DataFrame, controls: DataFrame | None = None) -> None:
        """Registers documents (doc_id, filename, bytes) that may be uploaded, and parses their dumped pages. A document that is there already is replaced,
        with its results."""
        taken = filenames.where(D.admitted(F.col("filename"), F.col("bytes"))).dropDuplicates(["doc_id"])
        counts = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
        index = taken.join(counts, "doc_id", "left").select("doc_id", "filename", "page_count", F.lit("uploaded").alias("status"), F.current_timestamp().alias("created_at"), F.lit(False).alias("output_ready"))
        self._put("layout", taken, parse(pages.join(taken, "doc_id", "left_semi"), controls))
        if self._runs("results"):
            self._put("results", taken, None)
        self._put("index", taken, index)

    def list_documents(self) -> DataFrame:
        rows = self._read("index")
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, filename string, page_count long, status string, created_at timestamp, output_ready boolean")
        return rows.orderBy(F.desc("created_at"), "doc_id")

    def get_document(self, doc_id: int) -> DataFrame:
        return self._of("index", doc_id)

    def get_layout(self, doc_id: int) -> DataFrame:
        return self._of("layout", doc_id).orderBy("place")

    def get_result(self, doc_id: int) -> DataFrame:
        return self._of("results", doc_id).orderBy("place")

    def delete_documents(self, ids: DataFrame) -> None:
        """Takes documents out of the index first, then out of the other tables."""
        for name in ("index", "layout", "results"):
            if self._runs(name):
                self._put(name, ids, None)

    # ---- translation

    def translate(self, translator: M.Translator, retries: int = 2, ids: DataFrame | None = None, fallback: M.Translator | None = None) -> None:
        """Translates documents that have no results yet, or those of ids anew: every block that goes, in stages; others are passed through. Blocks that
        were edited by hand keep their text."""
        layout, before = self._read("layout"), self._read("results")
        if layout is None:
            return
        if ids is not None:
            layout = layout.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        elif before is not None:
            layout = layout.join(before.select("doc_id").distinct(), "doc_id", "left_anti")
        edited = None if before is None else before.where("edited").select("doc_id", "source_id", F.col("translated").alias("__by_hand"))
        asked = layout if edited is None else layout.join(edited.drop("__by_hand"), ["doc_id", "source_id"], "left_anti")
        done = flow.translated(asked, translator, fallback, retries=retries, folder=self._at("replies")).withColumn("edited", F.lit(False))
        if edited is not None:
            kept = layout.join(edited, ["doc_id", "source_id"]).select(*[F.col(c) for c in layout.columns], F.col("__by_hand").alias("translated"), F.lit(None).cast("string").alias("error"), F.lit("none").alias("stage"), F.lit(0).alias("attempt"), F.lit(True).alias("edited"))
            done = done.unionByName(kept)
        done = M.stored(done, self._at("replies"))
        of = done.select("doc_id").distinct()
        self._put("results", of, done)
        status = done.groupBy("doc_id").agg(F.bool_or(flow.failed(F.col("translated"))).alias("failed"))
        index = self._read("index").join(status, "doc_id")
        self._put("index", of, index.withColumn("status", F.lit("completed")).withColumn("output_ready", ~F.col("failed")).drop("failed"))

    def retranslate_block(self, doc_id: int, source_id: str, text: str) -> DataFrame:
        """A block's text by hand, in its document's bucket alone, and the document's quality with it."""
        rows = self._of("results", doc_id)
        here = F.col("source_id") == source_id
        rows = rows.withColumn("translated", F.when(here, F.lit(text)).otherwise(F.col("translated"))).withColumn("edited", F.col("edited") | here)
        self._put("results", self.spark.createDataFrame([(doc_id,)], "doc_id long"), rows)
        return self.check(doc_id)

    def check(self, doc_id: int) -> DataFrame:
        """The quality summary of a document."""
        return quality.summary(quality.block_quality(self._of("results", doc_id).withColumn("vision", F.lit(False))))

    def published(self) -> DataFrame:
        """The pages of all results: blocks, stages and digests."""
        return flow.published(self._read("results"))

    def rebuild_layout(self, pages: DataFrame) -> None:
        """Geometry and type of a new parse for results of the same place: all edges within a point, the nearest origin first."""
        edges, kinds = ("x0", "y0", "x1", "y1"), ("type", "translate")
        fresh = parse(pages).select("doc_id", "page", *[F.col(c).alias(f"n_{c}") for c in ("ord", *edges, *kinds)])
        rows = self._read("results")
        if rows is None:
            return
        rows = rows.join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
        met = rows.join(fresh, ["doc_id", "page"]).where(F.greatest(*[F.abs(F.col(e) - F.col(f"n_{e}")) for e in edges]) < 1)
        best = met.groupBy("doc_id", "page", "ord").agg(F.min_by(F.struct(*[f"n_{c}" for c in (*edges, *kinds)]), F.struct(F.abs(F.col("x0") - F.col("n_x0")) + F.abs(F.col("y0") - F.col("n_y0")), F.col("n_ord"))).alias("n"))
        now = rows.join(best, ["doc_id", "page", "ord"], "left")
        now = now.withColumns({c: F.coalesce(F.col(f"n.n_{c}"), F.col(c)) for c in (*edges, *kinds)}).drop("n")
        self._put("results", pages, now)

    # ---- questions

    def chat_context(self, doc_id: int, page: int | None = None, blocks: int = 40, cited: int = 5) -> tuple[str, list[str]]:
        """The first blocks of a document, or of a page, with their translations, and the ids of the first of them."""
        rows = self._of("results", doc_id)
        if page:
            rows = rows.where(F.col("page") == page)
        found = rows.orderBy("place").limit(blocks).select("source_id", "text", "translated").collect()
        return "\n".join(f"{r['source_id']}: {r['text']} → {r['translated']}" for r in found), [r["source_id"] for r in found[:cited]]

    def chat(self, doc_id: int, question: str, model: M.Model, name: str, page: int | None = None) -> dict:
        """A model's answer to a question about a document, with the blocks that it was told."""
        context, cited = self.chat_context(doc_id, page)
        return {"answer": M.chat(model, name, f"{context}\n\n{question}"), "citations": cited}

    # ---- configuration

    def save_config(self, config: dict) -> None:
        """Keeps the configuration of the model, secrets as they are."""
        seq = 1 + len(self._configs())
        self.spark.createDataFrame([(seq, json.dumps(config, ensure_ascii=False))], "seq long, config string").coalesce(1).write.mode("append").parquet(self._at("config"))

    def load_config(self, defaults: dict | None = None) -> dict:
        """What was saved last; what it doesn't say is as in defaults."""
        saved = self._configs()
        return (defaults or {}) | (json.loads(max(saved)[1]) if saved else {})

    def shown_config(self, defaults: dict | None = None) -> dict:
        """The configuration with its secret masked."""
        found = self.load_config(defaults)
        secret = found.get("api_key") or ""
        return found | {"api_key": f"{secret[:4]}****{secret[-4:]}" if len(secret) > 8 else "****"}

    def _configs(self) -> list[tuple[int, str]]:
        try:
            return [(r["seq"], r["config"]) for r in self.spark.read.parquet(self._at("config")).collect()]  # a row for each time it was saved
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
