"""The engine's front: build, update and search an index."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..sources import tree
from . import chunking, fusion, graph, prompt, retrieval, sync
from .embed import HashingEmbedder
from .store import Collection, collections, open_collection

log = logging.getLogger("tamarack")


class Index:
    """An index over file trees, in a collection below a path."""

    def __init__(self, spark: SparkSession, base: str, config: Config = Config(), embedder=None, collection: str | None = None):
        self.spark, self.config = spark, config
        self.embedder = embedder or HashingEmbedder(config.dimensions)
        self.collection = Collection(spark, base, collection or config.collection)

    @classmethod
    def open(cls, spark: SparkSession, base: str, collection: str | None = None, config: Config = Config(), embedder=None) -> Index:
        """An existing collection, by default the first; its model and dimension must be the embedder's."""
        found = open_collection(spark, base, collection)
        out = cls(spark, base, config, embedder, found.name)
        dim = found.properties().get("dim")
        if dim is not None and dim != out.embedder.dimensions:
            raise ValueError(f"the collection's vectors have {dim} components, the embedder's {out.embedder.dimensions}")
        return out

    @staticmethod
    def list(spark: SparkSession, base: str) -> list[str]:
        return collections(spark, base)

    def sync(self, root: str, full: bool = False, syntax: bool = True, extensions=None, excluded=None, on_progress=None) -> dict[str, int]:
        """Bring the collection up to the tree's state; counts by action. Nothing is written if nothing changed.

        on_progress(done, total) is called with numbers of files: before they are indexed
        and after; what it raises stops the run, before anything is written or after all is.
        """
        return self.sync_files(tree.with_text(tree.scan(self.spark, root, extensions, excluded, self.config.max_file_bytes)), full, syntax, on_progress)

    def sync_files(self, files: DataFrame, full: bool = False, syntax: bool = True, on_progress=None) -> dict[str, int]:
        """The same from files (source, file_hash, text)."""
        said = on_progress or (lambda done, total: None)
        indexed = self.collection.read("files")
        if full:
            indexed = indexed.limit(0)
        classified = sync.classify(files.select("source", "file_hash"), indexed.select("source", "file_hash")).persist()
        counts = {r.action: r.n for r in sync.summary(classified).collect()}  # four rows
        log.info("changes: %s", counts)
        if counts["add"] + counts["update"] + counts["delete"] == 0 and self.collection.exists():
            return counts
        total = counts["add"] + counts["update"]
        said(0, total)
        changed = classified.where(F.col("action").isin("add", "update")).select("source")
        todo = files.join(changed, "source", "left_semi")
        fresh = self.embedder.add(chunking.records(todo, self.config, syntax), "document", "embedding")
        watch = Observation()
        fresh = fresh.observe(watch, F.count(F.lit(1)).alias("chunks"))  # counted as they are written
        old = self.collection.read("chunks").limit(0) if full else self.collection.read("chunks")
        chunks = sync.merge(old, classified, fresh)
        # The manifest also lists files without chunks, so that they aren't processed again.
        known = classified.where("action <> 'delete'").select("source", "file_hash")

        def manifest(read):
            sizes = read("chunks").groupBy("source").agg(F.count("*").alias("n_chunks"))
            return known.join(sizes, "source", "left").select("source", "file_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))

        self.collection.commit({"chunks": chunks, "files": manifest}, {"dim": self.embedder.dimensions, "embed_model": self.config.embed_model})
        classified.unpersist()
        log.info("%d files gave %s chunks", total, watch.get["chunks"])
        said(total, total)
        return counts

    def search(self, questions: DataFrame | str, k: int | None = None, exact_distinct: bool = False) -> DataFrame:
        """query_id, rank, source, chunk_index, document, distance, score."""
        asked = self._questions(questions)
        queries = self.embedder.add(asked, "text", "embedding")
        hits = retrieval.nearest_sources(self.collection.read("chunks"), queries, k or self.config.top_k, self.config.metric, self.config.overfetch, exact_distinct)
        return retrieval.relative_scores(hits).select("query_id", "rank", "source", "chunk_index", "document", "distance", "score")

    def prompts(self, questions: DataFrame | str, template: str, k: int | None = None) -> DataFrame:
        """query_id, prompt, context, question: ready for an Answerer."""
        asked = self._questions(questions)
        made = prompt.context(self.search(asked, k)).join(asked, "query_id").withColumnRenamed("text", "question")
        return made.withColumn("prompt", prompt.chat_prompt(F.lit(template), F.col("question"), F.col("context")))

    def build_graph(self, files: DataFrame, plugins=None) -> dict[str, int] | None:
        """Extract and store the edges of files (source, text); those of other files stay.

        With a file_hash, files are the whole tree: only those whose hash changed since the
        last time are extracted, edges of files that are gone go, and counts by action are
        returned; nothing is written if nothing changed.
        """
        known = lambda name, schema: self.collection.read(name) if self._has(name) else self.spark.createDataFrame([], schema)
        old = known("edges", graph.EDGES)
        if "file_hash" not in files.columns:
            self.collection.commit({"edges": graph.replace_edges(old, files.select("source"), graph.extract_edges(files, plugins))})
            return None
        classified = sync.classify(files.select("source", "file_hash"), known("edge_files", "source string, file_hash string")).persist()
        counts = {r.action: r.n for r in sync.summary(classified).collect()}  # four rows
        if counts["add"] + counts["update"] + counts["delete"] or not self._has("edges"):
            new = graph.extract_edges(files.join(classified.where(F.col("action").isin("add", "update")).select("source"), "source", "left_semi"), plugins)
            gone = classified.where("action <> 'unchanged'").select("source")
            self.collection.commit({"edges": graph.replace_edges(old, gone, new), "edge_files": classified.where("action <> 'delete'").select("source", "file_hash")})
        classified.unpersist()
        return counts

    def _has(self, table: str) -> bool:
        try:
            self.collection.read(table)
        except FileNotFoundError:
            return False
        return True

    def hybrid_search(self, question: str, k: int | None = None) -> DataFrame:
        """Files by fused score; by vectors alone if the graph is off or can't be read."""
        seeds = self.search(question, k).select(F.col("source").alias("file_path"), F.col("distance").alias("cos_distance"), F.col("document").alias("content_snippet"))
        vector = self.embedder.add(self._questions(question), "text", "embedding").first().embedding  # one question
        cosine = retrieval.distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)), "cosine")
        # Chunks, not files: what the graph reaches is joined before anything is ranked.
        chunks = self.collection.read("chunks").select(F.col("source").alias("file_path"), cosine.alias("cos_distance"), F.col("document").alias("content_snippet"))
        seeds = chunks.join(seeds.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.min("cos_distance").alias("cos_distance"), F.min_by("content_snippet", "cos_distance").alias("content_snippet"))
        return fusion.expand_or_fall_back(seeds, question, lambda: self.collection.read("edges") if self.config.graph else None, chunks, self.config.alpha, self.config.beta, self.config.max_hops)

    def _questions(self, questions: DataFrame | str) -> DataFrame:
        if isinstance(questions, str):
            return self.spark.createDataFrame([(0, prompt.checked_question(questions))], "query_id long, text string")
        return questions.where("trim(text) <> ''").select("query_id", "text")
