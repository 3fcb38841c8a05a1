"""One object for building and asking: batches of questions in, ranked contexts or answers out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import tools
from corvane.config import RetrievalConfig
from corvane.models import ChatModel, Embedder, PairScorer, ToolModel, replies
from corvane.operators import bm25, chunking, corrective, fusion, generation, ingest, reranking, vectors
from corvane.operators.durable import cut
from corvane.sources.artifacts import Artifacts


@dataclass(frozen=True)
class Lists:
    """Ranked lists of a set of questions, each first stage at its deepest; any subset and any lesser depth is read off them."""

    depth: int
    dense: DataFrame | None = None
    sparse: DataFrame | None = None

    def cut_to(self, name: str, questions: DataFrame, n: int) -> DataFrame | None:
        found = getattr(self, name)
        return None if found is None or n > self.depth else found.join(questions.select("qid"), "qid", "left_semi").where(F.col("rank") < n)


class Engine:
    """Tables of a configuration and the operators over them.

    chunks (chunk_id, text, source_ids, doc_id) is all it needs; vectors and the
    sparse index are made on first use, or read from artifacts.  embedder makes
    vectors, scorer second scores (None: coverage_scores), model routes, grades,
    rewrites and answers, agent is a model with tools; who isn't given isn't used.
    """

    def __init__(
        self,
        chunks: DataFrame,
        config: RetrievalConfig | None = None,
        *,
        vectors_: DataFrame | None = None,
        index: bm25.Bm25Index | None = None,
        embedder: Embedder | None = None,
        scorer: PairScorer | None = None,
        model: ChatModel | None = None,
        agent: ToolModel | None = None,
        lists: Lists | None = None,
    ):
        self.config = config or RetrievalConfig()
        self.chunks = chunks.select("chunk_id", "text").distinct()
        self.sources = chunks
        self._vectors, self._index = vectors_, index
        self.embedder, self.scorer, self.model, self.agent, self.lists = embedder or vectors.HashEmbedder(), scorer, model, agent, lists

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, folder: str, config: RetrievalConfig | None = None, *, embedder: Embedder | None = None, **plugged: object) -> Engine:
        """From raw blocks (path, content, and `start` and `seq` where a file comes in several rows) to all artifacts."""
        config = config or RetrievalConfig()
        embedder = embedder or vectors.HashEmbedder()
        kept = Artifacts(spark, folder, config)
        order = ["path", *(c for c in ("start", "seq") if c in files.columns), "block_no"]
        parsed = ingest.parse_blocks(files, keep=order[1:-1])
        rows = parsed.select(*order, ingest.source_tag(F.col("path")).alias("source"), "timestamp", ingest.squeeze(F.col("text")).alias("text")).where(F.length("text") >= ingest.LEAST_LENGTH)
        first = ingest.first_of_each(rows, F.lower("text"), order)
        numbered = ingest.numbered(first, order, within=["source"])
        corpus = kept.write("corpus", numbered.select(F.format_string("%s:%05d", "source", "rn").alias("source_id"), "source", "text", "timestamp", *order))
        spans = kept.write("spans", chunking.pseudo_spans(corpus, order=order))
        texts = chunking.document_texts(spans, corpus)
        pieces = chunking.chunk_ids(cut(chunking.recursive_chunks(texts, size=config.chunk_size, overlap=config.chunk_overlap)))
        touched = chunking.provenance(pieces, spans)
        chunks = kept.write("chunks", pieces.join(touched, "chunk_id").select("chunk_id", "text", "source_ids", "doc_id", "start_pos"))
        made = kept.write("vectors", vectors.embed(chunks.select("chunk_id", "text"), embedder))
        index = kept.write_bm25(bm25.build_bm25(chunks))
        return cls(chunks, config, vectors_=made, index=index, embedder=embedder, **plugged)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, config: RetrievalConfig | None = None, **plugged: object) -> Engine:
        config = config or RetrievalConfig()
        kept = Artifacts(spark, folder, config)
        return cls(kept.read("chunks"), config, vectors_=kept.read_vectors(), index=kept.read_bm25(), **plugged)

    def with_config(self, config: RetrievalConfig, *, lists: Lists | None = None) -> Engine:
        """The same tables and models under other settings."""
        return Engine(self.sources, config, vectors_=self.vectors, index=self.index, embedder=self.embedder, scorer=self.scorer, model=self.model, agent=self.agent, lists=lists or self.lists)

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = cut(vectors.embed(self.chunks, self.embedder))
        return self._vectors

    @property
    def size(self) -> int:
        """How many chunks there are."""
        return self.chunks.select("chunk_id").distinct().count()

    @property
    def dimension(self) -> int:
        """The length of the embedder's vectors."""
        return len(self.embedder.encode([""])[0])

    @property
    def index(self) -> bm25.Bm25Index:
        if self._index is None:
            self._index = bm25.build_bm25(self.chunks)
        return self._index

    def _dense(self, questions: DataFrame, n: int) -> DataFrame:
        known = self.lists.cut_to("dense", questions, n) if self.lists else None
        return known if known is not None else vectors.search_vectors(vectors.embed(questions, self.embedder, id_col="qid", text_col="question"), self.vectors, n)

    def _sparse(self, questions: DataFrame, n: int) -> DataFrame:
        known = self.lists.cut_to("sparse", questions, n) if self.lists else None
        return known if known is not None else bm25.search_bm25(self.index, questions, n)

    def prepared(self, questions: DataFrame, depth: int, stages: set[str]) -> Lists:
        """The first stages' lists of these questions, searched once for all that follows."""
        plain = self.with_config(self.config)
        plain.lists = None
        return Lists(depth, cut(plain._dense(questions, depth)) if "dense" in stages else None, cut(plain._sparse(questions, depth)) if "sparse" in stages else None)

    def candidates(self, questions: DataFrame, n: int) -> DataFrame:
        """(qid, chunk_id, score, rank) of the first stage."""
        if self.config.retrieval == "sparse":
            return self._sparse(questions, n)
        if self.config.retrieval == "dense":
            return self._dense(questions, n)
        return fusion.fuse([self._dense(questions, n), self._sparse(questions, n)], n, rrf_k=self.config.rrf_k)

    def dense_top(self, questions: DataFrame) -> DataFrame:
        """(qid, top_score): the best cosine, by which every arm but the corrective one refuses."""
        return vectors.top_scores(self._dense(questions, 1), questions)

    def _gate(self, ranked: DataFrame, questions: DataFrame) -> DataFrame:
        asks = reranking.routed(questions, self.model) if self.config.policy == "llm" and self.model is not None else None
        if self.config.policy == "llm" and asks is None:
            asks = questions.select("qid", F.lit(None).cast("boolean").alias("asks"))
        return reranking.gate(ranked, questions, self.config, asks=asks)

    def _second(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        if self.scorer is not None:
            return reranking.model_scores(pairs, questions, self.chunks, self.scorer)
        return reranking.coverage_scores(pairs, questions, self.index)

    def retrieve(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank, signal) after the gate and the second scorer; k overrides the settings' depth."""
        k = self.config.k if k is None else k
        ranked = cut(self.candidates(questions, k if self.config.policy == "never" else max(self.config.depth, k)))
        if self.config.policy == "never":
            return ranked.withColumn("signal", F.lit("cosine"))
        gated = self._gate(ranked, questions)
        needed = ranked.join(gated.where("rerank"), "qid", "left_semi")
        return reranking.rerank(ranked, gated, self._second(needed, questions), k)

    def corrective(self, questions: DataFrame) -> corrective.Loop:
        """The finished corrective loop: its trace, contexts and calls."""
        config = self.config
        rewrites = config.reformulate and self.model is not None
        asked = cut(questions.select("qid", "question").distinct())
        fixed = self
        if not rewrites and config.retrieval != "hybrid" and self.lists is None:
            fixed = self.with_config(config, lists=self.prepared(asked, config.deepest, {config.retrieval}))
        fresh = self.with_config(config)
        fresh.lists = None

        def candidates(some: DataFrame, n: int) -> DataFrame:
            if not rewrites:
                return fixed.candidates(some, n) if fixed.lists is not None else cut(fixed.candidates(some, n))
            unchanged = (some["qid"] == asked["qid"]) & some["question"].eqNullSafe(asked["question"])
            parts = ((fixed, cut(some.join(asked, unchanged, "left_semi"))), (fresh, cut(some.join(asked, unchanged, "left_anti"))))
            found = [own.candidates(part, n) for own, part in parts if part.limit(1).count()]
            return cut(reduce(DataFrame.unionByName, found) if found else fresh.candidates(some, n))

        says = rewrite = None
        if config.grader == "llm":
            if self.model is None:
                raise ValueError("the grader llm needs a model")
            says = lambda ranked, some: corrective.judged_by(ranked, some, self.chunks, self.model)
        if rewrites:
            rewrite = lambda some, weak: corrective.reformulated(some, weak, self.chunks, self.model)
        return corrective.correct(asked, config, corrective.Steps(candidates, self._gate, self._second, says, rewrite))

    def tool_agent(self, questions: DataFrame) -> tools.AgentRun:
        """Conversations of the agent with its tools about each question."""
        if self.agent is None:
            raise ValueError("the mode agent needs a model with tools")
        search = lambda calls, k: self.retrieve(calls.select(F.col("call").alias("qid"), F.col("query").alias("question")), k).withColumnRenamed("qid", "call")
        return tools.run_agents(questions, self.agent, tools.ToolBox(self.sources, search), most_steps=self.config.tool_steps)

    def contexts(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((qid, chunk_id, score, rank), (qid) of the refused) by the settings' mode."""
        if self.config.mode == "crag":
            found = cut(self.corrective(questions).contexts)
            return found, questions.select("qid").join(found.select("qid").distinct(), "qid", "left_anti")
        return self.retrieve(questions).select("qid", "chunk_id", "score", "rank"), questions.select("qid").limit(0)

    def answer(self, questions: DataFrame, model: ChatModel | None = None, *, expand: bool = True) -> DataFrame:
        """(qid, answer, refused) by mode: the model's answers to prompts of contexts, citations expanded; an agent's last words; a fixed sentence for who is refused."""
        if self.config.mode == "agent":
            return self.tool_agent(questions).answers.select("qid", "answer", F.lit(False).alias("refused"))
        model = model or self.model
        if model is None:
            raise ValueError("answers need a model")
        contexts, refused = self.contexts(questions)
        told = cut(contexts.join(self.chunks, "chunk_id"))
        asked = questions.join(refused, "qid", "left_anti")
        prompts = generation.build_prompts(asked, told.select("qid", "rank", "text"))
        answers = cut(prompts.select("qid", replies(model, F.col("prompt")).alias("answer")))
        if expand:
            answers = generation.expand_citations(answers, told).withColumnRenamed("expanded", "answer")
        return answers.select("qid", "answer", F.lit(False).alias("refused")).unionByName(refused.select("qid", F.lit(generation.REFUSAL).alias("answer"), F.lit(True).alias("refused")))


class Engines:
    """Engines over the same tables by (mode, rerank, retrieval), each made once."""

    def __init__(self, base: Engine):
        self.base, self.made = base, {}

    def get(self, mode: str, rerank: str, retrieval: str) -> Engine:
        key = (mode, rerank, retrieval)
        if key not in self.made:
            self.made[key] = self.base.with_config(self.base.config.with_(mode=mode, rerank=rerank, retrieval=retrieval))
        return self.made[key]
