"""The whole way: build an index from an ontology, and answer batches of queries over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.operators import assemble, hierarchy
from kedrion.operators.drill import DrillConfig, select_seeds
from kedrion.operators.embed import Encoder, query_embeddings, section_embeddings, text_embeddings
from kedrion.operators.expand import ExpandConfig, expand
from kedrion.operators.ingest import load_ontology
from kedrion.operators.score import ScoreConfig, node_scores, top_nodes
from kedrion.session import staged
from kedrion.sources.index_store import Index


def build_index(nodes: DataFrame, edges: DataFrame, encoder: Encoder) -> Index:
    """Nodes and edges as read from the files -> sections and text nodes with texts and vectors."""
    found = load_ontology(nodes, edges)
    texts = staged(found.text_nodes, "build-nodes")
    sections = staged(hierarchy.local_text(found.sections, texts), "build-sections")
    children = staged(found.children, "build-children")
    sections = hierarchy.subtree_text(sections, children)
    return Index(section_embeddings(sections, encoder), children, text_embeddings(texts, encoder), found.edges)


@dataclass(frozen=True)
class Answer:
    """The stages of a batch of queries; every frame is keyed by ``query_id``."""

    seeds: DataFrame
    reached: DataFrame
    traversed: DataFrame
    ranked: DataFrame
    candidates: DataFrame
    context: DataFrame
    documents: DataFrame


@dataclass(frozen=True)
class Engine:
    index: Index
    drill: DrillConfig = field(default_factory=DrillConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    max_graph_depth: int = 3
    max_graph_nodes: int = 200
    top_k_text: int = 20
    top_r: int = 3
    encoder: Encoder | None = None

    def run(self, queries: DataFrame) -> Answer:
        """``queries``: query_id, query, and q_emb (null: similar to nothing); without q_emb the engine's encoder makes it."""
        index = self.index
        if "q_emb" not in queries.columns:
            if self.encoder is None:
                raise ValueError("queries without q_emb need an engine with an encoder")
            queries = staged(query_embeddings(queries, self.encoder), "asked")
        seeds = staged(select_seeds(queries, index.sections, index.children, self.drill, self.top_r), "seeds")
        start = seeds.select("query_id", F.col("section_id").alias("id"), "rank")
        reached, traversed = expand(start, index.edges, ExpandConfig(self.max_graph_depth, self.max_graph_nodes))
        scores = node_scores(reached, queries, index.text_nodes, index.sections, self.score)
        ranked = staged(top_nodes(scores, self.top_k_text), "ranked")
        candidates = assemble.section_candidates(ranked, index.sections, index.text_nodes)
        context = assemble.graph_context(reached, traversed)
        return Answer(seeds, reached, traversed, ranked, candidates, context, assemble.result_documents(queries, ranked, candidates, context))
