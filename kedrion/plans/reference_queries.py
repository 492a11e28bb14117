"""Queries of the ontology operators over the given tables, and the DuckDB SQL of each.

The node file is the rows of ``raw_nodes`` that stand; the index is ``sections`` and ``text_nodes`` (rows that
stand) with ``edges``.  Long texts are compared by md5 and length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedrion.functions.text import SPACE
from kedrion.functions.vectors import nearest
from kedrion.operators import assemble, hierarchy, ingest, quality
from kedrion.operators.drill import DrillConfig, child_scores, decide, root_ranking, select_seeds
from kedrion.operators.embed import HashingEncoder, query_embeddings, section_embeddings, text_embeddings
from kedrion.operators.expand import ALLOWED_RELATIONS, ExpandConfig, expand
from kedrion.operators.expand import khop as khop_
from kedrion.operators.score import ScoreConfig, node_scores, top_nodes
from kedrion.plans.pipeline import Engine
from kedrion.session import load_table, shared_path, staged
from kedrion.sources.index_store import Index, load_index, save_index, saved_facts
from kedrion.sources.json_ontology import live, read_edges, read_nodes
from kedrion.sources.tables import index_of, texts_of, tree_of

NO_BUDGET = 1 << 30
#: Thresholds under which the chained queries descend several levels and find many seeds.
WIDE = DrillConfig(tau_local=0.15, tau_child=0.1, margin=0.1, top_k=2)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return live(load_table(spark, sf, "raw_nodes")).select("seq", "id", "type", "text", "attributes")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "edges").select("seq", "from_id", "to_id", "relation_type")


def _index(spark: SparkSession, sf: str) -> Index:
    return index_of(load_table(spark, sf, "sections"), load_table(spark, sf, "text_nodes"), load_table(spark, sf, "edges"))


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tree_of(load_table(spark, sf, "sections"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return texts_of(load_table(spark, sf, "text_nodes"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "queries")


def _digest(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], F.md5(F.col(column).cast("binary")).alias(f"{column}_md5"), F.length(column).alias(f"{column}_len"))


# --- scans ---------------------------------------------------------------------------------------


def node_kinds(spark, sf):
    return ingest.node_kinds(_nodes(spark, sf))


def section_scan(spark, sf):
    return ingest.section_scan(_nodes(spark, sf))


def figure_scan(spark, sf):
    return ingest.figure_scan(_nodes(spark, sf)).select("seq", "id")


def chunk_scan(spark, sf):
    return ingest.chunk_scan(_nodes(spark, sf))


def page_number_filter(spark, sf):
    return ingest.page_number_chunks(_nodes(spark, sf))


def edge_scan(spark, sf):
    return ingest.adjacency(_edges(spark, sf))


# --- graph ---------------------------------------------------------------------------------------


def section_links(spark, sf):
    return ingest.section_links(ingest.section_scan(_nodes(spark, sf)), _edges(spark, sf))[0]


def section_children(spark, sf):
    return ingest.section_links(ingest.section_scan(_nodes(spark, sf)), _edges(spark, sf))[1]


def chunk_links(spark, sf):
    nodes = _nodes(spark, sf)
    return ingest.chunk_links(ingest.chunk_scan(nodes), ingest.section_scan(nodes), _edges(spark, sf)).select("seq", "id", "section_id")


def caption_retype(spark, sf):
    return ingest.caption_retype(ingest.chunk_scan(_nodes(spark, sf)), _edges(spark, sf)).select("id", "node_type")


def _digests(part: str, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    detail = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return rows.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), F.md5(detail.cast("binary")).alias("detail"))


def load_ontology(spark, sf):
    """Every row of every part of the loaded ontology, as a digest of its contents."""
    found = ingest.load_ontology(_nodes(spark, sf), _edges(spark, sf))
    sections = _digests("sections", found.sections, "id", "seq", "level", "parent_id")
    children = _digests("children", found.children, "parent_id", "child_id", "child_ord")
    texts = _digests("text_nodes", found.text_nodes, "id", "seq", "section_id", "node_type", "text")
    edges = _digests("edges", found.edges, "seq", "from_id", "to_id", "relation_type")
    return sections.unionByName(children).unionByName(texts).unionByName(edges)


# --- files ---------------------------------------------------------------------------------------


def _file_of_nodes(spark, sf):
    """The nodes written to JSON Lines in their order, and read again."""
    path = shared_path(spark, "nodes") + ".jsonl"
    item = F.to_json(F.struct("id", "type", "text", F.try_parse_json("attributes").alias("attributes")))
    _nodes(spark, sf).orderBy("seq").select(item.alias("value")).write.text(path)
    return staged(read_nodes(spark, path), "file-nodes")


def file_chunks(spark, sf):
    return ingest.chunk_scan(_file_of_nodes(spark, sf)).select("id", "text")


def file_sections(spark, sf):
    return ingest.section_scan(_file_of_nodes(spark, sf)).select("id", "level")


def file_edges(spark, sf):
    """Edges written to a file and read again, with their place among those of their source."""
    path = shared_path(spark, "edges") + ".jsonl"
    item = F.to_json(F.struct(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("relation_type").alias("type")))
    _edges(spark, sf).orderBy("seq").select(item.alias("value")).write.text(path)
    return ingest.adjacency(staged(read_edges(spark, path), "file-edges")).drop("seq")


def index_roundtrip(spark, sf):
    """The index saved, loaded again and checked against its stated dimension."""
    folder = shared_path(spark, "index")
    save_index(_index(spark, sf), folder, "given")
    found = load_index(spark, folder)
    sections = found.sections.withColumn("dim", F.size("e_subtree")).withColumn("l", F.size("e_local"))
    texts = found.text_nodes.withColumn("dim", F.size("embedding"))
    rows = _digests("sections", sections, "id", "seq", "level", "parent_id", "local_text", "subtree_text", "l", "dim")
    rows = rows.unionByName(_digests("text_nodes", texts, "id", "seq", "section_id", "node_type", "text", "dim"))
    return rows.unionByName(_digests("children", found.children, "parent_id", "child_id", "child_ord")).unionByName(_digests("edges", found.edges, "seq", "from_id", "to_id", "relation_type"))


def index_facts(spark, sf):
    """Dimension and encoder of a saved index, as read again."""
    folder = shared_path(spark, "index")
    save_index(_index(spark, sf), folder, "given")
    return spark.createDataFrame([saved_facts(spark, folder)], "dim int, encoder string")


# --- hierarchy -----------------------------------------------------------------------------------


def _ontology(spark, sf):
    found = ingest.load_ontology(_nodes(spark, sf), _edges(spark, sf))
    return staged(hierarchy.local_text(found.sections, found.text_nodes), "sections"), staged(found.children, "children")


def local_text(spark, sf):
    found = ingest.load_ontology(_nodes(spark, sf), _edges(spark, sf))
    return _digest(hierarchy.local_text(found.sections, found.text_nodes).select("id", "local_text"), "local_text")


def subtree_text(spark, sf):
    return _digest(hierarchy.subtree_text(*_ontology(spark, sf)).select("id", "subtree_text"), "subtree_text")


def roots(spark, sf):
    return hierarchy.root_sections(ingest.section_scan(_nodes(spark, sf))).select("seq", "id")


def section_path(spark, sf):
    links = ingest.section_links(ingest.section_scan(_nodes(spark, sf)), _edges(spark, sf))[0]
    return hierarchy.section_paths(staged(links, "links"))


# --- embeddings ----------------------------------------------------------------------------------


def _components(df: DataFrame, vector: str) -> DataFrame:
    rows = df.select("id", F.posexplode(vector).alias("component", "value"))
    return rows.filter("value <> 0").select("id", "component", F.col("value").cast("double").alias("value"))


def text_embedding(spark, sf):
    nodes = _texts(spark, sf).drop("embedding")
    return _components(text_embeddings(nodes, HashingEncoder()), "embedding")


def section_embedding(spark, sf):
    sections = _tree(spark, sf)[0].drop("e_local", "e_subtree")
    rows = section_embeddings(sections, HashingEncoder())
    both = [_components(rows, v).withColumn("vector", F.lit(v)) for v in ("e_local", "e_subtree")]
    return both[0].unionByName(both[1])


def query_embedding(spark, sf):
    """Queries by the encoder of the texts; blank ones are similar to nothing."""
    rows = query_embeddings(_queries(spark, sf).select(F.col("query_id").alias("id"), "query"), HashingEncoder())
    return _components(rows, "q_emb")


# --- similarity and drill ------------------------------------------------------------------------


def vector_topk(spark, sf):
    """The 10 text nodes most similar to every query."""
    nodes = _texts(spark, sf).select("id", "seq", F.col("embedding").alias("vector"))
    return nearest(_queries(spark, sf), nodes, 10).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


def embeddings_topk(spark, sf):
    """The 20 vectors most similar to every query, over ``embeddings``."""
    rows = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    return nearest(_queries(spark, sf), rows, 20).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"), "rank")


def root_rank(spark, sf):
    return root_ranking(_queries(spark, sf), _tree(spark, sf)[0], 3).withColumn("sim", F.round("sim", 6))


def _frontier(spark, sf):
    queries = _queries(spark, sf)
    sections, children = (staged(t, "tree") for t in _tree(spark, sf))
    return staged(root_ranking(queries, sections, 3).select("query_id", "section_id"), "roots"), queries, sections, children


def child_score(spark, sf):
    """Children of the best roots of every query."""
    return child_scores(*_frontier(spark, sf)).withColumn("sim", F.round("sim", 6))


def drill_decisions(spark, sf):
    """What becomes of the best roots of every query."""
    decided, _ = decide(*_frontier(spark, sf), DrillConfig())
    return decided.select("query_id", "section_id", "blank", F.round("best", 6).alias("best"), F.round("local", 6).alias("local"), "outcome")


def seeds(spark, sf):
    return select_seeds(_queries(spark, sf), *_tree(spark, sf)).select("query_id", "section_id")


# --- expansion -----------------------------------------------------------------------------------


def _starts(spark, sf, sections=None):
    """The best roots of every query, as seeds of the walks."""
    return root_ranking(_queries(spark, sf), sections or _tree(spark, sf)[0], 3).select("query_id", F.col("section_id").alias("id"), "rank")


def bfs_nodes(spark, sf):
    return expand(_starts(spark, sf), _edges(spark, sf), ExpandConfig(3, NO_BUDGET))[0].select("query_id", "id", "dist")


def bfs_edges(spark, sf):
    return expand(_starts(spark, sf), _edges(spark, sf), ExpandConfig(3, NO_BUDGET))[1].select("query_id", "seq", "from_id", "to_id", "relation_type")


def bfs_budget(spark, sf):
    return expand(_starts(spark, sf), _edges(spark, sf), ExpandConfig(3, 200))[0]


def bfs_budget_edges(spark, sf):
    return expand(_starts(spark, sf), _edges(spark, sf), ExpandConfig(3, 200))[1].select("query_id", "seq", "ord")


def khop(spark, sf):
    """Nodes within two edges of any type of the first section."""
    first = _tree(spark, sf)[0].select("id", "seq").orderBy("seq").limit(1)
    return khop_(first, _edges(spark, sf), 2)


# --- score and assembly --------------------------------------------------------------------------


def _scored(spark, sf):
    index = _index(spark, sf)
    reached, traversed = expand(_starts(spark, sf, index.sections), index.edges, ExpandConfig(3, 200))
    return index, reached, traversed, node_scores(reached, _queries(spark, sf), index.text_nodes, index.sections, ScoreConfig())


def node_score(spark, sf):
    return _scored(spark, sf)[3].select("query_id", "node_id", "section_id", "node_type", "dist", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"))


def topk_nodes(spark, sf):
    return top_nodes(_scored(spark, sf)[3], 20).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


def section_text(spark, sf):
    return _digest(assemble.section_texts(_texts(spark, sf)), "text")


def section_candidates(spark, sf):
    index, _, _, scores = _scored(spark, sf)
    found = assemble.section_candidates(top_nodes(scores, 20), index.sections, index.text_nodes)
    return _digest(found.withColumn("score", F.round("score", 6)), "text")


def graph_context(spark, sf):
    """Nodes and edges of the walk of every query, in their order."""
    found = assemble.graph_context(*expand(_starts(spark, sf), _edges(spark, sf), ExpandConfig(3, 200)))
    return found.select("query_id", F.array_join("nodes", ",").alias("nodes"), F.size("edges").alias("n_edges"), F.array_join(F.transform("edges", lambda e: F.concat(e["from"], F.lit(">"), e["to"])), ",").alias("edges"))


def full_pipeline(spark, sf):
    """The result document of every query."""
    index = _index(spark, sf)
    kept = Index(*[staged(getattr(index, t), t) for t in ("sections", "children", "text_nodes", "edges")])
    return Engine(kept).run(_queries(spark, sf)).documents


def _answer(spark, sf):
    index = _index(spark, sf)
    kept = Index(*[staged(getattr(index, t), t) for t in ("sections", "children", "text_nodes", "edges")])
    return Engine(kept, drill=WIDE).run(_queries(spark, sf))


def seed_ranks(spark, sf):
    return _answer(spark, sf).seeds


def pipeline_nodes(spark, sf):
    """Ranked text nodes of the whole chain: seeds, expansion, scores."""
    return _answer(spark, sf).ranked.select("query_id", "rank", "node_id", "section_id", "node_type", F.round("score", 6).alias("score"))


def pipeline_documents(spark, sf):
    """The result document of every query, flattened."""
    docs = _answer(spark, sf).documents

    def listed(items: str, field: str) -> F.Column:
        return F.array_join(F.transform(items, lambda x: x[field]), "|")

    return docs.select(
        "query_id", "query", listed("section_candidates", "section_id").alias("sections"), F.md5(listed("section_candidates", "text").cast("binary")).alias("texts_md5"),
        listed("section_candidates", "title").alias("titles"), listed("text_nodes", "node_id").alias("text_nodes"), F.array_join("graph_context.nodes", "|").alias("graph_nodes"),
        F.array_join(F.transform("graph_context.edges", lambda e: F.concat(e["from"], F.lit(">"), e["to"], F.lit(":"), e["type"])), "|").alias("graph_edges"),
    )


# --- reports -------------------------------------------------------------------------------------


def level_histogram(spark, sf):
    return quality.level_histogram(ingest.section_scan(_nodes(spark, sf)))


def orphans(spark, sf):
    """Over the links of the odd places only: the table itself has no orphans, so links are taken away."""
    edges = _edges(spark, sf).filter("relation_type <> 'HAS_SUBSECTION' or seq % 2 = 1")
    return quality.orphan_sections(ingest.section_links(ingest.section_scan(_nodes(spark, sf)), edges)[0])


def caption_check(spark, sf):
    texts = ingest.caption_retype(ingest.chunk_scan(_nodes(spark, sf)), _edges(spark, sf))
    return quality.caption_check(texts, _edges(spark, sf))


def raw_levels(spark, sf):
    return quality.raw_section_levels(_nodes(spark, sf))


def phantoms(spark, sf):
    nodes = _nodes(spark, sf)
    return quality.phantom_sections(nodes, ingest.section_scan(nodes))


def embedding_coverage(spark, sf):
    return quality.embedding_coverage(_texts(spark, sf))


def pair_cosine(spark, sf):
    """Cosine of the two ends of every link between text nodes."""
    vectors = _texts(spark, sf).select("id", "embedding")
    pairs = _edges(spark, sf).filter("relation_type = 'LINKS_TO'").select(F.col("from_id").alias("id_a"), F.col("to_id").alias("id_b")).distinct()
    return quality.pair_cosines(pairs, vectors)


_ALL = (
    node_kinds, section_scan, figure_scan, chunk_scan, page_number_filter, edge_scan, section_links, section_children, chunk_links,
    caption_retype, load_ontology, file_chunks, file_sections, file_edges, index_roundtrip, index_facts, local_text, subtree_text, roots, section_path, text_embedding, section_embedding, query_embedding, vector_topk,
    embeddings_topk, root_rank, child_score, drill_decisions, seeds, bfs_nodes, bfs_edges, bfs_budget, bfs_budget_edges, khop,
    node_score, topk_nodes, section_text, section_candidates, graph_context, full_pipeline, seed_ranks, pipeline_nodes, pipeline_documents, level_histogram, orphans,
    caption_check, raw_levels, phantoms, embedding_coverage, pair_cosine,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


# --- SQL -----------------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_ORD = "coalesce(try_cast(case when regexp_full_match({0}, '[+-]?[0-9]+') then {0} end as bigint), 999999)"


def _ordinal(identifier: str) -> str:
    return _ORD.format(_strip(f"string_split({identifier}, 'ch')[2]"))


_LEVEL = f"""case json_type(attributes, '$.level')
  when 'VARCHAR' then case when regexp_full_match({_strip("attributes->>'$.level'")}, '[+-]?[0-9]+') then try_cast({_strip("attributes->>'$.level'")} as int) end
  when 'UBIGINT' then try_cast(attributes->>'$.level' as int) when 'BIGINT' then try_cast(attributes->>'$.level' as int)
  when 'DOUBLE' then try_cast(trunc(try_cast(attributes->>'$.level' as double)) as int)
  when 'BOOLEAN' then (attributes->>'$.level' = 'true')::int end"""
_PAGE = f"coalesce(regexp_full_match({_strip('text')}, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]{{1,3}}'), false)"
_BASE = f"""with recursive n as (select seq, id, type, text, attributes from raw_nodes where removed_at is null),
sec as (select id, min(seq) seq, arg_max(level, seq) "level" from (select seq, id, {_LEVEL} "level" from n where type = 'Section') where "level" is not null group by id),
ch as (select id, min(seq) seq, arg_max(text, seq) text from (select seq, id, coalesce(text, '') text from n where type = 'Chunk' and not {_PAGE}) group by id),
sub as (select seq, from_id, to_id from edges where relation_type = 'HAS_SUBSECTION' and from_id in (select id from sec) and to_id in (select id from sec)),
par as (select to_id id, arg_max(from_id, seq) parent_id from sub group by 1),
kid as (select from_id parent_id, to_id child_id, row_number() over (partition by from_id order by seq)::int child_ord from sub),
own as (select to_id id, arg_max(from_id, seq) section_id from edges where relation_type = 'HAS_CHUNK' and from_id in (select id from sec) and to_id in (select id from ch) group by 1),
loc as (select sec.id, coalesce(max(t), '') local_text from sec left join (select section_id, {_strip("string_agg(text, chr(10) order by seq)")} t from ch join own using (id) group by 1) x on x.section_id = sec.id group by sec.id)
"""
_IX = f"""with recursive s as (select id, min(seq) seq, arg_max(struct_pack(l := "level", p := parent_id, k := children_ids, lt := local_text, st := subtree_text, el := e_local, es := e_subtree), seq) r from sections where removed_at is null group by id),
t as (select id, min(seq) seq, arg_max(struct_pack(s := section_id, k := node_type, x := text, e := embedding), seq) r from text_nodes where removed_at is null group by id),
kids as (select p parent_id, c child_id, o::int child_ord from (select id p, unnest(r.k) c, generate_subscripts(r.k, 1) o from s) where c in (select id from s)),
q as (select query_id, query, q_emb from queries)
"""


def _cos(a: str, b: str) -> str:
    dot = f"list_dot_product({a}::double[], {b}::double[])"
    size = f"(sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])))"
    return f"(case when {a} is null or {b} is null or len({a}) <> len({b}) then -1.0 else case when {size} > 0 then {dot} / {size} else -1.0 end end)"


_ROOTS = f"""{_IX}, rr as (select query_id, id section_id, sim, row_number() over (partition by query_id order by sim desc, seq)::int rank
  from (select query_id, s.id, s.seq, round({_cos("q_emb", "s.r.es")}, 9) sim from q, s where s.r.l = 1) qualify rank <= 3)"""
_BLANK = f"coalesce({_strip('s.r.lt')} = '', true)"


def _decided(pairs: str, cfg: DrillConfig = DrillConfig()) -> str:
    return f"""cs as (select p.query_id, p.section_id, k.child_id, k.child_ord, round({_cos("q.q_emb", "c.r.es")}, 9) sim
    from {pairs} p join kids k on k.parent_id = p.section_id join s c on c.id = k.child_id join q on q.query_id = p.query_id),
  best as (select query_id, section_id, max(sim) best from cs group by 1, 2),
  dec as (select query_id, section_id, blank, best, local,
    case when not blank and local >= best - {cfg.margin} and local >= {cfg.tau_local} then 'seed' when best >= {cfg.tau_child} then 'drill' else 'prune' end outcome
    from (select p.query_id, p.section_id, {_BLANK} blank, coalesce(best, -1.0) best, round({_cos("q.q_emb", "s.r.el")}, 9) "local"
      from {pairs} p join s on s.id = p.section_id join q on q.query_id = p.query_id left join best b on b.query_id = p.query_id and b.section_id = p.section_id))"""


_SEEDS = f"""{_ROOTS}, everyone as (select query_id, s.id section_id from q, s), {_decided("everyone")},
ranked as (select *, row_number() over (partition by query_id, section_id order by sim desc, child_ord) rk from cs),
visit as (select query_id, section_id from rr union
  select v.query_id, r.child_id from visit v join dec d on d.query_id = v.query_id and d.section_id = v.section_id and d.outcome = 'drill'
    join ranked r on r.query_id = v.query_id and r.section_id = v.section_id and r.rk <= 2)
select query_id, section_id from visit join dec using (query_id, section_id) where outcome = 'seed'"""
_ALLOWED = "(" + ", ".join(f"'{r}'" for r in ALLOWED_RELATIONS) + ")"
_E = f"al as (select seq, from_id, to_id, relation_type from edges where relation_type in {_ALLOWED})"
_WALK = f"""{_ROOTS}, {_E}, walk as (select query_id, section_id id, 0 dist from rr
  union select w.query_id, e.to_id, w.dist + 1 from walk w join al e on e.from_id = w.id where w.dist < 3),
near as (select query_id, id, min(dist) dist from walk group by 1, 2)"""


_SEED_RANKS = f"""{_ROOTS}, everyone as (select query_id, s.id section_id from q, s), {_decided("everyone", WIDE)},
ranked as (select *, row_number() over (partition by query_id, section_id order by sim desc, child_ord)::int rk from cs),
visit as (select query_id, section_id, 0 depth, [rank] way, [section_id] trail from rr union all
  select v.query_id, r.child_id, v.depth + 1, list_append(v.way, r.rk), list_append(v.trail, r.child_id) from visit v join dec d on d.query_id = v.query_id and d.section_id = v.section_id and d.outcome = 'drill'
    join ranked r on r.query_id = v.query_id and r.section_id = v.section_id and r.rk <= {WIDE.top_k} where not list_contains(v.trail, r.child_id)),
met as (select query_id, section_id, min(struct_pack(depth := depth, way := way)) f from visit group by 1, 2),
sr as (select query_id, section_id, row_number() over (partition by query_id order by f.depth, f.way)::int rank from met join dec using (query_id, section_id) where outcome = 'seed')"""


def _budget(depth: int, nodes: int, head: str = _ROOTS, starts: str = "rr") -> str:
    """The levels of the bounded walk, one after another."""
    parts = [f"{head}, {_E}, re0 as (select query_id, section_id id, 0 dist, rank::bigint rank from {starts}), fr0 as (select * from re0)"]
    for d in range(depth):
        parts.append(f"""ac{d} as (select f.query_id, f.id, f.rank, {nodes} - h.held "left" from fr{d} f join (select query_id, count(*) held from re{d} group by 1) h using (query_id) where h.held < {nodes}),
st{d} as (select a.query_id, e.*, a.rank from_rank, a.left, a.rank * 1000000000000 + e.seq k from ac{d} a join al e on e.from_id = a.id),
me{d} as (select *, row_number() over (partition by query_id order by k) n from (
  select query_id, to_id id, min(k) k, min("left") "left" from st{d} x where not exists (select 1 from re{d} r where r.query_id = x.query_id and r.id = x.to_id) group by 1, 2) qualify n <= "left"),
em{d} as (select x.query_id, x.seq, x.from_id, x.to_id, {d} depth, x.from_rank from st{d} x left join (select query_id, k stop from me{d} where n = "left") z using (query_id) where stop is null or x.k <= stop),
fr{d + 1} as (select m.query_id, m.id, {d + 1} dist, b.base + m.n rank from me{d} m join (select query_id, max(rank) base from re{d} group by 1) b using (query_id)),
re{d + 1} as (select * from re{d} union all select * from fr{d + 1})""")
    em = " union all ".join(f"select * from em{d}" for d in range(depth))
    parts.append(f"tr as (select *, row_number() over (partition by query_id order by from_rank, seq)::int ord from ({em}))")
    return ", ".join(parts)


_BUDGET = _budget(3, 200)
_SCORED = f"""sc as (select query_id, node_id, seq, section_id, node_type, text, dist, sim, round(
    1.0 * sim + 0.3 * (case node_type when 'list_item' then 1.0 when 'chunk' then 0.6 when 'section_title' then 0.8 when 'caption' then 0.2 else 0.0 end)
    + 0.15 * (case lvl when 1 then 0.1 when 2 then 0.2 when 3 then 0.3 else 0.0 end) - 0.2 * dist, 9) score
  from (select r.query_id, t.id node_id, t.seq, t.r.s section_id, t.r.k node_type, t.r.x text, r.dist, {_cos("q.q_emb", "t.r.e")} sim, coalesce(s.r.l, 1) lvl
    from re3 r join t on t.id = r.id join q on q.query_id = r.query_id left join s on s.id = t.r.s)),
tk as (select *, row_number() over (partition by query_id order by score desc, seq)::int rank from sc qualify rank <= 20)"""
_SCORE = f"{_BUDGET}, {_SCORED}"
_CHAIN = f"{_budget(3, 200, _SEED_RANKS, 'sr')}, {_SCORED}"
_STEXT = f"stx as (select t.r.s section_id, {_strip(f"string_agg(t.r.x, chr(10) order by {_ordinal('t.id')}, t.seq)")} text from t where t.r.s is not null group by 1)"
_CANDIDATES = f"""{_STEXT}, ca as (select query_id, section_id, max(score) score, list(node_id order by rank) node_ids, min(rank) fr from tk where section_id is not null group by 1, 2),
cd as (select query_id, ca.section_id, coalesce({_strip("string_split(s.r.lt, chr(10))[1]")}, '') title, score, node_ids,
  row_number() over (partition by query_id order by score desc, {_ordinal("ca.section_id")}, fr)::int rank, coalesce(text, '') text
  from ca left join s on s.id = ca.section_id left join stx on stx.section_id = ca.section_id)"""


def _detail(*columns: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(({c})::varchar, '~')" for c in columns) + "))"


_HASH = "(('0x' || substr(md5(w), 1, 2))::int % 64)"


def _hashed(rows: str) -> str:
    """Components of the hashing encoder for rows (id, txt)."""
    return f"""select id, b component, (c / sqrt(sum(c * c) over (partition by id)))::float::double "value" from (
      select id, {_HASH}::int b, count(*)::double c from (select id, unnest(string_split(txt, ' ')) w from ({rows})) where w <> '' group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "node_kinds": f"""{_BASE} select type, case type when 'Section' then case when ({_LEVEL}) is not null then 'section' else 'dropped' end
            when 'Figure' then 'figure' when 'Chunk' then case when {_PAGE} then 'dropped' else 'text_node' end else 'dropped' end fate, count(*) n_rows from n group by all""",
        "section_scan": f'{_BASE} select seq, id, "level" from sec',
        "figure_scan": f"{_BASE} select min(seq) seq, id from n where type = 'Figure' group by id",
        "chunk_scan": f"{_BASE} select seq, id, text, 'chunk' node_type from ch",
        "page_number_filter": f"{_BASE} select seq, id, text from n where type = 'Chunk' and {_PAGE}",
        "edge_scan": "select seq, from_id, to_id, relation_type, row_number() over (partition by from_id order by seq)::int adj_ord from edges",
        "section_links": f'{_BASE} select seq, id, "level", parent_id from sec left join par using (id)',
        "section_children": f"{_BASE} select parent_id, child_id, child_ord from kid",
        "chunk_links": f"{_BASE} select seq, id, section_id from ch left join own using (id)",
        "caption_retype": f"{_BASE} select id, case when id in (select from_id from edges where relation_type = 'CAPTIONS') then 'caption' else 'chunk' end node_type from ch",
        "load_ontology": f"""{_BASE} select 'sections' part, id, {_detail("seq", '"level"', "parent_id")} detail from sec left join par using (id)
            union all select 'children', parent_id, {_detail("child_id", "child_ord")} from kid
            union all select 'text_nodes', id, {_detail("seq", "section_id", "case when id in (select from_id from edges where relation_type = 'CAPTIONS') then 'caption' else 'chunk' end", "text")} from ch left join own using (id)
            union all select 'edges', seq::varchar, {_detail("from_id", "to_id", "relation_type")} from edges""",
        "file_chunks": f"{_BASE} select id, text from ch",
        "file_sections": f'{_BASE} select id, "level" from sec',
        "file_edges": "select from_id, to_id, relation_type, row_number() over (partition by from_id order by seq)::int adj_ord from edges",
        "index_roundtrip": f"""{_IX} select 'sections' part, id, {_detail("seq", "r.l", "r.p", "r.lt", "r.st", "len(r.el)", "len(r.es)")} detail from s
            union all select 'text_nodes', id, {_detail("seq", "r.s", "r.k", "r.x", "len(r.e)")} from t
            union all select 'children', parent_id, {_detail("child_id", "child_ord")} from kids
            union all select 'edges', seq::varchar, {_detail("from_id", "to_id", "relation_type")} from edges""",
        "index_facts": f"{_IX} select arg_min(len(r.es), seq)::int dim, 'given' encoder from s where r.es is not null",
        "query_embedding": _hashed("select query_id id, query txt from queries"),
        "local_text": f"{_BASE} select id, md5(local_text) local_text_md5, length(local_text) local_text_len from loc",
        "subtree_text": f"""{_BASE}, lk as (select distinct parent_id u, child_id v from kid),
            reach as (select u, v from lk union select reach.u, lk.v from reach join lk on reach.v = lk.u),
            bad as (select u id from reach where u = v union select r.u from reach r where r.v in (select u from reach where u = v)),
            ways as (select id anc, id des, []::int[] path from sec where id not in (select id from bad)
              union all select w.anc, k.child_id, list_append(w.path, k.child_ord) from ways w join kid k on k.parent_id = w.des),
            txt as (select anc id, {_strip("string_agg(local_text, chr(10) order by path)")} x from ways join loc on loc.id = des where local_text <> '' group by 1)
            select id, md5(z) subtree_text_md5, length(z) subtree_text_len from (select sec.id, case when bad.id is null then coalesce(x, '') end z from sec left join bad on bad.id = sec.id left join txt on txt.id = sec.id)""",
        "roots": f'{_BASE} select seq, id from sec where "level" = 1',
        "section_path": f"""{_BASE}, up as (select id, id at_, [id] path, false loop from sec
              union all select up.id, p.parent_id, [p.parent_id] || path, list_contains(path, p.parent_id) from up join par p on p.id = up.at_ where not loop),
            tip as (select id, arg_max(struct_pack(path := path, loop := loop), len(path)) t from up group by id)
            select id, case when not t.loop then t.path end path from tip""",
        "text_embedding": f"{_IX} {_hashed(f'select id, t.r.x txt from t where {_strip("t.r.x")} <> {chr(39) * 2}')}",
        "section_embedding": f"{_IX} select *, 'e_local' vector from ({_hashed(f'select id, {_strip("s.r.lt")} txt from s')}) union all select *, 'e_subtree' from ({_hashed(f'select id, {_strip("s.r.st")} txt from s')})",
        "vector_topk": f"""{_IX} select query_id, id, round(sim, 6) sim, row_number() over (partition by query_id order by sim desc, seq)::int rank
            from (select query_id, t.id, t.seq, round({_cos("q_emb", "t.r.e")}, 9) sim from q, t) qualify rank <= 10""",
        "embeddings_topk": f"""{_IX} select query_id, vec_id, round(sim, 6) sim, row_number() over (partition by query_id order by sim desc, vec_id)::int rank
            from (select query_id, vec_id, round({_cos("q_emb", "embedding")}, 9) sim from q, embeddings) qualify rank <= 20""",
        "root_rank": f"{_ROOTS} select query_id, section_id, round(sim, 6) sim, rank from rr",
        "child_score": f"{_ROOTS}, {_decided('rr')} select query_id, section_id, child_id, child_ord, round(sim, 6) sim from cs",
        "drill_decisions": f'{_ROOTS}, {_decided("rr")} select query_id, section_id, blank, round(best, 6) best, round("local", 6) "local", outcome from dec',
        "seeds": _SEEDS,
        "bfs_nodes": f"{_WALK} select query_id, id, dist from near",
        "bfs_edges": f"{_WALK} select query_id, e.seq, e.from_id, e.to_id, e.relation_type from near join al e on e.from_id = near.id where dist < 3",
        "bfs_budget": f"{_BUDGET} select query_id, id, dist, rank from re3",
        "bfs_budget_edges": f"{_BUDGET} select query_id, seq, ord from tr",
        "khop": f"""{_IX}, w as (select id, 0 dist from (select id from s order by seq limit 1) union select e.to_id, w.dist + 1 from w join edges e on e.from_id = w.id where w.dist < 2)
            select id, min(dist) dist from w where id is not null group by id""",
        "node_score": f"{_SCORE} select query_id, node_id, section_id, node_type, dist, round(sim, 6) sim, round(score, 6) score from sc",
        "topk_nodes": f"{_SCORE} select query_id, node_id, round(score, 6) score, rank from tk",
        "section_text": f"{_IX}, {_STEXT} select section_id, md5(text) text_md5, length(text) text_len from stx",
        "section_candidates": f"{_SCORE}, {_CANDIDATES} select query_id, section_id, title, round(score, 6) score, node_ids, rank, md5(text) text_md5, length(text) text_len from cd",
        "seed_ranks": f"{_SEED_RANKS} select query_id, section_id, rank from sr",
        "pipeline_nodes": f"{_CHAIN} select query_id, rank, node_id, section_id, node_type, round(score, 6) score from tk",
        "pipeline_documents": f"""{_CHAIN}, {_CANDIDATES} select q.query_id, q.query, coalesce(sections, '') sections, md5(coalesce(texts, '')) texts_md5, coalesce(titles, '') titles,
              coalesce(text_nodes, '') text_nodes, coalesce(graph_nodes, '') graph_nodes, coalesce(graph_edges, '') graph_edges
            from q left join (select query_id, string_agg(section_id, '|' order by rank) sections, string_agg(text, '|' order by rank) texts, string_agg(title, '|' order by rank) titles from cd group by 1) a using (query_id)
            left join (select query_id, string_agg(node_id, '|' order by rank) text_nodes from tk group by 1) b using (query_id)
            left join (select query_id, string_agg(id, '|' order by rank) graph_nodes from re3 group by 1) c using (query_id)
            left join (select query_id, string_agg(tr.from_id || '>' || tr.to_id || ':' || e.relation_type, '|' order by ord) graph_edges from tr join edges e using (seq) group by 1) d using (query_id)""",
        "graph_context": f"""{_BUDGET} select n.query_id, nodes, coalesce(n_edges, 0)::int n_edges, coalesce(edges, '') edges
            from (select query_id, string_agg(id, ',' order by rank) nodes from re3 group by 1) n
            left join (select query_id, count(*) n_edges, string_agg(from_id || '>' || to_id, ',' order by ord) edges from tr group by 1) e using (query_id)""",
        "level_histogram": f'{_BASE} select "level", count(*) n_sections from sec group by 1',
        "orphans": f"""{_BASE}, half as (select to_id id, arg_max(from_id, seq) parent_id from sub where seq % 2 = 1 group by 1)
            select id, "level" from sec left join half using (id) where "level" <> 1 and parent_id is null""",
        "caption_check": f"""{_BASE} select (select count(*) from ch where id in (select from_id from edges where relation_type = 'CAPTIONS')) caption_nodes,
            (select count(*) from edges where relation_type = 'CAPTIONS') caption_edges""",
        "raw_levels": f"{_BASE} select count(*) filter (({_LEVEL}) is not null) with_level, count(*) filter (({_LEVEL}) is null) without_level from n where type = 'Section'",
        "phantoms": f"{_BASE} select id, id in (select id from sec) leaked from n where type = 'Section' group by id having max({_LEVEL}) is null",
        "embedding_coverage": f"""{_IX} select count(*) filter ({_strip("t.r.x")} <> '' and t.r.e is null) text_without_vector,
            count(*) filter (coalesce({_strip("t.r.x")} = '', true) and t.r.e is not null) blank_with_vector from t""",
        "pair_cosine": f"""{_IX} select id_a, id_b, round({_cos("a.r.e", "b.r.e")}, 6) cos from (select distinct from_id id_a, to_id id_b from edges where relation_type = 'LINKS_TO') p
            join t a on a.id = id_a join t b on b.id = id_b""",
    }
