"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedrion.operators import orphan_refs, tree_paths
from kedrion.plans import reference_queries
from kedrion.session import load_table, staged


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries answered over the index: seeds, expansion, ranking and assembled sections."""
    return reference_queries.full_pipeline(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of edges and text nodes without a live record behind it."""
    edges, nodes = load_table(spark, sf_dir, "edges"), load_table(spark, sf_dir, "text_nodes")
    refs = [
        orphan_refs.Reference("edges", "from_id", edges, "raw_nodes"),
        orphan_refs.Reference("edges", "to_id", edges, "raw_nodes"),
        orphan_refs.Reference("text_nodes", "section_id", nodes, "sections"),
    ]
    parents = {t: load_table(spark, sf_dir, t) for t in ("raw_nodes", "sections")}
    return orphan_refs.orphans(refs, parents)


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing references per table, field, period and reason."""
    return orphan_refs.summary(p1_found(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tree_paths.section_links(load_table(spark, sf_dir, "sections"), load_table(spark, sf_dir, "edges"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on a cycle, without a root, or of a wrong level."""
    return tree_paths.faults(*_links(spark, sf_dir))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and descendants (an interval of the tree's numbers) of every section."""
    return tree_paths.paths(tree_paths.forest(*_links(spark, sf_dir)))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_hierarchy(spark, sf_dir).select("id", "rooted", "root", "depth", "path", "n_descendants")


def p2_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy chain of every section and its place in it."""
    return tree_paths.paths(tree_paths.forest(*_links(spark, sf_dir)), with_path=False).select("id", "chain", "chain_pos")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section with each of its descendants, from the intervals of the chains' numbers."""
    found = tree_paths.paths(tree_paths.forest(*_links(spark, sf_dir)), with_path=False)
    return tree_paths.descendants(staged(found.select("id", "root", "sub_lo", "sub_hi"), "intervals"))


_S = "with recursive s as (select id, arg_min(struct_pack(p := parent_id, l := level, c := children_ids), seq) r from sections where id is not null group by id)"
#: the way up by parent_id until a root, a missing parent or a repeated section
_UP = f"""{_S}, up as (
  select id, id at_, [id] path, false loop from s
  union all
  select up.id, s.r.p, [s.r.p] || path, list_contains(path, s.r.p)
  from up join s on s.id = up.at_ join s q on q.id = s.r.p where not loop),
tip as (select id, arg_max(struct_pack(a := at_, path := path, loop := loop), len(path)) t from up group by id)"""
_P2 = f"""{_UP}, link as (
  select distinct u, v from (
    select r.p u, id v from s union all select id, unnest(r.c) from s
    union all select from_id, to_id from edges where relation_type = 'HAS_SUBSECTION')
  where u in (select id from s) and v in (select id from s)),
reach as (select u, v from link union select reach.u, link.v from reach join link on reach.v = link.u)
select s.id, case when s.id in (select u from reach where u = v) then 'cycle'
  when t.loop or (select r.p from s x where x.id = t.a) is not null then 'rootless' else 'level' end kind
from s join tip using (id)
where s.id in (select u from reach where u = v) or t.loop
  or (select r.p from s x where x.id = t.a) is not null or s.r.l is distinct from len(t.path)
"""
#: the path in the forest: a cycle is cut above its least section
_FOREST = f"""{_UP}, least as (
  select id, t.path path, case when t.loop then list_min(t.path[1:list_position(t.path[2:], t.path[1])]) end m,
    not t.loop and (select r.p from s x where x.id = t.a) is null rooted from tip),
tree as (select id, rooted, case when m is null then path else path[len(path) - list_position(list_reverse(path), m) + 1:] end path from least)"""
_P2P = f"""{_FOREST} select id, rooted, path[1] root, len(path) depth, path,
  (select count(*) - 1 from tree d where list_contains(d.path, tree.id)) n_descendants from tree"""
_P2D = f"{_FOREST} select path[i] id, id descendant from tree, range(1, 1000) g(i) where i < len(path)"
#: the heavy child has the largest subtree, of equals the greatest id; a chain begins at the last node of a path that is none
_CHAINS = f"""{_FOREST}, sized as (select x.id, (select count(*) from tree d where list_contains(d.path, x.id)) n, x.path[-2] up, x.path from tree x),
heavy as (select up, max(struct_pack(n := n, id := id)).id h from sized where up is not null group by up),
lights as (select id, max(i) i from (select id, path, unnest(range(1, len(path) + 1)) i from sized)
  where i = 1 or not exists (select 1 from heavy where heavy.up = path[i - 1] and heavy.h = path[i]) group by id)
"""
_P2C = f"{_CHAINS} select id, path[i] chain, (len(path) - i)::int chain_pos from sized join lights using (id)"
#: numbers go down the heavy child first, then down the others in the order of their ids
_P2H = f"""{_CHAINS}, places as (select x.id, row_number() over (partition by up order by heavy.h is not distinct from x.id desc, x.id) o from sized x left join heavy using (up)),
way as (select x.id, list(o order by i) k from (select id, unnest(path) p, unnest(range(1, len(path) + 1)) i from sized) x join places on places.id = x.p group by 1),
numbered as (select id, row_number() over (partition by path[1] order by k) - 1 lo from sized join way using (id))
select id, up parent, path[1] root, rooted, len(path)::int depth, path[i] chain, (len(path) - i)::int chain_pos, n - 1 n_descendants, lo sub_lo, lo + n - 1 sub_hi, path
from sized join lights using (id) join numbered using (id) join (select id, rooted from tree) using (id)"""

_P1 = """
with parent as (
  select 'raw_nodes' p, id, min(case when removed_at is null then loaded_at end) since from raw_nodes group by id
  union all select 'sections', id, min(case when removed_at is null then loaded_at end) from sections group by id),
refs as (
  select 'edges' ref_table, 'from_id' ref_field, seq, from_id k, loaded_at, 'raw_nodes' p from edges
  union all select 'edges', 'to_id', seq, to_id, loaded_at, 'raw_nodes' from edges
  union all select 'text_nodes', 'section_id', seq, section_id, loaded_at, 'sections' from text_nodes)
select ref_table, ref_field, seq, strftime(loaded_at, '%Y-%m') period,
  case when id is null then 'missing' when since is null then 'removed' else 'late' end reason
from refs r left join parent on parent.p = r.p and parent.id = r.k
where k is not null and (id is null or since is null or since > loaded_at)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p1_found, p1_summary, p2_found, p2_hierarchy, p2_paths, p2_chains, p2_descendants)}
    return {**own, **reference_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {
        **reference_queries.oracle_sql(),
        "p1_found": _P1,
        "p2_found": _P2,
        "p2_paths": _P2P,
        "p2_chains": _P2C,
        "p2_hierarchy": _P2H,
        "p2_descendants": _P2D,
        "p1_summary": f"select ref_table, ref_field, period, reason, count(*) n_refs from ({_P1}) group by all",
    }
