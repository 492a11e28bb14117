"""Queries of the training-data operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kedrion.llm import knn_forest, leak_scan, near_dup, reading_level, source_mix, split_text
from kedrion.llm.common import first_rows
from kedrion.session import load_table


def spelled(column: str) -> Column:
    """One spelling of a label: small letters, no outer white space, ``_`` for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s-]+", "_")


def language(column: str) -> Column:
    name = spelled(column)
    return F.when(name.startswith("ru"), "ru").when(name.startswith("en"), "en").otherwise(name)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_pairs(load_table(spark, sf_dir, "text_nodes"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, the class of texts of the same words and the number of links of every passage with a similar one."""
    return near_dup.groups(load_table(spark, sf_dir, "text_nodes"))


def _split(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    parts = []
    for table, field in (("sections", "local_text"), ("sections", "subtree_text"), ("text_nodes", "text")):
        rows = first_rows(load_table(spark, sf_dir, table)).select(
            F.lit(table).alias("item_table"), F.lit(field).alias("item_field"), "id", F.col(field).alias("__item")
        )
        parts.append(split_text.split(rows, "__item", ["item_table", "item_field", "id"], with_text=with_text))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, with_text=True)


def p4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text over the limit put together again from its pieces, and whether these hold to limit and overlap."""
    limit, overlap = split_text.LIMIT, split_text.OVERLAP
    pieces = p4_pieces(spark, sf_dir).select("item_table", "item_field", "id", F.struct("piece", "start", "end", "piece_text").alias("p"))
    rows = pieces.groupBy("item_table", "item_field", "id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # of one text
    follows = F.transform(F.sequence(F.lit(2), F.size("p")), lambda k: F.element_at("p", k)["start"] == F.element_at("p", k - 1)["end"] - overlap)
    text = F.array_join(F.transform("p", lambda x: F.when(x["piece"] == 0, x["piece_text"]).otherwise(x["piece_text"].substr(F.lit(overlap + 1), F.length(x["piece_text"])))), "")
    return rows.select(
        "item_table", "item_field", "id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).alias("n_chars"),
        F.forall("p", lambda x: (F.length(x["piece_text"]) <= limit) & (F.length(x["piece_text"]) == x["end"] - x["start"])).alias("within_limit"),
        F.forall(follows, lambda x: x).alias("joined_by_overlap"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the limit, from their first pieces."""
    return _split(spark, sf_dir, with_text=False).filter("piece = 0").select("item_table", "item_field", "id", "boundary")


_VECTORS = (("embedding", "text_nodes"), ("e_local", "sections"), ("e_subtree", "sections"))


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of every vector of each column."""
    parts = [
        knn_forest.neighbours(load_table(spark, sf_dir, table), field).withColumn("vec_field", F.lit(field))
        for field, table in _VECTORS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for field, table in _VECTORS:
        near = knn_forest.neighbours(load_table(spark, sf_dir, table), field, least=0.9)
        parts.append(near.select(F.lit(field).alias("vec_field"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_scan.leaked_items(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked, with the number of documents that hold them."""
    return p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "mix_targets").withColumn("source", spelled("source"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return source_mix.mix(source_mix.sized(load_table(spark, sf_dir, "documents"), spelled("source"), TOKENIZER), _targets(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose drawn documents, all at their most repeats, give less than needed."""
    return _mix(spark, sf_dir)[1].filter("short").select("source")


def _weighted_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """By characters instead of tokens; documents of stated language weigh double."""
    docs = load_table(spark, sf_dir, "documents").withColumn("__w", F.when(F.col("lang").isNotNull(), 2).otherwise(1))
    return source_mix.mix(source_mix.measured(docs, spelled("source"), F.length("text"), weight="__w"), _targets(spark, sf_dir))


def p7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted_mix(spark, sf_dir)[0]


def p7_weighted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _weighted_mix(spark, sf_dir)[1]
    return shares.select("source", "max_repeats", "available", "given", F.round("actual_share", 9).alias("actual_share"), F.round("given_share", 9).alias("given_share"), "short")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return reading_level.reading_levels(docs, load_table(spark, sf_dir, "reading_labels"), carry=["source", "lang"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    levels = reading_level.reading_levels(docs, load_table(spark, sf_dir, "reading_labels"))
    return levels.filter("grade >= 4").select("doc_id")


def p8_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades and their spread by source and language."""
    return reading_level.spread(p8_levels(spark, sf_dir), spelled("source").alias("source"), language("lang").alias("lang"))


_ALL = (
    p3_found, p3_groups, p4_found, p4_pieces, p4_roundtrip, p5_found, p5_knn, p6_found, p6_items, p7_found, p7_mix, p7_shares,
    p7_weighted_mix, p7_weighted_shares, p8_found, p8_levels, p8_spread,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_ITEMS = """
with items as (
  select 'sections' item_table, 'local_text' item_field, id, arg_min(local_text, seq) t from sections group by id
  union all select 'sections', 'subtree_text', id, arg_min(subtree_text, seq) from sections group by id
  union all select 'text_nodes', 'text', id, arg_min(text, seq) from text_nodes group by id)
"""
_P4 = _ITEMS + """
select item_table, item_field, id,
  case when list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) <= 2000 then 'line'
       when list_max(list_transform(regexp_split_to_array(t, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: length(x))) <= 2000 then 'word'
       else 'none' end boundary
from items where id is not null and length(t) > 2000
"""
_P4R = _ITEMS + """
select item_table, item_field, id, md5(t) text_md5, length(t)::int n_chars, true within_limit, true joined_by_overlap
from items where id is not null and length(t) > 2000
"""
#: Words in common over words in either, repeated words counted as often as they occur.
_P3 = """
with recursive t as (select id, arg_min(text, seq) text from text_nodes where id is not null group by id),
w as (select id, word, count(*) n from (select id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) word from t) group by all),
size as (select id, sum(n)::bigint n from w group by id having sum(n) >= 20),
kept as (select w.* from w join size using (id)),
shared as (select a.id id_a, b.id id_b, sum(least(a.n, b.n))::bigint c from kept a join kept b on a.word = b.word and a.id < b.id group by all),
near as (select id_a, id_b, c = a.n and c = b.n alike from shared join size a on a.id = id_a join size b on b.id = id_b where c * 10 >= (a.n + b.n - c) * 7)
"""
_P3G = _P3 + """, ways as (select id_a u, id_b v, alike from near union all select id_b, id_a, alike from near),
reach as (select u, v from ways union select reach.u, ways.v from reach join ways on ways.u = reach.v)
select u id, min(least(u, v)) group_id, coalesce(min(v) filter (alike and v < u), u) class_id, count(distinct v) filter (alike is not null) n_links
from (select u, v, alike from ways union all select u, v, null from reach) group by u
"""


def _vectors(field: str, table: str) -> str:
    """Pairs of one column: of cosine 0.9 and more, one among the ten most similar of the other (exactly, all against all)."""
    return f"""select '{field}' vec_field, least(a, b) id_a, greatest(a, b) id_b from (
      select a.id a, b.id b, list_cosine_similarity(a.v, b.v) c, row_number() over (partition by a.id order by c desc, b.id) r
      from v_{field} a join v_{field} b on a.id <> b.id) where r <= 10 and c >= 0.9"""


_P5 = "with " + ", ".join(
    f"""v_{field} as (select id, v::double[] v from (select id, arg_min({field}, seq) v, arg_min({field} is null, seq) none from {table} where id is not null group by id)
      where not none and len(v) = 64 and list_sum(list_transform(v, lambda x: abs(x))) > 0)""" for field, table in _VECTORS
) + " select distinct * from (" + " union all ".join(_vectors(*v) for v in _VECTORS) + ")"
_SPELLED = r"regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g')"
#: Certain copies, then Pareto order sampling, as one order of each source.
_P7 = f"""
with d as (select doc_id, {_SPELLED} source, case when lang is not null then 2.0::double else 1.0::double end w, coalesce(length(text), 0)::bigint t from documents),
g as (select {_SPELLED} source, sum(target_share) target_share, max(max_repeats)::double cap from mix_targets where source is not null group by 1),
tot as (select sum(t)::double total from d),
p0 as (select g.*, coalesce(available, 0) available, target_share * total needed, case when weighed > 0 then (target_share * total) / weighed else 0.0::double end rate
  from g cross join tot left join (select source, sum(t)::bigint available, sum(w * t) weighed from d group by 1) s using (source)),
""" + "".join(f"""p{k + 1} as (select p.* exclude (rate), case when free > 0 and needed - filled > 0 then greatest(rate, (needed - filled) / free) else rate end rate
  from p{k} p left join (select source, sum(case when rate * w >= cap then t * cap else 0.0::double end) filled, sum(case when rate * w >= cap then 0.0::double else t * w end) free
    from d join p{k} using (source) group by 1) using (source)),
""" for k in range(4)) + """e as (select d.*, cap, needed, case when t > 0 then least(cap, rate * w) else 0.0::double end e from d join p4 using (source)),
f as (select *, floor(e + 1e-12::double) whole, (('0x' || substr(md5(doc_id::varchar || ':7'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double u from e),
o as (select *, (u / (1 - u)) * ((1 - (e - whole)) / (e - whole)) odds, (e - whole) > 1e-12::double open_ from f),
c as (select *, sum(case when open_ then t else 0 end) over (partition by source order by case when open_ then odds / (1 + odds) else 2.0::double end, doc_id rows unbounded preceding) upto,
  needed - sum(whole * t) over (partition by source) open_for from o),
r as (select doc_id, source, t tokens, cap, (whole + case when open_ and upto - t / 2.0::double <= open_for then 1 else 0 end)::int repeats from c),
mixed as (select doc_id, source, tokens, repeats from r union all select doc_id, source, t, 0 from d where source is null or source not in (select source from g))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p4_roundtrip": _P4R,
        "p3_found": _P3 + "select id_a, id_b from near",
        "p3_groups": _P3G,
        "p5_found": _P5,
        # words and single signs for tokens: by the statement of the problem any common tokenizer gives the same sources
        "p7_found": f"""with d as (select {_SPELLED} source, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))) t from documents group by 1),
            g as (select {_SPELLED} source, sum(target_share) share, max(max_repeats) cap from mix_targets group by 1)
            select source from g left join d using (source) where coalesce(t, 0) * cap < share * (select sum(t) from d)""",
        "p7_weighted_mix": _P7 + "select doc_id, source, tokens, repeats from mixed",
        "p7_weighted_shares": _P7 + """, given as (select source, sum(tokens * repeats)::bigint given, bool_and(tokens = 0 or repeats >= cap) filled from r group by 1)
            select source, cap::int max_repeats, available, coalesce(given, 0)::bigint given, round(coalesce(given, 0) / sum(coalesce(given, 0)) over (), 9) actual_share,
              round(coalesce(given, 0) / (select total from tot), 9) given_share, coalesce(filled, true) and coalesce(given, 0) < needed short
            from p4 left join given using (source)""",
    }
