"""The golden ontology of FIXTURES.md section 3, at every stage, from the JSON files to the result document."""

import json

import pytest
from pyspark.sql import functions as F

from kedrion.operators import hierarchy, ingest, quality
from kedrion.operators.drill import DrillConfig, select_seeds
from kedrion.operators.embed import DEFAULT_MODEL, HashingEncoder, SentenceEncoder, query_embeddings, text_embeddings
from kedrion.operators.expand import ExpandConfig, expand, khop
from kedrion.operators.score import node_scores, top_nodes
from kedrion.plans import build, cli
from kedrion.plans.pipeline import Engine, build_index
from kedrion.session import staged
from kedrion.sources.index_store import Index, dimension, load_index, save_index, saved_dimension, saved_facts
from kedrion.sources.json_ontology import read_edges, read_nodes

NODES = [
    {"id": "sec_ch1", "type": "Section", "attributes": {"level": 1}},
    {"id": "sec_ch2", "type": "Section", "attributes": {"level": "2"}},
    {"id": "sec_ch3", "type": "Section", "attributes": {"level": 2}},
    {"id": "sec_x", "type": "Section", "attributes": {"level": None}},
    {"id": "sec_bad", "type": "Section", "attributes": {"level": "abc"}},
    {"id": "sec_ch4", "type": "Section", "attributes": {"level": 4}, "unknown": 1},
    {"id": "ch11", "type": "Chunk", "text": "beta"},
    {"id": "ch10", "type": "Chunk", "text": "alpha"},
    {"id": "chunk_ch12", "type": "Chunk", "text": "gamma"},
    {"id": "ch7", "type": "Chunk", "text": " 7 "},
    {"id": "ch1234", "type": "Chunk", "text": "1234"},
    {"id": "ch13", "type": "Chunk", "text": None},
    {"id": "ch14", "type": "Chunk", "text": "delta"},
    {"id": "fig1", "type": "Figure"},
    {"id": "li1", "type": "ListItem", "text": "item"},
    {"id": "url1", "type": "URL"},
]
LINKS = """sec_ch1 HAS_SUBSECTION sec_ch2|sec_ch1 HAS_SUBSECTION sec_ch3|sec_ch2 HAS_SUBSECTION sec_ch4|sec_ch2 HAS_CHUNK ch11
sec_ch2 HAS_CHUNK ch10|sec_ch2 HAS_CHUNK chunk_ch12|sec_ch2 HAS_CHUNK ch7|sec_ch3 HAS_CHUNK ch1234|sec_ch4 HAS_CHUNK ch13
chunk_ch12 CAPTIONS fig1|sec_ch2 HAS_ITEM li1|ch11 LINKS_TO ch14|ch11 MENTIONS ch1234|sec_ch1 HAS_SUBSECTION sec_x|ch10 LINKS_TO sec_ch2"""
VECTORS = {
    "beta": [1.0, 0.0], "alpha": [0.6, 0.8], "gamma": [0.8, 0.6], "1234": [0.0, 1.0], "delta": [0.6, -0.8],
    "beta\nalpha\ngamma": [0.8, 0.6], "beta\nalpha\ngamma\n1234": [0.6, 0.8],
}


def stub(vectors):
    class Stub:  # local: pickled by value
        dim = 2

        def encode(self, texts):
            return [vectors[t] for t in texts]

    return Stub()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    edges = [dict(zip(("source", "type", "target"), e.split())) for e in LINKS.replace("\n", "|").split("|")]
    (folder / "nodes.json").write_text(json.dumps(NODES, ensure_ascii=False))
    (folder / "edges.json").write_text(json.dumps(edges))
    return staged(read_nodes(spark, f"file://{folder}/nodes.json")), staged(read_edges(spark, f"file://{folder}/edges.json"))


@pytest.fixture(scope="module")
def index(files):
    built = build_index(*files, stub(VECTORS))
    return Index(*[staged(getattr(built, t)) for t in ("sections", "children", "text_nodes", "edges")])


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([("q", "вопрос", [1.0, 0.0])], "query_id string, query string, q_emb array<float>")


def test_scans(files):
    nodes, edges = files
    assert [r.seq for r in nodes.orderBy("seq").collect()] == list(range(16)) and edges.count() == 15
    assert {(r.id, r.level) for r in ingest.section_scan(nodes).collect()} == {("sec_ch1", 1), ("sec_ch2", 2), ("sec_ch3", 2), ("sec_ch4", 4)}
    assert {r.id for r in ingest.chunk_scan(nodes).collect()} == {"ch11", "ch10", "chunk_ch12", "ch1234", "ch13", "ch14"}
    assert {r.id for r in ingest.page_number_chunks(nodes).collect()} == {"ch7"} and {r.id for r in ingest.figure_scan(nodes).collect()} == {"fig1"}
    report = quality.raw_section_levels(nodes).first()
    assert (report.with_level, report.without_level) == (4, 2)


def test_links_and_texts(files, index):
    nodes, edges = files
    texts = {r.id: r for r in index.text_nodes.collect()}
    assert {i: r.section_id for i, r in texts.items()} == {"ch11": "sec_ch2", "ch10": "sec_ch2", "chunk_ch12": "sec_ch2", "ch1234": "sec_ch3", "ch13": "sec_ch4", "ch14": None}
    assert {i for i, r in texts.items() if r.node_type == "caption"} == {"chunk_ch12"} and texts["ch13"].text == "" and texts["ch13"].embedding is None
    assert sorted((r.parent_id, r.child_ord, r.child_id) for r in index.children.collect()) == [("sec_ch1", 1, "sec_ch2"), ("sec_ch1", 2, "sec_ch3"), ("sec_ch2", 1, "sec_ch4")]
    own = {r.id: (r.local_text, r.subtree_text) for r in index.sections.collect()}
    three = "beta\nalpha\ngamma"
    assert own == {"sec_ch1": ("", three + "\n1234"), "sec_ch2": (three, three), "sec_ch3": ("1234", "1234"), "sec_ch4": ("", "")}
    paths = {r.id: r.path for r in hierarchy.section_paths(index.sections).collect()}
    assert paths["sec_ch4"] == ["sec_ch1", "sec_ch2", "sec_ch4"]
    assert quality.orphan_sections(index.sections).count() == 0 and quality.caption_check(index.text_nodes, edges).first().caption_nodes == 1


def test_drill(index, query):
    assert [r.section_id for r in select_seeds(query, index.sections, index.children).collect()] == ["sec_ch2"]
    strict = DrillConfig(tau_child=0.9)
    assert select_seeds(query, index.sections, index.children, strict).count() == 0


@pytest.mark.parametrize(
    "cfg,nodes,edges",
    [
        (ExpandConfig(3, 200), "sec_ch2 sec_ch4 ch11 ch10 chunk_ch12 ch7 li1 ch13 ch14 fig1", [2, 3, 4, 5, 6, 10, 8, 11, 14, 9]),
        (ExpandConfig(1, 200), "sec_ch2 sec_ch4 ch11 ch10 chunk_ch12 ch7 li1", [2, 3, 4, 5, 6, 10]),
        (ExpandConfig(3, 4), "sec_ch2 sec_ch4 ch11 ch10", [2, 3, 4]),
        (ExpandConfig(3, 7), "sec_ch2 sec_ch4 ch11 ch10 chunk_ch12 ch7 li1", [2, 3, 4, 5, 6, 10]),
        (ExpandConfig(3, 1), "sec_ch2", []),
    ],
)
def test_expand(spark, files, cfg, nodes, edges):
    seeds = spark.createDataFrame([("q", "sec_ch2", 1)], "query_id string, id string, rank int")
    reached, traversed = expand(seeds, files[1], cfg)
    assert [r.id for r in reached.orderBy("rank").collect()] == nodes.split()
    assert [r.seq for r in traversed.orderBy("ord").collect()] == edges
    if cfg == ExpandConfig(3, 200):
        assert {r.id: r.dist for r in reached.collect()}["fig1"] == 2
        assert {r.id for r in khop(seeds.select("id"), files[1], 2).collect()} == set(nodes.split()) | {"ch1234"}


def test_scores_and_documents(index, query):
    answer = Engine(index).run(query)
    got = {r.node_id: r.score for r in answer.ranked.collect()}
    assert got == pytest.approx({"ch11": 1.01, "chunk_ch12": 0.69, "ch10": 0.61, "ch14": 0.395, "ch13": -1.22}, abs=1e-6)
    doc = answer.documents.first().asDict(True)
    assert doc["section_candidates"] == [
        {"section_id": "sec_ch2", "title": "beta", "text": "alpha\nbeta\ngamma", "score": pytest.approx(1.01, abs=1e-6), "node_ids": ["ch11", "chunk_ch12", "ch10"]},
        {"section_id": "sec_ch4", "title": "", "text": "", "score": pytest.approx(-1.22, abs=1e-6), "node_ids": ["ch13"]},
    ]
    assert [n["node_id"] for n in doc["text_nodes"]] == ["ch11", "chunk_ch12", "ch10", "ch14", "ch13"] and doc["text_nodes"][3]["section_id"] is None
    assert len(doc["graph_context"]["edges"]) == 10 and doc["graph_context"]["edges"][0] == {"from": "sec_ch2", "to": "sec_ch4", "type": "HAS_SUBSECTION"}


def test_queries_without_vector_or_seed(spark, index):
    rows = spark.createDataFrame([("n", None, None), ("z", "", [0.0, 0.0]), ("q", "да", [1.0, 0.0])], "query_id string, query string, q_emb array<float>")
    docs = {r.query_id: r for r in Engine(index).run(rows).documents.collect()}
    assert set(docs) == {"n", "z", "q"} and docs["n"].section_candidates == [] and docs["n"].graph_context.nodes == [] and len(docs["q"].text_nodes) == 5


def test_store_and_cli(spark, index, tmp_path):
    assert save_index(index, f"file://{tmp_path}/ix") == 2 == saved_dimension(spark, f"file://{tmp_path}/ix")
    again = load_index(spark, f"file://{tmp_path}/ix")
    assert sorted(again.edges.collect()) == sorted(index.edges.collect()) and dimension(again.sections) == 2
    with pytest.raises(RuntimeError):
        save_index(Index(index.sections.withColumn("e_subtree", F.lit(None).cast("array<float>")), *[getattr(index, t) for t in ("children", "text_nodes", "edges")]), f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    assert list(cli.asked([" a \n", "\n", "QUIT", "b"])) == ["a", ""]


def test_build_load_and_ask_by_one_encoder(spark, files, tmp_path):
    """From the two files to an answer; another encoder, or vectors of another dimension, are refused."""
    lines = tmp_path / "edges.jsonl"
    lines.write_text("\n".join(json.dumps(dict(zip(("source", "type", "target"), e.split()))) for e in LINKS.replace("\n", "|").split("|")))
    (tmp_path / "nodes.json").write_text(json.dumps(NODES, ensure_ascii=False))
    folder = f"file://{tmp_path}/ix"
    assert build.build(spark, f"file://{tmp_path}/nodes.json", f"file://{lines}", folder, HashingEncoder(32)) == 32
    assert saved_facts(spark, folder) == (32, "hashing-32")
    engine = cli.opened(spark, folder)
    assert engine.encoder.dim == 32 and engine.max_graph_nodes == 800
    out = json.loads(cli.answer(spark, engine, "beta\nalpha\ngamma"))
    assert set(out) == {"query", "section_candidates"} and out["section_candidates"][0]["section_id"] == "sec_ch2"
    for wrong in (HashingEncoder(), SentenceEncoder(dim=32)):
        with pytest.raises(ValueError):
            cli.opened(spark, folder, wrong)
    with pytest.raises(ValueError):
        Engine(load_index(spark, folder)).run(spark.createDataFrame([("q", "x")], "query_id string, query string"))


def test_json_lines_keep_their_order_over_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / "n.jsonl").mkdir(exist_ok=True)
        (tmp_path / "n.jsonl" / f"part-{part}.json").write_text("".join(json.dumps({"id": f"{part}-{k:04d}", "type": "Chunk", "text": "ы" * (k % 50), "x": k}) + "\n" for k in range(1500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_nodes(spark, f"file://{tmp_path}/n.jsonl")
        assert rows.rdd.getNumPartitions() > 4
        got = [r.id for r in rows.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(got) and len(got) == 4500


def test_sentence_encoder_with_a_stand_in_model(spark, tmp_path):
    (tmp_path / "sentence_transformers.py").write_text(
        "import numpy as np\n"
        "class SentenceTransformer:\n"
        "    def __init__(self, name, device=None):\n"
        "        self.name = name\n"
        "    def encode(self, texts, normalize_embeddings):\n"
        "        assert all(t for t in texts) and normalize_embeddings\n"
        "        return np.array([[len(t), 0.0, 0.0] for t in texts]) / np.array([[max(1, len(t))] for t in texts])\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    encoder = SentenceEncoder(dim=3)
    assert encoder.name == DEFAULT_MODEL
    rows = query_embeddings(spark.createDataFrame([("q", None), ("r", "слово")], "query_id string, query string"), encoder)
    assert {r.query_id: list(r.q_emb) for r in rows.collect()} == {"q": [1.0, 0.0, 0.0], "r": [1.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="dimensions"):
        query_embeddings(spark.createDataFrame([("r", "слово")], "query_id string, query string"), SentenceEncoder()).collect()


def test_encoders(spark):
    texts = spark.createDataFrame([(0, "a", " x y x "), (1, "b", " "), (2, "c", None), (3, "d", "слово")], "seq bigint, id string, text string")
    got = {r.id: r.embedding for r in text_embeddings(texts, HashingEncoder()).collect()}
    assert got["b"] is None and got["c"] is None and len(got["a"]) == 64 and abs(sum(v * v for v in got["d"]) - 1) < 1e-6
    rows = query_embeddings(spark.createDataFrame([("q", None), ("r", "слово")], "query_id string, query string"), HashingEncoder())
    assert {r.query_id: sum(r.q_emb) > 0 for r in rows.collect()} == {"q": False, "r": True}


def test_levels(spark):
    cases = [("2", 2), ("2.7", 2), ("true", 1), ('"2"', 2), ('" 2 "', 2), ('"2.0"', None), ('"abc"', None), ('""', None), ("[1]", None), ("null", None), ('"-3"', -3)]
    rows = [(k, f"s{k}", "Section", None, '{"level": %s}' % value) for k, (value, _) in enumerate(cases)]
    rows += [(90, "t", "Section", None, None), (91, "u", "Section", None, "{broken")]
    nodes = spark.createDataFrame(rows, "seq bigint, id string, type string, text string, attributes string")
    assert {r.id: r.level for r in ingest.section_scan(nodes).collect()} == {f"s{k}": level for k, (_, level) in enumerate(cases) if level is not None}


def test_duplicates_and_dirt(spark):
    rows = [(0, "a", "Chunk", "one", None), (3, "a", "Chunk", "two", None), (5, "a", "Chunk", "7", None), (1, "b", "Chunk", " 12 ", None), (2, None, "Chunk", "x", None), (4, "c", None, "x", None), (6, "d", "Chunk", "²", None)]
    nodes = spark.createDataFrame(rows, "seq bigint, id string, type string, text string, attributes string")
    assert [(r.seq, r.id, r.text) for r in ingest.chunk_scan(nodes).collect()] == [(0, "a", "two")]
    edges = spark.createDataFrame([(0, "s", "s", "HAS_SUBSECTION"), (1, None, "a", "HAS_CHUNK"), (2, "s", None, "CAPTIONS"), (3, "s", "t", "HAS_SUBSECTION"), (4, "t", "s", "HAS_SUBSECTION"), (5, "t", "s", "HAS_SUBSECTION")], "seq bigint, from_id string, to_id string, relation_type string")
    sections = spark.createDataFrame([(0, "s", 1), (1, "t", 2), (2, "u", 3)], "seq bigint, id string, level int")
    linked, children = ingest.section_links(sections, edges)
    assert sorted((r.parent_id, r.child_id, r.child_ord) for r in children.collect()) == [("s", "s", 1), ("s", "t", 2), ("t", "s", 1), ("t", "s", 2)]
    texts = spark.createDataFrame([], "seq bigint, id string, section_id string, node_type string, text string")
    own = staged(hierarchy.local_text(linked, texts))
    assert {r.id: r.subtree_text for r in hierarchy.subtree_text(own, staged(children)).collect()} == {"s": None, "t": None, "u": ""}


def test_empty(spark):
    nodes = spark.createDataFrame([], "seq bigint, id string, type string, text string, attributes string")
    edges = spark.createDataFrame([], "seq bigint, from_id string, to_id string, relation_type string")
    built = build_index(nodes, edges, HashingEncoder())
    query = spark.createDataFrame([("q", "x", [1.0])], "query_id string, query string, q_emb array<float>")
    assert built.sections.count() == 0 and Engine(built).run(query).documents.first().section_candidates == []
