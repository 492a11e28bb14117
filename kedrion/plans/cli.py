"""Interactive loop over an index: ``python -m kedrion.plans.cli INDEX_FOLDER``."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from kedrion.operators.embed import Encoder, encoder_named
from kedrion.plans.pipeline import Engine
from kedrion.session import build_session
from kedrion.sources.index_store import load_index, saved_facts


def asked(lines: Iterable[str]) -> Iterator[str]:
    """Stripped lines up to ``exit`` or ``quit`` in any case; empty ones are queries too."""
    for line in lines:
        line = line.strip()
        if line.lower() in ("exit", "quit"):
            return
        yield line


def answer(spark: SparkSession, engine: Engine, query: str) -> str:
    """The result as JSON: the query and its section candidates."""
    rows = spark.createDataFrame([("q", query)], "query_id string, query string")
    found = json.loads(engine.run(rows).documents.select("query", "section_candidates").toJSON().first())
    return json.dumps(found, ensure_ascii=False, indent=2)


def opened(spark: SparkSession, folder: str, encoder: Encoder | None = None) -> Engine:
    """An engine over the index of ``folder`` with the encoder that built it (or ``encoder``, if it is the same)."""
    encoder = encoder or encoder_named(*reversed(saved_facts(spark, folder)))
    return Engine(load_index(spark, folder, encoder), max_graph_depth=5, max_graph_nodes=800, top_k_text=60, encoder=encoder)


def main(folder: str, lines: Iterable[str] = sys.stdin, show: Callable[[str], None] = print) -> None:
    spark = build_session()
    engine = opened(spark, folder)
    for query in asked(lines):
        show(answer(spark, engine, query))


if __name__ == "__main__":
    main(sys.argv[1])
