"""Build and save an index: ``python -m kedrion.plans.build NODES EDGES FOLDER [--encoder hashing-64 | MODEL] [--device DEVICE]``.

Without ``--encoder`` the default sentence model is used.  The index names its encoder, and is asked with the same one.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession

from kedrion.operators.embed import DEFAULT_MODEL, Encoder, HashingEncoder, SentenceEncoder
from kedrion.plans.pipeline import build_index
from kedrion.session import build_session
from kedrion.sources.index_store import Index, save_index
from kedrion.sources.json_ontology import read_edges, read_nodes
from kedrion.session import staged


def build(spark: SparkSession, nodes: str, edges: str, folder: str, encoder: Encoder) -> int:
    """Index of the two files in ``folder``; the dimension of its vectors is returned."""
    found = build_index(staged(read_nodes(spark, nodes), "file-nodes"), staged(read_edges(spark, edges), "file-edges"), encoder)
    kept = Index(staged(found.sections, "build-sections"), found.children, staged(found.text_nodes, "build-nodes"), found.edges)
    return save_index(kept, folder, encoder.name)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kedrion.plans.build")
    parser.add_argument("nodes")
    parser.add_argument("edges")
    parser.add_argument("folder")
    parser.add_argument("--encoder", default=DEFAULT_MODEL)
    parser.add_argument("--device")
    given = parser.parse_args(arguments)
    hashing = re.fullmatch(r"hashing-(\d+)", given.encoder)
    encoder = HashingEncoder(int(hashing[1])) if hashing else SentenceEncoder(given.encoder, given.device)
    return build(build_session(), given.nodes, given.edges, given.folder, encoder)


if __name__ == "__main__":
    print(main())
