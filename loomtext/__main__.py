"""Command line: python -m loomtext FOLDER COMMAND ...

search WORDS...   the best documents
index PATH        reads a file or folder of texts
push FILE...      puts the documents of message files, a message a file
build             writes the search index
all               stored documents as JSON lines
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

from .engine import Engine
from .sources.files import source_type

_LABELS = {0: "local", 1: "web"}
_BOLD, _GREEN, _BLUE, _PLAIN = "\033[1m", "\033[92m", "\033[94m", "\033[0m"


def lines(response: dict, colours: bool = False) -> list[str]:
    """A search response as it is shown; the results are numbered from 0."""
    paint = (lambda code, text: f"{code}{text}{_PLAIN}") if colours else lambda code, text: text
    out = [f"--- Search results for query '{paint(_BOLD, response['Query'])}' ---"]
    for n, r in enumerate(response["Results"]):
        out.append(f"{n}. Path: {paint(_BLUE, r['Path'])} Score: {paint(_GREEN, format(r['Score'], '.2f'))}, Source: {paint(_BOLD, _LABELS.get(r['Source'], 'unknown'))}")
    return out


def run(engine: Engine, command: str, *args: str, colours: bool = False) -> list[str]:
    if command == "search":
        query = " ".join(args)
        rows = engine.search(query).collect()
        return lines({"Query": query, "Results": [{"Path": r["path"], "Score": r["score"], "Source": r["source"]} for r in rows]}, colours)
    if command == "index":
        path = os.path.abspath(args[0])
        indexer = engine.indexers().first()
        collection = engine.register_collection(path, indexer["id"] if indexer else engine.register_indexer(), source_type="dir" if source_type(path) else "file")
        engine.index(collection)
        return [f"indexed {path} as collection {collection}"]
    if command == "push":
        return [f"put {engine.push_documents([Path(f).read_text() for f in args])} documents"]
    if command == "build":
        engine.build_index()
        return [f"index built in {engine.seconds['build index']:.1f} s"]
    if command == "all":
        return [r["value"] for r in engine.all_documents().toLocalIterator()]
    raise ValueError(f"no such command: {command}")


def main() -> int:
    if len(sys.argv) < 3:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    for line in run(Engine(spark, sys.argv[1]), *sys.argv[2:], colours=sys.stdout.isatty()):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
