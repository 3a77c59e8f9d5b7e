"""``python -m stratadoc ingest | retag | query | index | compact | reset | serve``: the engine from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stratadoc import serve
from stratadoc.operators import upkeep
from stratadoc.plans.engine import Engine
from stratadoc.sources import readers


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="stratadoc")
    parser.add_argument("folder", help="the engine's folder")
    parts = parser.add_subparsers(dest="command", required=True)
    ingest = parts.add_parser("ingest", help="add the blocks of new files")
    ingest.add_argument("blocks", help="Parquet with block_id, source_file, text, kind, page")
    ingest.add_argument("root", help="the documents' folder, whose paths give the places and links")
    ingest.add_argument("--force", action="store_true", help="replace files that are there")
    ingest.add_argument("--yes", action="store_true", help="do not ask before replacing")
    ingest.add_argument("--only", help="a subfolder of the root")
    ingest.add_argument("--dry-run", action="store_true", help="show the first blocks of each file")
    retag = parts.add_parser("retag", help="find places, sections and pages again")
    retag.add_argument("root")
    query = parts.add_parser("query", help="answer a question")
    query.add_argument("question", nargs="*", default=["What are the requirements for fall protection?"])
    for name in ("index", "compact", "reset"):
        parts.add_parser(name)
    service = parts.add_parser("serve")
    service.add_argument("--port", type=int, default=8000)
    return parser.parse_args(given)


def files_under(spark: SparkSession, root: str, only: str | None = None):
    """Files with their links, those in none of the tiers' folders left out."""
    listed = readers.documents_under(spark, root, only)
    placed = listed.join(readers.misplaced(listed).select("path"), "path", "left_anti")
    return upkeep.links(placed, readers.link_entries(spark, root))


def run(args: argparse.Namespace, spark: SparkSession, ask=input, say=print) -> int:
    engine = Engine(spark, args.folder)
    if args.command == "ingest":
        if args.force and not args.yes and not args.dry_run and ask("Files that are there will be replaced. Type Y to go on: ") != "Y":
            return 1
        files = files_under(spark, args.root, args.only)
        blocks = spark.read.parquet(args.blocks)
        if args.only:
            blocks = blocks.join(files.selectExpr("element_at(split(path, '/'), -1) AS source_file").distinct(), "source_file", "left_semi")
        if args.dry_run:
            for r in engine.preview(blocks).orderBy("source_file", "place").toLocalIterator():
                say(f"{r.source_file} {r.block_id} {r.kind} {r.section} {r.doc_page}: {(r.text or '')[:80]}")
        else:
            say(f"{engine.ingest(blocks, files, args.force).count()} chunks could not be embedded")
    elif args.command == "retag":
        for r in engine.retag(files_under(spark, args.root)).toLocalIterator():
            say(f"no longer there: {r.source_file}")
    elif args.command == "query":
        row = engine.answer(spark.createDataFrame([(1, " ".join(args.question))], "query_id int, query string"), distance=4.0).first()
        say(row.answer)
    elif args.command == "index":
        say(engine.index_texts())
    elif args.command == "compact":
        engine.table.compact()
    elif args.command == "reset":
        if ask("The table will be emptied. Type Y to go on: ") != "Y":
            return 1
        engine.reset()
    else:
        serve.server(serve.from_environment(engine), port=args.port).serve_forever()
    return 0


if __name__ == "__main__":
    parsed = arguments()
    raise SystemExit(run(parsed, SparkSession.builder.appName("stratadoc").getOrCreate()))
