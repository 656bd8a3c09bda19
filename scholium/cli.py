"""Command line: create, search, download, review."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import CorpusLibraryError

ROOT = os.environ.get("SCHOLIUM_HOME", os.path.join(os.getcwd(), "temp"))


def folder(*names: str) -> str:
    """A folder under the working root, made if need be."""
    path = os.path.join(ROOT, *names)
    os.makedirs(path, exist_ok=True)
    return path


def parser() -> argparse.ArgumentParser:
    """Options of every command; --config may stand before or after it."""
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    shared.add_argument("--config", "-c", help="YAML file of options; those given on the line win")
    shared.add_argument("--verbose", "-v", action="store_true")
    out = argparse.ArgumentParser(prog="scholium", parents=[shared], description="Collections of papers on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create", parents=[shared], help="make a corpus")
    create.add_argument("--name", "-n")
    create.add_argument("--path", "-p")
    for name in ("search", "download"):
        c = commands.add_parser(name, parents=[shared], help=f"{name} papers of a source")
        c.add_argument("--query", "-q")
        c.add_argument("--repository", "-r", default="europe_pmc")
        c.add_argument("--limit", "-l", type=int, default=10)
        c.add_argument("--output", "-o")
        if name == "download":
            c.add_argument("--formats", "-f", default="xml,pdf")
    review = commands.add_parser("review", parents=[shared], help="review table of a folder of records or of saved search results")
    for option in ("--query-dir", "--search-results", "--xml-dir", "--query-run", "--output-dir"):
        review.add_argument(option)
    review.add_argument("--basename", default="review_table")
    return out


def arguments(argv: list[str]) -> argparse.Namespace:
    """Parsed options, with those of a configuration file wherever the line has none."""
    p = parser()
    args = p.parse_args(argv)
    path = getattr(args, "config", None)
    if path:
        from .operators.runs import config

        values = config(path)
        at = next(i for i, a in enumerate(argv) if a == args.command)
        own = {a for a in vars(args)}
        extra = [x for k, v in values.items() if k.replace("-", "_") in own or k in ("name", "query") for x in (f"--{k.replace('_', '-')}", ",".join(v) if isinstance(v, list) else str(v)) if k != "command"]
        args = p.parse_args([*argv[: at + 1], *extra, *argv[at + 1 :]])
    needed = {"create": "name", "search": "query", "download": "query"}.get(args.command)
    if needed and not getattr(args, needed, None):
        p.error(f"{args.command} needs --{needed}")
    return args


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("scholium").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(args: argparse.Namespace, spark, fetch=None) -> int:
    from .operators import ingest, review, runs
    from .operators.files import Bag, listing, paper_files
    from .sources.registry import source

    if args.command == "create":
        path = args.path or os.path.join(folder("corpus"), args.name)
        Bag(spark, path).create({"Corpus-Name": args.name})
        print(f"Created corpus {args.name} at {path}")
    elif args.command in ("search", "download"):
        out = args.output or folder("downloads")
        os.makedirs(out, exist_ok=True)
        origin = source(args.repository, spark, fetch)
        hits = [r.asDict(recursive=True) for r in origin.search(args.query, args.limit).collect()]
        if args.command == "search":
            for i, hit in enumerate(hits, 1):
                print(f"{i}. {hit['title']}")
            with open(os.path.join(out, "search_results.json"), "w", encoding="utf-8") as text:
                json.dump(hits, text, indent=2)
        else:
            for hit in hits:
                paper = hit.get("pmcid") or hit.get("arxiv_id") or hit.get("pmid")
                if not paper:
                    continue
                try:
                    kinds = [k for k in args.formats.split(",") if k in origin.formats]
                    print(paper, *origin.download(paper, out, kinds)["files"].values())
                except CorpusLibraryError as e:
                    print(f"{paper}: {e.message}", file=sys.stderr)
    else:
        name, text = runs.context(spark, args.query_run)
        if args.query_dir:
            papers = ingest.from_record(ingest.folders(spark, args.query_dir), folder="folder")
        else:
            papers = ingest.search_results(spark, args.search_results)
        if args.xml_dir:
            files = paper_files(listing(spark, args.xml_dir)).selectExpr("concat('europe_pmc_', paper_id) as paper_id", "kind", "length")
        else:
            files = spark.createDataFrame([], "paper_id string, kind string, length long")
        table = review.rows(review.with_files(papers, files, sized=False), name, text)
        for path in review.export(table, args.output_dir or folder("review"), args.basename).values():
            print(path)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    try:
        return run(args, _session())
    except CorpusLibraryError as e:
        print(e.message, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
