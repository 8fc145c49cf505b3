"""Command line: bring an index up to date and ask it."""

from __future__ import annotations

import argparse
import sys

from .config import Config, load_json
from .operators import diagnostics, retrieval
from .operators.index import Index
from .session import local_session


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tamarack", description=__doc__)
    p.add_argument("question", nargs="*", help="words of the question")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--collection", help="by default the first there is")
    p.add_argument("--sync", metavar="TREE", help="first bring the index up to date with this file tree")
    p.add_argument("--settings", help="JSON file with any of Config's fields")
    p.add_argument("--file", help="read the question from this file")
    p.add_argument("--top-k", type=int)
    p.add_argument("--json", action="store_true", help="print JSON rows, not text")
    p.add_argument("--snippets", action="store_true", help="with --json: include the texts")
    p.add_argument("--describe", action="store_true", help="print what the index holds")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parsed(argv)
    settings = load_json(args.settings) if args.settings else {}
    config = Config(**{k: v for k, v in settings.items() if k in Config.__dataclass_fields__}) if settings else Config.from_env()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.sync:
        index = Index(spark, args.index, config, collection=args.collection)
        print(index.sync(args.sync), file=sys.stderr)
    else:
        index = Index.open(spark, args.index, args.collection, config)
    if args.describe:
        diagnostics.by_extension(index.collection.read()).show(100, False)
    question = " ".join(args.question)
    if args.file:
        question = spark.read.text(args.file, wholetext=True).first().value
    if question.strip():
        hits = index.search(question, args.top_k)
        if args.json:
            rows = retrieval.json_rows(hits, args.snippets).orderBy("rank").collect()  # k rows
            print("[\n  " + ",\n  ".join(r.json for r in rows) + "\n]")
        else:
            for r in retrieval.lines(hits).orderBy("rank").collect():  # k rows
                print(r.line + "\n")
    elif not (args.sync or args.describe):
        print("the question is empty", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
