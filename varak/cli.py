"""Command line: python -m varak.cli -i FOLDER -o FOLDER {extract,pairs,stats,analysis} ..."""

from __future__ import annotations

import argparse
import difflib
import importlib
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from varak.config import load_config
from varak.operators import lexicon, pairs, stats
from varak.sources import files

log = logging.getLogger("varak")
ANALYSES = ("formality", "semantics", "genre")
#: Named elsewhere as analyses, but nowhere defined: refused with a reason.
UNDEFINED = ("morphology", "syntax")


class Parser(argparse.ArgumentParser):
    """Names the nearest choices when one is mistyped."""

    def error(self, message: str):
        word = message.partition("invalid choice: ")[2].strip("'\" ").split("'")[0]
        known = [c for a in self._actions if a.choices for c in a.choices]
        near = difflib.get_close_matches(word, known, n=3, cutoff=0.6) if word else []
        super().error(message + (f"; did you mean {', '.join(near)}?" if near else ""))


def folder(text: str) -> Path:
    """An existing folder; nothing is written to find out."""
    path = Path(text)
    if not path.is_dir():
        beside = [p.name for p in path.parent.iterdir()] if path.parent.is_dir() else []
        near = difflib.get_close_matches(path.name, beside, n=3, cutoff=0.6)
        raise argparse.ArgumentTypeError(f"no such folder: {text}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return path


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="varak", description="Text mining on Spark")
    top.add_argument("-i", "--input", type=folder, required=True, help="folder of input files")
    top.add_argument("-o", "--output", type=Path, required=True, help="folder for results")
    top.add_argument("-c", "--config", type=Path, help="JSON settings")
    commands = top.add_subparsers(dest="command", required=True, parser_class=Parser)
    extract = commands.add_parser("extract", help="PDF files to text")
    extract.add_argument("--converter", help="module:function that takes bytes and options and returns text (default: pymupdf4llm)")
    extract.add_argument("--workers", type=int, help="partitions")
    mine = commands.add_parser("pairs", help="original and translation pairs of text files")
    mine.add_argument("--min-similarity", type=float, default=0.3)
    commands.add_parser("stats", help="statistics of a corpus of folders")
    analysis = commands.add_parser("analysis", help="markers in text files (an extension)")
    analysis.add_argument("--type", choices=ANALYSES + UNDEFINED, default="formality")
    return top


def _callable(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    config, source, target = load_config(args.config), str(args.input), str(args.output)
    if args.command == "extract":
        paths = [str(p) for p in sorted(args.input.glob("*.pdf"))]
        done = files.read_pdfs(spark, paths, _callable(args.converter) if args.converter else files.library_converter, config.pdf_extraction, partitions=args.workers or config.workers)
        done.write.mode("overwrite").parquet(target)
    elif args.command == "pairs":
        found = pairs.mine_pairs(files.read_whole(spark, f"{source}/*.txt"), "path", "text", args.min_similarity)
        found.drop("metadata").write.mode("overwrite").parquet(target)
    elif args.command == "stats":
        for missing in files.folders_without_corpus(spark, source):
            log.warning("no %s in %s", files.CORPUS_FILE, missing)
        each = stats.text_stats(files.read_corpus(spark, source), "folder")
        each.write.mode("overwrite").parquet(f"{target}/folders")
        stats.totals(each).write.mode("overwrite").parquet(f"{target}/total")
    elif args.type in UNDEFINED:
        raise ValueError(f"the analysis {args.type} is only a name: nothing says what it should find")
    else:
        lists = lexicon.load_lexicon(spark, config.lexicon_dir) if config.lexicon_dir else lexicon.starter(spark)
        texts = files.read_whole(spark, f"{source}/*.txt")
        lexicon.marker_counts(texts, lists, args.type, "path").write.mode("overwrite").parquet(target)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=load_config(args.config).logging.level)
    run(SparkSession.builder.appName("varak").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
