"""``python -m corpusmill index --data-dir D --artifacts-dir A [--config C] [--rebuild]``,
``python -m corpusmill ask QUESTION --artifacts-dir A [--config C] [--mode rag] [--show-contexts]``,
``python -m corpusmill validate --artifacts-dir A``, ``python -m corpusmill snapshot --artifacts-dir A [--label L] [--notes N]`` and
``python -m corpusmill regression --artifacts-dir A --items NAME=FILE .. [--baseline NAME=FILE ..] [--out O]``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .operators.chunk import document_records
from .plans import pipeline
from .sources import files, store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    commands = parser.add_subparsers(dest="command", required=True)
    index, ask = commands.add_parser("index"), commands.add_parser("ask")
    index.add_argument("--data-dir", required=True)
    index.add_argument("--rebuild", action="store_true")
    ask.add_argument("question")
    ask.add_argument("--mode", choices=["rag", "retrieval_only"], default="retrieval_only")
    ask.add_argument("--show-contexts", action="store_true")
    validate, snapshot, regression = (commands.add_parser(n) for n in ("validate", "snapshot", "regression"))
    snapshot.add_argument("--label", default="manual")
    snapshot.add_argument("--notes", default="")
    for name in ("--items", "--baseline"):
        regression.add_argument(name, action="append", default=[], metavar="NAME=FILE")
    regression.add_argument("--out")
    for p in (index, ask, validate, snapshot, regression):
        p.add_argument("--artifacts-dir", required=True)
        p.add_argument("--config")
    args = parser.parse_args(argv)
    config = load_config(args.config) if args.config else Config()
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if args.command == "index":
        docs = files.read_documents(spark, args.data_dir)
        print(pipeline.build_index(document_records(docs, F.col("source_path"), F.col("source_name")), config, args.artifacts_dir, rebuild=args.rebuild), "chunks")
        return 0
    if args.command == "validate":
        print(json.dumps(files.validated(spark, args.artifacts_dir), ensure_ascii=False, indent=2))
        return 0
    if args.command == "snapshot":
        print(files.snapshot(spark, args.artifacts_dir, asdict(config), label=args.label, notes=args.notes, data_dir=config.paths.data_dir))
        return 0
    found = files.load_index(spark, args.artifacts_dir)
    if args.command == "regression":
        sets = {n: files.read_eval_items(spark, f) for n, _, f in (x.partition("=") for x in args.items)}
        base = {n: store.read_json(spark, f) for n, _, f in (x.partition("=") for x in args.baseline)}
        code, said = pipeline.regression_run(found, sets, config, base, out=args.out, required=("auto",) if not sets else ())
        print(pipeline.regression_markdown(said))
        return code
    row = pipeline.ask(found, spark.createDataFrame([(0, args.question)], "qid bigint, query string"), config, mode=args.mode).first()
    print(row.answer)
    for s in row.sources or []:
        print(f"[{s.rank}] {s.source_name} {s.section or s.title} {s.start_char}-{s.end_char}")
    if args.show_contexts:
        print(*row.contexts, sep="\n\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
