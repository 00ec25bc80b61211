"""Command line: demo, synth, parse, eval, table, time, examples, scrub."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.patterns import usable
from .functions.tables import keep
from .operators import alignment, clustering
from .operators.synthesis import synth_masks
from .plans import evaluation, reports
from .sources import lines as sources
from .sources import sinks


def _corpus(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.dataset == [sources.DEMO] and not Path(args.root, sources.DEMO).exists():
        return sources.demo_lines(spark)
    return sources.corpus(spark, args.root, args.dataset)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodeline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for option, more in options:
            c.add_argument(option, **more)

    data = [("--root", {"default": "datasets"}), ("--dataset", {"nargs": "+", "default": [sources.DEMO]})]
    out, masks = ("--out", {"required": True}), ("--masks", {"required": True})
    command("synth", *data, out, ("--k", {"type": int, "default": 50}), ("--strict", {"action": "store_true"}))
    command("parse", *data, out, masks, ("--show", {"type": int, "default": 0}))
    command("demo", ("root", {}))
    command("eval", *data, out, ("--k", {"type": int, "default": 50}), ("--truth", {"action": "store_true"}))
    command("table", out, ("csv", {"nargs": "+"}))
    command("time", *data, out, masks, ("--n", {"type": int, "default": 100}))
    command("examples", *data, out, ("--max", {"type": int}), ("--entropy-k", {"type": int}))
    command("scrub", ("source", {}), out)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lodeline").getOrCreate()
    if args.command == "synth":
        for name in args.dataset:
            one = argparse.Namespace(root=args.root, dataset=[name])
            n = sinks.write_masks(spark, synth_masks(_corpus(spark, one), args.k, strict=args.strict), f"{args.out}/{name}")
            print(f"{name}: {n} masks")
    elif args.command == "parse":
        parsed = keep(clustering.parse(_corpus(spark, args), usable(spark, sources.read_masks(spark, args.masks, strict=True))), "parsed")
        sinks.write_parsed_csv(parsed, args.out)
        if args.show:
            sinks.show(parsed.orderBy("dataset", "line_no").select("line", "template"), args.show)
    elif args.command == "demo":
        print(evaluation.write_demo(spark, args.root))
    elif args.command == "eval":
        truth = sources.ground_truth(spark, args.root, args.dataset) if args.truth else None
        rows = evaluation.evaluate(_corpus(spark, args), truth, evaluation.Settings(k=args.k))
        rows.show(truncate=False)
        sinks.write_csv(rows, args.out)
    elif args.command == "table":
        print(*reports.build_tables(spark, args.csv, args.out))
    elif args.command == "time":
        sinks.write_csv(evaluation.timing(_corpus(spark, args), sources.read_masks(spark, args.masks, strict=True), args.n), args.out)
    elif args.command == "examples":
        both = _corpus(spark, args).join(sources.ground_truth(spark, args.root, args.dataset), ["dataset", "line_no"])
        rows = alignment.training_examples(both, args.max, args.entropy_k)
        print(sinks.write_jsonl(rows.select("instruction", "input", "output"), args.out))
    else:
        sinks.scrub_files(spark, args.source, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
