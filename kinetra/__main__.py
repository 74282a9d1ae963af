"""python -m kinetra list | query NAME TABLES [--out PATH] | trials FOLDER --out PATH | study DATABASE=FOLDER... --out PATH | clear PATH | analyse PATH DATABASE..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinetra.config import METHODS, SEEDS, Study


def main() -> None:
    p = argparse.ArgumentParser(prog="kinetra")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    q = sub.add_parser("query", help="run a registered query over a folder of Parquet tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--out")
    t = sub.add_parser("trials", help="decode recordings and write their trials as Parquet")
    t.add_argument("folder")
    t.add_argument("--out", required=True)
    t.add_argument("--min-trial", type=int, default=100)
    r = sub.add_parser("study", help="leave-one-subject-out over databases of recordings; a rerun does what is missing")
    r.add_argument("folders", nargs="+", metavar="DATABASE=FOLDER")
    r.add_argument("--out", required=True)
    r.add_argument("--extractor", default="canonical")
    r.add_argument("--kernels", type=int, default=10_000)
    r.add_argument("--methods", nargs="+", default=list(METHODS), choices=METHODS)
    r.add_argument("--seeds", nargs="+", type=int, default=list(SEEDS))
    r.add_argument("--subjects", type=int, help="as many target subjects; all subjects stay sources")
    r.add_argument("--grouped", action="store_true", help="functional groups in place of movements")
    r.add_argument("--by-sums", action="store_true", help="folds by sums, with kernel importance; without TCA")
    c = sub.add_parser("clear", help="list what a study's feature cache holds that nothing names; --delete removes it")
    c.add_argument("out")
    c.add_argument("--delete", action="store_true")
    y = sub.add_parser("analyse", help="analyses of a study's stored results; a rerun does what has changed")
    y.add_argument("out")
    y.add_argument("databases", nargs="+")
    y.add_argument("--only", nargs="+")
    args = p.parse_args()
    from kinetra.plans import evaluation, models, signals, tables  # noqa: F401
    from kinetra.plans.registry import QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("kinetra").getOrCreate()
    if args.command == "query":
        df = QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
        return
    if args.command == "study":
        from kinetra.operators import driver

        errors = driver.study_all(spark, dict(f.split("=", 1) for f in args.folders), args.out, Study(kernels=args.kernels), extractor=args.extractor, methods=tuple(args.methods), seeds=tuple(args.seeds), grouped=args.grouped, held_out=args.subjects, by_sums=args.by_sums)
        for database, error in errors.items():
            print(f"{database}: {error or 'done'}")
        raise SystemExit(any(errors.values()))
    if args.command == "analyse":
        from kinetra.operators import analyses

        told = analyses.run(spark, args.out, args.databases, args.only)
        for database, name, state in told:
            print(f"{database} {name}: {state}")
        raise SystemExit(any(state not in ("done", "unchanged", "no input") for _, _, state in told))
    if args.command == "clear":
        from kinetra.sources import cache

        for place, reason in cache.clear(spark, f"{args.out}/features", dry_run=not args.delete):
            print(f"{place}: {reason}")
        return
    from pyspark.sql import functions as F

    from kinetra.operators import segment
    from kinetra.sources import recordings

    good, bad = recordings.quarantine(recordings.read(spark, args.folder))
    rows = good.withColumn("i", F.col("sample_idx"))
    segment.trials(rows, ["path", "subject_id"], args.min_trial).write.mode("overwrite").partitionBy("subject_id").parquet(args.out)
    for r in bad.collect():
        print(f"unreadable: {r.path}: {r.error}")


if __name__ == "__main__":
    main()
