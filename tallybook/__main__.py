"""Run a stage: ``spark-submit -m tallybook <stage> ...`` or ``python -m tallybook``.

    collate   ledger files          -> OUT/invoices, OUT/unique_suppliers, OUT/files/*
    enrich    invoices and master   -> OUT/combined, OUT/extract, OUT/tally
    report    tally and lookups     -> OUT/report/*
    profile   tally and geography   -> OUT/profile/*
"""

from __future__ import annotations

import argparse

from tallybook import schemas
from tallybook.plans import pipeline
from tallybook.session import build_session
from tallybook.sources import missing_files, read_csv, read_dataset, read_ledgers, read_named


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallybook", description=__doc__)
    parser.add_argument("--master", help="Spark master; left to spark-submit when absent")
    stages = parser.add_subparsers(dest="stage", required=True)
    collate = stages.add_parser("collate")
    collate.add_argument("--ledgers", required=True, help="folder of ledger files")
    collate.add_argument("--format", default="csv", choices=["csv", "parquet"])
    collate.add_argument("--manifest", help="list of the files to take")
    collate.add_argument("--codes", required=True, help="names and codes of the bodies")
    enrich = stages.add_parser("enrich")
    enrich.add_argument("--suppliers", required=True, help="supplier master")
    report = stages.add_parser("report")
    report.add_argument("--population", required=True)
    report.add_argument("--geography", required=True)
    report.add_argument("--shared", required=True, help="list of shared bodies")
    report.add_argument("--body", action="append", default=[], help="body to list suppliers of")
    report.add_argument(
        "--nth", action="append", default=[], metavar="BODY=2,3", help="places of suppliers to share"
    )
    report.add_argument("--supplier", action="append", help="supplier to list by body")
    report.add_argument(
        "--excluded", action="append", help="successor unit left out; derived without this"
    )
    for name, kind in (
        ("case-rank", int), ("successor-case-rank", int), ("successor-cut", float), ("spend-cut", float),
    ):
        report.add_argument(f"--{name}", action="append", type=kind)
    report.add_argument("--top-cut", type=float)
    profile = stages.add_parser("profile")
    profile.add_argument("--geography", required=True)
    profile.add_argument("--body", action="append", default=[])
    profile.add_argument("--successor", action="append", default=[])
    for stage in (collate, enrich, report, profile):
        stage.add_argument("--out", required=True, help="folder of the stored datasets")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = build_session(master=args.master)
    out = args.out
    if args.stage == "collate":
        manifest = None
        if args.manifest:
            manifest = read_csv(spark, args.manifest, schemas.MANIFEST)
            lost = missing_files(spark, args.ledgers, manifest)
            if not lost.isEmpty():
                raise SystemExit(f"the manifest names files that are not there, e.g. {lost.first()[0]}")
        raw = read_ledgers(spark, args.ledgers, manifest, args.format)
        pipeline.write_tables(pipeline.file_report(raw, manifest), f"{out}/files")
        codes = read_named(spark, args.codes, schemas.BODY_CODES)
        pipeline.build_invoices(raw, codes, out)
    elif args.stage == "enrich":
        master = read_named(spark, args.suppliers, schemas.SUPPLIERS)
        pipeline.build_datasets(read_dataset(spark, f"{out}/invoices"), master, out)
    elif args.stage == "report":
        ledger = read_dataset(spark, f"{out}/tally")
        shared = read_named(spark, args.shared, schemas.SHARED_LIST)
        chosen = {
            "excluded": args.excluded,
            "case_ranks": args.case_rank,
            "successor_case_ranks": args.successor_case_rank,
            "successor_cuts": args.successor_cut,
            "spend_cuts": args.spend_cut,
            "top_cut": args.top_cut,
            "suppliers": args.supplier,
        }
        tables = pipeline.report_tables(
            ledger,
            read_named(spark, args.population, schemas.POPULATION),
            read_named(spark, args.geography, schemas.GEOGRAPHY),
            shared,
            pipeline.build_split(ledger, out),
            pipeline.Choices(**{k: v for k, v in chosen.items() if v is not None}),
        )
        places = {}
        for text in args.nth:
            body, _, numbers = text.rpartition("=")
            places[body] = [int(n) for n in numbers.split(",")]
        if args.body or places:
            tables.update(pipeline.body_tables(ledger, args.body, places))
        pipeline.build_shared(read_dataset(spark, f"{out}/extract"), ledger, shared, out)
        pipeline.write_tables(tables, f"{out}/report")
    else:
        ledger = read_dataset(spark, f"{out}/tally")
        geography = read_named(spark, args.geography, schemas.GEOGRAPHY)
        tables = pipeline.profile_tables(ledger, geography, args.body, args.successor)
        pipeline.write_tables(tables, f"{out}/profile")


if __name__ == "__main__":
    main()
