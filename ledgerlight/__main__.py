"""Command line: ``python -m ledgerlight batch|live|tune --input ... --output ...``."""

from __future__ import annotations

import argparse

from .operators import normalize, rollup
from .plans import pipeline, tuned
from .schemas import BILLING
from .session import build_session
from .sources.billing import read_billing
from .streaming import live


def main() -> None:
    parser = argparse.ArgumentParser(prog="ledgerlight")
    parser.add_argument("mode", choices=["batch", "live", "tune"])
    parser.add_argument("--input", required=True, help="billing files")
    parser.add_argument("--output", required=True, help="folder of the result tables")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet", "json", "orc"])
    parser.add_argument("--batch-id", default="batch")
    parser.add_argument("--budget", type=float, default=50_000.0)
    parser.add_argument("--interval", type=int, default=60, help="seconds between live batches")
    parser.add_argument("--clear", action="store_true", help="drop earlier results first")
    parser.add_argument("--sequence", default="series", choices=["series", "service"])
    args = parser.parse_args()
    spark = build_session()

    if args.mode == "live":
        rows = live.arriving_rows(spark, args.input, BILLING, args.format)
        out = args.output.rstrip("/")
        live.run_live(rows, f"{out}/bronze", f"{out}/results", f"{out}/checkpoint", f"{args.interval} seconds").awaitTermination()
        return
    raw = read_billing(spark, args.input, args.format)
    if args.mode == "tune":
        tuned.tuned_run(rollup.segment_daily(normalize.normalize(raw)), args.output)
    else:
        # An export may name categories of its own, so the service list is open.
        pipeline.run_batch(raw, args.output, args.batch_id, args.budget, closed=False, sequence=args.sequence, clear=args.clear)


if __name__ == "__main__":
    main()
