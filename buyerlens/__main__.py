"""Command line for the batch pipeline.

    python -m buyerlens build-features --purchases P --offers O --likes L --comments C --out DIR
    python -m buyerlens model-table --buyers DIR --out DIR
    python -m buyerlens score --train DIR --upload DIR --out DIR [--min-score 0.5] [--top 10]

Inputs of ``build-features`` are pipe-delimited exports with a header; every
other input and output is Parquet.  Work files go under the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import sys

from buyerlens import params


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="buyerlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build-features", help="raw exports -> one row per buyer (D1-D4)")
    for name in ("purchases", "offers", "likes", "comments", "out"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--cutoff", default=params.ACTIVITY_CUTOFF)
    b.add_argument("--check-density", action="store_true")
    m = sub.add_parser("model-table", help="buyer table -> model table (D5)")
    m.add_argument("--buyers", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--snapshot", default=params.SNAPSHOT_DATE)
    s = sub.add_parser("score", help="fit, score an upload and write the report (D6)")
    for name in ("train", "upload", "out"):
        s.add_argument(f"--{name}", required=True)
    s.add_argument("--min-score", type=float, default=params.MIN_SCORE)
    s.add_argument("--top", type=int, default=params.TOP_K)
    args = ap.parse_args(argv)

    from buyerlens.session import get_session
    spark = get_session()
    if args.cmd == "build-features":
        from buyerlens.pipeline import build_features
        build_features(spark, args.purchases, args.offers, args.likes, args.comments, args.out,
                       args.cutoff, args.check_density)
    elif args.cmd == "model-table":
        from buyerlens.pipeline import build_model_table
        build_model_table(spark, args.buyers, args.out, args.snapshot)
    else:
        from buyerlens.plans.scoring_job import run_scoring_job
        _, _, top = run_scoring_job(spark, spark.read.parquet(args.train),
                                    spark.read.parquet(args.upload), args.out,
                                    args.min_score, args.top)
        for row in top.collect():          # at most --top rows
            print(row["ID_BUYER"], row["Composite_Score"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
