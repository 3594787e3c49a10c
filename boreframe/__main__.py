"""Command line: ``python -m boreframe {quality,train,score} ...``.

A thin front end over the plans; each subcommand is one Spark application.
"""

from __future__ import annotations

import argparse
import json


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="boreframe")
    sub = ap.add_subparsers(dest="cmd", required=True)

    q = sub.add_parser("quality", help="quality report and issue tables")
    q.add_argument("input")
    q.add_argument("--out", required=True)

    t = sub.add_parser("train", help="train, evaluate, save models and the enhanced table")
    t.add_argument("input")
    t.add_argument("--models", required=True, help="model directory (one sub-folder per run)")
    t.add_argument("--out", required=True)
    t.add_argument("--target", default=None)
    t.add_argument("--max-samples", type=int, default=None, help="bounds the rows of the fit")
    t.add_argument("--grids", choices=["full", "large"], default="full")

    s = sub.add_parser("score", help="score a table with the newest saved run")
    s.add_argument("input")
    s.add_argument("--models", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--model", default="best")
    s.add_argument("--confidence", type=float, default=0.0)
    s.add_argument("--column-mapping", default=None)

    a = ap.parse_args(argv)
    from .session import get_session
    spark = get_session()
    from .sources.readers import read_table

    if a.cmd == "quality":
        from .plans.quality_report import analyze, write_reports
        rep = analyze(read_table(spark, a.input))
        write_reports(rep, f"{a.out}/issues")
        for name in ("recommendations", "table_score", "oob_summary", "missing_profile"):
            rep[name].coalesce(1).write.mode("overwrite").json(f"{a.out}/{name}")
    elif a.cmd == "train":
        from .config import LogConfig
        from .operators.conform import find_target
        from .plans.training_run import RunOptions, run
        df = read_table(spark, a.input)
        cfg = LogConfig(target=a.target or find_target(df.columns) or LogConfig().target)
        res = run(spark, df, cfg, RunOptions(max_samples=a.max_samples, grids=a.grids), a.models, a.out)
        print(json.dumps({"run_id": res.run_id, "best_model": res.best_model, "imputation": res.imputation}))
    else:
        from .plans.batch_scoring import score_input
        _scored, report = score_input(spark, a.input, a.models, a.model, a.confidence, a.column_mapping,
                                      a.output)
        print(json.dumps([r.asDict() for r in report["summary"].collect()], default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
