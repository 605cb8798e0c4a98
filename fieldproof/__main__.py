"""Command line: generate, run, evaluate, compare, list, registry, cost, verify-audit."""

from __future__ import annotations

import argparse
import getpass
import json
import sys
from pathlib import Path

from . import runs
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fieldproof", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    g = sub.add_parser("generate")
    g.add_argument("--out", default="data")
    for name, n in (("train", 200), ("val", 50), ("test", 100), ("holdout", 0), ("rl", 0)):
        g.add_argument(f"--{name}", type=int, default=n)
    g.add_argument("--fair-sets", type=int, default=25)
    g.add_argument("--fair-variants", type=int, default=4)
    g.add_argument("--seed", type=int, default=1234)
    r = sub.add_parser("run")
    r.add_argument("--data", default="data")
    r.add_argument("--split", default="test")
    r.add_argument("--runs-dir", default="runs")
    r.add_argument("--run-id")
    r.add_argument("--limit", type=int)
    r.add_argument("--bias-group")
    r.add_argument("--bias-strength", type=float, default=0.0)
    e = sub.add_parser("evaluate")
    e.add_argument("run_dir")
    e.add_argument("--data")
    c = sub.add_parser("compare")
    c.add_argument("run_dirs", nargs="+")
    c.add_argument("--out")
    sub.add_parser("list").add_argument("--runs-dir", default="runs")
    rg = sub.add_parser("registry")
    rg.add_argument("action", choices=["build", "show", "promote"])
    rg.add_argument("name", nargs="?")
    rg.add_argument("--reason", default="")
    rg.add_argument("--force", action="store_true")
    rg.add_argument("--path", default="models/registry.json")
    rg.add_argument("--adapters", default="adapters")
    rg.add_argument("--runs-dir", default="runs")
    co = sub.add_parser("cost")
    co.add_argument("run_dirs", nargs="+")
    for name in ("--gpu-hourly", "--in-price", "--out-price"):
        co.add_argument(name, type=float)
    v = sub.add_parser("verify-audit")
    v.add_argument("run_dir")
    v.add_argument("--known", help="folder of the blocks that earlier verifications found intact")
    a = p.parse_args(argv)
    if a.verb == "registry" and a.action == "show":
        print(Path(a.path).read_text(encoding="utf-8"))
        return 0
    spark = session()
    if a.verb == "compare":
        text = runs.compared(spark, a.run_dirs)
        print(text)
        if a.out:
            Path(a.out).write_text(text, encoding="utf-8")
    elif a.verb == "list":
        for row in runs.listed(spark, a.runs_dir):
            print(json.dumps(row))
    elif a.verb == "generate":
        print(json.dumps(runs.generate(spark, a.out, {k: getattr(a, k) for k in ("train", "val", "test", "holdout", "rl")}, a.fair_sets, a.fair_variants, a.seed), indent=2))
    elif a.verb in ("run", "evaluate"):
        folder = runs.run(spark, a.data, a.split, a.runs_dir, a.run_id, a.limit, a.bias_group, a.bias_strength) if a.verb == "run" else Path(a.run_dir)
        made = runs.evaluate(spark, str(folder), a.data)
        print(json.dumps({k: made[k] for k in ("run_id", "field_accuracy", "grounded_accuracy", "json_valid_rate", "hallucination_rate", "mean_reward", "audit_message")}, indent=2))
    elif a.verb == "registry" and a.action == "build":
        print(json.dumps(runs.build_registry(spark, a.adapters, a.runs_dir, a.path)["models"], indent=2))
    elif a.verb == "registry":
        if not a.name:
            raise SystemExit("usage: registry promote <model> --reason ...")
        ok, rows = runs.promote(spark, a.name, a.reason, a.path, a.force, getpass.getuser())
        for row in rows:
            print(f"  {row['split']:<8} {row['metric']:<20} {row['candidate']} {row['production']} {row['result']}")
        print("promoted" if ok else "promoted (forced)" if a.force else "not promoted")
        return 0 if ok or a.force else 1
    elif a.verb == "cost":
        for d in a.run_dirs:
            print(json.dumps(runs.run_costs(spark, d, gpu_hourly=a.gpu_hourly, in_price=a.in_price, out_price=a.out_price)))
    else:
        found = runs.verify_log(spark, f"{a.run_dir}/audit.jsonl", a.known)
        print(found.message if found else "empty log")
        return 0 if not found or found.ok else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
