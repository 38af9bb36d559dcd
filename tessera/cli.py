"""Commands over tables: python -m tessera.cli COMMAND ... (or by spark-submit).

fit             class priors from rows (parent, class, scene, scan, valid, value)
evaluate        average precision of predictions (scene, prediction, class, score, point) against gt (scene, point, class, instance)
prepare-gt      scenes in array archives as a table
audit-alignment share of points with a neighbour in another table within a radius; fails below a minimum
audit-objects   counts and metrics of rows with boolean columns `predicted` and `actual` by `object`
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import curve, overlap, quantile, spatial
from .sources import formats, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    fit = sub.add_parser("fit")
    fit.add_argument("rows")
    fit.add_argument("--least-scenes", type=int, default=5)
    fit.add_argument("--tau", type=float, default=20.0)
    ev = sub.add_parser("evaluate")
    ev.add_argument("gt")
    ev.add_argument("predictions")
    ev.add_argument("--least", type=int, default=100)
    gt = sub.add_parser("prepare-gt")
    gt.add_argument("archives")
    al = sub.add_parser("audit-alignment")
    al.add_argument("points")
    al.add_argument("others")
    al.add_argument("--radius", type=float, default=0.05)
    al.add_argument("--minimum", type=float, default=0.9)
    ob = sub.add_parser("audit-objects")
    ob.add_argument("rows")
    for s in sub.choices.values():
        s.add_argument("--out", required=True)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    status = 0
    if args.command == "fit":
        out = quantile.hierarchy(tables.read_rows(spark, args.rows), "parent", "class", "scene", "scan", "valid", "value", args.least_scenes, args.tau)
    elif args.command == "evaluate":
        gt, predictions = tables.read_rows(spark, args.gt), tables.read_rows(spark, args.predictions)
        names = sorted(r[0] for r in gt.where("class IS NOT NULL").select("class").distinct().collect())  # the classes
        out = curve.average_precision(gt, predictions, names, least=args.least)
    elif args.command == "prepare-gt":
        formats.register(spark)
        out = spark.read.format("npz_scene").load(args.archives)
    elif args.command == "audit-alignment":
        near = spatial.nearest(tables.read_rows(spark, args.points), tables.read_rows(spark, args.others), "id", "id", ["x", "y", "z"], args.radius)
        out = spatial.mapped_share(near, "id_2").withColumn("passed", F.col("mapped") >= args.minimum)
        status = 0 if out.first().passed else 1
    else:
        out = overlap.confusion(tables.read_rows(spark, args.rows), ["object"], F.col("predicted"), F.col("actual"))
    tables.write_rows(out, args.out)
    return status


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(SparkSession.builder.appName(f"tessera {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
