"""python -m tidemark TASK IN OUT: normalizes a GCT or plain matrix, counts reads over genes, or runs a registered query."""

from __future__ import annotations

import argparse


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark import catalog
    from tidemark.operators import matrix as mx
    from tidemark.sources import sinks, text

    tasks = {
        "quantilenormalizecols": lambda m, log: mx.quantile_normalize(mx.log2(m) if log else m),
        **{f"{verb}{axis}": lambda m, log, f=f, a=a: f(mx.log2(m) if log else m, a) for verb, f in (("mediancenter", mx.median_center), ("meannormalize", mx.mean_normalize), ("densitynormalize", mx.density_normalize), ("znormalize", mx.z_normalize)) for axis, a in (("rows", "row"), ("columns", "col"))},
    }
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", help=f"{', '.join(sorted(tasks))} (case aside), count or query:NAME")
    parser.add_argument("source", help="matrix file; reads (SAM text); or the folder of the tables")
    parser.add_argument("target", help="folder to write to")
    parser.add_argument("--log", action="store_true", help="log2 first")
    parser.add_argument("--genes", help="BED file of the genes to count over")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if args.task.startswith("query:"):
        catalog.queries()[args.task[6:]](spark, args.source).write.mode("overwrite").parquet(args.target)
    elif args.task == "count":
        from tidemark.operators.counting import count_regions

        count_regions(text.sam(spark, args.source), text.bed(spark, args.genes), 1 << 14).write.mode("overwrite").csv(args.target, sep="\t", header=True)
    else:
        m = text.gct(spark, args.source).select("row", "col", "value")
        sinks.write_text(sinks.gct(tasks[args.task.lower()](m, args.log).select("row", "col", F.round("value", 9).alias("value"))), args.target, one_file=True)


if __name__ == "__main__":
    main()
