"""Commands over packs: ``python -m sigloom.cli scrape|build|info|detect|query``.

Tables are Parquet paths that Spark can read; results go to standard output, or to a
Parquet path with ``--out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import codes
from sigloom.operators import dedup, detect, hamming, sampling
from sigloom.sources import pack


def scrape(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What to fetch of the listed versions; prints how many can be had and how many not."""
    plan = sampling.scrape_plan(*[spark.read.parquet(p) for p in (args.versions, args.cached, args.available)], args.stamp, args.max_n)
    ok, failed = sampling.fetch_counters(plan).first()
    print(f"ok {ok}, failed {failed}")
    return plan.orderBy("coord", "version")


def build(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """A pack of stamped observations."""
    obs = spark.read.parquet(args.observations)
    now = dedup.current(obs, args.stamp)
    built = dedup.build(obs, args.stamp, args.min_instructions).persist()
    counts = dedup.counters(now, args.min_instructions)
    c = counts.first()
    order = dedup.version_order(now)
    meta = {"coords": [r.coord for r in order.select("coord").distinct().orderBy("coord").collect()], "versions": order.count(), "classes_seen": c.classes_seen, "classes_below_min_instr": c.below_min, "min_instr": args.min_instructions}
    pack.write_pack(args.pack, built.select("payload_id", "hi", "lo", "strings"), built.select("payload_id", "coord", "ranges", "fqcn"), args.stamp, meta)
    built.unpersist()
    return counts


def info(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What a pack says of itself."""
    facts = [(k, None if v is None else str(v)) for k, v in pack.describe_pack(spark, args.pack).items()]
    return spark.createDataFrame(facts, "fact string, value string")


def detect_(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The libraries that an app's classes (qid, hi, lo, strings, instructions) speak for."""
    d = detect.Detector.from_pack(spark, args.pack, args.radius, args.stamp)
    app = detect.probes(spark.read.parquet(args.app), args.min_instructions)
    return detect.library_report(d.resolve(d.detect(app.select("qid", "hi", "lo", "strings"))), args.min_classes)


def query(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Entries near one code, nearest first, with their labels."""
    entries, payloads, _ = pack.read_pack(spark, args.pack, args.stamp)
    hi, lo = codes.lanes_of_int(int(args.code, 16))
    probe = spark.createDataFrame([(0, hi, lo)], "qid long, hi long, lo long")
    hits = hamming.hamming_join(probe, entries.withColumnRenamed("payload_id", "pid"), args.radius)
    d = detect.Detector(entries, payloads, args.radius)
    return d.label(hamming.by_distance(hits).select("qid", F.col("pid").alias("payload_id"), "distance")).select("payload_id", "distance", "label").orderBy("distance", "payload_id")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sigloom", description=__doc__)
    p.add_argument("--out", help="write the result there as Parquet")
    sub = p.add_subparsers(required=True)

    def command(name, run, *places, **options):
        c = sub.add_parser(name, help=run.__doc__)
        for x in places:
            c.add_argument(x)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        c.set_defaults(run=run)

    command("scrape", scrape, "versions", "cached", "available", stamp="", max_n=8)
    command("build", build, "observations", "pack", stamp="", min_instructions=dedup.MIN_INSTRUCTIONS)
    command("info", info, "pack")
    command("detect", detect_, "pack", "app", stamp=None, radius=detect.RADIUS, min_instructions=detect.MIN_INSTRUCTIONS, min_classes=detect.MIN_CLASSES)
    command("query", query, "pack", "code", stamp=None, radius=detect.RADIUS)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    df = args.run(spark or SparkSession.builder.appName("sigloom").getOrCreate(), args)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(1000, truncate=False)


if __name__ == "__main__":
    main()
