"""python -m sigweave process | processAll | analyze | stats: corpus ingest, detection, and corpus statistics over signature artifacts.

`process` reads lifted artifacts (-src), or with -m JAR or AAR archives found by a pattern (-ld, -p, -vcg, -n or -ncg); `processAll` reads the archives of
a table of recipes. Archives are catalogued by content beside the corpus (archives/, archive_index/), once each, for a lifter to read; what
it lifts goes in by -src.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions import hashing
from sigweave.functions.formula import compile_formula
from sigweave.operators import catalogue, detection, rollup, sketches
from sigweave.sources import archives, cache, recipes, results, signatures
from sigweave.sources.storage import materialise


def within(low: float, high: float, kind=float):
    """An argument type: a number of low to high."""

    def number(text: str):
        try:
            v = kind(text)
        except ValueError:
            v = None
        if v is None or not low <= v <= high:
            raise argparse.ArgumentTypeError(f"{text} is not a number of {low:g} to {high:g}")
        return v

    return number


def formula(*variables: str):
    def check(text: str) -> str:
        import ast

        try:
            names = {n.id for n in ast.walk(ast.parse(text.replace("^", "**"), mode="eval")) if isinstance(n, ast.Name)}
        except SyntaxError as e:
            raise argparse.ArgumentTypeError(f"{text} is not a formula") from e
        if names - {*variables, "min", "max", "log10", "log2", "log", "sqrt", "abs", "exp", "floor", "ceil", "signum"}:
            raise argparse.ArgumentTypeError(f"{text} has other variables than {', '.join(variables)}")
        return text

    return check


def parser() -> argparse.ArgumentParser:
    share = within(0, 1)
    top = argparse.ArgumentParser(prog="sigweave")
    commands = top.add_subparsers(dest="command", required=True)
    default = detection.Settings()
    for name, what in (("process", "read lifted artifacts or archives into a corpus, once for each content"), ("processAll", "read the archives of all recipes into a corpus"), ("analyze", "detect the corpus's libraries in applications"), ("stats", "bit frequencies of the corpus")):
        p = commands.add_parser(name, help=what)
        p.add_argument("-libs", required=True, help="corpus table (process writes it)")
        p.add_argument("-k", type=within(1, 10, int), default=default.k, help="k-gram length")
        p.add_argument("-mt", type=within(1, 4096, int), help="threads of a local session")
        if name == "processAll":
            p.add_argument("-recipes", default=recipes.DEFAULT, help="JSON table of recipes")
            p.add_argument("-root", help="folder that the recipes' paths are in")
        if name == "process":
            p.add_argument("-m", choices=("LIFTED", "JAR", "AAR"), default="LIFTED", help="what to read")
            p.add_argument("-src", help="folder of artifact files (LIFTED)")
            p.add_argument("-ld", help="folder of archives")
            p.add_argument("-p", help="pattern on an archive's whole path")
            p.add_argument("-vcg", type=within(1, 2, int), help="group of the pattern that is the version")
            p.add_argument("-n", help="the library's name")
            p.add_argument("-ncg", type=within(1, 2, int), help="group of the pattern that is the library's name")
        if name in ("process", "processAll"):
            p.add_argument("-x", default="^$", help="artifacts to leave out, as a pattern on the whole name")
        if name == "analyze":
            p.add_argument("-apk", required=True, help="folder of the applications' artifact files")
            p.add_argument("-v", type=within(0, 7, int), default=0, help="report: 1 package weights, 2 alternatives, 4 matched classes")
            p.add_argument("-mth", type=share, default=default.mapping_threshold)
            p.add_argument("-scth", type=share, default=default.class_similarity)
            p.add_argument("-cri", type=share, default=default.call_importance)
            p.add_argument("-scr", type=share, default=default.scan_range)
            p.add_argument("-bsth", type=formula("size", "pop"), default=default.sketch_formula)
            p.add_argument("-dtth", type=formula("size"), default=default.detection_formula)
            p.add_argument("-out", help="folder of JSON results")
            p.add_argument("-f", action="store_true", help="replace results that exist")
            p.add_argument("-bench", action="store_true", help="print the time taken")
    return top


def digests(records: DataFrame) -> DataFrame:
    """(library, version, digest) of artifacts named library/version; equal records in any order are equal content."""
    one = records.groupBy("artifact").agg(F.sort_array(F.collect_list(F.sha2("record", 256))).alias("parts"))
    parts = F.split("artifact", "/")
    return one.select(F.element_at(parts, -2).alias("library"), F.element_at(parts, -1).alias("version"), hashing.content_hash(F.array_join("parts", "")).alias("digest"))


def wrong(args) -> str | None:
    """What is missing of a command's options, if anything."""
    if args.command != "process":
        return None
    if args.m == "LIFTED":
        return None if args.src else "-src is needed"
    missing = [f"-{o}" for o in ("ld", "p", "vcg") if getattr(args, o) is None]
    if missing:
        return f"{', '.join(missing)} needed with -m {args.m}"
    return None if args.n or args.ncg else "a name (-n) or its group (-ncg) is needed"


def catalogue_archives(found: DataFrame, args) -> None:
    """Archives beside the corpus: one file of each content (those that exist stay), and their index."""
    spark = found.sparkSession
    known = materialise(archives.catalogued(found, args.x))
    results.write_index(catalogue.content_index(known, "library", "version", "digest"), f"{args.libs}/archive_index")
    first = catalogue.representatives(known, "library", "version", "digest")
    at = f"{args.libs}/archives"
    if cache.exists(spark, at):
        first = first.join(spark.read.parquet(at).select("library", "digest"), ["library", "digest"], "left_anti")
    first.write.mode("append").parquet(at)


def process_all(spark: SparkSession, args) -> None:
    catalogue_archives(recipes.artifacts(spark, [r for r in recipes.load(args.recipes, args.root) if cache.is_folder(spark, r["path"])]), args)


def process(spark: SparkSession, args) -> None:
    if args.m != "LIFTED":
        found = archives.listing(spark, args.ld, args.p, args.ncg, args.vcg, args.n or "")
        catalogue_archives(archives.aar_classes(found) if args.m == "AAR" else found, args)
        return
    records = signatures.read(spark, args.src).where(~F.col("artifact").rlike(f"^(?:{args.x})$"))
    hashed = detection.class_hashes(records, args.k).select("artifact").distinct()
    records = records.join(hashed, "artifact", "left_semi").persist()  # artifacts without k-grams are of no use
    results.write_index(catalogue.content_index(digests(records), "library", "version", "digest"), f"{args.libs}/index")
    first = catalogue.representatives(digests(records), "library", "version", "digest")
    records.join(first.select(F.concat_ws("/", "library", "version").alias("artifact")), "artifact", "left_semi").write.mode("overwrite").parquet(f"{args.libs}/records")


def analyze(spark: SparkSession, args) -> None:
    settings = detection.Settings(k=args.k, class_similarity=args.scth, mapping_threshold=args.mth, call_importance=args.cri, scan_range=args.scr, sketch_formula=args.bsth, detection_formula=args.dtth)
    compile_formula(args.bsth, {"size": F.lit(1), "pop": F.lit(0)})
    apps = signatures.read(spark, args.apk).persist()
    began = time.perf_counter()
    records = spark.read.parquet(f"{args.libs}/records")
    found = detection.detect(records, apps, settings, keep=materialise, opened_libraries=cache.cached(records, f"{args.libs}/opened", args.k, detection.opened)).persist()
    if args.out:
        results.write_json(found, args.out, args.f)
    lines = results.report(found if args.v & 2 else found.where("accepted"))
    for r in lines.toLocalIterator():
        print(r.line)
    if args.v & 1:
        for title, r in package_weights(found, apps):
            print(r.line if title is None else title)
    if args.v & 4:
        for r in found.where("accepted").select("app", "library", F.explode("classes").alias("cls")).orderBy("app", "library", "cls").toLocalIterator():
            print(r.app, r.library, r.cls)
    if args.bench:
        print(f"Duration: {time.perf_counter() - began:.3f} sec")


def package_weights(found: DataFrame, apps: DataFrame):
    """Lines of the packages' weights: of each application, and of what each accepted detection matched there; chains of packages are one line."""
    weights = materialise(signatures.units(apps).groupBy(F.col("artifact").alias("app"), "cls").agg(F.count("*").alias("weight")))
    taken = found.where("accepted").select("app", "library", "round", F.explode("classes").alias("cls")).join(weights, ["app", "cls"])
    for app in [r.app for r in weights.select("app").distinct().orderBy("app").collect()]:  # one report after the other
        parts = [(app, weights.where(F.col("app") == app))]
        parts += [(f"{app}: {r.library}", taken.where((F.col("app") == app) & (F.col("library") == r.library) & (F.col("round") == r.round))) for r in taken.where(F.col("app") == app).select("library", "round").distinct().orderBy("round", "library").collect()]
        for title, rows in parts:
            yield title, None
            for r in rollup.rendered(rollup.own_share(rollup.rollup(rows, "cls", "weight")), collapse=True).orderBy("prefix").toLocalIterator():
                yield None, r


def stats(spark: SparkSession, args) -> None:
    hashes = cache.cached(spark.read.parquet(f"{args.libs}/records"), f"{args.libs}/opened", args.k, detection.opened).select("artifact", F.explode("hashes").alias("h"))
    parts = F.split("artifact", "/")
    bits = hashes.select(F.element_at(parts, -2).alias("name"), F.element_at(parts, -1).alias("version"), sketches.bit(F.col("h"), sketches.ARTIFACT_PRIME).alias("bit"))
    for r in sketches.bit_frequency(sketches.common_bits(bits, "name", "version"), "name").orderBy(F.desc("freq")).toLocalIterator():
        print(f"{r.freq}\t{r.bits}\t{r.share:.6f}\t{r.running_share:.6f}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if said := wrong(args):
        parser().error(said)
    spark = spark or SparkSession.builder.master(f"local[{args.mt or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    {"process": process, "processAll": process_all, "analyze": analyze, "stats": stats}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
