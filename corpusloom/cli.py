"""Command line: python -m corpusloom.cli COMMAND ...; tables are Parquet folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _between(low: int, high: int):
    def number(value: str) -> int:
        n = int(value)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"must be within {low} and {high}")
        return n

    return number


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def status(spark, a):
    from corpusloom.operators import stages

    for r in stages.stage_counts(spark.read.parquet(a.input), spark.read.parquet(a.rejections)).orderBy("stage").collect():
        print(r["stage"], r["n"])


def import_(spark, a):
    from corpusloom.sources import readers

    with open(a.config, encoding="utf-8") as f:
        configs = readers.load_configs(f.read())
    rows = readers.read_all(spark, configs)
    if missing := readers.missing_provenance(rows).limit(20).collect():
        raise SystemExit("\n".join(f"{r['source_name']} {r['source_item_id']}: lacks {', '.join(r['missing'])}" for r in missing))
    _save(rows, a.output)


def report_sources(spark, a):
    rows = spark.read.parquet(a.input).groupBy("source_name").agg(F.count("*").alias("items"), F.countDistinct("license_name").alias("licences"), F.countDistinct("source_author").alias("authors"))
    _save(rows, a.output)


def clean(spark, a):
    from corpusloom.operators import gate

    accepted, rejected = gate.clean_stage(spark.read.parquet(a.input))
    _save(accepted, f"{a.output}/accepted")
    _save(rejected, f"{a.output}/rejected")


def dedupe(spark, a):
    from corpusloom.operators import dedupe as d

    _save(d.dedupe(spark.read.parquet(a.input), hash_name=a.hash), a.output)


def classify(spark, a):
    from corpusloom.operators import classify as c

    _save(c.classify_candidates(spark.read.parquet(a.input), spark.read.parquet(a.lexicon), spark.read.parquet(a.scenes)), a.output)


def select(spark, a):
    from corpusloom.operators import select as s

    pool = spark.read.parquet(a.input)
    chosen = s.select_quotas(pool)
    if a.exact_quotas:
        s.require_quotas(s.shortages(pool, chosen))
    _save(chosen, a.output)


def recall(spark, a):
    from corpusloom.operators import recall as r

    _save(r.vector_top_k(spark.read.parquet(a.input), spark.read.parquet(a.prototypes), a.top_k, exclude=spark.read.parquet(a.exclude) if a.exclude else None), a.output)


def prepare_review(spark, a):
    from corpusloom.operators import review as v

    _save(v.batches(v.merge_suggestions(spark.read.parquet(a.input)), a.batch_size), a.output)


def validate_review(spark, a):
    from corpusloom.operators import review as v

    problems = v.coverage(spark.read.parquet(a.requests), spark.read.parquet(a.input))
    if bad := problems.limit(20).collect():
        raise SystemExit("\n".join(f"{r['item_id']}: {r['problem']}" for r in bad))


def check_translations(spark, a):
    from corpusloom.operators import translate as t

    rows = spark.read.parquet(a.input)
    _save(rows.withColumn("issues", t.issues(F.col("text"), F.col("translation_zh"))), a.output)


def variants(spark, a):
    from corpusloom.operators import variants as v

    _save(v.with_variants(spark.read.parquet(a.input)), a.output)


def queries(spark, a):
    from corpusloom.plans import registry

    print("\n".join(registry.QUERIES))


def run(spark, a):
    from corpusloom.plans import registry

    _save(registry.QUERIES[a.name](spark, a.input), a.output)


COMMANDS = {
    "status": (status, ("input", "rejections")), "import": (import_, ("config", "output")), "report-sources": (report_sources, ("input", "output")), "clean": (clean, ("input", "output")), "dedupe": (dedupe, ("input", "output")),
    "classify": (classify, ("input", "lexicon", "scenes", "output")), "select": (select, ("input", "output")), "recall": (recall, ("input", "prototypes", "output")), "prepare-review": (prepare_review, ("input", "output")),
    "validate-review": (validate_review, ("input", "requests")), "check-translations": (check_translations, ("input", "output")), "variants": (variants, ("input", "output")), "queries": (queries, ()), "run": (run, ("input", "output")),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, paths) in COMMANDS.items():
        c = sub.add_parser(name)
        for path in paths:
            c.add_argument(f"--{path}", required=True)
        if name == "dedupe":
            c.add_argument("--hash", choices=("blake2b", "sha256"), default="blake2b")
        if name == "select":
            c.add_argument("--exact-quotas", action="store_true")
        if name == "recall":
            c.add_argument("--top-k", type=_between(1, 500), default=50)
            c.add_argument("--exclude")
        if name == "prepare-review":
            c.add_argument("--batch-size", type=_between(1, 1000), default=500)
        if name == "run":
            c.add_argument("name")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    COMMANDS[a.command][0](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
