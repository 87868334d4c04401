"""Command lines: python -m tidemark.cli STAGE ..., where STAGE is normalize, block, features, splits, train, prune, decide, variants or run.

Tables are parquet unless they are raw (TSV). run does the stages in turn in one work folder: raw/{train,test}/*.tsv in, output/ out.
"""

from __future__ import annotations

import argparse
import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PAIR, DecisionConfig
from tidemark.functions.text import normalize_source
from tidemark.operators import blocking, decision, features, learning, pruner
from tidemark.operators.decision import CANDIDATE, S1
from tidemark.sources import io
from tidemark.workers import prepare, written

STAGES = ("normalize", "block", "features", "splits", "train", "decide")


def normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    io.write_records(normalize_source(io.read_tsv(spark, args.input)), args.output, by_country=True)


def _sides(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    first, *more = (io.read_records(spark, p) for p in args.gallery)
    return io.read_records(spark, args.s1), functools.reduce(DataFrame.unionByName, more, first)


def block(spark: SparkSession, args: argparse.Namespace) -> None:
    s1, gallery = _sides(spark, args)
    truth = io.read_truth(spark, args.truth) if args.truth else None
    prune = pruner.as_pruner(io.read_model(spark, args.pruner), s1, gallery) if args.pruner and io.exists(spark, args.pruner) else None
    io.write_records(blocking.generate_candidates(s1, gallery, truth, pruner=prune), args.output)


def prune(spark: SparkSession, args: argparse.Namespace) -> None:
    """Slices are country:pattern, the last one held out."""
    s1, gallery = _sides(spark, args)
    truth = io.read_truth(spark, args.truth)
    *parts, held = (pruner.training_pairs(s1, gallery, truth, *x.split(":", 1), args.queries) for x in args.slices)
    model = pruner.fit_pruner(functools.reduce(DataFrame.unionByName, parts), held)
    io.write_model(model, args.output)
    pruner.pruner_recall(held, model, held.where("label = 1").count()).show()


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    s1, gallery = _sides(spark, args)
    io.write_records(features.build_features(spark.read.parquet(args.candidates), s1, gallery), args.output)


def splits(spark: SparkSession, args: argparse.Namespace) -> None:
    io.write_splits(written(features.split_entities(spark.read.parquet(args.s1).select("entity_id", "country"))), args.output)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.features)
    lists = {x: io.read_id_list(spark, f"{args.splits}/{x}").withColumnRenamed("entity_id", S1) for x in ("train", "val")}
    fit, val = (rows.join(lists[x], S1, "left_semi") for x in ("train", "val"))
    model, calibrator, columns = learning.two_phase(fit, args.rounds, args.hard_from, args.hard_weight, val=val)
    io.write_model(model, f"{args.output}/model")
    io.write_model(calibrator, f"{args.output}/calibrator")
    scored = written(learning.predict(val, model, columns, calibrator).select(*PAIR, "label", "prob"))
    truth = io.read_truth(spark, args.truth) if args.truth else scored.where("label = 1").select(S1, CANDIDATE)
    spine = scored.select(S1, "country").distinct()
    if args.s1:
        spine = spark.read.parquet(args.s1).select(F.col("entity_id").alias(S1), "country").join(lists["val"], S1, "left_semi")
    results = {r["part"]: r.asDict() for r in learning.evaluate(scored, truth, spine, args.formula).collect()}
    learning.reliability(scored).orderBy("bin").show()
    io.write_summary(spark, {"feature_cols": columns, "importance": learning.feature_importance(model, columns), "rounds": model.getNumTrees, "results": results, "formula": args.formula}, f"{args.output}/summary")


def decide(spark: SparkSession, args: argparse.Namespace) -> None:
    spine = spark.read.parquet(args.s1).select("entity_id")
    config = DecisionConfig(formula=args.formula, min_prob=args.min_prob, vetoes=not args.no_vetoes, exclusivity=not args.no_exclusivity, prior_shift=args.prior_shift)
    if args.load_probs:
        pairs = spark.read.parquet(args.load_probs)
    else:
        rows = spark.read.parquet(args.features)
        model = io.read_model(spark, f"{args.models}/model")
        scored = learning.predict(rows, model, features.feature_columns(rows.columns), io.read_calibrator(spark, f"{args.models}/calibrator"), config.vetoes)
        pairs = written(scored.select(*PAIR, "prob"))
    if args.save_probs:
        io.write_records(pairs, args.save_probs)
    chosen = written(decision.decide(pairs, config))
    io.write_tsv(decision.matching_results(chosen, spine), f"{args.output}/matching_results")
    if not args.skip_candidates:
        io.write_tsv(decision.candidate_pairs(pairs, spine, "prob"), f"{args.output}/candidate_pairs")
    decision.summary(chosen, spine).show()


def variants(spark: SparkSession, args: argparse.Namespace) -> None:
    pairs, spine = spark.read.parquet(args.load_probs), spark.read.parquet(args.s1).select("entity_id")
    for name in args.names:
        io.write_tsv(decision.matching_results(decision.decide(pairs, decision.variant(name)), spine), f"{args.output}/{name}/matching_results")
    io.write_csv(decision.variants(pairs, spine, tuple(args.names)), f"{args.output}/summary")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """All stages, or those named, for raw/{train,test}/{train,test}_{source1,source2,source3}.tsv and raw/train/train_ground_truth.tsv."""
    raw, work = io.dataset_folder(spark, (f"{args.work}/raw", f"{args.work}/dataset")), args.work
    names = STAGES if args.stages == "all" else tuple(args.stages.split(","))
    if unknown := set(names) - set(STAGES):
        raise SystemExit(f"no stage: {sorted(unknown)}")
    truth = f"{raw}/train/train_ground_truth.tsv"
    for name in names:
        if name in ("train", "splits"):
            at = ["--s1", f"{work}/normalized/train/source1"]
            more = ["--features", f"{work}/features/train", "--splits", f"{work}/splits", "--truth", truth, *at] if name == "train" else at
            main([name, *more, "--output", f"{work}/{'models' if name == 'train' else 'splits'}"], spark)
            continue
        for part in ("train", "test") if name != "decide" else ("test",):
            sides = ["--s1", f"{work}/normalized/{part}/source1", "--gallery", *(f"{work}/normalized/{part}/source{i}" for i in (2, 3))]
            if name == "normalize":
                for i in (1, 2, 3):
                    main([name, "--input", f"{raw}/{part}/{part}_source{i}.tsv", "--output", f"{work}/normalized/{part}/source{i}"], spark)
            elif name == "block":
                main([name, *sides, *(["--truth", truth] if part == "train" else []), "--pruner", f"{work}/models/pruner", "--output", f"{work}/candidates/{part}"], spark)
            elif name == "features":
                main([name, *sides, "--candidates", f"{work}/candidates/{part}", "--output", f"{work}/features/{part}"], spark)
            else:
                main([name, *sides[:2], "--features", f"{work}/features/{part}", "--models", f"{work}/models", "--output", f"{work}/output"], spark)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="stage", required=True)

    def add(name: str, f, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for option in needed:
            p.add_argument(f"--{option}", required=True, **({"nargs": "+"} if option in ("gallery", "slices", "names") else {}))
        return p

    add("normalize", normalize, "input", "output")
    b = add("block", block, "s1", "gallery", "output")
    b.add_argument("--truth")
    b.add_argument("--pruner")
    add("prune", prune, "s1", "gallery", "truth", "slices", "output").add_argument("--queries", type=int, default=40_000)
    add("features", build, "s1", "gallery", "candidates", "output")
    add("splits", splits, "s1", "output")
    t = add("train", train, "features", "splits", "output")
    t.add_argument("--truth")
    t.add_argument("--s1")
    t.add_argument("--rounds", type=int, default=20)
    t.add_argument("--hard-from", type=float, default=0.30)
    t.add_argument("--hard-weight", type=float, default=2.0)
    t.add_argument("--formula", default="expected", choices=["expected", "pdf"])
    d = add("decide", decide, "s1", "output")
    source = d.add_mutually_exclusive_group(required=True)
    source.add_argument("--features")
    source.add_argument("--load-probs")
    d.add_argument("--models", default="models")
    d.add_argument("--save-probs")
    d.add_argument("--formula", default="expected", choices=["expected", "pdf"])
    d.add_argument("--min-prob", type=float, default=0.0)
    d.add_argument("--prior-shift", type=float, default=1.0)
    for option in ("no-vetoes", "no-exclusivity", "skip-candidates"):
        d.add_argument(f"--{option}", action="store_true")
    add("variants", variants, "load-probs", "s1", "names", "output")
    add("run", run, "work").add_argument("--stages", default="all")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    prepare(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
