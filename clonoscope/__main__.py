"""Command line: fit on a folder of labelled repertoires, score folders of new ones, rank sequences, write one result.

    python -m clonoscope --train_dir train_dataset_4 --test_dir test_dataset_4_1 test_dataset_4_2 --out_dir out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from clonoscope.operators import ranking as R
from clonoscope.plans import pipelines
from clonoscope.sources import files


def run(spark: SparkSession, train_dir: str, test_dirs: list[str], out_dir: str, recipe: str | None = None, reference: DataFrame | None = None, skip_training: bool = False) -> DataFrame:
    """The result of one training folder and its test folders, also written to out_dir. `skip_training` takes the
    model that an earlier run stored there."""
    number = files.dataset_number(train_dir) or files.dataset_number(train_dir.rstrip("/").rsplit("/", 1)[0])
    recipe = recipe or pipelines.BY_NUMBER.get(number or 0, "composition")
    rep = files.read_repertoires(spark, train_dir)
    meta = files.read_metadata(spark, f"{train_dir.rstrip('/')}/metadata.csv").select("repertoire_id", "label_positive").where("label_positive is not null")
    if skip_training:
        fitted = pipelines.Fitted.load(spark, f"{out_dir}/model")
    else:
        fitted = pipelines.fit(recipe, rep, meta, reference)
        fitted.save(f"{out_dir}/model")
    parts = []
    for folder in test_dirs:
        scored = fitted.score(files.read_repertoires(spark, folder))
        parts.append(R.test_rows(scored, folder.rstrip("/").rsplit("/", 1)[-1]))
    best = pipelines.ranked(fitted, rep, meta, reference)
    result = R.assembled([*parts, R.ranked_rows(best, train_dir.rstrip("/").rsplit("/", 1)[-1])])
    files.write_result(result, f"{out_dir}/predictions")
    files.write_json(files.result_manifest(result), f"{out_dir}/manifest")
    return result


def main(arguments: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="clonoscope", description=__doc__)
    ask.add_argument("--train_dir", required=True)
    ask.add_argument("--test_dir", nargs="+", required=True)
    ask.add_argument("--out_dir", required=True)
    ask.add_argument("--recipe", choices=sorted(pipelines.RECIPES))
    ask.add_argument("--reference", help="tab-separated reference sequences with cdr3_aa, sample and is_positive")
    ask.add_argument("--sample", default="", help="the antigen of the reference's sequences")
    ask.add_argument("--skip_training", action="store_true")
    got = ask.parse_args(arguments)
    spark = SparkSession.builder.appName("clonoscope").getOrCreate()
    reference = files.read_reference(spark, got.reference, got.sample) if got.reference else None
    result = run(spark, got.train_dir, got.test_dir, got.out_dir, got.recipe, reference, got.skip_training)
    R.validated(result).show(truncate=False)


if __name__ == "__main__":
    main()
