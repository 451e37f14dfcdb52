"""Recommendation job: raw requests against a catalog, to ranked rows, envelopes and rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wheelbase import vocab
from wheelbase.operators import recommend, requests
from wheelbase.sources import tables


def answer(items: DataFrame, raw_requests: DataFrame, policy: vocab.RelaxPolicy = vocab.RelaxPolicy()):
    """(ranked, envelope, rejected) frames of a batch of raw requests."""
    valid, rejected = requests.validate_requests(raw_requests)
    ranked, envelope = recommend.recommend(items, valid, policy)
    return ranked, envelope, rejected


def run(items: DataFrame, raw_requests: DataFrame, output: str, policy: vocab.RelaxPolicy = vocab.RelaxPolicy()) -> None:
    names = ("recommendations", "envelopes", "rejected")
    for name, frame in zip(names, answer(items, raw_requests, policy)):
        tables.write_parquet(frame, f"{output}/{name}.parquet")
