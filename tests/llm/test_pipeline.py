"""The pipeline's stages, and the queries against their SQL."""

from __future__ import annotations

import glob
import hashlib
import itertools
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from orrery.llm import byte_pair, mixing, ngram_join, quality_rules
from orrery.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    verdicts = quality_rules.quality_rules(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in verdicts.filter("kept").select("doc_id").collect())
    kept = spark.createDataFrame(kept.toPandas(), docs.schema)
    one = corpus_pipeline.near_copies(spark, kept, SMALL)
    firsts = {r["component_id"] for r in ngram_join.similar_groups(kept).collect()}
    assert one.columns == docs.columns and sorted(r[0] for r in one.select("doc_id").collect()) == sorted(firsts)
    one = spark.createDataFrame(one.toPandas(), docs.schema)
    mix = corpus_pipeline.mix(spark, one, SMALL)
    copies = {r["id"]: r["n_copies"] for r in mixing.mixed(one).collect()}
    assert mix.columns == docs.columns and mix.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == {i: n for i, n in copies.items() if n}
    last = corpus_pipeline.encode(spark, mix, SMALL)
    assert last.count() == sum(copies.values())
    whole = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert key(whole) == key(last)


def _shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares by weight, stopped at three times a source's size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def test_stages_by_brute_force(spark):
    """The first stage by SQL, groups of near copies by comparing all pairs, the mix by its targets, tokens by the library."""
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {r[0] for r in c.execute(f"SELECT doc_id FROM ({SQL['op5_quality_rules']}) WHERE kept").fetchall()}
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(rows[i]) for i in want)
    sets = {i: _shingles(rows[i]["text"]) for i in want}
    top = {i: i for i in want}

    def root(i: int) -> int:
        return i if top[i] == i else root(top[i])

    for i, j in itertools.combinations(sorted(want), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            top[b] = a
    firsts = {i for i in want if root(i) == i}
    one = corpus_pipeline.near_copies(spark, spark.createDataFrame([rows[i] for i in want], docs.schema), SMALL)
    assert sorted(map(tuple, one.collect())) == sorted(tuple(rows[i]) for i in firsts)
    mix = corpus_pipeline.mix(spark, spark.createDataFrame([rows[i] for i in firsts], docs.schema), SMALL).collect()
    copies = Counter(r["doc_id"] for r in mix)
    assert set(copies) <= firsts and max(copies.values()) <= 3 and all(tuple(r) == tuple(rows[r["doc_id"]]) for r in mix)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")) for i in firsts}
    by_source: Counter = Counter()
    taken: Counter = Counter()
    for i in firsts:
        by_source[rows[i]["source"]] += size[i]
        taken[rows[i]["source"]] += copies[i] * size[i]
    for source, target in _targets(by_source).items():
        assert abs(taken[source] - target) <= max(max(size[i] for i in firsts if rows[i]["source"] == source), 1e-6)
    whole = tokenizers.Tokenizer.from_file(byte_pair.default_path())
    last = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in last) == copies
    assert all(list(r["ids"]) == whole.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids for r in last)


def test_stages_keep_columns_of_any_name_and_kind(spark):
    rows = [(i, " ".join(f"word{i}y{k}" for k in range(80)), "s", {"a": i}, 1, "k") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row map<string,int>, first_id int, component string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns and out.count() > 0
        assert stage(spark, df.limit(0), SMALL).count() == 0


def test_the_last_stage_returns_tokens(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    rows = corpus_pipeline.encode(spark, docs, SMALL).collect()
    assert len(rows) == 20
    for r in rows:
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest() == r["ids_sha256"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), c.execute(SQL[name]).df()
    text = lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(tuple(map(text, r)) for r in got[names].astype(object).itertuples(index=False)) == sorted(tuple(map(text, r)) for r in want[names].astype(object).itertuples(index=False))
