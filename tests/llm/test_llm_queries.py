"""The registered text queries on whole tables: SQL where there is some, else brute force; and the pipeline."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from compare import normalise  # noqa: E402
from copycensus.llm import bpe, decontaminate  # noqa: E402
from copycensus.llm.oracles import ORACLES  # noqa: E402
from copycensus.llm.queries import REGISTRY  # noqa: E402
from copycensus.llm.quality import judge  # noqa: E402
from test_llm_operators import brute_items, brute_near, brute_repeats, covered  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in REGISTRY if n != "pipeline"]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLES) <= set(REGISTRY)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    relation = con.execute(ORACLES[name])
    theirs = normalise([d[0] for d in relation.description], relation.fetchall())
    found = REGISTRY[name](spark, SF)
    assert normalise(found.columns, [tuple(r) for r in found.collect()]) == theirs


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def items(spark):
    return [(r["item_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_near_duplicate_query(spark):
    found = REGISTRY["op5_bottom_k"](spark, SF).collect()
    assert sorted(map(tuple, found), key=str) == brute_near(documents(spark))


def test_suffix_query(spark):
    assert sorted(map(tuple, REGISTRY["op8_suffix_columns"](spark, SF).collect()), key=str) == brute_repeats(documents(spark))


def test_decontamination_query(spark):
    found = {(r["doc_id"], r["item_id"]) for r in REGISTRY["op2_simhash_windows"](spark, SF).collect()}
    assert found == set(brute_items(documents(spark), items(spark)))


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on what the stage before kept; all but the last keep the columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.collect())

    kept = stages["quality_rules"](spark, docs, SF).cache()
    verdicts = {r["doc_id"]: r["kept"] for r in judge(docs).collect()}
    assert kept.columns == columns and text(kept) == [(d, t) for d, t in text(docs) if verdicts[d]]

    alone = stages["near_dedup"](spark, kept, SF).cache()
    assert alone.columns == columns and {d for d, _ in text(alone)} == {d for d, _, _, keep in brute_near(text(kept)) if keep}

    cut = stages["suffix_dedup"](spark, alone, SF).cache()
    assert cut.columns == columns
    removed = {d: (len(t.encode()), int(gone.sum())) for (d, t), (gone, _) in zip(text(alone), covered(text(alone), corpus_pipeline.REPEAT_BYTES), strict=True)}
    for d, t in text(cut):
        n, gone = removed[d]
        assert 0 <= len(t.encode()) - (n - gone) <= 6 * (gone > 0) * 50

    clean = stages["decontamination"](spark, cut, SF).cache()
    dirty = {d for d, _ in brute_items(text(cut), items(spark))}
    assert clean.columns == columns and text(clean) == [(d, t) for d, t in text(cut) if d not in dirty]

    last = stages["byte_bpe"](spark, clean, SF).collect()
    assert sorted(r["doc_id"] for r in last) == [d for d, _ in text(clean)]
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last))


def test_rules_write_no_second_table_and_judge_once(spark, monkeypatch):
    """The rows are not written before they are filtered, and the filter reads a finished verdict."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def no_table(df):
        raise AssertionError("the stage writes a table of its own")

    monkeypatch.setattr(corpus_pipeline, "materialize", no_table)
    monkeypatch.setattr(corpus_pipeline.quality, "order_rules", lambda docs, text, rules, rows: rules)
    kept = {r["doc_id"] for r in judge(docs).collect() if r["kept"]}
    alone = corpus_pipeline.quality_rules(spark, docs, SF)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert not any("n_words" in line or "CASE" in line for line in plan.splitlines() if " Filter " in line)
    assert {r["doc_id"] for r in alone.collect()} == kept and kept


def test_token_parts_are_small():
    """A worker keeps what it held at most, so a part of a batch and the remembered pre-tokens are few."""
    batch = pa.RecordBatch.from_pydict({"text": [chr(97 + i % 26) * 100_000 for i in range(60)]})
    parts = list(bpe.slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == 60 and max(p.num_rows for p in parts) * 100_000 <= 1 << 20
    assert bpe.REMEMBERED <= 100_000


def test_labels_are_respected(spark):
    """Rows that people call good and that pass the base rule stay; most others that pass it go."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 1]) > 0.99
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 0]) < 0.3


def test_items_are_read_in_passes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 15)
    assert sorted(map(str, decontaminate.contaminated(docs, bench).collect())) == whole and whole
