"""The registered queries and the pipeline at the smallest scale; SQL oracles where there are any."""

import hashlib
import os
import sys

import duckdb
import pytest

from longform.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, name):
    from oracle_check import rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    res = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name,key,table", [
    ("op1_embedding_near_dedup", "vec_id", "embeddings"), ("op3_simhash_near_dedup", "doc_id", "documents"),
    ("op4_toxicity", "doc_id", "documents"), ("op5_pii_pseudonyms", "doc_id", "documents"),
    ("op9_masked_pseudo_likelihood", "doc_id", "documents"), ("op10_language_id", "doc_id", "documents")])
def test_one_row_per_row(spark, name, key, table):
    rows = queries.queries()[name](spark, SF).select(key).collect()
    want = duckdb.sql(f"SELECT {key} FROM read_parquet('{SF}/{table}.parquet')").fetchall()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in want)


def test_control_strings_survive(spark):
    row = queries.queries()["op2_chat_formatting"](spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage against a plain version on the rows that the stage before kept."""
    import corpus_pipeline as cp
    from longform.llm import simhash
    from longform.llm.common import shared_path, table
    from tests_brute import contained, mixed
    docs = table(spark, SF, "documents")
    columns, folder = docs.columns, shared_path(spark, "t")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii_pseudonyms",
                                         "source_mixing"]
    seen = [docs.collect()]
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.collect())
        assert docs.columns == columns
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()]
    assert {r["doc_id"] for r in seen[1]} <= {r["doc_id"] for r in seen[0]} and len(seen[1]) > 0.7 * len(seen[0])
    fps = [simhash.fingerprint(r["text"].encode()) for r in seen[1]]
    order = sorted(range(len(fps)), key=lambda i: seen[1][i]["doc_id"])
    root = {i: i for i in order}
    for a in order:
        for b in order:
            if bin(fps[a] ^ fps[b]).count("1") <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]), key=lambda i: seen[1][i]["doc_id"])
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in seen[2]} == {seen[1][i]["doc_id"] for i in set(root.values())}
    assert {r["doc_id"] for r in seen[3]} == {r["doc_id"] for r in seen[2] if not contained(r["text"], items)}
    assert {r["doc_id"] for r in seen[4]} == {r["doc_id"] for r in seen[3]}
    assert sorted(r["doc_id"] for r in seen[5]) == mixed([(r["doc_id"], r["text"], r["source"]) for r in seen[4]])
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, seen[5]))
