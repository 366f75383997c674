"""The corpus pipeline and the registered queries."""

import zlib

import pytest

import corpus_pipeline as cp
from corpusloom.llm import queries, secretscan
from corpusloom.llm.queries import tokenizer_path

from .cases import ROWS, frame

SF = "/root/testdata/sf0.001"


def test_stages_and_their_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialize(stage(spark, docs, SF))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert not any(secretscan.find(r["text"] or "") for r in docs.collect())
    packed = cp.STAGES[-1][1](spark, docs, SF)
    library = __import__("tokenizers").Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, len(p), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p))) for k, p in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    got = [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_every_stage_stands_any_rows(spark, rows):
    docs = frame(spark, rows)
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).collect()


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in queries.QUERIES] or len(queries.QUERIES) == 10
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
