import brute
import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
from compare import compare
from scoreloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check(spark, sf_dir, duck, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck, queries.CHECKS[name]) is None


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in entry_points.queries() if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in entry_points.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_their_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mix":
            assert out.columns == docs.columns
        docs = out.cache()
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "quality":
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.97 * len(good)
        if name == "near_duplicates":
            found = brute.near_copies(sorted(before.items()))
            assert sorted(after) == sorted({c for _, _, c in found})
        if name == "decontamination":
            assert sorted(after) == sorted(r[0] for r in brute.contaminated(sorted(before.items()), items) if not r[4])
        if name == "personal_data":
            assert after.keys() == before.keys()
            for i, text in before.items():
                if brute.personal(text):
                    assert after[i]["text"] != text and not brute.personal(after[i]["text"])
                    assert after[i]["n_chars"] == len(after[i]["text"])
                else:
                    assert after[i]["n_chars"] == len(after[i]["text"])
        if name == "mix":
            assert after.keys() == before.keys()
            assert all(0 <= r["taken"] <= 3 * r["size"] for r in after.values())
        before = {i: r.get("text") for i, r in after.items()}
