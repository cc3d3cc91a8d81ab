"""The corpus pipeline stage by stage and as a whole."""

from __future__ import annotations

import corpus_pipeline
from sylvameter.llm import contamination
from sylvameter.sources.tables import table


def test_stages_keep_columns_and_decide(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    extra = spark.createDataFrame(
        [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 !!", "en", "src0", 5), (10**6 + 2, "", None, None, 0)], docs.schema
    )
    docs, columns, kept = docs.unionByName(extra), docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if i < 4:
            assert docs.columns == columns and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType
        if name == "near_dedup":
            assert len(kept[name]) == docs.count()
        if name == "decontamination":
            assert contamination.find_leaks(docs, table(spark, data, "benchmark")).count() == 0 and len(kept[name]) < before.count()
    assert not kept["language_id"] & {10**6, 10**6 + 1, 10**6 + 2}
    assert kept["packing"] == kept["decontamination"]
    whole = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == kept["packing"]


def test_the_rest_does_not_need_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    hide = "import sys; sys.modules['sylvameter.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", hide], cwd=root).returncode == 0
    others = [p for p in (root / "sylvameter").rglob("*.py") if "llm" not in p.parts]
    assert others and not any("sylvameter.llm" in p.read_text() for p in others)


def test_stages_take_clashing_names_null_ids_and_long_texts(spark, data, tmp_path):
    """Columns with the names that operators use are carried; rows without an id, repeated ones and long ones count each."""
    from pyspark.sql import functions as F

    docs = table(spark, data, "documents").limit(60)
    alone = docs.orderBy("doc_id").limit(3).collect()
    long = " ".join(f"{r.text}" for r in docs.collect()) + " " * 20_000 + "end"
    extra = [(None, alone[0].text + " and more words of its own that nobody else has in any text at all", "en", None, 1), (10**6, long, "en", "srcX", 1), (10**6, long, "en", "srcX", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name in ("score", "lang_pred", "fit", "n_lines", "n_removed", "places", "__doc_id", "key_", "node_", "text_", "row"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    wanted, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == wanted
        kept[name] = docs.count()
        assert docs.where("n_lines <> 'own n_lines' or score <> 'own score' or key_ <> 'own key_' or __doc_id <> 'own __doc_id'").count() == 0
    assert kept["language_id"] == 63 and kept["line_dedup"] >= 62
    before = spark.read.parquet(str(tmp_path / "line_dedup"))
    after = spark.read.parquet(str(tmp_path / "near_dedup"))
    assert before.where(f"doc_id = {10**6}").count() == 2 and after.where(f"doc_id = {10**6}").count() == 1
    pieces = corpus_pipeline.pack(spark, docs, data)
    assert pieces.select("doc_id", "doc_tokens").distinct().count() > 0
