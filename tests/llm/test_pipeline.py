import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from linkweave.llm.decontamination import contamination_report, without_benchmark
from linkweave.llm.minhash import near_duplicates, without_near_duplicates
from linkweave.llm.common import BATCH_BYTES, small_batches, table
from linkweave.llm.toxicity import without_toxic
from tests.llm.samples import docs, prose, texts

SF = "/root/testdata/sf0.001"


def test_registered():
    names = queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in oracle_sql()


def test_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name == "near_dedup":
            assert docs.count() == near_duplicates(before).where("kept").count()
        if name == "decontamination":
            assert docs.count() == contamination_report(before, table(spark, SF, "benchmark")).where("not contaminated").count()
        if name != "sharding":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


BENCH = "item_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def stored(spark, folder, documents, labels=(), benchmark=()):
    for name, df in (
        ("documents", documents), ("labels", spark.createDataFrame(list(labels), LABELS)),
        ("benchmark", spark.createDataFrame(list(benchmark), BENCH)),
    ):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_empty_tables_go_through(spark, tmp_path):
    sf = stored(spark, tmp_path, docs(spark, []))
    empty = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.collect() == [] and (name == "sharding" or out.columns == empty.columns)
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_awkward_rows_and_clashing_columns_go_through(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns named as the stages name theirs."""
    leaked = "zeta eta theta iota kappa lamda mu nu xi omicron pi"
    data = texts() + [(50, f"before {leaked} after"), (51, leaked)]
    data += [(1000 + i, f"{prose(500 + i, 40)} {'grumblor' if i % 2 else ''} {prose(700 + i, 30)}") for i in range(30)]
    labels = [(1000 + i, 0, i % 2) for i in range(30)] + [(None, None, None), (1, None, 0)]
    sf = stored(spark, tmp_path, docs(spark, data), labels, [(1, leaked), (2, None), (3, "")])
    given = table(spark, sf, "documents")
    rest = given
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, rest = rest, stage(spark, rest, sf)
        assert rest.schema.names == given.schema.names, name
        rest = spark.createDataFrame(rest.collect(), rest.schema)
        assert rest.exceptAll(before).isEmpty(), name
    ids = {r["doc_id"] for r in rest.collect()}
    assert not ids & {50, 51} and not ids & {3} and {4, 8, 12} <= ids
    kept = corpus_pipeline.run(spark, sf).collect()
    slots = {}
    for r in kept:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert kept and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 or len(slots) < 24


def test_texts_are_handed_to_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1600).alias("text"))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    few = docs.limit(3)
    operators = [
        lambda: without_toxic(few, labels), lambda: without_near_duplicates(few), lambda: without_benchmark(few, items),
    ]
    try:
        for operator in operators:
            spark.conf.unset(setting)
            operator()
            handed = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in handed) == 3000 and max(r.bytes for r in handed) < 2 * BATCH_BYTES
        for held, left in [("100000b", "100000b"), ("1m", "1m"), ("1g", str(BATCH_BYTES))]:
            spark.conf.set(setting, held)
            small_batches(spark)
            assert spark.conf.get(setting).removesuffix("b") == left.removesuffix("b")
    finally:
        spark.conf.unset(setting)
