"""The pipeline's stages, one after the other, against plain versions of what each must do."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", "en", "src0", 5), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    out.append(docs)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_only_texts_without_language_go(stages):
    assert sorted(set(ids(stages[0])) - set(ids(stages[1]))) == [10**6, 10**6 + 1, 10**6 + 2]


def test_one_document_of_each_group_stays(stages):
    from test_text_operators import plain_components, plain_print

    rows = [(r["doc_id"], plain_print(r["text"])) for r in stages[1].collect()]
    part, least = plain_components([p for _, p in rows]), {}
    for i, p in rows:
        least[part[p]] = min(least.get(part[p], i), i)
    assert ids(stages[2]) == sorted(least.values())


def test_personal_data_is_gone(stages):
    from test_text_operators import plain_spans

    assert ids(stages[2]) == ids(stages[3])
    assert any(plain_spans(r["text"]) for r in stages[2].collect())
    assert not any(plain_spans(r["text"]) for r in stages[3].collect())
    assert stages[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_the_mix_is_a_part_and_all_of_it_is_encoded(stages):
    assert set(ids(stages[4])) < set(ids(stages[3]))
    assert ids(stages[5]) == ids(stages[4]) and stages[5].where("size(ids) <> n_tokens").count() == 0


def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_run_on_an_empty_table_and_on_repeated_rows_long_texts_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    odd = docs.schema.add("_source", "string").add("row", "integer").add("hash", "string").add("domain", "string").add("lang_pred", "string").add("component_id", "long").add("spans", "string").add("text_", "string")
    some = docs.limit(60).collect()
    rows = [(*r, "s", 1, "h", "d", "l", 2, "x", "y") for r in [*some, *some[:9]]]
    rows += [(None, "a short text without an id that stays", "en", None, 5, *rows[0][5:]), (10**7, "the weather with that other thing there " * 20_000, "en", "src1", 9, *rows[0][5:]), (10**7 + 1, None, None, None, None, *rows[0][5:])]
    spark.createDataFrame(rows, odd).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    whole = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, whole, SF)
        assert after.columns == whole.columns
        after.write.mode("overwrite").parquet(str(tmp_path / "next"))
        whole = spark.createDataFrame(spark.read.parquet(str(tmp_path / "next")).collect(), whole.schema)
    got = [r["doc_id"] for r in pipeline.run(spark, str(tmp_path / "odd")).collect()]
    assert got and len(got) == len(set(got)) and set(got) <= {r[0] for r in rows}


def test_python_gets_rows_in_small_batches_and_all_of_them(spark, tmp_path):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" the weather of this other thing"), 128)).alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    one = spark.createDataFrame([(10**6, "a long word " * 200_000, "en", "src0", 0)], long.schema)  # more than a batch by itself
    long = long.unionByName(one).coalesce(1).cache()

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes]), pa.array([max(len(t.as_py()) for t in b.column(1))])], names=["n", "bytes", "longest"])

    for name, stage in (s for s in pipeline.STAGES if s[0] in ("language_id", "near_duplicates", "byte_bpe")):
        spark.conf.unset(key)
        stage(spark, docs, SF)
        seen = long.select("doc_id", "text").mapInArrow(sizes, "n long, bytes long, longest long").collect()
        assert sum(r["n"] for r in seen) == 2001, name
        assert max(r["bytes"] - r["longest"] for r in seen) < 1.1 * pipeline.BATCH_BYTES, name
    coded = {r[0]: r[1] for r in pipeline.encode(spark, long, SF).select("doc_id", F.hex("decoded_sha256")).collect()}
    assert coded == {r[0]: r[1] for r in long.select("doc_id", F.hex(F.sha2(F.col("text").cast("binary"), 256))).collect()}
    spark.conf.set(key, "3m")  # a setting that is there holds
    pipeline.encode(spark, docs, SF)
    assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)
