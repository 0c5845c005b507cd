import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import attribution, byte_bpe, common, context_mixing, licences, merkle, mixing, periodic_runs, phrases, pii, quality, simhash, toxicity


def test_slices_are_bounded_by_rows_and_bytes_and_lose_nothing():
    texts = ["x" * n for n in (10, 5_000, 3, 9_000, 1, 1, 20_000)] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), rows=64, most=10_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 64 and (p.num_rows == 1 or p.nbytes <= 10_000) for p in parts)


def test_own_names_clash_with_none(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, _X int, __x int")
    assert common.own_names(df, "_x", "b", "_x") == ["___x", "b", "____x"]


WORDS = "the river and the stone walk under green hills often with bread and water for all who come"


@pytest.mark.parametrize("clash", ["_text", "_lang", "_of", "KEPT", "_mix_n", "_MIX_KEY", "_mix_source", "_turn", "_times", "_size", "Taken", "N_tokens"])
def test_extra_columns_may_bear_any_name(spark, clash):
    rows = [(i, f"{WORDS} {i}", "en", "s", 7) for i in range(5)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, `{clash}` int")
    for out in (quality.quality_rules(df), byte_bpe.encode_documents(df), mixing.mix_sources(df.withColumn("words", F.lit(10)), size="words")):
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and out.count() == 5
        if clash in out.columns and clash not in ("Taken", "N_tokens", "KEPT"):
            assert {r[clash] for r in out.collect()} == {7}
    for most in (0, 256):
        assert quality.quality_rules(df, most=most).filter("kept").count() == quality.quality_rules(df).filter("kept").count()
    times = mixing.repetitions(mixing.mix_sources(df.withColumn("words", F.lit(10)), size="words"), "words", ["doc_id"])
    assert times.count() >= 5


def test_decoding_gives_the_texts_back(spark):
    rows = [(1, "The river — été 日本 \U0001f600"), (2, ""), (3, None), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = byte_bpe.decode_documents(byte_bpe.encode_documents(df))
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == sorted((i, t or "") for i, t in rows)
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(df.limit(0))).count() == 0
    cut = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in byte_bpe.decode_documents(cut).collect()] == ["", ""]


ODD_NAMES = ["a.b", "x`y", "two words", "`", ".", "doc_id.text", "ünï(1)", "N_Chars "]


def odd_table(spark):
    rows = [(i, f"{WORDS} {i} call +49 30 1234567 " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 7, *[11] * len(ODD_NAMES)) for i in range(6)]
    columns = ", ".join("`" + n.replace("`", "``") + "` int" for n in ODD_NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")


def test_every_operator_takes_columns_of_any_name(spark):
    df = odd_table(spark)
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    keeping = [quality.quality_rules(df), byte_bpe.encode_documents(df), byte_bpe.decode_documents(byte_bpe.encode_documents(df)), mixing.mix_sources(df.withColumn("words", F.lit(10)), size="words"), pii.mask_personal_data(df), simhash.one_of_each(df), periodic_runs.periodic_runs(df), phrases.document_fingerprints(df)]
    for out in keeping:
        assert set(ODD_NAMES) <= set(out.columns) and out.count() == 6
        assert {r[n] for r in out.collect() for n in ODD_NAMES} == {11}
    for out in (pii.find_personal_data(df), attribution.section_tokens(df), licences.scan_licences(df), simhash.near_duplicates(df), phrases.compare_with_next(df), merkle.verify_documents(df)):
        assert out.count() == 6
    assert context_mixing.score_texts(df).count() == 6
    assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)).count() == 6


def test_every_stage_takes_columns_of_any_name(spark):
    docs = odd_table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert set(ODD_NAMES) <= set(out.columns) and {r[n] for r in out.collect() for n in ODD_NAMES} == {11}, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
