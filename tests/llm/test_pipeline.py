"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import common, packing, pii, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out = [common.table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    for df in stages[1:5]:
        assert df.schema.names == stages[0].schema.names and [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_each_decision(spark, stages):
    docs, calm, good, single, clean, packed = stages
    model = toxicity.fit(docs, common.table(spark, SF, "labels"))
    scorer = model.scorer()
    assert sorted(ids(calm)) == sorted(r.doc_id for r in docs.collect() if scorer.score(r.text) < toxicity.THRESHOLD)
    assert sorted(ids(good)) == sorted(r.doc_id for r in quality.judge(calm).where("kept").collect())
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(good).collect()}
    assert sorted(ids(single)) == sorted(set(groups.values()))
    field = pii.trained()
    want = {r.doc_id: pii.cover(r.text, pii.find(r.text, field)[1]) for r in single.collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {}
    for r in packed.orderBy("start").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for d, text in want.items():
        whole = np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in rows[d]])
        assert whole.tolist() == t.encode(text, add_special_tokens=False).ids + [1]
        assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes()) for r in rows[d])


def whole(packed):
    """Each document's pieces in order: start, tokens so far, and the checksums of its whole id sequence."""
    out = {}
    for r in packed.select("doc_id", "start", "length", "doc_tokens", "ids").collect():
        out.setdefault(r.doc_id, []).append(r)
    return {k: (b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.start)), v[0].doc_tokens) for k, v in out.items()}


def test_run_gives_the_same(spark, stages):
    """The whole pipeline at once gives the documents and ids of the stages one by one."""
    got, want = whole(corpus_pipeline.run(spark, SF)), whole(stages[-1])
    assert got == want and len(got) == stages[4].count() > 100
    assert all(len(ids) == 2 * n for ids, n in got.values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone_id int, component long, spans string"


def odd_tables(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(1, 40)] + [(None, 1, 1), (3, None, None), (10**9, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, copies, shared ids, more columns with clashing names."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdeiklmnorst"), rng.integers(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    a, b = prose(120), prose(90) + " mail anna.02@mail.example.com"
    rows = [(i, prose(80), "en", "s", 1, 0.5, 1, 1, "x") for i in range(20, 60)]
    rows += [(1, a, "en", "s", 1, None, None, None, None), (1, a, "en", "s", 1, None, None, None, None), (2, a, None, None, None, None, None, None, None), (2, b, "en", "t", 1, 0.1, 2, 3, "y")]
    rows += [(None, a, "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, None, "en", "s", 1, None, None, None, None), (4, "", "en", "s", 0, None, None, None, None)]
    rows += [(5, " ".join(prose(50) for _ in range(800)), "de", "s", 1, None, None, None, None), (6, "x" * 30_000, "de", "s", 1, None, None, None, None)]
    sf = odd_tables(spark, tmp_path, rows)
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, docs, sf), name)
        assert after.schema.names == docs.schema.names and after.count() <= docs.count()
        docs = after
    kept = docs.collect()
    assert {(r.doc_id, r.text) for r in kept if r.doc_id in (1, 2)} == {(1, a), (2, b.replace("anna.02@mail.example.com", "[EMAIL]"))}
    assert sum(r.doc_id == 1 for r in kept) == 1 and any(r.doc_id is None and r.text == a for r in kept) and any(r.doc_id == 5 for r in kept)
    got = whole(corpus_pipeline.run(spark, sf))
    assert set(got) == {r.doc_id for r in kept}


def test_an_empty_table_stays_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0
