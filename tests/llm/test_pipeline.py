"""The pipeline's stages, each against brute force on what the stage before kept."""

from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F
from test_native_ops import brute_decontam, brute_mix, jump
from test_python_ops import brute_components, brute_fingerprint

from proofsheet.llm import quality
from proofsheet.llm.queries import GRADE, GRADE_KEEP, MIX_SEED, TAIL_KEEP

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "component_id"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest tables, with copies, a benchmark passage, rows without text, id, language or source, and an
    extra column named like an operator's own."""
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items.write.parquet(f"{sf}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    leak = items.where(F.length("text") > 80).orderBy("item_id").first()["text"]
    rows += [(10_000 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows[:20])] + rows[30:33]
    rows += [(20_000, f"{rows[40][1]} {leak}", "en", "src1", 0), (20_001, None, "en", "src0", None), (20_002, "", None, None, 0),
             (20_003, " \n", "de", "elsewhere", 0), (20_004, f"{rows[41][1]} " * 300, None, "src2", 0), (None, rows[42][1] + " once", "fr", "src3", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    spark.createDataFrame([(*r, "mine") for r in rows], schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    return sf


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.columns == (COLUMNS if name != "shard" else [*COLUMNS, "shard"])
        out.write.parquet(str(tmp_path / name))
        kept[name] = (as_rows(docs), docs := spark.read.parquet(str(tmp_path / name)))

    before, after = kept["quality"]
    model = quality.train(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"), F.expr(GRADE))
    features, first = quality.Features(), model.grades.index(GRADE_KEEP)

    def passes(text):
        index, value = features(text)
        return 1.0 - model.below((model.weights[index] * value).sum().reshape(1))[0, first - 1] >= TAIL_KEEP

    assert Counter(as_rows(after)) == Counter(r for r in before if passes(r[1]))

    before, after = kept["simhash"]
    prints = [brute_fingerprint(r[1]) for r in before]
    roots = brute_components(prints, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    groups = {}
    for r, root in zip(before, roots):
        groups.setdefault(root, []).append(r)
    after = as_rows(after)
    assert len(after) == len(groups) < len(before)
    assert Counter(r[0] for r in after) == Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())
    assert not Counter(after) - Counter(before)

    before, after = kept["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r, d in zip(before, brute_decontam([r[:2] for r in before], items)) if not d[-1]]
    assert Counter(as_rows(after)) == Counter(clean) and len(clean) < len(before)

    before, after = kept["mix"]
    wanted = Counter(i for i, _ in brute_mix(before, corpus_pipeline.BUDGET_SHARE, 1, MIX_SEED))
    assert Counter(r[0] for r in as_rows(after)) == wanted and sum(wanted.values()) < len(before)

    before, after = kept["shard"]
    assert Counter(before) == Counter(as_rows(after))
    for r in after.where("doc_id is not null").collect():
        assert r["shard"] == jump(xxhash.xxh64_intdigest(str(r["doc_id"]).encode(), seed=42), corpus_pipeline.SHARDS)


def test_run_of_an_empty_table(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
