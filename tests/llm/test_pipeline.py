"""The stages on the smallest tables, each on its predecessor's output, against brute force."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest

from .test_exact_and_packing import brute_tokens, stripped
from .test_near_and_suffix import brute_components

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return spark.read.parquet(f"{DIR}/documents.parquet"), out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_shrinking(outputs):
    docs, out = outputs
    sizes = [docs.count(), *(x.count() for x in out[:-1])]
    assert all(x.columns == docs.columns for x in out[:-1]) and sizes == sorted(sizes, reverse=True)
    assert sizes[-1] > 0.5 * sizes[0]


def test_quality_rejects_junk_and_keeps_the_rest(spark, outputs):
    kept = set(by_id(outputs[1][0]))
    rows = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in rows) / len(rows) > 0.9


def test_exact_stage(outputs):
    before, after = by_id(outputs[1][0]), by_id(outputs[1][1])
    groups = {}
    for i, r in before.items():
        groups.setdefault(stripped(r.text), []).append((-len(r.text), i))
    assert set(after) == {min(g)[1] for g in groups.values()}


def test_near_stage(outputs):
    before, after = by_id(outputs[1][1]), by_id(outputs[1][2])
    ids = sorted(before)
    roots, _ = brute_components([before[i].text for i in ids], 5, 80)
    assert set(after) == {ids[x] for x in set(roots)}


def test_packing_stage(outputs):
    docs, pieces = by_id(outputs[1][3]), outputs[1][4].collect()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(brute_tokens(d.text)) for i, d in docs.items()}


def test_run_is_the_stages(spark, outputs):
    assert pipeline.run(spark, DIR).count() == outputs[1][4].count()


def odd_rows(spark):
    from .conftest import make, prose

    rng = __import__("random").Random(8)
    text = prose(rng, 60)
    rows = make(spark, [None, "", " \n", text, text, text.replace(" ", "  "), prose(rng, 30_000), "x" * 20_000, *(prose(rng, 50) for _ in range(12))])
    return rows.unionByName(rows.where("doc_id in (3, 9)"))


def test_every_stage_takes_odd_rows_and_keeps_all_columns(spark):
    docs = odd_rows(spark)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != "packing":
            assert out.columns == docs.columns, name
            kept = {r.doc_id for r in out.collect()}
            assert kept <= set(range(20)) and {9, 10, 11} <= kept, name
        else:
            assert {r.doc_id for r in out.collect()} == set(range(20))


def test_every_stage_takes_an_empty_table(spark, empty):
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0, name


def test_mixing_asks_for_what_is_left(spark, recwarn):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = pipeline.quality_stage(spark, docs, "/root/testdata/sf0.01")
    out = pipeline.mixing_stage(spark, left, "/root/testdata/sf0.01")
    assert not [w for w in recwarn if "out of reach" in str(w.message)]
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in (left, out))
    clean = [i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert sum(i in after for i in clean) >= 0.98 * len(clean)
