import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.llm import exact_dedup as E
from strandwise.llm import packing as P


def stripped(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_groups_against_brute_force(docs, texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(stripped(t), []).append((-len(t or ""), i))
    for r in E.groups(docs).collect():
        group = groups[stripped(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(group)[1], len(group), min(group)[1] == r.doc_id)
        assert r.digest == hashlib.sha256(stripped(texts[r.doc_id]).encode()).digest()


def test_one_row_of_each_group_stays_with_all_columns(docs, texts):
    kept = E.deduplicate(docs.union(docs))
    assert kept.columns == docs.columns
    assert kept.count() == len({stripped(t) for t in texts})


def test_empty_table_and_null_ids(spark, docs, empty):
    assert E.groups(empty).count() == 0 and E.deduplicate(empty).count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert E.groups(odd).count() == docs.where("doc_id > 3").count()


def test_rows_of_different_texts_that_share_a_doc_id_are_told_apart(spark):
    from .conftest import make

    rows = make(spark, ["aaa", "bbb", "b b b", "b  bb", "bbb", "ccc"]).withColumn("doc_id", F.when(F.col("doc_id") < 5, 1).otherwise(2).cast("long"))
    assert sorted(r.text for r in E.deduplicate(rows).collect()) in (["aaa", "b b b", "ccc"], ["aaa", "b  bb", "ccc"])


def test_filter_keeps_all_it_holds_and_forgets_what_is_deleted():
    rng = random.Random(1)
    held, live = E.CuckooFilter(2000), set()
    for _ in range(5000):
        key = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if key in live:
            assert held.delete(key)
            live.remove(key)
        else:
            assert held.insert(key)
            live.add(key)
    again = E.CuckooFilter(held=held.to_bytes())
    for one in (held, again):
        assert all(k in one for k in live)
        assert sum(hashlib.sha256(f"x{i}".encode()).digest() in one for i in range(20_000)) < 40
    for k in live:
        again.delete(k)
    assert not any(again.slots)


def test_an_overflow_builds_a_larger_filter_from_the_stored_keys():
    index = E.DigestIndex(16)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.put(k, 1, i)
    assert index.resizes > 0 and set(index.store) == set(keys) and all(k in index.filter for k in keys)


LIVE = "digest binary, n_chars long, doc_id long, rows long"


def records(index):
    return {bytes(r.digest): (r.keep_id, r.group_size) for r in index.records().collect()}


def test_deleting_the_kept_document_brings_the_next_best_forward(spark):
    d = [bytes([i]) * 32 for i in range(4)]
    index = E.start_index(spark.createDataFrame([(d[0], 5, 1), (d[0], 4, 2), (d[1], 6, 2)], "digest binary, n_chars long, doc_id long"), 3)
    assert records(index) == {d[0]: (1, 2), d[1]: (2, 1)}
    changes = [(d[0], 5, 1, -1), (d[1], 6, 2, -1), (d[2], 3, 3, 1), (d[3], 1, 1, -1), (d[0], 4, 9, -1)]
    index = E.maintain(index, spark.createDataFrame(changes, LIVE))
    assert records(index) == {d[0]: (2, 1), d[2]: (3, 1)}
    index = E.maintain(index, spark.createDataFrame([(d[0], 9, 7, 1)], LIVE))
    assert records(index) == {d[0]: (7, 2), d[2]: (3, 1)}


def test_batches_of_changes_against_brute_force(spark):
    rng = random.Random(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(400)]
    index, live = E.start_index(spark.createDataFrame([], "digest binary, n_chars long, doc_id long"), 2), {}
    for _ in range(3):
        changes = {}
        for _ in range(500):
            row = (rng.choice(keys), rng.randrange(3), rng.randrange(4))
            changes[row] = rng.choice([1, 1, 2, -1, -5])
        index = E.maintain(index, spark.createDataFrame([(*k, n) for k, n in changes.items()], LIVE))
        for row, n in changes.items():
            if (total := max(0, live.get(row, 0) + n)) > 0:
                live[row] = total
            else:
                live.pop(row, None)
        expected = {}
        for (k, chars, doc), n in live.items():
            expected.setdefault(k, []).append((-chars, doc, n))
        assert records(index) == {k: (min(v)[1], sum(x[2] for x in v)) for k, v in expected.items()}
    filters = {r.bucket: E.CuckooFilter(held=bytes(r.slots)) for r in index.filters.collect()}
    buckets = {bytes(r.digest): r.b for r in index.live.select("digest", E.bucket_of(2).alias("b")).collect()}
    assert all(k in filters[b] for k, b in buckets.items())
    assert sum(len(x) for f in filters.values() for x in f.slots) == len(buckets)


def brute_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_put_together_give_every_document(docs, texts):
    rows = P.pack(docs, window=256).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in r.token_ids]
        assert ids == brute_tokens(t)
        assert all(r.doc_tokens == len(ids) for r in by_doc[i])
        for r in by_doc[i]:
            assert r.from_before == (r.start > 0) and r.goes_on == (r.start + r.length < r.doc_tokens) and r.length == len(r.token_ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, some in by_seq.items():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == some[0].sequence_tokens and (at == 256 or seq == max(by_seq))


def test_checksums_are_of_the_ids(docs):
    import numpy as np

    whole = {(r.doc_id, r.start, r.length): zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in P.pack(docs).collect()}
    assert whole == {(r.doc_id, r.start, r.length): r.ids_crc32 for r in P.pack(docs, ids="crc32").collect()}


def test_special_tokens_in_a_text_are_found(spark):
    from .conftest import make

    rows = P.pack(make(spark, ["hello <|endoftext|> there"])).collect()
    assert [x for r in rows for x in r.token_ids] == [31373, 220, 50256, 612, 1]


def test_packing_nothing(empty):
    assert P.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> is text", "hello <|endoftext|> there", "<|endoftext|><|endoftext|>\n<|endof",  " " * 3000 + "x", "x" * 3000, "\u0000\n\n\ttab"])
def test_fast_and_slow_encoders_agree(text):
    assert P.public_encoder()(text).tolist() == brute_tokens(text)[:-1]


def test_buckets_grow_from_an_empty_start_and_small_batches_rewrite_few(spark):
    from pathlib import Path

    rng = random.Random(11)
    live: dict = {}
    index = E.start_index(spark.createDataFrame([], "digest binary, n_chars long, doc_id long"), bucket_size=40)
    assert index.buckets == 1
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    for batch in range(7):
        some = Counter()
        for _ in range(150 if batch < 5 else 3):
            key = rng.choice(keys)
            some[key, len(key), rng.randrange(3)] += rng.choice([1, 1, 1, -1])
        for k, n in some.items():
            left = live.get(k, 0) + n
            live.pop(k, None)
            if left > 0:
                live[k] = left
        before = index
        index = E.maintain(index, spark.createDataFrame([(*k, n) for k, n in some.items()], LIVE))
        assert {(bytes(r.digest), r.n_chars, r.doc_id): r["rows"] for r in index.live.collect()} == live
        assert sum(index.sizes.values()) == len(live) <= 2 * 40 * index.buckets
        held = {r.bucket: E.CuckooFilter(held=r.slots) for r in index.filters.collect()}
        spread = {bytes(r.digest): r.bucket for r in index.live.select("digest", E.bucket_of(index.buckets).alias("bucket")).collect()}
        assert all(d in held[b] for d, b in spread.items())
        if batch >= 5:
            assert index.buckets == before.buckets >= 4
            written = index.live_rows.tables[-1].inputFiles()
            assert len({Path(f).parent.name for f in written}) <= 3 and len(index.live_rows.tables) == len(before.live_rows.tables) + 1
    assert E.maintain(index, spark.createDataFrame([], LIVE)) is index


def test_an_index_of_many_versions_is_written_as_one(spark):
    index = E.start_index(spark.createDataFrame([], "digest binary, n_chars long, doc_id long"), 4)
    for i in range(E.TABLES + 2):
        index = E.maintain(index, spark.createDataFrame([(hashlib.sha256(bytes([i])).digest(), 1, i, 1)], LIVE))
    assert len(index.live_rows.tables) <= E.TABLES and sorted(r.doc_id for r in index.live.collect()) == list(range(E.TABLES + 2))
