import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import align as A
from strandwise.llm import fim, queries
from strandwise.llm import sharding as S

from .conftest import make

SMALLEST = "/root/testdata/sf0.001"

# --- sharding ------------------------------------------------------------------------------------------------------------


def check_shards(rows, texts, shards=16):
    """Every row once, sizes as they are, slots without gaps. -> bytes of each shard"""
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    of: dict[int, list] = {s: [] for s in range(shards)}
    for r in rows:
        of[r.shard].append(r)
    for held in of.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return [sum(r.size for r in held) for held in of.values()]


def test_shards_are_near_equal(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    loads = check_shards(S.shard(docs.repartition(7)).collect(), texts)
    largest, mean = max(len((t or "").encode()) + 1 for _, t in texts), sum(loads) / 16
    assert max(loads) <= max(mean * (1 + S.SLACK), mean + largest) and min(loads) >= 0.95 * mean


def test_one_doc_id_with_a_third_of_all_rows_is_spread(spark):
    texts = [(5 if i % 3 == 0 else 1000 + i, "same" if i % 6 == 0 else f"text number {i}") for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    loads = check_shards(S.shard(docs).collect(), texts)
    assert max(loads) <= 1.01 * sum(loads) / 16 and min(loads) >= 0.98 * sum(loads) / 16


def test_shards_of_odd_rows(docs, texts, empty, spark):
    assert S.shard(empty).count() == 0
    check_shards(S.shard(docs).collect(), list(enumerate(texts)))
    check_shards(S.shard(docs.union(docs)).collect(), [*enumerate(texts), *enumerate(texts)])
    check_shards(S.shard(make(spark, ["x"])).collect(), [(0, "x")])
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert S.shard(odd).count() == docs.where("doc_id > 3").count()


def test_written_shards_hold_the_texts(docs, texts, spark, tmp_path):
    S.write_shards(docs, f"{tmp_path}/out", shards=3)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted((i, t or "") for i, t in enumerate(texts))
    assert {r["shard"] for r in found.select("shard").distinct().collect()} <= {0, 1, 2}


def plainly_placed(weights, shards, cells, nodes, slack):
    """The same rule node by node."""
    places, owner = S.ring_of(shards, cells, nodes)
    bound, load, out = sum(w for _, _, w in weights) * (1 + slack) / shards, Counter(), {}
    for cell, part, weight in sorted(weights, key=lambda x: (-x[2], x[0], x[1])):
        home = next((i for i, x in enumerate(places) if x >= cell), 0)
        order = owner[home:] + owner[:home]
        to = next((s for s in order if load[s] + weight <= bound), min(range(shards), key=lambda s: (load[s], s)))
        load[to] += weight
        out[cell, part] = to
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 63), st.integers(0, 2), st.integers(1, 50)), unique_by=lambda x: x[:2]), st.integers(1, 6))
def test_placing_against_the_plain_rule(weights, shards):
    assert S.place(weights, shards, 64, 4, 0.05) == plainly_placed(weights, shards, 64, 4, 0.05)


def test_one_more_shard_moves_little():
    rng = random.Random(3)
    weights = [(cell, 0, rng.randrange(900, 1100)) for cell in range(S.CELLS)]
    before, after = S.place(weights, 16), S.place(weights, 17)
    moved = sum(w for cell, _, w in weights if before[cell, 0] != after[cell, 0]) / sum(w for _, _, w in weights)
    assert 1 / 17 * 0.9 < moved < 0.2


# --- fill in the middle -----------------------------------------------------------------------------------------------------


def plainly_cut(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digits = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_lines():
    rng = random.Random(2)
    passage = "\n".join("".join(rng.choice("abcdé 😀") for _ in range(rng.randrange(60))) for _ in range(200))
    return ["\n", "\n\n\n", "no break", "ends in one\n", "a\r\nb\rc\n", "<", "x<\n<S\n<P>", "a <M> b\nc", "é\n" * 3000, "y" * 30_000 + "\n" + "z" * 30_000, *(passage[i:] + "\n" * (i % 3) for i in range(0, 9000, 700)), passage * 30, *("<\nS>\n<P\n>" for _ in range(9))]


def test_cuts_against_brute_force(spark, texts):
    every = [*texts, *odd_lines()]
    rows = fim.transform(make(spark, every).repartition(3)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(every)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly_cut(r.doc_id, every[r.doc_id])
        assert r.again == (every[r.doc_id] or "")


def test_rates(spark):
    rows = make(spark, ["a\nb\nc\n"] * 400)
    assert fim.transform(rows, rate=0).where("form <> 'plain'").count() == 0
    assert 120 < fim.transform(rows, rate=50, spm=100).where("form = 'spm'").count() < 280
    assert fim.transform(rows, spm=0).where("form = 'psm'").count() == 400


def test_cuts_of_an_empty_table_and_null_ids(docs, empty):
    assert fim.transform(empty).count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert fim.transform(odd).count() == docs.where("doc_id > 3").count()


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 5))
def test_chunks_follow_from_what_is_near(data, seed):
    shared = random.Random(seed).randbytes(40_000)
    ends = fim.chunk_ends(data + shared)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) + 40_000 and sizes.max() <= fim.MOST and (len(sizes) == 1 or sizes[:-1].min() >= fim.LEAST)
    # From some place on the chunks of a shared passage are the same whatever stands before.
    own = {x - len(data) for x in ends if x > len(data) + 20_000}
    assert own == {x for x in fim.chunk_ends(shared) if x > 20_000}


def test_chunks_don_t_depend_on_how_much_is_hashed_at_a_time(monkeypatch):
    data = random.Random(1).randbytes(50_000)
    whole = fim.chunk_ends(data).tolist()
    monkeypatch.setattr(fim, "SPAN", 777)
    assert fim.chunk_ends(data).tolist() == whole


def test_summaries_are_met_again_and_bounded():
    cache = fim.Summaries(16)
    passage = random.Random(4).randbytes(60_000).replace(b"\x00", b"\n")
    first = fim.Lines(b"one\n" + passage, cache)
    made = cache.made
    cache.most = 10_000
    again = fim.Lines(b"another\nbeginning\n" + passage, cache)
    assert first.n + 1 == again.n and made > 30
    warm = fim.Summaries()
    fim.Lines(passage, warm)
    made = warm.made
    fim.Lines(b"other " + passage, warm)
    assert warm.made - made < made / 3
    small = fim.Summaries(4)
    for i in range(100):
        small.of(b"%d\n" % i)
    assert len(small.young) <= 4 and len(small.old) <= 4


def test_twin_of_fim(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALLEST}/documents.parquet'")
    ours, theirs = queries.op12_fim(spark, SMALLEST).toPandas(), con.execute(queries.ORACLE_SQL["op12_fim"]).df()
    key = lambda f: sorted(tuple(map(repr, r)) for r in f[sorted(f.columns)].astype(object).values.tolist())
    assert key(ours) == key(theirs)


# --- alignment ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of():
    """The byte for each letter that stands for one in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plainly_aligned(tokenizers, text):
    """ids of both, and the groups as lists of ids."""
    a, b = tokenizers
    letters = byte_of()
    ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
    spelt = (" " + (text or "")).encode()
    if not text or b"".join(bytes_a) != spelt or b"".join(bytes_b) != spelt:
        return [], [], None
    ends = lambda pieces: [sum(map(len, pieces[: i + 1])) for i in range(len(pieces))]
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, at = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if at < e <= end], [i for i, e in zip(ids_b, ends_b, strict=True) if at < e <= end]))
        at = end
    return ids_a, ids_b, groups


def plain_table(tokenizers, texts):
    found = [plainly_aligned(tokenizers, t) for t in texts]
    links = [[(x, y) for own, other in groups or [] for x in own for y in other] for _, _, groups in found]
    n_docs = Counter(pair for own in links for pair in set(own))
    most: dict[int, int] = {}
    for (x, _), n in n_docs.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for i, ((a, b, groups), own) in enumerate(zip(found, links, strict=True)):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups or [])
        rows.append((i, len(a), len(b), len(groups or []), len(own), sum(n_docs[p] == most[p[0]] for p in own), sum(n_docs[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, {(x, y, n, n == most[x]) for (x, y), n in n_docs.items()}


ODD = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "▁", " ", "  two  blanks ", "\n\n\t x", "日本語のテキスト 漢字", "naïve café 👩‍👩‍👧 é", "ab" * 300, "aaaa " * 40, "<0x41> \x00\x01 \x7f", "ﬁ ½ Å", " x y", "1234567890 12,345.67", "‮right to left", "ไทยไทย ภาษา", "x" * 3000, "é" * 500]


def test_alignment_against_brute_force(spark, texts, tokenizers):
    every = [t if t is None else t[:3000] for t in texts[:24]] + ODD + ODD[7:9]
    rows, pairs = plain_table(tokenizers, every)
    for block in (A.BLOCK, 40):
        ours, table = A.align(make(spark, every).repartition(3), block=block)
        assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ours.collect()) == rows
        assert {tuple(r) for r in table.collect()} == pairs
        assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in ours.where("n_a > 0").collect())


def test_alignment_of_whole_documents(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").orderBy("doc_id")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sides = A.Aligner(*A.public_sides())
    for _, text in texts[:60]:
        a, b = sides.a.tokens([text or ""])[0], sides.b.tokens([text or ""])[0]
        own_a, own_b, groups = plainly_aligned(tokenizers, (text or "")[:4000])
        if text and len(text) <= 4000 and groups:
            assert (a.tolist(), b.tolist()) == (own_a, own_b)
            assert next(sides.align([text], [a], [b]))[0] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def test_alignment_of_no_rows_and_null_ids(docs, empty):
    for frame in A.align(empty):
        assert frame.count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert A.align(odd, with_groups=False)[0].count() == docs.where("doc_id > 3").count()


@pytest.fixture(scope="module")
def toy():
    """Two made-up vocabularies in which windows are ambiguous and groups are large."""
    pieces_a, pieces_b = [b"a", b"b", b" ", b" a", b"ab", b"aaaa"], [b"aa", b"a", b"b", b" ", b" a", b"aaa", b"aaaaaaa"]
    return A.Side(pieces_a, None), A.Side(pieces_b, None)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_windows_against_the_definition(toy, data):
    a, b = toy

    def split(side, text):
        ids = []
        while text:
            i = data.draw(st.sampled_from([i for i, p in enumerate(side.pieces) if text.startswith(p)]))
            ids.append(i)
            text = text[len(side.pieces[i]) :]
        return np.array(ids, "<u4")

    text = data.draw(st.text("ab ", min_size=1, max_size=40))
    own, other = split(a, (" " + text).encode()), split(b, (" " + text).encode())
    aligner = A.Aligner(a, b, cached=3)
    for _ in range(2):  # the second time from what is remembered
        said, n_groups, n_links, pairs, times = next(aligner.align([text], [own], [other]))
        ends_a, ends_b = np.cumsum(a.sizes[own]).tolist(), np.cumsum(b.sizes[other]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        group = lambda e: next(i for i, s in enumerate(shared) if e <= s)
        links = Counter((int(x), int(y)) for x, e in zip(own, ends_a, strict=True) for y, f in zip(other, ends_b, strict=True) if group(e) == group(f))
        assert n_groups == len(shared) and n_links == links.total()
        assert {(int(p) // 7, int(p) % 7): int(n) for p, n in zip(pairs, times, strict=True)} == dict(links)
        assert said == ";".join(f"{','.join(str(x) for x, e in zip(own, ends_a, strict=True) if group(e) == i)}|{','.join(str(y) for y, f in zip(other, ends_b, strict=True) if group(f) == i)}" for i in range(len(shared)))


def test_large_groups_have_few_pairs():
    side = A.Side([b" ", b"a"], None), A.Side([b" a", b"aaa", b"a"], None)
    n = 3000
    a, b = np.array([0] + [1] * n, "<u4"), np.array([0] + [2] * (n - 1), "<u4")
    _, groups, links, pairs, times = next(A.Aligner(*side).align(["a" * n], [a], [b]))
    assert groups == n and links == n + 1 == times.sum() and len(pairs) == 3
