"""Operators against plain versions, libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, bpe_codec, components, decontamination, hamming_search, jaccard_join, lm_scoring, pii, removal, sharding, token_counts, toxicity, url_filter
from tessera.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def machine():
    with open(vocabulary(), "rb") as f:
        return bpe.tokenizer_of(f.read())


PARTS = ["a", "b", "'s", "'re", "'r", "'", "'ll", "'ve", " ", "  ", "\n", "\t", "1", "²", "é", "日本", "!", "...", " ", "　", "😀", "e", "'S", "<|endoftext|>", "the", "\x1c", "\x85", "Ⅷ"]


def test_encoding_is_the_librarys(machine, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * 700, " " * 300, "é" * 300, "'r", "\n" * 100 + "x"]
    mine = machine.encode_batch(texts)
    for text, ids, want in zip(texts, mine, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert machine.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_streaming_needs_bounded_memory(machine, library):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdeth") for _ in range(6000))
    stream = bpe.StreamingMerger(machine.merger)
    ids = [i for k in range(0, 6000, 7) for i in stream.feed(text[k : k + 7].encode())] + stream.finish()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert stream.deepest <= 4 * machine.merger.lookahead + 8


def test_decoding_broken_bytes(machine, library):
    ids = [machine.merger.single[b] for b in (0xE2, 0x41, 0xF0, 0x9F)]
    assert machine.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_token_counts(docs, odd, library):
    for table in (docs, odd, docs.limit(0)):
        want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect()]
        got = token_counts.count_tokens(table, vocabulary()).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_round_trip(odd, library):
    got = bpe_codec.round_trip(odd, vocabulary()).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    encoded = bpe_codec.encode(odd, vocabulary())
    assert sorted(r.decoded for r in bpe_codec.decode(encoded, vocabulary()).collect()) == sorted((r.text or "") for r in odd.collect())


def test_base_entities():
    rng = random.Random(3)
    parts = list("0123456789") + ["@", ".", "+", "-", " ", "(", ")", "a", "_", "%", "@x.y", "1.2.3.4", "255", "+1", "\n", "é", "4111111111111111", "00"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute.base_entities(text), text


def test_patterns_discover_identifiers(spark):
    rng = random.Random(1)
    rows = [(i, f"note please reach me at user{i}@mail.example.org now") for i in range(30)]
    rows += [(100 + i, f"note please reach me at handle{i}x now") for i in range(5)]
    rows += [(200 + i, f"the model {rng.choice('abc')}{i}99x sold") for i in range(30)]
    found = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(found[i].n_email == 1 and found[i].n_learned == 0 for i in range(30))
    assert all(found[100 + i].n_learned == 1 and found[100 + i].spans.startswith("email:24:") for i in range(5))
    assert all(found[200 + i].spans == "" for i in range(30))


def test_shapes_discover_grouped_numbers(spark):
    rng = random.Random(2)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"{rng.choice('abcdef')}x +1 {number()} z{i}q") for i in range(20)] + [(100 + i, f"w{i}r {number()} u{i}v") for i in range(6)] + [(200 + i, f"k{i}l {rng.randint(100, 999)} 77 s{i}t") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x"))
    found = {r.doc_id: r for r in pii.digest(pii.find(table)).collect()}
    texts = dict(rows)
    for i in range(6):
        start = texts[100 + i].index("(")
        assert found[100 + i].spans == f"phone:{start}:{start + 14}" and found[100 + i].n_phone == 0
    assert all(found[200 + i].spans == "" for i in range(9))
    # masking gives the same texts by a broadcast and by joins
    plain, joined = (sorted(map(tuple, pii.mask(table, most=n).collect())) for n in (1000, 0))
    assert plain == joined and all("[PHONE]" in r[1] for r in plain if 100 <= r[0] < 200)


def chain():
    """Texts in which each context is confident only once the one before has made its instances known."""
    sizes = [90, 60, 40, 26, 17, 11, 7]
    items = [[f"user{i}@mail.example.org" for i in range(sizes[0])]]
    items += [[f"k{k}" + "-x" * (100 * k + i) for i in range(n)] for k, n in enumerate(sizes[1:], 1)]
    rows = [f"step{'abcdef'[k]} {item} end" for k in range(6) for item in items[k] + items[k + 1]]
    return list(enumerate(rows))


def plain_patterns(texts):
    sightings = []
    for text in texts:
        for s, e, kind in pii.candidates(text or "", pii.base_spans(text or "")):
            sightings.append((pii.named(text[s:e]), kind, (*pii.context(text, s, e), pii.shape(text[s:e]))))
    return brute.learned_patterns(sightings)


def test_rounds_go_on_until_nothing_is_new(spark, docs, odd):
    rows = spark.createDataFrame(chain(), "doc_id long, text string")
    for table in (rows, docs, odd, docs.limit(0)):
        got = {r.pattern: (r.kind, r.share) for r in pii.learn(pii.scan(table).df).collect()}
        want = plain_patterns([r.text for r in table.collect()])
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1]) for p in want)
    assert any("stepf" in p for p in plain_patterns([t for _, t in chain()]))
    with pytest.raises(RuntimeError):
        pii.learn(pii.scan(rows).df, rounds=3)


def test_long_shapes_stay_apart():
    a, b = ("1a" * 60 + x for x in ("b-2", "b.2"))
    assert pii.shape(a) != pii.shape(b) and len(pii.shape(a)) == len("= ") + 64


def test_candidates_have_no_length_limits():
    long = "x9" * 100
    assert [text[s:e] for text in (f"call 030 123 4567, id {long} or 12",) for s, e, k in pii.candidates(text, [])] == ["030 123 4567", long]
    assert len(pii.named(long)) == 64 and pii.shape("+1 (743) 555-3824") == pii.shape("(017) 555-7713")


def test_pii_digest_and_mask(docs, odd, spark):
    for table in (docs, odd, docs.limit(0)):
        texts = sorted((str(r.doc_id), pii.sha256_of(brute.base_entities(r.text))) for r in table.collect())
        got = pii.digest(pii.find(table)).collect()
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == texts
        masked = pii.mask(table)
        assert masked.columns == table.columns
        assert not [r for r in masked.collect() if r.text and brute.base_entities(r.text)]
    assert pii.masked("a 1.2.3.4 b", [(2, 9, "ip")]) == "a [IP] b"


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in scored)
    assert right / len(scored) > 0.9
    assert sum(r.predicted and not r.toxic for r in scored) <= 0.02 * len(scored)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    units = []
    for _ in range(400):
        terms = rng.choice(40, 5, replace=False).tolist()
        w = rng.random(5)
        units.append(dict(zip(terms, (w / np.linalg.norm(w)).tolist())))
    index = toxicity.BlockMaxIndex(units)
    for q in units[:60]:
        cos = [(round(sum(v * u.get(t, 0.0) for t, v in q.items()), 9), -e) for e, u in enumerate(units)]
        want = [(c, -e) for c, e in sorted((x for x in cos if x[0] > 0), reverse=True)[:7]]
        assert [e for _, e in index.nearest(q, 7)] == [e for _, e in want]


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    empty = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.5}
    assert toxicity.keep_clean(odd, empty).columns == odd.columns


def check_shards(rows, shards):
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    largest = max((r.size for r in rows), default=0)
    for s, part in by.items():
        assert 0 <= s < shards
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / shards) <= 0.05 * total / shards + 2 * largest


def test_sharding(docs, odd, spark):
    rows = sharding.shard_by_bytes(docs, shards=4, per_shard=3).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert sharding.shard_by_bytes(odd).count() == odd.count()
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    hot = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    check_shards(sharding.shard_by_bytes(hot, shards=6, per_shard=2).collect(), 6)


def test_cuts_are_the_nearest_rows(spark):
    rng = random.Random(11)
    keys = [(rng.choice([5, 5, 5, rng.getrandbits(62) - (1 << 61), sharding.LOW, sharding.HIGH]), rng.choice([sharding.LOW, 7, 7, rng.randint(-9, 9)]), rng.getrandbits(63) - (1 << 62), rng.randint(16, 400)) for _ in range(500)]
    keyed = spark.createDataFrame(keys, "h long, d long, t long, size long")
    total = sum(k[3] for k in keys)
    found = sharding.splitters(keyed, total, 12, 0.0)
    ends, at = {0}, 0
    for k in sorted(keys):
        at += k[3]
        ends.add(at)
    for n, cut in enumerate(sorted(found), 1):
        target = total * n // 12
        below = sum(k[3] for k in keys if k[:3] <= cut)
        assert abs(below - target) == min(abs(e - target) for e in ends)


def test_sharding_of_repeated_rows(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "the same text " * 70).otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit(1).alias("h"), F.lit(2).alias("bucket"))
    got = sharding.shard_by_bytes(rows, shards=10, per_shard=2).collect()
    assert len(got) == 4000
    check_shards(got, 10)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes)


CONTRACTS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_queries_keep_their_contracts(spark, docs, name):
    got = QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert [f"{c} {kinds[c]}" for c in kinds][: CONTRACTS[name].count(",") + 1] == CONTRACTS[name].split(", ")
    table = spark.read.parquet(f"{SF}/pages.parquet") if name == "op10_url_filter" else docs
    assert got.count() == table.count()


def test_registered_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, SF).collect()} == brute.leaks(texts, items) | brute.leaks_of_short_texts(texts, items)


def test_fingerprints_find_what_brute_force_finds():
    """Recall of the Hamming radius at its limit: windows of just 0.75 or more, repeated shingles among them."""
    rng = np.random.default_rng(7)
    lost = met = 0
    with np.errstate(over="ignore"):
        for size in (4, 8, 12, 20, 36, 60, 96):
            for _ in range(300):
                pool = rng.integers(0, 1 << 63, size * 2).astype(np.uint64)
                a = rng.choice(pool[: max(2, size // 2)], size) if rng.random() < 0.5 else pool[:size].copy()
                b = a.copy()
                n = size - -(-6 * size // 7)  # as many as may differ
                b[rng.choice(size, n, replace=False)] = rng.integers(0, 1 << 63, n).astype(np.uint64)
                x, y = (decontamination.simhash(decontamination.bit_weights(s).sum(0)[None])[0] for s in (a, b))
                met += 1
                lost += int(np.bitwise_count(x ^ y)) > decontamination.RADIUS
    assert lost <= 0.01 * met
    print("lost", lost, "of", met)


def test_leaks(docs, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == brute.leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_leaks_with_edits(spark, odd):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 50)))) for i in range(12)] + [(50, "tiny pair"), (51, None), (52, "")]
    docs = []
    for d in range(150):
        passage = (rng.choice(items[:13])[1]).split()
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = word()
        docs.append((d, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]).upper()))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.leaks(docs, items)
    assert decontamination.find_leaks(odd, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.find_leaks(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_in_texts_shorter_than_an_item(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 40, 40, 60, 90))]
    docs = [(0, " ".join(w for k, w in enumerate(items[1][1].split()) if k != 20))]  # 31 of 36 and 35 shingles
    for d in range(1, 80):
        passage = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            passage = passage[rng.randint(0, 5) : len(passage) - rng.randint(0, 5)]
        for _ in range(rng.randint(0, 3)):
            del passage[rng.randrange(len(passage))]
        docs.append((d, " ".join(passage)))
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(docs, items) | brute.leaks_of_short_texts(docs, items)
    assert [(r.item_id, r.similarity, r.first_word, r.n_windows) for r in found if r.doc_id == 0] == [(1, 31 / 40, 0, 1)]


def variants(rng, n):
    """Texts of many sizes with copies and near copies, short ones and hubs among them."""
    word = lambda: f"w{rng.randrange(60)}"
    common = " ".join(f"c{i}" for i in range(60))
    rows, made = [], []
    for d in range(n):
        kind = rng.random()
        if made and kind < 0.5:
            words = rng.choice(made).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.6:
            text = common + " " + " ".join(word() for _ in range(rng.randint(1, 40)))
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 11, 12, 14, 16, 30, 90])))
        made.append(text)
        rows.append((d, text))
    return rows


def test_jaccard_join(docs, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes_of(docs).collect()}
    assert got == brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])
    rows = variants(random.Random(9), 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_odd_rows(odd):
    rows = jaccard_join.classes_of(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[d][0].n_shingles == 0 and by[d][0].component_id == d for d in (1, 2, 3))
    assert [r.component_id for r in by[4]] == [4, 4] and by[5][0].component_id == 4 and by[4][0].n_copies == 3
    assert by[7][0].component_id == 6
    assert by[None][0].component_id is None
    assert jaccard_join.classes_of(odd.limit(0)).count() == 0


def test_subsets_meet_all_small_links():
    for a in range(1, 13):
        for b in jaccard_join.partner_sizes(a):
            c = jaccard_join.overlap(a, b)
            assert jaccard_join.linked(c, a, b) and not jaccard_join.linked(c - 1, a, b)
            if min(a, b) <= 7:
                assert c in jaccard_join.subset_sizes(a, 7) and c in jaccard_join.subset_sizes(b, 7)


def test_sketches_bound_differences():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 900, 2)
        pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        assert jaccard_join.unlike(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (20, 10), (20, 30), (30, 40), (40, 50), (50, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 10 for k in (10, 20, 30, 40, 50, 60)}


def test_hamming_search(spark):
    rng = random.Random(8)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(300)] + [(1000 + i, 5) for i in range(40)] + [(None, 3), (7000, None)]
    frame = spark.createDataFrame(codes, "vec_id long, code long")
    queries = frame.where("vec_id % 100 = 0")
    want = set()
    known = [(i, c) for i, c in codes if i is not None and c is not None]
    for q, c in known:
        if q % 100 == 0:
            near = sorted((bin((c ^ x) & ((1 << 64) - 1)).count("1"), i) for i, x in known)[:10]
            want |= {(q, k + 1, i, d) for k, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming_search.search(frame, queries).collect()} == want
    assert hamming_search.search(frame.limit(0), queries.limit(0)).count() == 0
    assert hamming_search.search(frame.where("vec_id < 5"), frame.where("vec_id = 0")).count() == 5


@pytest.mark.parametrize("size", [8, 80, 150])
def test_hamming_search_of_other_lengths(spark, size):
    rng = random.Random(size)
    vectors = [(i, [rng.choice([-1.0, 1.0, 0.5, -0.1]) for _ in range(size)]) for i in range(120)]
    vectors += [(200, []), (201, None), (202, [None] * size), (203, [1.0] * (size // 2)), (0, [1.0] * size), (0, [1.0] * size), (300, [float("nan")] * size)]
    frame = spark.createDataFrame(vectors, "vec_id long, v array<double>").withColumn("extra", F.lit(1))
    codes = frame.select("vec_id", hamming_search.sign_code(F.col("v")).alias("code"), "extra")
    bits = lambda v: tuple(int(i < len(v) and v[i] is not None and v[i] > 0) for i in range(size))
    rows = {(i, bits(v)) for i, v in vectors if v is not None}
    want = set()
    for q in {b for i, b in rows if i % 100 == 0}:
        near = sorted((sum(a != b for a, b in zip(q, c)), i) for i, c in rows)[:10]
        want |= {(i, k + 1, j, d) for i, b in rows if i % 100 == 0 and b == q for k, (d, j) in enumerate(near)}
    assert {tuple(r) for r in hamming_search.search(codes, codes.where("vec_id % 100 = 0"), bits=size).collect()} == want


def test_lm_base_scores_and_probabilities(docs, odd):
    import math
    from collections import Counter

    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        counts = Counter()
        for r in rows:
            if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
                counts.update(brute.words(r.text))
                counts[None] += 1
        n, v = sum(counts.values()), len(counts)
        want = []
        for r in rows:
            tokens = [*brute.words(r.text), None]
            want.append((str(r.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), 5)))
        got = lm_scoring.score(table).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
        assert all(r.score < 0 for r in got)
    held = [r for r in lm_scoring.score(docs).collect() if r.held_out]
    assert 1 < sum(r.bits_per_byte for r in held) / len(held) < 4.5
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_bytes_sum_to_one(spark):
    counts = {b"abc": 9, b"abd": 3, b"b": 50, b"": 12}
    rows = [(bytearray(w), n) for w, n in counts.items()] + [(bytearray(w + bytes([b])), 0) for w in (b"", b"a", b"ab", b"az", b"abcdefgh") for b in range(256)]
    got = {r.code: r.lp for r in lm_scoring.log_codes(spark.createDataFrame(rows, "word binary, c long")).df.collect()}
    tree = brute.PlainTree(counts)
    for last in (b"", b"a", b"ba", b"za", b"hgfedc"):  # the last byte first
        ctx = last.ljust(lm_scoring.DEPTH, b" ")
        mine = [got[int.from_bytes(ctx, "big") << 8 | b] for b in range(256)]
        assert sum(10.0**x for x in mine) == pytest.approx(1.0, abs=1e-6)
        assert mine == pytest.approx([tree.log_byte(ctx, b) for b in range(256)], rel=1e-5)
    ctx = int.from_bytes(b"ba".ljust(lm_scoring.DEPTH, b" "), "big") << 8
    assert got[ctx | 0x63] > got[ctx | 0x64] > -1


def test_lm_scores_are_the_plain_trees(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "HEAD", 20)  # most words come by the join
    rng = random.Random(12)
    rows = [(d, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(30))) for d in range(40)]
    learned = Counter()
    for d, text in rows:
        learned.update(brute.words(text) if zlib.crc32(str(d).encode()) % 5 != 1 else ())
    ends = sum(zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows)
    tree = brute.PlainTree({w.encode(): n for w, n in learned.items()} | {b"": ends})
    names = {w for _, text in rows for w in brute.words(text)} | {""}
    assert names - set(learned) - {""}  # held-out words that training has not
    lp = {w: tree.log_word(w.encode()) for w in names}
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        found = Counter(brute.words(text))
        n = 1 + sum(found.values())
        want = sum(lm_scoring.drawn(k, lp[w]) for w, k in found.items()) + lm_scoring.drawn(1, lp[""]) - (math.lgamma(n + lm_scoring.OWN) - math.lgamma(lm_scoring.OWN)) / math.log(10)
        assert got[d] == pytest.approx(want, rel=1e-5), d


def test_lm_runs_are_never_cut(monkeypatch):
    monkeypatch.setattr(lm_scoring, "RUNS", 7)
    rng = np.random.default_rng(5)
    cut = np.sort(rng.integers(0, 30, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(cut[i : i + 13]), pa.array(np.arange(i, min(200, i + 13)))], ["cut", "code"]) for i in range(0, 200, 13)]
    parts = list(lm_scoring._runs(iter(batches), ["cut", "code"]))
    assert np.concatenate([p[1] for p in parts]).tolist() == list(range(200))
    assert all(set(p[0].tolist()).isdisjoint(q[0].tolist()) for p, q in zip(parts, parts[1:])) and len(parts) > 5


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://WWW.Example.com/en/1?q", "http://x.example.com/en/2", "http://b.net/es/1", "http://b.net", "http://m.spam-farm.example.org/en/7#t", "http://ok.example.org/p", "nothing", None, "x://y.com", "ftp://u@free-bets.example.net:8080/", "http://a.com?x=://z"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("x.example.com", "/en/2", "example.com/en/", "block")
    assert got[3] == ("b.net", "/es/1", "net/es/", "block") and got[4] == ("b.net", "", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("y.com", "", None, "allow")
    assert got[10] == ("u@free-bets.example.net:8080", "/", None, "block") and got[11] == ("a.com", "", None, "allow")
    assert url_filter.filter_urls(rows.limit(0)).count() == 0
    listed = spark.createDataFrame([("b.net/es/1",), ("x.example.org/p",), ("x.example.org/p",), (None,), ("ok.example.org/",)], "key string")
    own = {r.page_id: (r.verdict, r.listed) for r in url_filter.filter_urls(rows, listed).collect()}
    assert own[3] == ("block", True) and own[6] == ("block", True) and own[5] == ("allow", False) and len(own) == len(urls)
    assert not any(r.listed for r in url_filter.filter_urls(rows, listed.limit(0)).collect())
    tiny = url_filter.filter_urls(rows, blocks=1).collect()  # a filter that passes nearly all
    assert {r.page_id: r.verdict for r in tiny} == {k: v[3] for k, v in got.items()}


def test_removal(odd, spark):
    gone = spark.createDataFrame([(4,), (6,), (999,), (None,)], "key long")
    left = removal.without(odd, F.col("doc_id"), gone)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (4, 6))
    assert removal.without(odd, F.col("doc_id"), gone.limit(0)).count() == odd.count()


def test_pipeline_stages(spark, docs, odd):
    import corpus_pipeline as cp

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = cp.drop_toxic(spark, docs, SF).cache()
    assert kept.columns == docs.columns and sum(labels.get(r.doc_id) == 0 for r in kept.collect()) >= 0.98 * sum(v == 0 for v in labels.values())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    unique = cp.drop_near_copies(spark, kept, SF).cache()
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, c in brute.jaccard_components(rows).values()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = cp.drop_leaks(spark, unique, SF).cache()
    leaked = {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in unique.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - leaked
    masked = cp.mask_private(spark, clean, SF)
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert cp.encode(spark, masked, SF).count() == clean.count()
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        stage(spark, odd, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SF)
    answer = con.execute(ORACLE_SQL[name])
    asked = [d[0] for d in answer.description]
    want = [tuple(str(r[asked.index(n)]) for n in got.columns) for r in answer.fetchall()]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(want)
