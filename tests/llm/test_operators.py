"""Each operator against brute force on small fixtures, and on hard and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, hilbert, langid, mixing, mpeg, neardup, quality, queries, rules, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_mixing(hard, none):
    rows = mixing.mix_sources(hard).select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == hard.count()
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full, free = sum(sizes.values()), {}, dict(weight)
    while True:  # water filling, source by source
        level = (total - sum(full.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 3 * sizes[s]
            del free[s]
    targets = full | {s: level * w for s, w in free.items()}
    taken = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r["size"]
    most = {s: max(r["size"] for r in rows if r.source == s) for s in order}
    assert all(abs(taken[s] - targets[s]) <= max(most[s], 1) for s in order)
    mixed = mixing.mixed_documents(hard)
    assert mixed.columns == hard.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_keeps_sources_without_words(spark):
    rows = [(1, None, "void"), (2, "", "void"), (3, " \n\t ", None), (4, "the house", "s"), (5, "", "s"), (6, "the river and the stone", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert sorted(got) == [r[0] for r in rows]
    assert all((got[i].source_size, got[i].target, got[i]["size"], got[i].copies) == (0, 0, 0, 1) for i in (1, 2, 3))
    assert {1, 2, 3} <= {r.doc_id for r in mixing.mixed_documents(docs).collect()}
    bare = mixing.mix_sources(docs.where("doc_id <= 3")).collect()
    assert sorted(r.doc_id for r in bare) == [1, 2, 3] and all(r.copies == 1 for r in bare)


def brute_balance(rows, goals, cap):
    """Rates by gradient descent on the dual, a multiplier a constraint at a time, by bisection."""
    at = {g: 0.0 for g in goals}
    rate = lambda keys, size: min(cap, math.exp(min(50, size * sum(at.get(k, 0.0) for k in keys))))
    for _ in range(400):
        for g, goal in goals.items():
            mine = [(k, s, n) for k, s, n in rows if g in k]
            low, high = -3.0, 3.0
            for _ in range(60):
                at[g] = (low + high) / 2
                low, high = (low, at[g]) if sum(n * s * rate(k, s) for k, s, n in mine) > goal else (at[g], high)
    return [rate(k, s) for k, s, n in rows]


def test_balancing_one_margin(spark):
    """Rates are exp(multiplier * size) under the cap, and meet every target."""
    rng = random.Random(2)
    rows = [(f"k{i % 6}", rng.randrange(0, 3000), 1 + i % 3) for i in range(300)]
    sums = collections.Counter()
    for k, s, n in rows:
        sums[k] += s * n
    goals = {k: sums[k] * f for k, f in zip(sorted(sums), (0.0, 0.05, 0.6, 1.0, 2.9, 3.0))}
    cells = spark.createDataFrame(rows, "_mix_key string, _mix_size long, _mix_count long")
    targets = spark.createDataFrame(list(goals.items()), "_mix_key string, target double")
    got = mixing.balanced(cells, [("_mix_key", targets)], cap=3.0).collect()
    taken, slopes = collections.Counter(), collections.defaultdict(list)
    for r in got:
        taken[r._mix_key] += r._mix_rate * r._mix_size * r._mix_count
        assert 0 <= r._mix_rate <= 3 and (r._mix_size > 0 or r._mix_rate == 1)
        if 1e-300 < r._mix_rate < 3 and r._mix_size:
            slopes[r._mix_key].append(math.log(r._mix_rate) / r._mix_size)
    assert len(got) == len(rows)
    assert all(taken[k] == pytest.approx(goals[k], rel=1e-8, abs=1e-6) for k in goals)
    assert all(max(v) == pytest.approx(min(v), rel=1e-6, abs=1e-12) for v in slopes.values())


def test_balancing_three_margins(spark):
    rng = random.Random(3)
    rows = [((f"a{rng.randrange(3)}", f"b{rng.randrange(2)}", f"c{rng.randrange(3)}"), rng.randrange(1, 40), rng.randrange(1, 4)) for _ in range(80)]
    hidden = {"a0": 0.02, "a1": -0.03, "a2": 0.0, "b0": 0.01, "b1": -0.02, "c0": 0.015, "c1": 0.0, "c2": -0.01}
    goals = collections.Counter()
    for keys, size, n in rows:  # targets that can be met together
        for k in keys:
            goals[k] += n * size * min(3.0, math.exp(size * sum(hidden[k] for k in keys)))
    cells = spark.createDataFrame([(*k, s, n) for k, s, n in rows], "a string, b string, c string, _mix_size long, _mix_count long")
    margins = [(c, spark.createDataFrame([(k, v) for k, v in goals.items() if k[0] == c], f"{c} string, target double")) for c in "abc"]
    got = collections.Counter()
    want = collections.Counter()
    for r in mixing.balanced(cells, margins, cap=3.0).collect():
        got[r.a, r.b, r.c, r._mix_size, r._mix_count, round(r._mix_rate, 5)] += 1
    for (keys, size, n), rate in zip(rows, brute_balance(rows, goals, 3.0)):
        want[*keys, size, n, round(rate, 5)] += 1
    assert got == want
    margins[0] = ("a", spark.createDataFrame([("a0", 1e9), ("a1", 1.0), ("a2", 1.0)], "a string, target double"))
    with pytest.raises(ArithmeticError):
        mixing.balanced(cells, margins, cap=3.0, steps=8)


def test_bpe(hard, none):
    path = queries.tokenizer_path()
    tok = bpe.load(path)
    got = bpe.encode_documents(hard.withColumn("k", F.monotonically_increasing_id()), path, key="k").collect()
    texts = {r.k: r.text for r in hard.withColumn("k", F.monotonically_increasing_id()).select("k", "text").collect()}
    assert sorted(r.k for r in got) == sorted(texts)
    for r in got:
        ids = tok.encode(texts[r.k] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)
    # null and repeated keys
    assert collections.Counter(r.doc_id for r in bpe.encode_documents(hard, path).collect()) == collections.Counter(r.doc_id for r in hard.collect())
    assert bpe.encode_documents(none, path).count() == 0


def test_bpe_tables(spark, monkeypatch):
    """Chunks of a few texts, one with more distinct words than two bytes can number."""
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2000)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(120)))) for i in range(200)]
    rows.append((200, " ".join(f"x{i}y" for i in range(70_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = bpe.chunk_words(docs, "doc_id").cache()
    assert found.select("chunk").distinct().count() > 10
    by_chunk, by_bucket = collections.Counter(), collections.defaultdict(set)
    for r in found.collect():
        for w in bpe.unpacked_words(r.words):
            by_chunk[r.chunk, w] += 1
            by_bucket[r.bucket].add(w)
    # a word is in one bucket, and once in each chunk that has it
    assert set(by_chunk.values()) == {1} and sum(map(len, by_bucket.values())) == len({w for _, t in rows for w in t.split()})
    path = queries.tokenizer_path()
    tok = bpe.load(path)
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows}
    encoded = bpe.encode_documents(docs, path)
    got = encoded.collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(rows)
    assert all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in got)
    joined = bpe.decode_by_join(encoded.where("doc_id < 200").select("doc_id", "ids"), path)
    assert {r.doc_id: r.decoded for r in joined.collect()} == {r.doc_id: r.decoded for r in got if r.doc_id < 200}


def test_bpe_refuses_rows_in_another_order(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    words_ = bpe.chunk_words
    monkeypatch.setattr(bpe, "chunk_words", lambda d, k: words_(d.withColumn("text", F.lit("a b c e")), k))
    with pytest.raises(Exception, match="another order"):
        bpe.encode_documents(docs, queries.tokenizer_path()).collect()


def test_bpe_splits_every_character_as_the_library_does():
    tok = bpe.load(queries.tokenizer_path())
    for c in [*range(0x3000), *range(0xFE00, 0xFFFE), 0x1D400, 0x1F600]:
        text = f"Ab{chr(c)}cD's {chr(c)}{chr(c)}"
        by_word = [i for w in bpe.split(text) for i in tok.encode(w, add_special_tokens=False).ids]
        assert by_word == tok.encode(text, add_special_tokens=False).ids, hex(c)


def test_mpeg(hard, none):
    media = mpeg.store_texts(hard)
    rows = mpeg.media_features(media).collect()
    expected = collections.Counter()
    for r in hard.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        body = mpeg.padded(raw)
        assert len(body) % 64 == 0 and len(body) >= 64
        expected[r.doc_id, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == expected
    assert mpeg.media_features(mpeg.store_texts(none)).count() == 0
    read = mpeg.read_column(media).where("doc_id = 46").first()
    assert read.skipped == 0 and read.wrong == 0 and read.frames == len(read.offsets) == read.table_frames and read.duration_num / read.duration_den == pytest.approx(read.samples / 32000)


def test_mpeg_reader_resynchronises_and_checks():
    body = mpeg.padded(bytes(range(256)) * 40)
    data = mpeg.write(body)
    clean = mpeg.read(data)
    assert mpeg.payload_of(clean) == body
    at = clean.offsets[2]
    torn = mpeg.read(data[:at] + b"\xff\xfbnoise\xff" + data[at:])
    assert torn.skipped == 8 and len(torn.offsets) == len(clean.offsets) and mpeg.payload_of(torn) == body
    spoilt = bytearray(data)
    spoilt[clean.offsets[1] + 10] ^= 1
    assert mpeg.read(bytes(spoilt)).wrong == 1
    lost = mpeg.read(data[at - 100 :])
    assert lost.offsets[0] == 100 and len(lost.offsets) == len(clean.offsets) - 2
    for junk in (None, b"", b"\xff", b"\xff\xfb\x90", b"no audio here" * 50):
        assert mpeg.read(junk).offsets == [] and mpeg.read(junk).duration == 0


def test_mpeg_headers():
    one = mpeg.header(bytes.fromhex("fffb9064"))
    assert (one.version, one.layer, one.kbits, one.rate, one.size, one.protected) == (1.0, 3, 128, 44100, 417, False)
    two = mpeg.header(bytes.fromhex("fff384c4"))
    assert (two.version, two.layer, two.kbits, two.rate, two.samples, two.mono) == (2.0, 3, 64, 24000, 576, True)
    assert mpeg.header(bytes.fromhex("fffff000")) is None and mpeg.header(bytes.fromhex("fffb9c64")) is None


def test_language(hard, none):
    model = langid.train(hard.where("doc_id % 4 <> 2"))
    assert model.languages == ["de", "en"]
    got = langid.predict(hard, model).collect()
    texts = collections.defaultdict(list)
    for r in hard.collect():
        texts[r.doc_id].append(r.text)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in texts[r.doc_id][0] or "")
            assert (r.lang_pred == "und") == (not letters)
            if r.doc_id < 40:
                assert r.lang_pred == ("en" if r.doc_id < 20 else "de")
    kept = langid.accepted(hard, model, least=0.3)
    assert kept.columns == hard.columns and kept.where("doc_id < 40").count() == 42 and kept.where("doc_id in (42, 43, 44, 45)").count() == 0
    empty = langid.train(none)
    assert langid.predict(none, model).count() == 0 and {r.lang_pred for r in langid.predict(hard, empty).collect()} == {"und"}
    assert langid.accepted(none, model).count() == 0


def test_language_filters_against_sets():
    letters = langid._letters()
    rng = np.random.default_rng(0)
    import pyarrow as pa

    codes = {k: rng.integers(0, 1 << 62, 3000) for k in ("a", "b")}
    filters = langid.build(pa.table({"lang": ["a"] * 3000 + ["b"] * 3000, "code": np.concatenate([codes["a"], codes["b"]])}))
    for lang, bit in (("a", 1), ("b", 2)):
        held = np.full(3000, 3, np.uint64)
        for at in langid._probes(codes[lang].view(np.uint64), len(filters.masks)):
            held &= filters.masks[at, 0]
        assert (held & np.uint64(bit)).all()
    other = np.full(20000, 3, np.uint64)
    for at in langid._probes(rng.integers(0, 1 << 62, 20000).view(np.uint64), len(filters.masks)):
        other &= filters.masks[at, 0]
    assert np.mean((other & np.uint64(1)) != 0) == pytest.approx(filters.chance[0], abs=0.01)
    cut, rows = langid._pieces(["ab cd " * 1000, None, ""], limit=100)
    assert "".join(cut) == "ab cd " * 1000 and set(rows) == {0, 1, 2} and letters[ord("é")]


def test_toxicity_learns_words(spark, hard, none, marks):
    calm = [(i, f"we walk to house number {i} by the river", 0) for i in range(300)]
    rude = [(1000 + i, f"we walk to house number {i} you {'grotk' if i % 2 else 'florbish'} by the river", 1) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in calm + rude], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in calm + rude if i % 3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] >= 0.7 for i, _, y in rude) and all(got[i] < 0.3 for i, _, y in calm)
    assert len(model.at) < 200
    for d in (hard, none):
        scores = [r.score for r in toxicity.score(d, toxicity.train(d, marks)).collect()]
        assert len(scores) == d.count() and all(0 <= s <= 1 for s in scores)


def test_toxicity_features_against_loops():
    import pyarrow as pa

    at, rows = toxicity.features(pa.array(["The cat sat", None, "", "dog"]))
    counts = np.bincount(rows, minlength=4).tolist()
    assert counts == [3 + 2 + 1, 0, 0, 1]
    again, _ = toxicity.features(pa.array(["x", "the CAT sat"]))
    assert set(at[rows == 0].tolist()) == set(again[1:].tolist())


def test_quality(hard, none, marks):
    forest = quality.train(hard, marks)
    for d in (hard, none):
        scores = [r.score for r in quality.score(d, forest).collect()]
        assert len(scores) == d.count() and all(0 <= s <= 1 for s in scores)
        assert quality.accepted(d, forest).columns == d.columns
    assert [r.score for r in quality.score(hard.limit(1), quality.train(none, marks)).collect()] == [0.5]


def test_forest_fits_and_traverses():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=60)
    assert np.mean((forest.scores(x[2000:]) >= 0.5) == y[2000:]) > 0.97

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert forest.margins(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_hilbert(spark, hard, none):
    import itertools

    for n, bits in ((2, 3), (3, 2), (2, 1), (1, 3)):
        points = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(points, ", ".join(f"c{i} long" for i in range(n)))
        got = sorted((r.h, *r[:n]) for r in df.withColumn("h", hilbert.hilbert_index([f"c{i}" for i in range(n)], bits)).collect())
        assert [r[0] for r in got] == list(range(len(points)))
        assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))
    rows = hilbert.shard_documents(hard, 7).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    counts = [len(v) for v in by.values()]
    assert sorted(by) == list(range(7)) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    order = [r.curve for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert order == sorted(order)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in hard.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert hilbert.shard_documents(none, 7).count() == 0


def test_hilbert_ranks_whole_strings(spark):
    """Strings with a long common beginning keep bins of their own, in order, and a hot one its own."""
    values = [f"https://example.test/{i:03d}" for i in range(16)]
    rows = [(v, 10) for v in values for _ in range(4)] + [(values[5], 10)] * 40 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "source string, n long").repartition(3)
    bins = dict(hilbert.string_bins(df, "source").collect())
    order = [bins[v] for v in values]
    assert sorted(bins) == values and order == sorted(order) and len(set(order)) == 16 and 1 <= order[0] <= order[-1] <= 31
    got = hilbert.quantised(df, ["source", "n"]).groupBy("source", "n").count().collect()
    assert {r.source for r in got} == {*order, 0} and {r.n for r in got if r.source == 0} == {0} and {r.n for r in got if r.source} == {1}


def test_warc(spark):
    long, short = "<p>" + "long " * 40, "<p>tiny"
    rows = [(5, "http://a/", long), (3, "http://b/\r\nx", long), (9, None, long), (1, "u", short), (2, "u", short), (4, "u", None),
        (6, "u", ""), (None, "u", long), (None, None, "y" * 200), (None, None, "y" * 200), (7, "ü", "é😀" * 5000), (3, "http://b/", long)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, digest string").repartition(3)
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == collections.Counter([(5, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3),
        (1, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (None, "revisit", 3),
        (None, "response", None), (None, "response", None), (7, "response", None)])
    one = warc.read_records(index.where("page_id = 7")).collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == "é😀" * 5000
    assert warc.read_records(warc.write_archives(pages.where("page_id > 100"))).count() == 0


def brute_fingerprint(text, n=3):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(fps, radius=3):
    """Index of the component of each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(hard, none):
    short = hard.where("doc_id is null or doc_id <> 46")
    rows = neardup.near_duplicates(short).collect()
    docs = short.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    fps = [brute_fingerprint(r.text) for r in docs]
    parts = brute_components(fps)
    ids = collections.defaultdict(list)
    for r, p in zip(docs, parts):
        ids[p].append(r.doc_id)
    want = collections.Counter((r.doc_id, f, min((i for i in ids[p] if i is not None), default=None)) for r, f, p in zip(docs, fps, parts))
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == want
    kept = neardup.deduplicated(short)
    assert kept.columns == short.columns and kept.count() == len(set(parts))
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicated(none).count() == 0


@pytest.mark.parametrize("few, block", [(16, 2048), (2, 4), (1, 1)])
def test_near_copies_against_all_pairs(spark, none, monkeypatch, few, block):
    """Components of near copies are those of brute-force Jaccard of five-word shingles, whether keys are
    searched pairwise or block against block."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "a b", "a b", "a b c"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(20, 200))
        texts.append(" ".join(base))
        for _ in range(10):  # near copies on both sides of the bound, and chains of them
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.3 else base
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def brute_set(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))
    missed = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                missed += (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 3
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert missed > 20  # the three SimHash bits of op9 do not reach these
    got = {r.doc_id: r.component_id for r in neardup.near_copies(docs).collect()}
    assert got == dict(enumerate(root))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(root))
    assert neardup.near_copies(none).count() == 0 and neardup.deduplicated_copies(none).count() == 0


def test_links_lose_no_component(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = set(base)
    for b in base[:10]:
        x = b
        for _ in range(40):  # chains and clusters of near fingerprints
            y = x
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
            x = y if rng.random() < 0.5 else b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = neardup.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r.node: r.root for r in neardup.components(edges).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, s, p in zip(fps, signed, brute_components(fps)):
        got[found.get(s, s)].add(f)
        want[p].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    for r in edges.collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3


def brute_statistics(text):
    text = text or ""
    w = words(text)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = collections.Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if counts[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, hard, none):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    odd = spark.createDataFrame([(1, "a b c a b c\nx\nx\n \n \n#|é é", 3), (2, "a b a b a b a", 3), (3, "a b c d\r\na b c d", 3),
        (4, "w", 3), (5, "a a a a", 3)], "doc_id long, text string, n_words int")
    for df in (hard, odd):
        got = collections.Counter(tuple(r) for r in rules.text_statistics(df.select("doc_id", "text")).select("doc_id", *columns).collect())
        assert got == collections.Counter((r.doc_id, *brute_statistics(r.text)) for r in df.collect())
    assert rules.text_statistics(odd).columns.count("n_words") == 1 and rules.text_statistics(none).count() == 0


def test_decision_list(spark, hard, none, marks):
    good = [(i, " ".join(f"word{i * 7 % 41 + k}" for k in range(60 + i % 9))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"w{i}x{k} ##" for k in range(60))) for i in range(60)] + [(2000 + i,
        "!! ".join(f"CAPS{i}Y{k}" for k in range(70))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    out, found = rules.filtered(docs, labels)
    assert 1 <= len(found) <= 4 and all(r.kept == 0 for r in found)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept == {i for i, _ in good}
    for d in (hard, none):
        rows, _ = rules.filtered(d, marks)
        assert rows.count() == d.count() and rows.where("base_failed and kept").count() == 0
    assert rules.learn(rules.text_statistics(none), marks) == []


def test_equal_texts_are_neighbours(spark):
    """Of groups of equal texts with other metadata, only those that a cut goes through lie in two shards."""
    rng = random.Random(4)
    rows = [(i, f"text {rng.randrange(60)}" if i % 3 else f"own {i}", rng.choice("abcdefgh"), rng.choice(["en", "de", None])) for i in range(900)]
    rows += [(None, "text 1", "z", "en"), (2000, None, "a", "en"), (2001, None, "h", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    out = hilbert.shard_documents(docs, 10).collect()
    texts = {r[0]: r[1] for r in rows}
    places = collections.defaultdict(set)
    for r in out:
        places[texts[r.doc_id]].add(r.shard)
    assert sorted(collections.Counter(r.shard for r in out).values()) == sorted([len(rows) // 10 + (i < len(rows) % 10) for i in range(10)])
    assert sum(len(s) > 1 for s in places.values()) <= 9 and all(max(s) - min(s) < 2 for s in places.values())


def test_toxicity_steps_against_scalars():
    """FTRL-proximal, coordinate by coordinate in plain floats."""
    import math

    import pyarrow as pa

    rng, size = np.random.default_rng(5), toxicity.BUCKETS
    model = toxicity.Ftrl(alpha=0.7, beta=1.5, l1=0.6, l2=0.2)
    z, n = {}, {}

    def weight(i):
        have, strength = z.get(i, 0.0), 0.0 if i == size else 0.6
        if abs(have) <= strength:
            return 0.0
        return -(have - math.copysign(strength, have)) / ((1.5 + math.sqrt(n.get(i, 0.0))) / 0.7 + 0.2)

    for _ in range(300):
        y, at = int(rng.integers(2)), rng.choice(40, int(rng.integers(0, 8)), replace=False)
        at = np.unique(at + 40 * y * (rng.random(len(at)) < 0.5)).astype(np.int32)
        own = [*at.tolist(), size]
        p = 1 / (1 + math.exp(-sum(map(weight, own))))
        for i, w in [(i, weight(i)) for i in own]:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + (p - y) - (math.sqrt(old + (p - y) ** 2) - math.sqrt(old)) / 0.7 * w
            n[i] = old + (p - y) ** 2
        model.learn(at, y)
    kept = model.kept()
    wanted = {i: weight(i) for i in range(80) if weight(i)}
    assert 0 < len(wanted) < 80 and kept.at.tolist() == sorted(wanted)
    assert kept.weight == pytest.approx([wanted[i] for i in sorted(wanted)]) and kept.bias == pytest.approx(weight(size))

    words = ["the cat sat on it", None, "", "the the dog"]
    own = [set(at.tolist()) for at in toxicity._distinct(*toxicity.features(pa.array(words)), len(words))]
    some = toxicity.Weights(np.array(sorted(own[0] | own[3]), np.int32)[::2], rng.normal(size=len((own[0] | own[3]))).astype(float)[: (len(own[0] | own[3]) + 1) // 2], -0.4)
    table = dict(zip(some.at.tolist(), some.weight.tolist()))
    plain = [1 / (1 + math.exp(0.4 - sum(table.get(i, 0.0) for i in have))) for have in own]
    assert toxicity.scores(pa.array(words), some) == pytest.approx(plain)


def test_first_split_against_all_splits():
    """The root of a tree against every split of every statistic, in loops."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, (200, 3)).astype(float)
    y = ((x[:, 1] > 11) | (rng.random(200) < 0.1)).astype(float)
    forest = quality.grow(x, y, trees=1, leaves=2, bins=64)
    share = y.mean()
    g, h = share - y, np.full(200, share * (1 - share))
    best = (-1.0, 0, 0.0)
    for j in range(3):
        for cut in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= cut
            if min(low.sum(), (~low).sum()) >= 5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, j, cut))
    root = forest.roots[0]
    assert forest.feature[root] == best[1]
    low = x[:, best[1]] <= best[2]
    assert ((x[:, best[1]] <= forest.threshold[root]) == low).all()
    for rows, node in ((low, forest.left[root]), (~low, forest.right[root])):
        assert forest.value[node] == pytest.approx(-0.15 * g[rows].sum() / (h[rows].sum() + 1))
