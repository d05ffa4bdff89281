"""Each operator against brute force, a round trip or held-out labels, with the awkward rows."""

import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trawlight.llm import fertility, interpolation, licenses, mixing, packing, quality_model, simhash, token_file, topk, toxicity
from trawlight.llm.tokens import WordEncoder, default_vocabulary
from trawlight.session import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, " \n\t ", "en", "a", 4, "x"),
    (None, "no id here", None, None, 9, "x"),
    (4, "one two three four five", "en", "a", 9, "x"),
    (4, "one two three four five", "en", "a", 9, "x"),
    (5, "Straße ÜBER é́ <|endoftext|> 12 don't end", "de", "b", 9, "x"),
    (6, "long words here " * 20_000, "en", "a", 9, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(text):
    encode = WordEncoder(default_vocabulary()).tokenizer.encode
    return array("I", encode(text or "", add_special_tokens=False).ids + [1])


def test_word_by_word_ids_equal_whole_text_ids(docs):
    texts = [row["text"] for row in docs.collect()] + [row[1] for row in ODD[:7]]
    found = {}
    for first, ids, bounds in WordEncoder(default_vocabulary()).blocks(pa.array(texts)):
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
            found[i] = array("I", [*ids[a:b].tolist(), 1])
    assert all(found[i] == whole_ids(text) for i, text in enumerate(texts))


def test_token_file_round_trip(spark, odd, none):
    path = scratch_path(spark, "tokens")
    token_file.write_tokens(odd, path, default_vocabulary())
    rows = sorted(token_file.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    start = 0
    for row, (doc_id, text, *_) in zip(rows, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = whole_ids(text)
        assert tuple(row)[:4] == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(ODD)
    assert token_file.read_document(spark, path, 4) == [whole_ids(ODD[4][1]).tolist()] * 2
    token_file.write_tokens(none, empty := scratch_path(spark, "tokens"), default_vocabulary())
    assert token_file.read_tokens(spark, empty).count() == 0


def test_packing_places_every_token_once(spark, docs, odd, none):
    rows = packing.pack_documents(odd.unionByName(docs.selectExpr("*", "'x' AS kept")), default_vocabulary(), 4096).collect()
    total = sum(row["length"] for row in rows)
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for held in sequences.values():
        held.sort()
        assert [at for at, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 4096
    assert len(sequences) <= math.ceil(total / 4096) + 1
    long = whole_ids(ODD[7][1])
    pieces = {row["piece"]: row for row in rows if row["doc_id"] == 6 and row["length"] > 1000}
    assert all(row["ids_crc32"] == zlib.crc32(long[4096 * k : 4096 * (k + 1)].tobytes()) for k, row in pieces.items() if k)
    assert packing.pack_documents(none, default_vocabulary()).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 5, 5]
    bins = packing.local_search([[0], [1], [2, 4], [3, 5]], lengths, 10)
    assert len(bins) == 3 and sorted(i for held in bins for i in held) == list(range(6))


def test_kneser_ney_sums_to_one(spark):
    model = quality_model.fit(spark.createDataFrame([("a b a c",), ("a b",), (None,), ("",)], "text string"))
    for history in ("", "a", "b a", "zz zz"):
        texts = [f"{history} {word}".strip() for word in ("a", "b", "c", "unknown")]
        logs = [model.log_probabilities(pa.array([text]))[0][-1] for text in texts]
        assert abs(sum(map(math.exp, logs)) - 1) < 1e-5


def test_quality_classifier(docs, labels, odd, none):
    rows = quality_model.judge(docs, labels, train_docs=40).collect()
    good = {row["doc_id"] for row in labels.where("quality = 1").collect()}
    long = [row for row in rows if row["doc_id"] in good and row["n_words"] >= 20]
    assert len(rows) == docs.count() and sum(row["kept"] for row in long) >= 0.95 * len(long)
    kept = {(r["doc_id"], r["kept"]) for r in quality_model.judge(odd, labels.where("false")).collect()}
    assert {(1, False), (2, False), (3, False), (4, True), (None, True)} <= kept
    assert quality_model.keep_good(none, labels).columns == none.columns


def test_quality_limits_come_from_held_out_documents(spark, docs, labels):
    rows = quality_model.judge(docs, labels).collect()
    assert all(row["threshold"] is not None for row in rows)
    quality = {row["doc_id"]: row["quality"] for row in labels.collect()}
    bad = [row for row in rows if quality.get(row["doc_id"]) == 0 and row["n_words"] >= 20]
    good = [row for row in rows if quality.get(row["doc_id"]) == 1]
    assert sum(not row["kept"] for row in bad) >= len(bad) / 2
    assert sum(row["kept"] for row in good) >= 0.95 * len(good)
    kept = {row["doc_id"] for row in quality_model.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {row["doc_id"] for row in rows if row["kept"]}
    # Every language has a limit of its own, even with one or two trusted documents.
    few = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30)), f"l{i // 2}") for i in range(9)], "doc_id long, text string, lang string")
    trusted = few.selectExpr("doc_id", "1 AS quality")
    model, sample = quality_model.train(few, trusted)
    limits, _ = quality_model.thresholds(quality_model.scores(few, model), trusted, sample)
    assert sample.count() == 4 and limits.count() == 5


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, odd, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    rows = fertility.judge(docs).collect()
    for row in rows:
        counts = base_counts(texts[row["doc_id"]])
        assert tuple(row[name] for name in names) == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (row["base_failed"] and row["kept"])
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in fertility.keep_good(docs).collect()}
    assert not any(row["kept"] for row in fertility.judge(odd).collect())
    assert fertility.keep_good(none).columns == none.columns and fertility.judge(none).count() == 0


def test_license_scan(spark, none):
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (1, f"code code {mit} more"),
        (2, mit.replace("software", "program").replace("charge", "cost")),
        (3, "Released under the MIT License.\nReleased under the MIT License."),
        (4, "a plain text about licenses and permission"),
        (5, None),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["license"], found[1]["coverage"]) == ("MIT", 1.0)
    assert found[2]["license"] == "MIT" and 0.8 <= found[2]["coverage"] < 1
    assert found[3]["n_found"] == 2 and found[4]["license"] is None and found[5]["n_found"] == 0
    assert licenses.align("x a b c".split(), "a b q c".split()) == [(1, 0), (2, 1), (3, 3)]
    assert licenses.scan(none).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=24).round(1).tolist()) for i in range(300)]
    vectors += [(20, [1.0] * 24), (301, None), (302, [float("nan")] * 24), (303, [1.0, None]), (None, [1.0]), (304, [0.5])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    queries = table.where("vec_id % 20 = 0")
    found = [tuple(r) for r in topk.top_k(table, queries, k=5).collect()]
    usable = [(i, v) for i, v in vectors if i is not None and v and None not in v and v[0] == v[0]]
    whole = [(i, np.pad(np.floor(64 * np.array(v, "f4").astype(float)), (0, 24 - len(v)))) for i, v in usable]
    expected = []
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-int(q @ c), j) for j, c in whole if j != i)[:5]
            expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted(found) == sorted(expected)
    assert topk.top_k(table.where("false"), queries.where("false")).count() == 0


def test_toxicity(spark, labels, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, known).join(known, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits >= 0.5 * sum(r["toxic"] for r in rows) and hits >= 0.7 * sum(r["predicted"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, labels).collect())
    assert toxicity.score(none, labels.where("false")).count() == 0


def test_poisson_mixing(spark, odd, none):
    rows = mixing.mix_sources(odd, seed=3).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ODD}
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    many = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'b', 'a') AS source")
    counts = dict(mixing.mix_sources(many, weights, size=40_000).groupBy("source").count().collect())
    assert abs(counts["a"] - 30_000) < 700 and abs(counts["b"] - 10_000) < 400
    times = Counter(r["doc_id"] for r in mixing.mix_sources(many, weights, size=40_000).where("source = 'b'").collect())
    mean, spread = np.mean([times[i] for i in range(0, 20_000, 10)]), np.var([times[i] for i in range(0, 20_000, 10)])
    assert abs(mean - 5) < 0.3 and abs(spread - 5) < 0.7
    assert mixing.mix_sources(none).count() == 0


def slow_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, odd, none):
    both = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text").where("doc_id IS NOT NULL"))
    texts = [tuple(row) for row in both.collect()]
    prints = [slow_fingerprint(text) for _, text in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {g: min(texts[i][0] for i in range(len(texts)) if group[i] == g) for g in set(group)}
    expected = sorted((d, f"{p:016x}", first[g]) for (d, _), p, g in zip(texts, prints, group))
    assert sorted(tuple(r) for r in simhash.near_duplicates(both).collect()) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    values = {int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")

    def roots(links):
        return {r["node"]: r["root"] for r in simhash.components(links).collect()}

    assert roots(simhash.near_links(table, bucket=4)) == roots(simhash.near_links(table))


def test_every_pair_within_the_radius_shares_a_table():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(mask & flips == 0 for mask in masks)


def test_interpolation(docs, odd, none):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = [tuple(row) for row in both.collect()]
    tokens = [[*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in texts]
    fold = [None if d is None else zlib.crc32(str(d).encode()) % 7 for d, _ in texts]
    counts = Counter(w for f, own in zip(fold, tokens) if f not in (None, 2) for w in own)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(d), len(own), sum(w in counts for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4))
        for (d, _), own in zip(texts, tokens)
    )
    rows = interpolation.score(both, 1 << 17).collect()
    found = sorted((str(r[0]), r[2], r[3], r[4], round(r["base_score"], 4)) for r in rows)
    assert [x[:4] for x in found] == [x[:4] for x in expected]
    assert np.allclose([x[4] for x in found], [x[4] for x in expected])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in rows)
    assert interpolation.score(none).count() == 0


def test_pipeline_keeps_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        docs.write.parquet(path := scratch_path(spark, "stage"))
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(whole_ids(r["text"])) for r in docs.collect())
