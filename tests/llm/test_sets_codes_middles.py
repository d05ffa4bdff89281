"""Set join, vector codes and fill-in-middle against brute force, and repaired cases of the other operators."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlight.llm import codes, fertility, fim, licenses, mixing, packing, set_join, simhash
from trawlight.llm.shingle_sets import shingle_sets
from trawlight.llm.tokens import default_vocabulary

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# Names that operators use inside or give to their results.
CLASHING = "doc_id long, text string, lang string, source string, n long, group long, number long, slot long, component_id string, form string"


def rows_of(df):
    return sorted(map(str, (tuple(row) for row in df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made_texts(seed, count):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    originals = [[rnd.choice(words) for _ in range(rnd.choice([5, 12, 60, 150]))] for _ in range(count)]
    texts = []
    for words_of in originals:
        texts.append(" ".join(words_of))
        for _ in range(rnd.randint(0, 4)):
            copy = list(words_of)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append("  ".join(copy).title())
    return texts


ODD = [None, "", " \n\t ", "one", "ONE", "one two", "one  two\n", "one two three", "a b c a b c", "é b c", "É b c", "x " * 30_000]


def shingles(text, width=3):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(rows):
    """Smallest id of what links lead to, by comparing every pair."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return [
        (doc_id, len(own), doc_id if not own else least.get(g)) for (doc_id, _), own, g in zip(rows, sets, group)
    ]


def test_set_join_equals_brute_force(spark):
    texts = [*made_texts(1, 70), *ODD]
    rows = [(i, text) for i, text in enumerate(texts, 10)]
    rows += [(None, texts[3]), (None, "only here and nowhere else at all"), (3, texts[3]), rows[5], rows[5]]
    table = spark.createDataFrame([(*row, None, None, 1, 2, 3, 4, "x", "y") for row in rows], CLASHING)
    assert rows_of(set_join.similar_sets(table.repartition(3))) == sorted(map(str, classes(rows)))
    assert set_join.similar_sets(table.limit(0)).count() == 0


def test_one_large_cluster_of_near_copies(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # copies of copies: links form chains through the whole cluster
        words[rnd.randrange(len(words))] = f"v{i}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(set_join.similar_sets(table)) == sorted(map(str, classes(rows)))


def test_cells_of_a_large_cluster_meet_group_by_group(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(640):  # some link, most are too far from each other but share many signatures
        words = list(base)
        for _ in range(rnd.choice([1, 3, 4, 5, 6])):
            words[rnd.randrange(len(words))] = f"v{i}"
        rows.append((i, " ".join(words)))
    stored, plain = {}, set_join.materialise

    def noted(df, label, path=None):
        stored.setdefault(label, []).append(plain(df, label, path))
        return stored[label][-1]

    monkeypatch.setattr(set_join, "materialise", noted)
    found = rows_of(set_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted(map(str, classes(rows)))
    met, shared = stored["matrix"][0].groupBy("part").count(), stored["shared"][0]
    assert shared.groupBy("part").count().agg(F.max("count")).first()[0] > 2 * set_join.GROUP
    assert met.agg(F.max("count")).first()[0] <= 640 / set_join.GROUP + 1
    # Pairs that whole sets are compared for, against those that share a signature.
    compared = sum(pairs.count() for label in ("first-pairs", "opened-groups") for pairs in stored[label])
    sharing = shared.alias("a").join(shared.alias("b"), "part").where("a.number < b.number")
    assert 4 * compared < sharing.select("a.number", "b.number").distinct().count()


def test_rows_of_a_large_cluster_are_pairs_of_groups(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rnd.choice([3, 4, 5])):
            words[rnd.randrange(len(words))] = f"v{i}"
        rows.append((i, " ".join(words)))
    stored, plain = {}, set_join.materialise

    def noted(df, label, path=None):
        stored.setdefault(label, []).append(plain(df, label, path))
        return stored[label][-1]

    monkeypatch.setattr(set_join, "materialise", noted)
    found = rows_of(set_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted(map(str, classes(rows)))
    groups = -(-500 // set_join.GROUP)
    for label in ("met-groups", "qualifying-groups"):
        assert 0 < stored[label][0].count() <= groups * (groups + 1) / 2


def test_sketches_differ_in_no_more_bytes_than_sets_in_tokens():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(9, 900))
        base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        drop, add = int(rng.integers(0, size // 5 + 2)), int(rng.integers(0, size // 5 + 2))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        one, two = set_join.sketch(base), set_join.sketch(other)
        apart = int(set_join.differing(one, two[None, :])[0])
        assert apart == int(set_join.differing(two, one[None, :])[0]) <= len(np.setxor1d(base, other))


def test_sets_within_the_threshold_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(400):
        size = int(rng.integers(9, 400))
        base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        drop, add = int(rng.integers(0, size // 9 + 2)), int(rng.integers(0, size // 9 + 2))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 90 * (len(base) + len(other) - common):
            assert np.isin(set_join.signatures(base), set_join.signatures(other)).any()


def test_shingle_hashes_tell_sets_apart():
    texts = [*made_texts(2, 20), *ODD]
    for first, sets in shingle_sets(pa.array(texts), 3):
        for i, own in enumerate(sets, first):
            assert len(own) == len(shingles(texts[i]))
            for j, other in enumerate(sets[: i - first], first):
                common = len(np.intersect1d(own, other))
                assert common == len(shingles(texts[i]) & shingles(texts[j]))


def slow_codes(rows, entries=64, rounds=2, parts=16):
    usable = [
        (i, label, np.floor(256 * np.array(v, np.float64)).astype(int))
        for i, v, label in rows
        if v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all()
    ]
    dims = -(-max(len(v) for _, _, v in usable) // parts) * parts
    data = [(i, label, np.pad(v, (0, dims - len(v))).reshape(parts, -1)) for i, label, v in usable]
    first = sorted((i, v.ravel().tolist()) for i, _, v in data if i is not None)[:entries]
    books = np.array([v for _, v in first]).reshape(len(first), parts, -1).transpose(1, 0, 2)

    def assign():
        return [[min(range(books.shape[1]), key=lambda e: (int(((v[p] - books[p, e]) ** 2).sum()), e)) for p in range(parts)] for _, _, v in data]

    for _ in range(rounds):
        codes_now, new = assign(), books.copy()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = [v[p] for (_, _, v), code in zip(data, codes_now) if code[p] == e]
                if own:
                    new[p, e] = [int(s) // len(own) for s in np.sum(own, axis=0)]
        books = new
    out = []
    for (i, label, v), code in zip(data, assign()):
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(int(((v[p] - books[p, c]) ** 2).sum()) for p, c in enumerate(code))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, label, code, error, sums[label], digest) for i, label, code, error in out]


@pytest.mark.parametrize("count", [150, 20])
def test_vector_codes_equal_brute_force(spark, count):
    rng = np.random.default_rng(count)
    rows = [(i, rng.normal(size=32).round(1).tolist(), [1, 2, None][i % 3]) for i in range(count)]
    rows += [rows[4], (5, rows[6][1], 1), (None, rows[7][1], 2), (900, None, 1), (901, [float("inf")] * 32, 1)]
    rows += [(902, [1.0, None], 1), (903, [0.5], None), (904, [], 2), (905, [0.1] * 32, 1), (906, [0.1] * 32, 1)]
    schema = "vec_id long, embedding array<double>, label int, code string, slot long, vector string, error string"
    table = spark.createDataFrame([(*row, "c", 1, "v", "e") for row in rows], schema).repartition(3)
    assert rows_of(codes.encode(table)) == sorted(map(str, slow_codes(rows)))
    assert codes.encode(table.limit(0)).count() == 0
    assert codes.encode(table.where("vec_id > 899 AND vec_id < 903")).count() == 0


def test_orchard_search_finds_the_nearest_lowest_entry():
    rng = np.random.default_rng(8)
    for width in (1, 2, 4):
        entries = rng.integers(-6, 6, (16, 64, width))  # many ties
        points = rng.integers(-8, 8, (300, 16, width))
        found, distance = codes.Codebooks(entries).nearest(points)
        gaps = np.square(points[:, :, None, :] - entries[None]).sum(-1)
        assert (found == gaps.argmin(2)).all() and (distance == gaps.min(2)).all()


def slow_middle(doc_id, text, unit):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    before, middle, after = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(before), len(middle), f"<S>{after}<P>{before}<M>{middle}"
    return doc_id, len(units), "psm", len(before), len(middle), f"<P>{before}<S>{after}<M>{middle}"


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fill_in_middle_equals_brute_force(spark, unit):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["a", "b ", "\n", "é", "中", "\U0001f600", "<", "<S", ">"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "x <M> y", "line\r\nline", "<", "no end", "é\n" * 20_000]
    rows = [(i if i % 50 else None, text) for i, text in enumerate(texts)] + [(7, "twice\nb"), (7, "twice\nb")]
    table = spark.createDataFrame([(*row, None, None, 1, 2, 3, 4, "x", "y") for row in rows], CLASHING).repartition(3)
    found = fim.fill_in_middle(table, unit)
    assert rows_of(found) == sorted(map(str, (slow_middle(*row, unit) for row in rows)))
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")))
    assert rows_of(back) == sorted(map(str, ((doc_id, text or "") for doc_id, text in rows)))
    assert fim.fill_in_middle(table.limit(0), unit).count() == 0
    assert {row.form for row in fim.fill_in_middle(table, unit, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(table, "page")


def fewest(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {fill: k for k, fill in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_finds_the_optimum_of_small_cases():
    rnd = random.Random(9)
    for _ in range(200):
        lengths = [rnd.randint(2, 12) for _ in range(rnd.randint(1, 10))]
        bins = packing.pack_group(lengths, 20)
        assert sorted(i for held in bins for i in held) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in held) <= 20 for held in bins)
        assert len(bins) == fewest(lengths, 20)


def test_packing_goes_on_until_nothing_helps():
    rnd = random.Random(1)
    lengths = [rnd.randint(1024, 2047) for _ in range(8000)]
    start = time.process_time()
    bins = packing.pack_group(lengths, 4096)
    assert len(packing.best_fit(lengths, 4096)) == 3331 and len(bins) <= 3200
    assert time.process_time() - start < 120


def test_packing_over_several_groups_and_clashing_columns(spark):
    rnd = random.Random(2)
    rows = [(n, rnd.randint(1, 100), "s", "o") for n in range(3000)] + [(n, 100, "s", "o") for n in range(5)]
    pieces = spark.createDataFrame(rows, "piece long, length long, sequence_id string, offset string")
    packed = packing.pack(pieces, 100, group_pieces=500)
    assert packed.columns == ["piece", "length", "sequence_id_in", "offset_in", "sequence_id", "offset"]
    held = {}
    for row in packed.collect():
        held.setdefault(row.sequence_id, []).append((row.offset, row.length))
    assert sum(map(len, held.values())) == len(rows)
    for places in held.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 100
    assert len(held) <= 1.02 * math.ceil(sum(row[1] for row in rows) / 100)
    empty = packing.pack(pieces.limit(0), 100)
    assert empty.count() == 0 and empty.columns == packed.columns


def test_near_dedup_stage_loses_no_text(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    a, b, c, d = (" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, f"{b} x"), (None, d), (None, c), (None, None), (4, ""), (4, "")]
    table = spark.createDataFrame([(*row, None, None, 1, 2, 3, 4, "x", "y") for row in rows], CLASHING).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, table, SF)
    assert kept.columns == table.columns
    assert rows_of(kept.select("doc_id", "text")) == sorted(map(str, [(1, a), (2, b), (3, c), (None, d), (4, "")]))


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("radius", [-1, 1, 3, 5, 6])
def test_radii_that_midpoints_cannot_serve_are_refused(spark, radius):
    with pytest.raises(ValueError):
        simhash.near_links(spark.range(3).withColumnRenamed("id", "fp"), radius)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_of_every_radius_equal_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    values = {int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(120)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    table = spark.createDataFrame([(k, v) for k in (1, 2) for v in values], "family int, fp long")
    group = list(range(len(values)))
    for i, x in enumerate(values):
        for j, y in enumerate(values[:i]):
            if ((x ^ y) & (2**64 - 1)).bit_count() <= radius and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    expected = {}
    for v, g in zip(values, group):
        expected.setdefault(g, []).append(v)
    expected = sorted(held for held in expected.values() if len(held) > 1)
    for bucket in (3, 1024):
        links = simhash.near_links(table, radius, bucket, by=("family",))
        for family in (1, 2):
            found = {}
            for row in simhash.components(links.where(F.col("family") == family).select("a", "b")).collect():
                found.setdefault(row["root"], []).append(row["node"])
            assert sorted(sorted(held) for held in found.values()) == expected


def brute_covered(words, template, needed):
    """Whether some window of the template's length aligns well enough."""
    size = len(template)
    return any(len(licenses.align(words[i : i + size], template)) >= needed for i in range(max(1, len(words) - size + 1)))


def test_licenses_in_one_piece_are_all_found(spark):
    texts = [row.text for row in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted, seen = tuple(licenses.TEMPLATES.items()), 0
    for text in texts:
        words = licenses.split_words(text)
        found = {hit[0] for hit in licenses.scan_text(text, wanted, 0.8)}
        for name, template in wanted:
            own = licenses.split_words(template)
            if len(set(own) & set(words)) >= 0.8 * len(set(own)) and brute_covered(words, own, 0.8 * len(own)):
                seen += 1
                assert name in found
    assert seen


def test_license_with_a_long_insertion(spark):
    words = licenses.TEMPLATES["GPL-3.0"].split()
    page = " ".join([*words[:35], *(f"header{i}" for i in range(40)), *words[35:]])
    notices = "Released under the MIT License. " * 5
    rows = [(1, f"{'before ' * 50}{page}{' after' * 50}"), (2, notices), (3, " ".join(words[:20]))]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].license, found[1].coverage) == ("GPL-3.0", 1.0)
    assert found[2].n_found == 5 and found[3].n_found == 0


def prose(seed, count, words):
    rnd = random.Random(seed)
    common = "the of and to in is was that with for on as at by from this which would there their".split()
    return [" ".join(rnd.choice(common + ["people", "water", "little", "number"]) for _ in range(words)) for _ in range(count)]


def test_sparse_cells_take_the_limits_of_wider_pools(spark):
    rows = [(i, text, "en") for i, text in enumerate(prose(1, 60, 200))]
    # A language of one clean, and one of one junk document; a cell of two; a length that only one document has.
    rows += [(100, prose(2, 1, 200)[0], "xx"), (101, " ".join(f"{c}#|{i}%$" for i, c in enumerate("qzjxk" * 30)), "yy")]
    rows += [(102 + i, text, "zz") for i, text in enumerate(prose(3, 2, 210))] + [(110, prose(4, 1, 5000)[0], "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {row.doc_id: row.kept for row in fertility.judge(table).collect() if not row.base_failed}
    assert kept[100] and kept[102] and kept[103] and not kept[101]
    assert {r.doc_id for r in fertility.keep_good(table).collect()} == {i for i, k in kept.items() if k}
    tiny = fertility.judge(table.where("doc_id = 100")).first()
    assert tiny.kept


def test_mixing_moves_the_texts_once_and_keeps_clashing_columns(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_copy", F.lit("mine"))
        mixed = mixing.mix_sources(docs)
        assert mixed.columns == [*docs.columns[:-1], "_copy_in", "_copy"]
        moved = [line for line in plan_of(mixed).split("\n") if "Exchange hashpartitioning" in line and "_tl_key" not in line]
        assert moved == [] and plan_of(mixed).count("Exchange hashpartitioning(_tl_key") == 1
        assert {row._copy_in for row in mixed.collect()} == {"mine"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nameless = spark.range(4000).selectExpr("CAST(null AS long) AS doc_id", "CAST(id AS string) AS text", "'s' AS source")
    spread = mixing.mix_sources(nameless, size=20_000.0).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) <= 1 or max(row["count"] for row in spread) < 0.9 * sum(row["count"] for row in spread)
