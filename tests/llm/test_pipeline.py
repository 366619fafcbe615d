"""The corpus pipeline on the smallest tables, stage by stage, and on odd rows."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaywise.llm import neardup, queries, quality, simhash

SF = "/root/testdata/sf0.001"


def least_of_groups(texts):
    """The least id of each group of texts that five-word shingles of similarity 0.8 link."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    least = {k: k for k in texts}
    keys = sorted(texts)
    for j, b in enumerate(keys):
        for a in keys[:j]:
            if 4 * max(len(sets[a]), len(sets[b])) <= 5 * min(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {k: low if x == high else x for k, x in least.items()}
    return set(least.values())


def test_stages_keep_columns_and_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        if name == "quality rules":
            want = quality.op1_quality_ledger(before).filter("kept").select("doc_id")
            assert sorted(map(tuple, want.collect())) == sorted(map(tuple, docs.select("doc_id").collect()))
        elif name == "SimHash near-dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == least_of_groups(texts)
            clean = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0")
            kept_clean = docs.join(clean, "doc_id").select("doc_id").collect()
        elif name == "secret scans":
            assert docs.count() == before.count()
        else:
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            toxic = {r.doc_id for r in before.join(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1"), "doc_id").collect()}
            assert all(r.doc_id in left for r in kept_clean)
            assert len(toxic & left) < len(toxic)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(tokens) == docs.count() and all(r.n == r.m for r in tokens)


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate string, p string, fp string"
    body = " ".join(f"word{i}" for i in range(80)) + " password=abcdefghijkl1234"
    rows = [(None, None, None, None, None, "x", "y", "z"), (1, body, "en", "a", 3, None, None, None), (1, body, "en", "a", 3, None, None, None), (2, body + " more", None, None, None, None, None, None), (None, body.upper(), "en", "b", 1, "", "", "")]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, out, SF)
            assert got.columns == docs.columns
            out = spark.createDataFrame(got.collect(), schema)
        corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]


def test_dedup_keeps_unlinked_rows_of_null_and_repeated_ids(spark):
    bodies = [" ".join(f"{name}{i}" for i in range(60)) for name in ("ash", "beech", "cedar", "elm")]
    rows = [(None, bodies[0]), (None, bodies[1]), (None, bodies[0]), (5, bodies[2]), (5, bodies[3]), (3, bodies[3]), (5, bodies[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, bodies[0]), (None, bodies[1]), (5, bodies[2]), (3, bodies[3])], key=str)


def test_dedup_finds_the_pairs_of_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, " \n", "one two", "One  TWO"]
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                other[at] = "new" + str(rng.randrange(5000))
            texts.append(" ".join(other))
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    least = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((least[i], least[j]))
        least = [a if x == b else x for x in least]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, neardup.near_duplicates(rows, "doc_id", "text").collect()))
    assert got == dict(enumerate(least))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect()}
    assert kept == set(least)
    far = [(i, j) for i, j in pairs if (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 4]
    assert len(far) > 20


def test_dedup_decides_bands_that_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 8)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(70)]  # a passage that makes texts alike by half, so that they meet in bands
    texts = []
    for k in range(60):
        own = [f"t{k}w{i}" for i in range(60)]
        texts.append(" ".join(common + own))
        if k % 3 == 0:
            at = rng.randrange(60)
            texts.append(" ".join(common + own[:at] + ["x"] + own[at + 1 :]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect()}
    assert kept == least_of_groups(dict(enumerate(texts)))


def test_dedup_bands_recall():
    rng = np.random.RandomState(3)
    met, likely, tries = 0, 0, 1500
    for _ in range(tries):  # sets of 180 of which 160 are shared: a similarity of exactly 0.8
        both = rng.randint(1, 1 << 62, 200, dtype=np.int64).astype(np.uint64)
        a, b = both[:180], both[20:]
        assert neardup.alike(np.sort(a), np.sort(b))
        least = neardup.minima(a), neardup.minima(b)
        met += bool((neardup.band_keys(least[0]) == neardup.band_keys(least[1])).any())
        signs = [np.frombuffer(neardup.signature(x), np.uint8) for x in least]
        likely += bool((signs[0] == signs[1]).sum() >= neardup.LIKELY)
    assert met / tries > 0.98 and likely / tries > 0.995


def test_dedup_makes_no_row_for_each_pair_of_a_band(spark, monkeypatch):
    """Texts of similarity near 0.75 meet in bands and agree in their signatures, but don't link: their pairs cost no rows."""
    rng, n, made = random.Random(11), 150, []
    common = [f"c{i}" for i in range(400)]
    texts = []
    for k in range(n):
        at = rng.randrange(350)
        texts.append(" ".join(common[:at] + [f"t{k}w{i}" for i in range(56)] + common[at:]))
        if k % 10 == 0:  # some that do link, late or not
            texts.append(texts[-1].replace(f"t{k}w5 ", f"x{k} "))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decided = neardup._decided

    def counted(pairs, *args):
        made.append(pairs.count())
        return decided(pairs, *args)

    monkeypatch.setattr(neardup, "_decided", counted)
    monkeypatch.setattr(neardup, "TILE_ROWS", 64)
    got = dict(map(tuple, neardup.near_duplicates(rows, "doc_id", "text").collect()))
    assert set(got.values()) == least_of_groups(dict(enumerate(texts)))
    assert sum(made) <= 2 * neardup.BANDS * len(texts) < len(texts) * (len(texts) - 1) // 2


def test_dedup_tiles_give_a_row_a_text_at_most():
    """All pairs of a tile link, in many bands; batches end within the tile."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"own{i}"] + base[i + 1 :]) for i in range(0, 120, 2)]
    runs = [neardup.shingles(x) for x in texts]
    least = [neardup.minima(r) for r in runs]
    keys = np.array([neardup.band_keys(m) for m in least])
    found = set()
    for k in range(neardup.BANDS):
        for band in np.unique(keys[:, k]):
            at = np.flatnonzero(keys[:, k] == band)
            rows = [(5, int(i), len(runs[i]), int(i), 0, int(band), neardup.signature(least[i]), keys[i].tolist(), runs[i].tobytes()) for i in at]
            names = ["tile", "node", "size", "part", "side", "band", "sig", "keys", "runs"]
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            out = [tuple(r.values()) for b in neardup._joins(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
            assert len(out) < len(at)
            found |= set(out)
    label = list(range(len(texts)))
    for a, b in found:
        assert neardup.alike(runs[a], runs[b])
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert set(label) == least_of_groups(dict(enumerate(texts)))
