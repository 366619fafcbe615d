"""Byte spans, phrases and centroids against brute force on odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywise.llm import bytespans, centroids, phrases

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, repeated rows and ids, passages shared in part, periodic text, characters of several bytes."""
    rng = random.Random(11)
    shared = prose(rng, 90, 4000)
    out = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (None, prose(rng, 80), "en"), (None, None, None)]
    out += [(10 + i, prose(rng, 60, 5000) + " " + shared[i * 7 : len(shared) - 11 * i] + "." + prose(rng, 30, 5000), "en") for i in range(12)]
    out += [(40 + i, out[8][1], "en") for i in range(25)]  # exact copies
    out += [(70 + i, out[9][1][: 150 + 3 * i] + "#" + out[9][1][151 + 3 * i :], "de") for i in range(20)]  # near copies
    out += [(100, "a" * 900, "fr"), (101, "a" * 1500 + "b", "fr"), (102, "ab" * 400, "fr"), (103, "Über straße naïve 東京, " * 30, "de")]
    out += [(104, prose(rng, 30_000, 3000), "fr"), (105, "x" + shared, None), (106, shared + "y", None)]
    out += [out[10], out[10], (out[11][0], prose(rng, 90), "en")]
    out += [(200 + i, "New York! new york; NEW YORK: new york city hall\tnew york city hall. The new york city hall", "en") for i in range(12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [F.lit("clash").alias(c) for c in ("kind", "rank", "t1", "phrase", "_key", "cuts")]
    return spark.createDataFrame(rows, SCHEMA).select("*", *extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(rows, length):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = Counter()
    for r, b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[r[0], len(b), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_byte_spans_equal_brute_force(docs, rows, length):
    got = bytespans.remove_repeats(docs, length=length, keep=False).collect()
    assert Counter(tuple(r) for r in got) == brute_spans(rows, length)


def test_kept_bytes_and_an_empty_table(docs, rows, empty):
    kept = bytespans.remove_repeats(docs).collect()
    assert Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in kept) == Counter({(k[0], k[4]): n for k, n in brute_spans(rows, 200).items()})
    assert bytespans.op11_byte_spans(empty).collect() == []
    assert bytespans.op11_byte_spans(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_blocks_of_a_long_text_miss_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(bytespans, "_BLOCK", 500)
    rng = random.Random(3)
    passage = prose(rng, 120, 9000)
    table = [(i, prose(rng, 400, 9000) + passage + prose(rng, 50 * i, 9000), "en") for i in range(4)]
    starts = bytespans.runs(table[0][1].encode(), 200)
    assert sum(starts[2].tolist()) == len(table[0][1].encode()) - 199
    got = bytespans.remove_repeats(spark.createDataFrame(table, SCHEMA), keep=False).collect()
    assert Counter(tuple(r) for r in got) == brute_spans(table, 200)


def test_runs_settle_nothing_that_doubling_would_not(spark):
    """Strings that begin before a difference and end after it share an anchor but not their bytes."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh") for _ in range(2000))
    table = [(0, base, "en")] + [(i, base[: 37 * i] + "Z" + base[37 * i + 1 :], "en") for i in range(1, 50)]
    got = bytespans.remove_repeats(spark.createDataFrame(table, SCHEMA).repartition(7), keep=False).collect()
    assert Counter(tuple(r) for r in got) == brute_spans(table, 200)


def brute_phrases(rows, least, top, share):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(100 * b >= share * a for q, b in cand.items() if q[0] == lang and len(q) > len(p) and w in (q[1:3], q[2:4])):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("shard", [1 << 20, 37])
def test_phrases_equal_brute_force(monkeypatch, docs, rows, empty, shard):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    chosen = docs.filter("doc_id is null or doc_id <> 104") if shard < 100 else docs
    table = [r for r in rows if r[0] != 104] if shard < 100 else rows
    got = sorted(tuple(r) for r in phrases.op12_collocations(chosen).collect())
    assert got == brute_phrases(table, 10, 2000, 50)
    assert got and phrases.op12_collocations(empty).collect() == []


def test_few_phrases_of_a_language_are_the_first(docs, rows):
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=3, top=7, share=80).collect())
    assert got == brute_phrases(rows, 3, 7, 80)


def test_suffix_array_and_shared_lengths():
    rng = np.random.RandomState(4)
    for n in (0, 1, 2, 50, 300):
        ids = rng.randint(0, 3, n)
        order, shared = phrases.suffix_array(ids, 3)
        cut = [tuple(ids[i : i + 4]) for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(n))
        for i in range(1, n):
            a, b = ids[order[i - 1] :], ids[order[i] :]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert shared[i] == min(same, 3)


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 10**13), ("en", 1, "a", 10**12 + 7), ("en", 1, "b", 10**12 + 9), ("en", 2, "a b", 10**12 + 1)]
    monkeypatch.setattr(phrases, "ngram_counts", lambda *_: spark.createDataFrame(counts, "lang string, words int, phrase string, f long"))
    (row,) = phrases.collocations(spark.createDataFrame([], SCHEMA)).collect()
    a, left, right = 10**12 + 1, 10**12 + 7, 10**12 + 9
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1000000 * a * a // (left * right))


def brute_clusters(table, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in table if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        c = [[sum(x) // own.count(j) for x in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == j], strict=True)] if j in own else x for j, x in enumerate(c)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, j, d, total[j], sum(total.values()), name[j]) for i, d, j in last)


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, _v string"


def test_clusters_equal_brute_force(spark):
    rng = np.random.RandomState(2)
    table = [(i, [float(x) for x in np.round(rng.randn(4) + 3 * (i % 5), 2).astype(np.float32)]) for i in range(120)]
    table += [(200 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(30)]  # alike: ties and a hot vector
    table += [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan"), 1.0, 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0, 1.0])]
    table += [(306, [1e5, -1e5, 3e5, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (None, [2.0, 1.0, 1.0, 1.0]), table[3], table[3]]
    rows = spark.createDataFrame([(i, v, None, "clash", "clash") for i, v in table], VECTORS).repartition(5)
    got = centroids.clustered(rows, clusters=12, rounds=5, size=4).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(table, 12, 5, 4)
    few = rows.filter("vec_id < 5")
    assert Counter(tuple(r) for r in centroids.clustered(few, clusters=12, rounds=2, size=4).collect()) == brute_clusters([t for t in table if t[0] is not None and t[0] < 5], 12, 2, 4)
    assert centroids.op13_annulus(rows).collect() == [] and centroids.op13_annulus(rows.limit(0)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 4, None, "", "")], VECTORS), size=4).collect()


def test_the_annulus_holds_ties_on_its_edge_and_leaves_others_out():
    far = np.array([[3, 4, 0], [5, 0, 0], [0, 0, 5], [400, 0, 0], [0, 900, 0], [-5, 0, 0]])
    model = centroids.Centroids(far)
    v = np.array([[0, 0, 0], [1, 0, 0], [401, 0, 0], [0, 0, 0]])
    number, distance, computed = model.nearest(v)
    assert number.tolist() == [0, 1, 3, 0] and distance.tolist() == [25, 16, 1, 25]
    assert computed < len(v) * (len(far) + 1)
    big = np.array([[1 << 27, -(1 << 27)], [0, 1]])
    number, distance, _ = centroids.Centroids(big).nearest(np.array([[-(1 << 27), 1 << 27], [1 << 27, 0]]))
    assert number.tolist() == [1, 1] or distance.tolist() == [min(2 * (1 << 28) ** 2, (1 << 54) + ((1 << 27) - 1) ** 2), 1 << 54]
