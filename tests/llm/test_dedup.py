import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import near, simhash
from lodestrand.llm.common import Scratch
from lodestrand.llm.exact_dedup import directory, exact_dedup
from lodestrand.llm.graph import components
from lodestrand.llm.xxh import xxh64_ranges


def brute_exact(rows):
    """(doc_id, text) in order of reading -> (doc_id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc is None, doc, i))
    out = []
    for body, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1] if m[1] is not None else 0, m[2]))
        out += [(doc, first[1], len(members), i == first[2], hashlib.sha256(body.encode()).hexdigest()) for _, doc, i in members]
    return sorted(map(repr, out))


def result(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_odd_rows(odd, weak):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text", F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
    options = {"key": lambda text: (F.length(text) % 3).cast("bigint"), "capacity": 2, "max_depth": 3} if weak else {}
    assert result(exact_dedup(odd, **options)) == brute_exact(rows)


def test_exact_dedup_no_rows(none):
    assert exact_dedup(none).count() == 0


def test_exact_dedup_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(exact_dedup(documents, capacity=10)) == brute_exact(rows)


def test_directory_splits_overfull_buckets(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [5 + i for i in range(300)]
    found = directory(spark.createDataFrame([(k,) for k in keys], "key bigint"), 40, 8)
    assert sum(n for *_, n in found) == len(keys)
    assert sum(2 ** (8 - d) for d, *_ in found) == 2**8  # every slot belongs to one bucket
    assert all(n <= 40 or d == 8 for d, _, n in found) and len({d for d, *_ in found}) > 1


def test_xxh64_equals_the_library():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(3000))
    starts = np.array([rng.randrange(2900) for _ in range(800)])
    lengths = np.array([rng.randrange(90) for _ in range(800)])
    assert xxh64_ranges(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(doc_id, fingerprint) -> smallest doc_id of each row's component."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                label[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [low.get(find(i)) for i in range(len(rows))]


def check_simhash(df, texts):
    rows = [(doc, brute_fingerprint(t)) for doc, t in texts]
    want = sorted(repr((doc, f"{fp:016x}", c)) for (doc, fp), c in zip(rows, brute_components(rows)))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in df.collect()) == want


def test_simhash_odd_rows(odd):
    check_simhash(simhash.simhash_dedup(odd), [(r.doc_id, r.text) for r in odd.collect()])


def test_simhash_documents(documents):
    check_simhash(simhash.simhash_dedup(documents), [(r.doc_id, r.text) for r in documents.collect()])


def test_simhash_no_rows(none):
    assert simhash.simhash_dedup(none).count() == 0


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        masks = [m % 2**64 for m in simhash.covering_masks(radius)]
        for _ in range(300):
            bits = rng.sample(range(64), radius)
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in bits)
            assert any(x & m == y & m for m in masks)


def test_links_connect_all_near_fingerprints(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:6]:  # clouds of fingerprints around one, and chains
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")), Scratch(spark, "t"))
    got = {r.node % 2**64: r.root % 2**64 for r in found.collect()}
    order = sorted(fps)
    want = brute_components(list(zip(order, order)))
    groups = defaultdict(set)
    for f, c in zip(order, want):
        groups[c].add(f)
    mine = defaultdict(set)
    for f in order:
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (101, 102), (102, 101), (101, 102)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == got[102] == 101


def test_survivors(odd):
    kept = simhash.survivors(simhash.simhash_dedup(odd))
    decisions = simhash.simhash_dedup(odd)
    assert kept.count() == kept.distinct().count() == decisions.select("component_key").distinct().count()


def brute_near(texts):
    """Pairs of places whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, places, common = [], defaultdict(list), defaultdict(int)
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
        for x in sets[-1]:
            for j in places[x]:
                common[j, i] += 1
            places[x].append(i)
    return [(i, j) for (i, j), n in common.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_blocks_connect_what_first_rows_do_not(spark):
    """A chain of edits: each text is near the next few, but not near the first of its buckets."""
    rng = random.Random(3)
    texts, words = [], [f"w{k}" for k in range(120)]
    for _ in range(260):
        words = list(words)
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    label = list(range(len(texts)))
    for i, j in brute_near(texts):
        a, b = label[i], label[j]
        label = [b if x == a else x for x in label]
    want = defaultdict(set)
    for i, x in enumerate(label):
        want[x].add(i)
    got = defaultdict(set)
    for r in near.near_dedup(docs.withColumn("row", F.col("doc_id")), "row").collect():
        got[r.component_key].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_group_of_copies_costs_rows_in_proportion(spark):
    """Dealt-out rows of a group of m near copies stay far below m * m / BLOCK."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = [edited(rng, base, 2) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    found = near.links(docs)
    assert found.count() < 20 * len(texts)
    assert near.near_dedup(docs.withColumn("doc_id", F.col("row_id")), "row_id").select("component_key").distinct().count() == 1


def test_near_dedup_equals_brute_force(spark, documents):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 150, 400]))] for _ in range(12)]
    texts = [edited(rng, w, rng.randrange(0, 1 + len(w) // 20)) for w in bases for _ in range(12)]
    texts += [edited(rng, bases[0], rng.randrange(3)) for _ in range(300)] + [None, "", " ", "One two", "one  TWO"]  # more than one block
    texts += [r.text for r in documents.collect()]
    pairs = brute_near(texts)
    label = list(range(len(texts)))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [b if x == a else x for x in label]
    want = defaultdict(set)
    for i, x in enumerate(label):
        want[x].add(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = defaultdict(set)
    for r in near.near_dedup(docs.withColumn("row", F.col("doc_id")), "row").collect():
        got[r.component_key].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {min(g) for g in want.values()}


def test_near_links_by_fingerprints_alone(spark, monkeypatch):
    import random

    import numpy as np

    from lodestrand.llm import near, simhash
    from lodestrand.llm.common import Scratch
    from lodestrand.llm.graph import components

    # no two sets share a band here, so that all candidates are those of the fingerprints
    bands = near.BANDS
    monkeypatch.setattr(near, "band_keys", lambda s: np.random.default_rng(int(s[0])).integers(0, 1 << 62, bands) ^ int(s[-1] >> np.uint64(2)) ^ len(s))
    rng, texts = random.Random(5), []
    for _ in range(15):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words + ["more"]), " ".join(words[:150] + ["x"] * 40)]
    sets = [set(near.shingles(t).tolist()) for t in texts]
    fps = [simhash.fingerprint(t, near.WORDS) for t in texts]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2 and alike(i, j)}
    assert len(want) >= 3
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    root = {r.node: r.root for r in components(near.links(rows), Scratch(spark, "t")).collect()}
    got = {(i, j) for i in root for j in root if j < i and root[i] == root[j]}
    assert want <= got and all(alike(i, j) for i, j in got)
