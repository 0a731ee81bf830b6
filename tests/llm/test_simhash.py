import random
from collections import Counter

import numpy as np
import xxhash

from plain import groups_of
from tablelens.llm import golay
from tablelens.llm import simhash as S
from tablelens.llm.common import table
from tablelens.llm.components import components
from tablelens.llm.queries import QUERIES

ALL = (1 << 64) - 1


def plain_fingerprint(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, most):
    ids = sorted(fps)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if ((fps[a] ^ fps[b]) & ALL).bit_count() <= most]


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    words = [rng.getrandbits(23) for _ in range(200)]
    own = golay.ball_indexes(np.array(words))
    assert max(len(set(r)) for r in own.tolist()) <= 6
    for w, keys in zip(words, own.tolist(), strict=True):
        a, b = rng.randrange(23), rng.randrange(23)
        assert set(keys) & set(golay.ball_indexes(np.array([w ^ 1 << a ^ (a != b) << b]))[0].tolist())


def test_keys_meet_for_all_allowed_errors(spark):
    rng = random.Random(2)
    for bits in (2, 5):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << p for p in rng.sample(range(64), bits))
            keys = S._keys_of(np.array([a, b], np.uint64).view(np.int64), bits)
            assert set(keys[1][keys[0] == 0].tolist()) & set(keys[1][keys[0] == 1].tolist())


def test_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    groups = groups_of(linked(fps, 2), fps)
    for r in QUERIES["op8_simhash"](spark, folder).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (fps[r["doc_id"]], groups[r["doc_id"]])


def test_crowded_keys_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(S, "MEETING", 8)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(3)}
    for f in list(fps):
        fps |= {f ^ sum(1 << p for p in rng.sample(range(60), rng.randint(0, 4))) for _ in range(40)}
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node long, words array<long>")
    whole = {f: f for f in fps}
    for most, make in ((2, S.fingerprint_links), (5, lambda n, crowd: S.similar_links(n, 5, crowd))):
        want = groups_of(linked(whole, most), fps)
        for crowd in (1, 1000):
            links = [(r["a"], r["b"]) for r in make(nodes, crowd=crowd).collect()]
            assert groups_of(links, fps) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 150)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == groups_of([x for x in links if x[0] != x[1]], {n for x in links if x[0] != x[1] for n in x})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_windows_of_shingles_change_nothing(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 4)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 23):
        text = " ".join(f"W{i * 7 % 5}" for i in range(n))
        assert S.fingerprint_of(text, 3)[0] & ALL == plain_fingerprint(text)


def test_odd_rows(odd):
    found = S.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[0] == by[1] == by[2] == {(0, 0)} and by[4] <= by[5]
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(documents):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    near, other = list(base), [f"v{rng.randrange(500)}" for _ in range(400)]
    near[17], near[300] = "changed", "too"
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(other), None, ""]
    rows = documents([*enumerate(texts), (None, " ".join(base)), (None, "alone here")])
    kept = S.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 3), (False, 4), (True, 0)]
    assert S.one_of_each(rows.limit(0)).count() == 0


def plain_set(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({tuple(words)} if words else set())


def jaccard_pairs(texts, least):
    """All pairs at that similarity, by counting the shingles they have in common."""
    sets, held, common = {i: plain_set(t) for i, t in texts.items()}, {}, Counter()
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in held.setdefault(s, []))
            held[s].append(i)
    empty = [i for i in sorted(sets) if not sets[i]]
    near = [p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= least]
    return near + list(zip(empty, empty[1:], strict=False))


def similar_texts(rng, groups, lengths=(60, 120, 300)):
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice(lengths))]
        texts.append(" ".join(base))
        for edits in rng.sample(range(1, max(3, len(base) // 20)), 2):
            words = list(base)
            for at in rng.sample(range(len(base)), edits):
                words[at] = f"new{rng.random()}"
            texts.append(" ".join(words))
    return dict(enumerate(texts))


def components_found(docs):
    return {r["doc_id"]: r["component_id"] for r in S.similar_documents(docs).collect()}


def test_similar_documents_equal_brute_force(documents):
    texts = similar_texts(random.Random(11), 250)
    near = jaccard_pairs(texts, 0.8)
    assert len(near) > 100 and len(jaccard_pairs(texts, 0.7)) > len(near) + 20
    assert components_found(documents(list(texts.items()))) == groups_of(near, texts)


def test_similar_documents_of_the_tables_equal_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert components_found(docs) == groups_of(jaccard_pairs(texts, 0.8), texts)


def test_crowded_bands_give_the_same_components(documents, monkeypatch):
    rng = random.Random(12)
    base, texts = [f"w{i}" for i in range(200)], []
    for _ in range(60):  # near one another at all grades, so that chains run through the crowd
        words = list(base)
        for at in rng.sample(range(200), rng.randint(1, 12)):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    texts = dict(enumerate(texts))
    want = groups_of(jaccard_pairs(texts, 0.8), texts)
    assert len(set(want.values())) > 1
    for few, meeting, weight in ((1, 8, 1 << 20), (1, 2048, 1500), (8, 2048, 1 << 21), (1000, 2048, 1 << 21)):
        monkeypatch.setattr(S.jaccard_links, "__defaults__", (few,))
        monkeypatch.setattr(S, "MEETING", meeting)
        monkeypatch.setattr(S, "WEIGHT", weight)
        assert components_found(documents(list(texts.items()))) == want


def test_linked_fingerprints_propose_pairs_that_sets_confirm(spark):
    rng = random.Random(13)
    near = [rng.getrandbits(62) for _ in range(40)]
    sets = {1: near, 2: [*near[:39], 7], 3: near[:20], 4: [rng.getrandbits(62) for _ in range(40)], 5: near[:38]}
    fps = {1: 5 << 40, 2: 5 << 40 ^ 1 << 63 ^ 4, 3: 5 << 40 ^ 8, 4: 5 << 40, 5: 5 << 40 ^ 15}
    signed = {i: (f + (1 << 63)) % (1 << 64) - (1 << 63) for i, f in fps.items()}
    rows = [(i, len(x), [], signed[i]) for i, x in sets.items()]  # no band is shared
    nodes = spark.createDataFrame(rows, "node long, size int, keys array<long>, fp long")
    held = spark.createDataFrame(list(sets.items()), "node long, words array<long>")
    found = S.jaccard_links(nodes, lambda asked: held.join(asked, "node"), 0.8).collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, 2)]  # 3 and 4 are near in bits alone, 5 by its set alone


def test_fingerprint_of_a_set_is_its_majority():
    text = " ".join(f"w{i}" for i in range(50))
    assert S.majority_of(S.shingle_set_of(text, 5)) == S.fingerprint_of(text, 5)[0]
    assert S.majority_of(S.shingle_set_of("", 5)) == 0
