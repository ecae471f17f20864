import numpy as np
import xxhash

from matchweave.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_matches_plain_version():
    for text in (None, "", " \t\n", "a", "A b C", "a b c d", "Ä ä ß x y z " * 7, "w" * 100_000, "x y " * 40_000):
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_trie_finds_every_near_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            keys.add(b ^ sum(1 << int(f) for f in flips))
    fps = np.array(sorted(keys), dtype=np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    for blocks in (5, 6):
        got = set()
        for order, exact in simhash.layouts(4, blocks):
            keys = simhash.permuted(fps, order)
            by = np.argsort(keys)
            for i, j in simhash.trie_links(keys[by], exact, 4):
                got |= {(max(x, y), min(x, y)) for x, y in zip(by[i].tolist(), by[j].tolist())}
        assert got == want


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs, group_rows=50).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fp % 2**64 for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == brute_components(fps)


def test_edge_rows(spark):
    schema = "doc_id long, text string, component string, fp string, node long"
    none = simhash.near_duplicates(spark.createDataFrame([], schema))
    assert none.count() == 0
    rows = [(4, None, "", "", 1), (2, " \n", "", "", 1), (9, "a b", "", "", 1), (9, "a b", "", "", 1), (None, "a b", "", "", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (2, 2), (4, 2), (9, 9), (9, 9)]
