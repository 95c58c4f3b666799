import random

import numpy as np
import xxhash

from siltstone.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def clustered(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set()
    while len(out) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randrange(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_join_finds_all_pairs():
    rng = random.Random(4)
    fps = np.array(clustered(rng, 700), np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 4}
    got = simhash.trie_self_join(np.zeros(len(fps), np.int64), fps, 4, forest_only=False, held=500)
    assert len(got) == len(want) and {tuple(sorted(x)) for x in got} == want
    assert len(simhash.trie_self_join(np.zeros(len(fps), np.int64), fps, 4)) < len(fps)


def test_components_of_clusters(spark):
    rng = random.Random(6)
    fps = clustered(rng, 900)
    rng.shuffle(fps)
    nodes = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)], "node long, fp long")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == plain_components(fps, 4)


def test_near_duplicates(docs, no_docs):
    rows = [r for r in docs.collect()]
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fps, 4)
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f, least.get(root)) for r, f, root in zip(rows, fps, roots)), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_id_with_unlinked_texts(spark):
    a, b = (" ".join(f"{x}x{k}" for k in range(100)) for x in (1, 2))
    rows = [(70, a), (70, b), (65, a + " tail"), (None, b + " tail"), (None, "alone")]
    assert all(0 < bin(plain_fingerprint(x) ^ plain_fingerprint(x + " tail")).count("1") <= 4 for x in (a, b))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, plain_fingerprint(t), c) for (i, t), c in zip(rows, (65, 70, 65, 70, None))]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(want, key=repr)
