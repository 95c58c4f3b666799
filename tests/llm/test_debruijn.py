import random

import numpy as np

from siltstone.llm import debruijn


def plain(rows, window):
    first = {}
    docs = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    for d, words in docs:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                first[key] = min(d, first.get(key, d))
    for d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        yield d, b" ".join(kept).decode(), len(words), len(gone)


def test_same_as_plain(spark, docs, no_docs):
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(250):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 7))]
        texts.append("\n".join(parts) + " a b" * rng.randrange(0, 15) * (rng.random() < 0.2))
    texts += texts[:20]
    order = rng.sample(range(1000), len(texts))
    mixed = spark.createDataFrame(list(zip(order, texts)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    rows = mixed.collect()
    for window, block_chars, bucket_nodes in ((13, 3000, 500), (13, 10**9, 10**9), (3, 2000, 2000)):
        got = debruijn.remove_repeats(mixed, window, block_chars, bucket_nodes)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, window), key=repr)
    assert debruijn.remove_repeats(no_docs.select("doc_id", "text")).count() == 0


def test_spans_name_their_sources(spark):
    run = " ".join(f"r{i}" for i in range(60))
    rows = [(1, f"a b {run} c"), (2, f"{run}"), (3, f"x y z {run} w"), (4, "nothing of that here but enough words to make a window of their own")]
    spans = debruijn.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, spans)) == [(1, 2, 60, 1, 2), (2, 0, 60, 1, 2), (3, 3, 60, 1, 2)]


def test_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        for top in (300, 1 << 40, (1 << 64) - 1):
            values = np.unique(rng.integers(0, top, n, np.uint64))
            assert debruijn.unpack_sorted(debruijn.pack_sorted(values)).tolist() == values.tolist()
            around = rng.integers(0, 1 << 48, len(values), np.uint64)
            nodes, back = debruijn.unpack_ends(debruijn.pack_ends(values, around))
            assert nodes.tolist() == values.tolist() and back.tolist() == around.tolist()


def test_words_that_a_power_sum_confuses(spark):
    """Words, and runs of words, in the pattern in which any polynomial modulo 2^64 takes one for the other."""
    turns = [bin(i).count("1") % 2 for i in range(1 << 11)]
    for long in (200, 256, 1024, 2048):
        a, b = ("".join("xy"[t ^ flip] for t in turns[:long]) for flip in (0, 1))
        shared = " ".join(f"w{i}" for i in range(12))
        rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared} {a}")]
        got = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 13, 0), (2, 13, 0), (3, 13, 13)]
    runs = [[f"{'ab'[t ^ flip]}" for t in turns] for flip in (0, 1)]
    words = debruijn.Words([" ".join(x).encode() for x in runs])
    n = len(turns)
    whole = words._runs.of(np.array([0, n]), np.array([n, 2 * n]))
    assert whole[0] != whole[1]


def test_run_hashes_are_exact():
    rng, p = random.Random(4), debruijn._PRIME
    a, b = ([rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(500)] for _ in range(2))
    assert debruijn._times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]
    values = np.array([rng.choice([0, (1 << 64) - 1, rng.getrandbits(64)]) for _ in range(3000)], np.uint64)
    sums, total = debruijn.RunHashes(values).sums, 0
    for k, v in enumerate(values.tolist()):
        assert int(sums[k]) == total
        total = (total + v % p * pow(debruijn._BASE, k, p)) % p


def test_one_id_and_no_id_and_long_texts(spark):
    run = " ".join(f"r{i}" for i in range(30))
    long = " ".join(f"z{i % 70_000}" for i in range(400_000))
    rows = [(None, run), (None, run), (None, None), (5, run), (5, run + " x"), (5, run), (9, f"q {run}"), (7, long), (8, long + " " + "y" * 1_000_000)]
    got = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=200).collect()
    want = list(plain([type("R", (), {"doc_id": d, "text": t}) for d, t in rows], 13))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
