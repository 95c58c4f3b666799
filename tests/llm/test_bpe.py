import random

import numpy as np
import tiktoken

from siltstone.llm import bpe


def test_same_as_tiktoken(spark, docs, no_docs):
    model = bpe.ByteBpe()
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    rng = random.Random(3)
    odd = [9, 10, 13, 28, 31, 133, 160, 0x1680, 0x180E, 0x2028, 0x200B, 0xFEFF]
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.choice(odd), rng.randrange(0x10000, 0x20000)])) for _ in range(80)) for _ in range(500)]
    for text in [*texts, "", "a" * 5000, "<|endoftext|>"]:
        assert np.frombuffer(model.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
        assert model.decode(model.encode(text)) == text.encode()
    got = bpe.encode_texts(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_lines", "_ids", "decoded"]
    rows = sorted(((r["doc_id"], bytes(r["_ids"]), bytes(r["decoded"])) for r in got.collect()), key=repr)
    want = [(r.doc_id, np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()]
    assert rows == sorted(want, key=repr)
    back = bpe.decode_ids(got.select("doc_id", "_ids"), "_ids")
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(x[2] for x in want)
    assert bpe.encode_texts(no_docs).count() == 0
