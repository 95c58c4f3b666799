import random

import numpy as np
from tokenizers import Tokenizer

from siltstone.llm import tokenfile


def test_ranks_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = np.array([rng.choice([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.int64)
        control, data = tokenfile.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert tokenfile.decode_ranks(control, data, n).tolist() == ranks.tolist()


def test_runs_encode_as_whole_texts():
    model, own, rng = Tokenizer.from_file(tokenfile.TOKENIZER), tokenfile.WordTokenizer(), random.Random(2)
    odd = [9, 10, 13, 28, 31, 133, 160, 0x300, 0x308, 0x345, 0x1680, 0x2028, 0x200B, 0xFEFF, 0x130, 0x1E9E, 0x3A3]
    texts = ["".join(chr(rng.choice([32, rng.randrange(32, 127), rng.randrange(0x3000), rng.choice(odd)])) for _ in range(60)) for _ in range(2000)]
    texts += ["a <|endoftext|> b<|startoftext|>c", " ", "x" * 3000]
    for text, ids in zip(texts, own.encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == model.encode(text, add_special_tokens=False).ids


def test_files(docs, no_docs):
    model = Tokenizer.from_file(tokenfile.TOKENIZER)
    manifest = tokenfile.write_token_files(tokenfile.token_ids(docs), file_ids=300)
    assert manifest.count() > 4
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read_token_files(manifest).collect()))
    want = {(r.doc_id, tuple(model.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect()}
    assert len(got) == docs.count() and {(k, tuple(x)) for _, k, x in got} == want
    assert [s for s, _, _ in got] == np.cumsum([0, *(len(x) for _, _, x in got)])[:-1].tolist()
    assert [k for _, k, _ in got if k is not None] == sorted(k for _, k, _ in got if k is not None) and got[0][1] is None
    direct = tokenfile.read_token_files(tokenfile.write_documents(docs))
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in direct.collect()} == want
    assert tokenfile.read_token_files(tokenfile.write_documents(no_docs)).count() == 0


def test_other_tokenizers_encode_whole_texts(spark, docs):
    path = tokenfile.public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), tokenfile.WordTokenizer(path)
    assert tokenfile.WordTokenizer().by_runs and not own.by_runs
    texts = ["Two  Words\n\tof\x1c THE text ", "", "it's  12 x́"]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode([x.encode() for x in texts])] == [model.encode(x, add_special_tokens=False).ids for x in texts]
