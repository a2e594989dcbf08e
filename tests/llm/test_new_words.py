"""Words met for the first time: encoded by a shorter way, with the same ids."""

import random

from foliograph.llm import pieces, tokenfile, vocab

R = random.Random(4)
SIGNS = "aeinrst  \n\t.,1é中ü▁\U0001f600"
TEXTS = ["".join(R.choice(SIGNS) for _ in range(R.randint(0, 40))) for _ in range(3_000)]


def test_short_parts_have_the_same_agenda(monkeypatch):
    path = vocab.vocabulary_path("piece_bpe_32k.model")
    own, sp = pieces.Merger(path), pieces.library(path)
    short = [own.encode(t) for t in TEXTS]
    assert short == sp.encode(TEXTS, num_threads=1)
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert short == [pieces.Merger(path).encode(t) for t in TEXTS[:500]] + short[500:]


def test_merges_alone_make_the_same_ids():
    path = vocab.vocabulary_path("byte_bpe_50k.json")
    one, library = vocab.word_encoder(path), vocab.tokenizer(path)
    words = [w for t in TEXTS for w in vocab.pieces(t)] + [chr(c) for c in range(1, 0x800)]
    assert [one(w) for w in words] == [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
    assert [tokenfile.Words(path).encode(t) for t in TEXTS[:50]] == [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in TEXTS[:50]]
