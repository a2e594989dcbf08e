"""Borders that no piece crosses, and agendas that run side by side."""

import random

import pytest
import sentencepiece

from foliograph.llm import pieces, vocab

R = random.Random(12)
WORDS = ["".join(R.choice(["an", "th", "er", "e", "ü", "st", "i", "on"]) for _ in range(R.randint(2, 7))) for _ in range(1_500)]
TEXTS = [" ".join(w + R.choice(["", ",", "$$$", ".\nWer", "***", "漢", "\U0001f600"]) for w in R.choices(WORDS, k=40)) for _ in range(200)]


class Counted(pieces.Merger):
    alone = 0

    def merged(self, part):
        self.alone += 1
        return super().merged(part)


def test_few_parts_have_an_agenda_of_their_own():
    path = vocab.vocabulary_path("piece_bpe_32k.model")
    own, sp = Counted(path), pieces.library(path)
    slices = [s for _, s in pieces._slices(TEXTS)]
    table = pieces.pa.table({"doc_id": range(len(TEXTS)), "text": TEXTS})
    list(pieces.encoded_batches(table.to_batches(), own, sp))
    assert len(slices) == 1 and own.alone < 100  # of more than a thousand words with many ends each
    assert [own.encode(t) for t in TEXTS] == sp.encode(TEXTS)


@pytest.mark.parametrize("short", [32, 3])
def test_spaces_signs_and_forgotten_parts(monkeypatch, short):
    path = vocab.vocabulary_path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "SHORT", short)
    monkeypatch.setattr(pieces, "FEW", 1)
    monkeypatch.setattr(pieces, "MOST_KEPT", 40)
    monkeypatch.setattr(pieces, "LONGEST_KEPT", 5)
    own, sp = pieces.Merger(path), pieces.library(path)
    signs = [*"aeinrst ▁  \n\x00é漢", "the", "\U0001f600", "    "]
    for _ in range(300):
        texts = ["".join(R.choice(signs) for _ in range(R.randint(0, 50))) for _ in range(R.randint(0, 9))]
        ids, ends = own.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t) for t in texts]
        assert len(own.known.numbers) <= 40 and len(own.older.numbers) <= 40


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_characters_that_are_no_pieces(tmp_path, byte_fallback):
    name = str(tmp_path / "small")
    learnt = (t.translate({0x6F22: "", 0x1F600: "", 10: " "}) for t in TEXTS)
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=learnt, model_prefix=name, model_type="bpe", vocab_size=360, byte_fallback=byte_fallback, normalization_rule_name="identity", remove_extra_whitespaces=False, character_coverage=1.0, hard_vocab_limit=False, minloglevel=2)
    own, sp = pieces.Merger(f"{name}.model"), pieces.library(f"{name}.model")
    texts = [*TEXTS, "éé", "", "漢漢漢", "éan漢é", "é", "é é"]
    ids, ends = own.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)
    assert byte_fallback or sp.encode("漢漢漢").count(sp.unk_id()) == 1
