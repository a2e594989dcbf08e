"""Toxicity on tokens and unclosed marks of a million characters: same finds as the plain patterns, in linear time."""

import random
import re
import time

from foliograph.llm import toxicity

#: The rules as patterns, which read a line again for every mark that is not closed.
PLAIN_QUOTED = re.compile(
    r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‘[^’\n]+’(?!\w)|`[^`\n]+`|(?<!\w)'(?=\w)[^\n']*(?:(?<=\w)'(?=\w)[^\n']*)*'(?!\w)|^[ \t]*>[^\n]*", re.M
)
PLAIN_RUN = re.compile(r"[^\W\d_]+(?:(?:[^\w\s]|[\d_])+[^\W\d_]+)+")


def test_same_as_the_plain_patterns():
    r = random.Random(2)
    for signs, plain, own in (("\"“”„«»‘’`'''  \n\n>\tab1_é-.", lambda t: [m.span() for m in PLAIN_QUOTED.finditer(t)], toxicity.quotations), ("ab1_é-. \n中½", PLAIN_RUN.findall, toxicity.RUN.findall)):
        for _ in range(20_000):
            text = "".join(r.choice(signs) for _ in range(r.randint(0, 24)))
            assert own(text) == plain(text), text


def test_linear():
    for text in ("a" * 1_000_000 + "1", "„" * 500_000, '"' + "«" * 500_000, "'a " * 300_000, "‘a’b" * 200_000, "a1" * 400_000 + "1", "1" * 500_000 + "a" * 500_000):
        began = time.time()
        toxicity.RUN.findall(text)
        toxicity.quotations(text)
        assert time.time() - began < 5


def test_features_of_a_long_token():
    began = time.time()
    got = toxicity.Scorer({"idiot": 1.0}).features("a" * 1_000_000 + "1 you idiot " + "„" * 200_000 + "b1" * 200_000 + "1")
    assert time.time() - began < 20
    assert got[1] > 0 and got[7] > 0
