"""Public byte-level BPE vocabularies and the pattern that splits text before the merges.

Worker-side code.  The vocabulary files' folder is a parameter; by default the
package ``public_tokenizers`` says where they are.
"""

from __future__ import annotations

import base64
import functools
import os
import re

#: What the pattern calls letters, numbers and white space below U+0250.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\\t-\\r \\x85\\xa0"
_SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _general():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def pieces(text: str) -> list[str]:
    """The pre-tokens of ``text``, in order; joined they are the text."""
    return (_general() if _BEYOND.search(text) else _SIMPLE).findall(text)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def piece_encoder(path: str):
    """Encodes one pre-token as a whole."""
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The token-byte table: as many rows as the vocabulary, whatever the corpus."""
    return {i: b for b, i in ranks(path).items()}


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def word_encoder(path: str):
    """Encodes one pre-token by the library's merges alone; None if the vocabulary does more to a word than write its bytes as letters."""
    import json

    library = tokenizer(path)
    own = json.loads(library.to_str())
    before = own["pre_tokenizer"] or {}
    if own["normalizer"] or own["post_processor"] or own["model"]["type"] != "BPE" or own["model"].get("dropout") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves; the others follow from 256
    letters = dict.fromkeys(plain) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    letters = {b: b if to is None else to for b, to in letters.items()}
    merges = library.model
    return lambda word: [t.id for t in merges.tokenize(word.encode().decode("latin-1").translate(letters))]


@functools.cache
def added_tokens(path: str):
    """A pattern for the tokens that the library cuts out of a text before anything else; None if there are none."""
    found = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, found))) if found else None
