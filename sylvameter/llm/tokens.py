"""Byte-level BPE ids of whole texts.

The vocabulary comes as a ``tokenizers`` file and as a rank file of the same tokens. The rank file is read here, and the
tokens that the ``tokenizers`` file adds to the ranks are split off first: both then give the same ids (tests compare
them with the library's default setting), and the rank reader takes about a fifth of the time.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from pathlib import Path

import tiktoken

#: Fixed value: the splitting pattern of the vocabulary, as its publisher gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe_path() -> str:
    """Where this machine keeps the public vocabulary; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_encoding(path: str) -> tiktoken.Encoding:
    """From a file of base64 tokens and their ranks. No special tokens: their strings are ordinary text."""
    lines = (x.split() for x in Path(path).read_bytes().splitlines())
    ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space that are longer are split off before the pattern, whose lookahead needs stack for each character.
LONG_SPACE = 10_000
#: The Unicode property White_Space, which Python's own class differs from.
_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")


def _ordinary(encoding: tiktoken.Encoding, text: str) -> array:
    """The ids of a text without added tokens.

    Of white space before a word the pattern takes all but the last character as one piece, and all at the end of a text.
    """
    if len(text) < LONG_SPACE:
        return array("I", encoding.encode_ordinary(text))
    out, at = array("I"), 0
    for run in _SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out.extend(encoding.encode_ordinary(text[at : run.start()]))
        out.extend(encoding._encode_single_piece(text[run.start() : stop]))
        at = stop
    out.extend(encoding.encode_ordinary(text[at:]))
    return out


def ids_bytes(encoding: tiktoken.Encoding, text: str) -> bytes:
    """The ids of ``text`` as unsigned 32-bit numbers in native (little-endian) order."""
    return _ordinary(encoding, text).tobytes()


def read_added(path: str) -> dict[str, int]:
    """The added tokens and their ids of the ``tokenizers`` file beside a rank file; none without such a file."""
    beside = Path(path).with_suffix(".json")
    if not beside.exists():
        return {}
    found = json.loads(beside.read_bytes())["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError(f"{beside} has added tokens that take more or less than their own text")
    return {t["content"]: t["id"] for t in found}


def whole_ids_bytes(encoding: tiktoken.Encoding, added: dict[str, int], text: str) -> bytes:
    """As ``ids_bytes``, with the id of each added token where its text stands."""
    if not any(t in text for t in added):
        return ids_bytes(encoding, text)
    longest_first = sorted(added, key=len, reverse=True)
    parts = re.split(f"({'|'.join(map(re.escape, longest_first))})", text)
    return b"".join(array("I", [added[x]]).tobytes() if i % 2 else ids_bytes(encoding, x) for i, x in enumerate(parts))
