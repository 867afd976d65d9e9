"""Byte-level BPE ids for a ``tokenizers`` file, by two engines with the same result.

The JSON file's own library is exact but slow on many short texts, so texts normally go to a
rank-based encoder built from the same JSON (vocabulary ids of such files are the merge order).
Texts that hold a special token's string, or runs too long for the rank-based encoder (its cost
grows with the square of a run), go to the file's own library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\S{4096}|\s{4096}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        letters = _byte_letters()
        skip = set(self.specials)
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in skip}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.own.get_vocab_size()

    def _needs_own(self, text: str) -> bool:
        return (len(text) >= 4096 and _RUN.search(text) is not None) or any(s in text for s in self.specials)

    def ids(self, text: str) -> list[int]:
        if self._needs_own(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text has; one call of either engine for all of them."""
        own = [i for i, t in enumerate(texts) if self._needs_own(t)]
        out = [0] * len(texts)
        for i, e in zip(own, self.own.encode_batch([texts[i] for i in own], add_special_tokens=False)):
            out[i] = len(e.ids)
        rest = sorted(set(range(len(texts))).difference(own))
        for i, ids in zip(rest, self.fast.encode_ordinary_batch([texts[i] for i in rest], num_threads=1)):
            out[i] = len(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def safe_pieces(text: str, most: int = 1 << 20):
    """Cut a long text where no token of the byte-level pattern can cross: before a single space
    between two letters or digits. A stretch without such a place stays whole."""
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at != -1 and not (text[at - 1].isalnum() and at + 1 < len(text) and text[at + 1].isalnum()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    yield text[start:]
