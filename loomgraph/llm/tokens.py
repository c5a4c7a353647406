"""Token ids by a ``tokenizers`` file, fast on repetitive text.

The split of byte-level BPE never lets a token cross the boundary before a single
space that follows and precedes something other than white space.  So such texts are
cut there, every different word is encoded once by the library, and a text is put
together from the ids of its words.  Texts with other white space next to a space
go to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable

AWKWARD = re.compile(r" (?=\s)|\s (?!\s)| $|^ ")
_CACHE_WORDS = 250_000
#: How byte-level BPE splits text: a fixed value of that format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """The same encoding from ranks, which has less to do per word, if the file is plain byte-level BPE.

    That is so if merges are listed in the order of the ids that they make; otherwise None.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(made):
        return None
    import tiktoken

    byte, special = _byte_of(), {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Encodes texts to ids, as little-endian unsigned 32-bit integers in ``bytes``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # texts with an added token's string go to the library whole, as it decides where that is a token
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = _ranked(path)
        # two generations: what is in neither is encoded, what the older has moves up
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [_packed(self.fast.encode_ordinary(t)) for t in texts]
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; none for null and empty ones."""
        if len(self.words) > _CACHE_WORDS:
            self.older, self.words = self.words, {}
        whole: dict[int, str] = {}
        split: dict[int, list[str]] = {}
        missing: set[str] = set()
        out: list[bytes] = []
        for i, text in enumerate(texts):
            out.append(b"")
            if not isinstance(text, str) or not text:
                continue
            if self.added and self.added.search(text):
                out[i] = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            if AWKWARD.search(text):
                whole[i] = text
                continue
            first, *rest = text.split(" ")
            whole[i] = first
            split[i] = rest
            missing.update(rest)
        new = []
        for w in missing.difference(self.words):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.words[w] = ids
        for w, ids in zip(new, self._encode([" " + w for w in new])):
            self.words[w] = ids
        for i, ids in zip(whole, self._encode(list(whole.values()))):
            out[i] = ids
        get = self.words.__getitem__
        for i, rest in split.items():
            out[i] += b"".join(map(get, rest))
        return out


_HELD: dict[str, Tokens] = {}


def held(path: str) -> Tokens:
    """The encoder of this process, whose words outlive the task (workers are reused)."""
    if path not in _HELD:
        _HELD[path] = Tokens(path)
    return _HELD[path]
