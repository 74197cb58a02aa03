"""Token ids of texts by a public tokenizer file, and documents cut into pieces."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

END = 2
_RUN = re.compile(r"\s{2000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as little-endian uint32 bytes, of a tokenizer file of the tokenizers library.

    Byte-level BPE applies the merge of the lowest rank first, the leftmost of equals. Where a file's pre-tokenizer is the plain
    byte-level one and its ids are the bytes followed by the merges in order of rank (checked here, entry by entry), tiktoken, which
    takes ids as ranks, runs the same merges over the same pre-tokens, several times as fast; what is left to differ is the Unicode
    classes of the pre-tokenizer's pattern, which a test compares over all code points. Any other file is run by the library itself,
    and so are texts that tiktoken cannot take (very long runs of blanks) or that hold an added token's string.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._tok = path or default_path(), None
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import public_tokenizers
        import tiktoken

        model = spec["model"]
        plain_split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or any(pre.get(k) != v for k, v in plain_split.items()):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[ch] for ch in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if sorted(ranks.values())[:256] != list(range(256)) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tok(self):
        """The library's tokenizer, loaded when a text needs it."""
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_file(self.path)
        return self._tok

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.fast is None:
            return [self.whole(t) if t else b"" for t in texts]
        return [(self.whole(t) if _RUN.search(t) or self.added and self.added.search(t) else np.array(self.fast.encode_ordinary(t), "<u4").tobytes()) if t else b"" for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a file, built once in a process: a Python worker runs many tasks."""
    return Encoder(path)


def pieces(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first one takes the rest, so that all others are full."""
    first = n % room or min(n, room)
    return [(0, first), *((s, room) for s in range(first, n, room))]
