"""Token ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Characters outside these ranges may differ in class between the Unicode versions of two splitters.
NOT_SAFE = re.compile("[^\u0000-՗‐-‧ぁ-ゖァ-ヺ一-龥가-힣]")
#: The pattern by which byte-level vocabularies split a text before merging. Fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids by a tokenizers file, without added tokens at the ends; special strings in a text become their ids.

    A byte-level vocabulary whose ids follow its merges has a faster encoder with the same ids; it takes the texts
    whose characters both split alike, and the library the others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.fast = self._fast(json.load(file))

    @staticmethod
    def _fast(spec: dict):
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout")
            and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
        )
        if not plain:
            return None
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if made != sorted(made):
            return None
        import tiktoken

        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not NOT_SAFE.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
