"""Byte-level BPE encoding for the operators that count or pack tokens.

``Encoder(path)`` reads a tokenizers JSON file.  Where that file is a plain
byte-level BPE whose merges stand in id order, the same vocabulary is also
loaded as ranks: texts made of long-settled characters then take the faster
encoder, all others (and texts that may hold a special token) the reference
one.  Both give the same ids, which the tests hold against each other.
"""

from __future__ import annotations

import json
import re

#: Fixed value: how byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters whose Unicode class every version of either library's tables agrees on.
_SETTLED = re.compile(
    "[\t\n\r -~¡-¬®-ɏΑ-ΡΣ-ώЁ-ЌЎ-яё-ќўџ"
    "‐-‧€ぁ-ゔァ-ヺ一-龥]*"
)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts; special tokens in a text get their ids, none are added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        try:
            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, split = spec["model"].get("vocab", {}), spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        ids = [vocab.get("".join(m), -1) for m in merges]
        plain = (
            spec["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True) and not spec.get("normalizer")
            and not spec["model"].get("ignore_merges") and all(a < b for a, b in zip(ids, ids[1:]))
        )
        if not plain:
            return None
        alphabet, special = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("settled", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and "<|" not in text and _SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
