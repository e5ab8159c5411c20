"""Subword ids by a public tokenizers file.

A byte-level BPE whose ids follow the order of its merges is the same as ranked merging, which tiktoken does several
times faster; texts go that way if all their characters are ones that both libraries class alike and no run without space is very
long. Everything else, and any other kind of tokenizer, is encoded by the tokenizers library. Either way the ids are its ids."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters or with a very long run are left to the tokenizers library.
_ODD = re.compile("[^\x00-ɏ‐-‧€]")
_LONG = re.compile(r"\S{1000}|\s{1000}")
#: Words that are not encoded alone: such as these two, and words with spaces that may be split off together with a space beside the word.
_APART = re.compile(r"[^\x00-ɏ‐-‧€]|[\x85\xa0]|\S{1000}")


def _bytes_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """encode() gives each text's ids; special tokens in a text are plain text. The tokenizers library is loaded where it is needed."""

    def __init__(self, path: str):
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = self._ranked(file)
        vocabulary = self._vocabulary(file)
        self.size = max(vocabulary.values()) + 1
        self.end = vocabulary.get("<|endoftext|>", self.size - 1)
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in ("Ġ", "▁")]] = True

    def _vocabulary(self, file: dict) -> dict[str, int]:
        if self.fast is None:
            return self.slow.get_vocab()
        return file["model"]["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens") or []}

    @property
    def slow(self):
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow

    def _ranked(self, file: dict):
        model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not file.get("normalizer")
        if not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
            return None
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(merged):
            return None
        import tiktoken

        of = _bytes_of()
        special = {t["content"] for t in file.get("added_tokens") or []}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def alone(self, words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin among them, how many it has) of words, a space before each: what they have in any text of such words.

        A word that may be split otherwise beside others, or is not ranked merging's to encode, has -1 ids. Words have no \x09-\x0D."""
        odd = np.full(words.count(" "), self.fast is None)
        if self.fast is not None and _APART.search(words):
            odd = np.array([_APART.search(w) is not None for w in words[1:].split(" ")])
            words = "".join(f" {w}" for w, o in zip(words[1:].split(" "), odd.tolist(), strict=True) if not o)
        begin, size = np.zeros(len(odd), np.int64), np.full(len(odd), -1)
        if odd.all():
            return np.zeros(0, np.uint32), begin, size
        ids = self.fast.encode_to_numpy(words, disallowed_special=())
        begin[~odd] = np.flatnonzero(self.begins[ids])  # no id but a word's first has a space
        size[~odd] = np.diff(begin[~odd], append=len(ids))
        return ids, begin, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.fast is None or _ODD.search(t) or _LONG.search(t):
                slow.append(i)
            else:
                out[i] = self.fast.encode_to_numpy(t, disallowed_special=())
        for i in slow:
            out[i] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One Encoder for all tasks of a worker."""
    return Encoder(path)
