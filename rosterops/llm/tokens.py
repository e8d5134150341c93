"""Token ids of whole texts by the ``tokenizers`` library, each distinct word of a batch once.

A tokenizer that drops white space and splits at it before merging gives a text the ids of
its words, one word after the other. For those, a batch of texts is cut into words and its
distinct words numbered in Arrow; the library encodes these, and numpy puts the texts together
again. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rosterops.llm.frames import kept

TOGETHER = 256  # words the library gets as one text


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    return kept(("encoder", path), lambda: Encoder(path))


def word_wise(spec: dict) -> bool:
    """Does the tokenizer drop white space and treat what lies between alone?"""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "\\s" in str(s["pattern"]) for s in steps)
    return drops and spec["model"].get("end_of_word_suffix") == "</w>"


class Encoder:
    """``encode(texts)`` gives all ids in a row, and where each text's ids end."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.last = np.zeros(self.size, bool)
        self.last[[number for word, number in vocabulary.items() if word.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = word_wise(spec)
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word or any("<|" in text for text in texts):  # a special token counts as written, capitals and all
            return self._library(texts)
        column = pa.array(texts, pa.large_string())
        words = pc.ascii_split_whitespace(pc.ascii_lower(column) if self.lower else column)
        numbered = pc.dictionary_encode(words.flatten())
        ids, reached = _repeat(*self._words(numbered.dictionary), numbered.indices.to_numpy())
        return ids, np.append(0, reached)[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [one.ids for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.kind), np.cumsum([len(ids) for ids in found], dtype=np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words. A comma or full stop behind a small ASCII letter is a piece of
        its own for the tokenizer, so such a word has the ids of its stem and the sign's."""
        signed = pc.match_substring_regex(words, "[a-z][.,]$")
        stems = pc.dictionary_encode(pc.if_else(signed, pc.utf8_slice_codeunits(words, 0, -1), words))
        ids, ends = _repeat(*self._stems(stems.dictionary), stems.indices.to_numpy())
        (stop, comma), _ = self._library([".", ","])
        at = np.flatnonzero(signed.to_numpy(zero_copy_only=False))
        commas = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)[at]
        return np.insert(ids, ends[at], np.where(commas, comma, stop)), ends + np.cumsum(signed.to_numpy(zero_copy_only=False))

    def _stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters go to the library many to a text: each is one piece, whose last id
        ends it. A text with another number of pieces than words is encoded word by word."""
        letters = pc.utf8_is_alpha(words)
        order = np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")
        words, n = words.take(pa.array(order)), pc.sum(letters).as_py() or 0
        firsts = np.append(np.arange(0, n, TOGETHER), n)
        plain = words.slice(0, n).to_pylist()
        ids, ends = self._library([" ".join(plain[a:b]) for a, b in zip(firsts, firsts[1:])])
        found, lengths, start = [], [], 0
        for first, after, end in zip(firsts, firsts[1:], ends):
            part = ids[start:end]
            stops = np.flatnonzero(self.last[part]) + 1
            if len(stops) != after - first:
                part, stops = self._library(plain[first:after])
            found.append(part)
            lengths.append(np.diff(stops, prepend=0))
            start = end
        rest, stops = self._library(words.slice(n).to_pylist())
        ids, sizes = np.concatenate([*found, rest]), np.concatenate([*lengths, np.diff(stops, prepend=0)]).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _repeat(ids, np.cumsum(sizes), back)


def _repeat(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``which``, one after the other, and where each ends."""
    lengths = np.diff(ends, prepend=0)
    sizes = lengths[which]
    reached = np.cumsum(sizes)
    total = int(reached[-1]) if len(reached) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    places = np.repeat(((ends - lengths)[which] - (reached - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return ids[places], reached


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> list[np.ndarray]:
    """Each text's ids as unsigned 32-bit integers, and the end id."""
    out = np.insert(ids.astype("<u4"), ends, end_id)
    return np.split(out, (ends + np.arange(1, len(ends) + 1))[:-1])
