"""Token ids of whole texts with a public tokenizer file.

A byte-level BPE tokenizer splits a text before a space that a visible character
follows, whatever stands around it, so such units can be encoded one by one.
Natural text repeats its units; a bounded cache of them saves most of the merging
work. Units of Latin letters are one pre-token each: they go to the library's model
alone, which saves looking for pre-tokens and places in them. Texts that hold the string of an added token, and all texts where the file
has another pre-tokenizer, a normalizer or a post-processor, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np

#: Units in a worker's cache; it is emptied beyond that.
CACHE_UNITS = 1_000_000
LONG_UNIT = 64
_ODD = re.compile(r" (?=\s)| $")
_CUT = re.compile(r" (?=\S)")
_TAIL = ".,!?;:#$%&*|"
_MARKS = frozenset(_TAIL)
#: Latin letters: a run of them is one pre-token, with the space before it.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder: its cache outlives a task, as Spark reuses its Python workers."""
    own = sys.modules.setdefault("_foliant_worker", types.ModuleType("_foliant_worker"))
    if getattr(own, "encoder", ("", None))[0] != path:
        own.encoder = path, Encoder(path)
    return own.encoder[1]


class Encoder:
    """Encodes texts to arrays of ids, equal to what the tokenizers library gives for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in made["added_tokens"]]
        first = made["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and made["model"]["type"] == "BPE"
        self.by_units = plain and not (made["normalizer"] or made["post_processor"] or made["truncation"] or made["padding"])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        if self.by_units:  # what the pre-tokenizer makes of a space and of the letters that are not ASCII
            shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.space = shown(" ")[0][0]
            self.letters = {c: shown(chr(c))[0][0] for c in range(0xC0, 0x250) if _LETTERS(chr(c))}
            self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}  # of a unit without its space: the ids of the space and the unit
        self.heads: dict[str, bytes] = {}  # of what stands before a text's first cut

    @staticmethod
    def units(text: str) -> list[str]:
        """What lies between the cuts; all but the first stand for themselves with a space before them."""
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 1024):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]
        return out

    def _words(self, words: list[str], before: str) -> Iterator[tuple[str, bytes]]:
        """Words of Latin letters with their ids, by the model alone: each is one pre-token, with `before` in front of it."""
        split, letters = self.model.tokenize, self.letters
        width = self.dtype.itemsize
        for i in range(0, len(words), 4096):
            some, ids, ends = words[i : i + 4096], [], []
            for word in some:
                ids += [t.id for t in split(before + (word if word.isascii() else word.translate(letters)))]
                ends.append(len(ids) * width)
            raw, start = np.array(ids, self.dtype).tobytes(), 0
            for word, end in zip(some, ends):
                yield word, raw[start:end]
                start = end

    def _learn_heads(self, firsts: set[str]) -> None:
        words = [x for x in firsts if _LETTERS(x)]
        self.heads.update(self._words(words, ""))
        rest = list(firsts.difference(words))
        self.heads.update(zip(rest, self._encode(rest)))

    def _lines(self, units: set[str]) -> list[tuple[str, list[str]]]:
        """Units that hold lone line ends between visible characters, with their lines: a lone line end is a token of its own,
        and what follows it begins like a text."""
        if self.newline is None:
            return []
        cut = ((u, u.split("\n")) for u in units if "\n" in u)
        return [(u, lines) for u, lines in cut if all(lines) and len(u.split()) == len(lines) and max(map(len, lines)) <= LONG_UNIT]

    def _learn(self, units: set[str]) -> None:
        """Put units into the cache; those of several lines by their lines, which recur more often."""
        lined = self._lines(units)
        if not lined:
            return self._learn_words(units)
        self._learn_words(units.difference(u for u, _ in lined).union(lines[0] for _, lines in lined).difference(self.cache))
        self._learn_heads({x for _, lines in lined for x in lines[1:]}.difference(self.heads))
        end = np.array([self.newline], self.dtype).tobytes()
        known, heads = self.cache, self.heads
        for unit, lines in lined:
            known[unit] = end.join([known[lines[0]], *[heads[x] for x in lines[1:]]])

    def _learn_words(self, units: set[str]) -> None:
        """Put units into the cache. A mark after a letter begins a new token, so marks at a unit's end go apart."""
        known, parts, cores, tails = self.cache, [], set(), set()
        for unit in units:
            if unit[-1:] not in _MARKS:
                cores.add(unit)
                continue
            core = unit.rstrip(_TAIL)
            if core and core[-1].isalpha():
                tail = unit[len(core) :]
                parts.append((unit, core, tail))
                cores.add(core)
                tails.add(tail)
            else:
                cores.add(unit)
        cores = cores.difference(known)
        words = [u for u in cores if _LETTERS(u)]
        known.update(self._words(words, self.space))
        cores.difference_update(words)
        # printable units without a space have no white space at all
        plain = [u for u in cores if u.isprintable() and " " not in u and u] if self.newline is not None else []
        width = self.dtype.itemsize
        for i in range(0, len(plain), 4096):
            # one text of many units: a newline between them is a token of its own, and no unit holds one
            some = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" " + "\n ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids)) * width
            raw, start = ids.tobytes(), 0
            for unit, end in zip(some, ends.tolist(), strict=True):
                known[unit] = raw[start:end]
                start = end + width
        rest = list(cores.difference(known))
        known.update(zip(rest, self._encode([" " + u for u in rest])))
        if parts:
            tails = list(tails)
            after = dict(zip(tails, self._encode(tails)))
            for unit, core, tail in parts:
                known[unit] = known[core] + after[tail]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, t in enumerate(texts) if not self.by_units or any(a in t for a in self.added)]
        if not whole:
            return self._by_units(texts)
        out = dict(zip(whole, (np.frombuffer(b, self.dtype) for b in self._encode([texts[k] for k in whole]))))
        rest = [k for k in range(len(texts)) if k not in out]
        out |= zip(rest, self._by_units([texts[k] for k in rest]) if rest else [])
        return [out[k] for k in range(len(texts))]

    def _by_units(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        if len(self.heads) > CACHE_UNITS // 10:
            self.heads.clear()
        split = [self.units(t) for t in texts]
        heads, seen = [units[0] for units in split], set()
        for units in split:
            del units[0]
            seen.update(units)
        new = seen.difference(self.cache)
        self._learn(new)
        firsts = set(heads).difference(self.heads)
        self._learn_heads(firsts)
        find = self.cache.__getitem__
        out = [np.frombuffer(self.heads[head] + b"".join(map(find, units)), self.dtype) for head, units in zip(heads, split)]
        for cache, units in ((self.cache, new), (self.heads, firsts)):
            for unit in units:
                if len(unit) > LONG_UNIT:
                    del cache[unit]
        return out
