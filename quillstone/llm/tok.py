"""Whole-text encoding by a public tokenizer, with a bounded table of segments.

No token crosses a segment's borders, so the library's model encodes each distinct segment once. Texts are cut and looked up
by 64-bit hashes of their segments in numpy, and joined from the table. Tests hold this against the library's own
encode_batch.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import regex

from .common import SPACE, mix, span_hashes

#: Segments, and ids of all segments, that a worker's table holds; those not used since the last clearing go first.
CACHE, CACHE_IDS = 800_000, 6_000_000
#: Slots of the table of the segments met last, which most lookups end in.
SLOTS = 1 << 17
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")
#: White space beyond ASCII.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_OPEN: dict[str, "Encoder"] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


#: That of a space.
SPACE_LETTER = byte_letters()[32]


def release() -> None:
    """Drop this worker's encoders and their tables.

    Workers are reused by later jobs of a session; operators that need their memory for something else call this first.
    """
    _OPEN.clear()


def split(text: str) -> list[str]:
    """Parts between white space; the separators 1C to 1F, which str.split takes for such, are none."""
    return text.split() if not _CONTROL.search(text) else [x for x in _SPACE.split(text) if x]


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter: a capital sigma has no final form."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII in UTF-8 bytes."""
    if len(data) < 3 or not (data >= 0x80).any():
        return np.zeros(0, np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    got = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    got |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    got |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    got |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    at = np.flatnonzero(got)
    if data[-2] == 0xC2 and data[-1] in (0x85, 0xA0):
        at = np.append(at, len(data) - 2)
    return at


class Recent:
    """Two generations of at most size entries (and one call's) each: what isn't used for a generation goes."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """Keys without an entry; all others are in the young generation after this."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new = set(keys).difference(self.young)
        seen = [k for k in new if k in self.old]
        self.young.update((k, self.old[k]) for k in seen)
        return list(new.difference(seen))


class Segments:
    """Ids of segments by their hashes. An entry keeps its number until the table is cleared."""

    def __init__(self) -> None:
        self.order_hash, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.hash, self.flat, self.filled = np.zeros(0, np.uint64), np.zeros(1 << 16, np.uint32), 0
        self.slot_hash, self.slot = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.where(self.slot_hash[slot] == h, self.slot[slot], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss) and len(self.order):
            rest = h[miss]
            pos = np.minimum(np.searchsorted(self.order_hash, rest), len(self.order) - 1)
            got = np.where(self.order_hash[pos] == rest, self.order[pos], -1)
            out[miss] = got
            some = got >= 0
            s = slot[miss[some]]
            self.slot_hash[s] = rest[some]
            # of several hashes with one slot the last stays, with the entry that belongs to it
            self.slot[s] = got[some]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New entries: hashes (each once, none there yet), all their ids in a row, how many each has."""
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.zeros(self.filled + 2 * len(ids), np.uint32)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        first = len(self.at)
        self.at = np.concatenate([self.at, self.filled + np.cumsum(n) - n])
        self.n, self.hash = np.concatenate([self.n, n]), np.concatenate([self.hash, h])
        self.used = np.concatenate([self.used, np.ones(len(h), bool)])
        self.filled += len(ids)
        order = np.argsort(h)
        place = np.searchsorted(self.order_hash, h[order])
        self.order_hash, self.order = np.insert(self.order_hash, place, h[order]), np.insert(self.order, place, first + order)

    def clear(self, most: int, most_ids: int) -> None:
        """Drop what hasn't been used since the last time, or everything if that isn't half."""
        keep = self.used & (self.n < most_ids // 64)
        old = self
        fresh = Segments()
        if keep.sum() <= most // 2 and self.n[keep].sum() <= most_ids // 2:
            fresh.add(old.hash[keep], old.take(np.flatnonzero(keep)), old.n[keep])
            fresh.used[:] = False
        self.__dict__ = fresh.__dict__

    def take(self, entry: np.ndarray) -> np.ndarray:
        """Ids of entries, in a row."""
        n = self.n[entry]
        return self.flat[np.repeat(self.at[entry] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class Encoder:
    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pre = self.spec["pre_tokenizer"]
        self.words = pre["type"] == "Sequence"
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if self.words else BYTE_PATTERN)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.table = Segments()
        # special strings are entries of their own: a text's pieces never have their hashes
        self.special_hash = {k: mix(np.array([v + 1], np.uint64))[0] for k, v in self.special.items()}

    def pieces(self, text: str) -> list[int]:
        """Ids of one segment: the library's model on each of its pre-tokens."""
        tokenize = self.model.tokenize
        if text.isascii() and text.isprintable():  # all but a space stand for themselves
            plain = text.replace(" ", SPACE_LETTER)
            if text.isalpha() or (not self.words and text[1:].isalpha() and text[0] == " "):
                return [t.id for t in tokenize(plain)]
            return [t.id for x in self.pattern.findall(text) for t in tokenize(x.replace(" ", SPACE_LETTER))]
        return [t.id for x in self.pattern.findall(text) for t in tokenize(x.encode().decode("latin-1").translate(self.letters))]

    def learn(self, raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Add segments."""
        made = [self.pieces(raw[s:e].decode()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        self.table.add(h, np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)))

    def chunks(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """Parts of all texts, the text of each, whether it is one segment as it stands, and which are special strings."""
        parts, of, one, special = [], [], [], []
        for d, t in enumerate(texts):
            if "<|" not in t:
                parts.append((lowered(t) if self.words else t).encode())
                of.append(d)
                one.append(False)
                continue
            for k, x in enumerate(self.cut.split(t)):
                if k % 2:
                    special.append((len(parts), x))
                parts.append((lowered(x) if self.words and not k % 2 else x).encode())
                of.append(d)
                one.append(bool(k % 2))
        return parts, np.array(of, np.int64), np.array(one, bool), special

    def even(self, parts: list[bytes], of: np.ndarray, one: np.ndarray, special: list[tuple[int, str]]):
        """The same with parts whose white space needs the pattern cut into segments, or made plain where it is dropped."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        odd = wide_spaces(data)
        if not self.words and len(data):
            space = SPACE[data]
            plain = (data == 0x20) | (data == 0x0A)
            twice = np.zeros(len(data), bool)
            twice[1:] = space[1:] & space[:-1]
            full = np.flatnonzero(sizes)
            twice[bounds[full]] = space[bounds[full]]  # at the start of a part, and at its end
            last = bounds[full + 1] - 1
            twice[last] |= space[last]
            odd = np.concatenate([odd, np.flatnonzero(twice | (space & ~plain))])
        which = np.unique(np.searchsorted(bounds, odd, "right") - 1) if len(odd) else np.zeros(0, np.int64)
        which = which[~one[which]]
        if not len(which):
            return raw, bounds, of, one, special
        if self.words:
            parts = list(parts)
            for k in which.tolist():
                parts[k] = _WIDE.sub(" ", parts[k].decode()).encode()
            return self.even(parts, of, one, special)
        bad, new, new_of, new_one, place = set(which.tolist()), [], [], [], {}
        for k, p in enumerate(parts):
            place[k] = len(new)
            got = [x.encode() for x in self.pattern.findall(p.decode())] if k in bad else [p]
            new += got
            new_of += [of[k]] * len(got)
            new_one += [k in bad or one[k]] * len(got)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        return b"".join(new), np.concatenate([[0], np.cumsum(sizes)]), np.array(new_of, np.int64), np.array(new_one, bool), [(place[k], x) for k, x in special]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end."""
        raw, bounds, of, one, special = self.even(*self.chunks(texts))
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        new = np.zeros(n + 1, bool)
        if self.words:
            word = ~SPACE[data]
            new[1:n] = word[1:] & ~word[:-1]
            new[bounds[:-1]] |= np.append(word, False)[bounds[:-1]]
            start = np.flatnonzero(new[:n])
            stop = np.zeros(n + 1, bool)
            stop[1:n] = ~word[1:] & word[:-1]
            stop[bounds[1:]] |= np.concatenate([[False], word])[bounds[1:]]
            end = np.flatnonzero(stop)
        else:
            line = data == 0x0A
            new[:n] = line | (data == 0x20)
            new[1:] |= line
            if one.any():
                new[:n] &= ~np.repeat(one, np.diff(bounds))
            new[bounds] = True
            start = np.flatnonzero(new[:n])
            end = np.append(start[1:], n) if len(start) else start
        h = span_hashes(data, start, end)
        first = np.searchsorted(start, bounds)
        for k, x in special:
            h[first[k]] = self.special_hash[x]
        if len(self.table.at) > CACHE or self.table.filled > CACHE_IDS:
            self.table.clear(CACHE, CACHE_IDS)
        entry = self.table.find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            kinds, at = np.unique(h[miss], return_index=True)
            known = np.isin(kinds, list(self.special_hash.values()))
            for x in kinds[known].tolist():
                self.table.add(np.array([x], np.uint64), np.array([next(v for k, v in self.special.items() if self.special_hash[k] == x)], np.uint32), np.ones(1, np.int64))
            if not known.all():
                at = miss[at[~known]]
                self.learn(raw, kinds[~known], start[at], end[at])
            entry[miss] = self.table.find(h[miss])
        self.table.used[entry] = True
        sums = np.concatenate([[0], np.cumsum(self.table.n[entry])])
        text_first = np.searchsorted(of, np.arange(len(texts) + 1))
        return self.table.take(entry), sums[first[text_first]]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, first = self.flat(list(texts))
        raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(name: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if name not in _OPEN:
        _OPEN[name] = Encoder(name)
    return _OPEN[name]
