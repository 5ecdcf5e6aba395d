"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A sequence of tokens is what BPE makes of its string if, and only if, BPE leaves each two neighbours as
they are. So a path over tokens whose neighbours agree is unique for a word. The nondeterministic machine has
states (last token, place in the trie of tokens that start there) and counts a token whenever it closes
one; determinising it on demand gives states that are sets of those with the counts by which they differ,
and transitions annotated with the count that all of them share (emitted as soon as it is certain).

A text is cut into chunks. White space takes the machine back to its start, so the state map of a chunk
is its head up to the first white space (whose effect depends on the state at entry), a count, and
the tail after the last one (the state at exit). Maps compose associatively; a scan by halves composes them.

Null texts count as empty: 0 bytes, 0 tokens. Texts of any length are read whole. Repeated rows and null
ids give a row each. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tok import Encoder, Recent, byte_letters, encoder, lowered, split

#: Characters of a chunk.
CHUNK = 1 << 16
#: States that a worker keeps; beyond that the machine is determinised anew.
STATES = 200_000
END = "</w>"
_MADE: dict[str, "Transducer"] = {}
_SPACE = regex.compile(r"\s")


class Transducer:
    """Counts of a word's tokens; words are UTF-8 bytes between pre-token borders."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.letters = byte_letters()
        vocab = model["vocab"]
        self.inner = {t for t in vocab if not t.endswith(END)}
        self.final = {t for t in vocab if t.endswith(END)}
        self.prefixes = {t.removesuffix(END)[:i] for t in vocab for i in range(1, len(t.removesuffix(END)) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.state_ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: (state << 8 | byte) to (next state, tokens emitted)
        self.step: dict[int, tuple[int, int]] = {}
        self.stop: dict[int, int] = {}
        self.pairs.clear()
        self.start = self.state((("", "", 0),))

    def state(self, key: tuple) -> int:
        got = self.state_ids.get(key)
        if got is None:
            got = self.state_ids[key] = len(self.states)
            self.states.append(key)
        return got

    def bpe(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 30))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def agree(self, a: str, b: str) -> bool:
        """Whether BPE leaves token b after token a ("": the start) as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            last = [b[-len(END) - 1 :]] if b.endswith(END) else [b[-1]]
            symbols = [*a, *(b.removesuffix(END)[:-1]), *last]
            got = self.pairs[a, b] = self.bpe(symbols) == ([a, b] if a else [b])
        return got

    def advance(self, s: int, byte: int) -> tuple[int, int]:
        c, new = self.letters[byte], []
        for last, part, n in self.states[s]:
            grown = part + c
            if grown in self.prefixes:
                new.append((last, grown, n))
                if grown in self.inner and self.agree(last, grown):
                    new.append((grown, "", n + 1))
        least = min(x[2] for x in new)
        to = self.state(tuple(sorted((a, b, n - least) for a, b, n in new)))
        self.step[s << 8 | byte] = to, least
        return to, least

    def finish(self, s: int) -> int:
        """Tokens emitted by the end of a word in a state."""
        got = self.stop.get(s)
        if got is None:
            ends = [n + 1 for last, part, n in self.states[s] if part + END in self.final and self.agree(last, part + END)]
            if len(ends) != 1:
                raise ValueError("the vocabulary has no unique path for a word")
            got = self.stop[s] = ends[0]
        return got

    def count(self, word: str) -> int:
        s, total, step = self.start, 0, self.step
        for byte in word.encode():
            s, n = step.get(s << 8 | byte) or self.advance(s, byte)
            total += n
        return total + self.finish(s)


class Counter:
    """Tokens of whole texts by chunks of an encoder's pre-tokens."""

    def __init__(self, enc: Encoder):
        if not enc.words:
            raise ValueError("the vocabulary must mark word ends")
        self.enc, self.machine = enc, Transducer(enc.spec)
        self.known = Recent(400_000)

    def plain(self, text: str) -> int:
        parts = split(text)
        find, machine = self.enc.pattern.findall, self.machine
        # a segment is a transition from the start to the start, and kept as such
        for x in self.known.missing(parts):
            if len(machine.states) > STATES:
                machine.reset()
            self.known.young[x] = sum(map(machine.count, find(x)))
        return sum(map(self.known.young.__getitem__, parts))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """Head, count, tail; a chunk without white space is all head, with None as its count."""
        first = _SPACE.search(chunk)
        if not first:
            return chunk, None, ""
        last = next(i for i in range(len(chunk) - 1, -1, -1) if _SPACE.match(chunk[i]))
        return chunk[: first.start()], self.plain(chunk[first.start() : last]), chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2])

    def scan(self, maps: list[tuple]) -> tuple:
        """Composition of all maps by halves, as a parallel scan takes them."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) & ~1 :]
        return maps[0]

    def text(self, text: str, chunk: int = CHUNK) -> int:
        total = 0
        for k, part in enumerate(self.enc.cut.split(text) if "<|" in text else [text]):
            if k % 2:
                total += 1
                continue
            part = lowered(part)
            if len(part) <= chunk:
                total += self.plain(part)
                continue
            head, n, tail = self.scan([self.chunk_map(part[i : i + chunk]) for i in range(0, len(part), chunk)])
            total += self.plain(head) + (n or 0) + self.plain(tail)
        return total


def counter(name: str) -> Counter:
    if name not in _MADE:
        _MADE[name] = Counter(encoder(name))
    return _MADE[name]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            sizes, counts = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                sizes.append(len(t.encode()))
                counts.append(c.text(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op1_token_counts": op1_token_counts}
