"""Byte-level BPE over a trie of distinct words.

Text is cut into pieces by the vocabulary's own rule.  The distinct pieces of a
batch go into a trie of bytes.  A walk down the trie gives each node one state: the
last token of the encoding of the bytes from the root to that node.  Such a state
follows from those above it: a token ``t`` that is a suffix of the path is the last
one if and only if ``t`` may follow the last token of the path without it.  Pieces
that share a prefix share all states on it, and each is computed once.

Two tokens may stand side by side if no merge joins parts of both.  Only the parts at
the border count: those down the right edge of the left token's merge tree, and down the
left edge of the right one's.  A pair of such parts is joined if its merge comes before
each of them goes into a larger part of its own token.  Answers are kept per pair.

Encodings are kept per task for pieces up to ``LONGEST_KEPT`` bytes, at most ``KEPT``
of them.  Longer pieces are encoded and forgotten, so memory has a bound whatever the
text.  A task that is lost only repeats its own rows; nothing is shared.

Defined results: a NULL text counts as empty, an empty text has no tokens; repeated
rows get equal results; an empty table gives no rows; further columns are not looked
at.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed pattern of byte-level BPE vocabularies of this kind.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
KEPT = 1_000_000
# Key of a node under which the trie keeps the piece that ends there.
END = -1
LONGEST_KEPT = 256


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies, and their bytes.

    Printable bytes stand for themselves, the others for characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {
            as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added
        }
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {
            (self.ids[as_bytes(a)], self.ids[as_bytes(b)]): (rank, self.ids[as_bytes(a + b)])
            for rank, (a, b) in enumerate(merges)
        }
        self.halves = {whole: (*pair, rank) for pair, (rank, whole) in self.ranks.items()}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left."""
        tokens = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(tokens) > 1:
            rank, at, joined = min(
                (
                    (*self.ranks[pair], i)
                    for i, pair in enumerate(zip(tokens, tokens[1:]))
                    if pair in self.ranks
                ),
                key=lambda found: (found[0], found[2]),
                default=(None, None, None),
            )
            if rank is None:
                break
            tokens[joined : joined + 2] = [at]
        return tokens


class Suffixes:
    """All tokens that end at a byte, found by an automaton over the vocabulary."""

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        own: list[int | None] = [None]
        for token, i in tokens.items():
            state = 0
            for byte in token:
                step = self.next[state].get(byte)
                if step is None:
                    step = self.next[state][byte] = len(own)
                    self.next.append({})
                    own.append(None)
                state = step
            own[state] = i
        self.fallback = [0] * len(own)
        # Tokens that are suffixes of what a state has read, longest first.
        self.tokens: list[tuple[int, ...]] = [()] * len(own)
        queue = [(0, byte, state) for byte, state in self.next[0].items()]
        for parent, byte, state in queue:
            shorter = self.step(self.fallback[parent], byte) if parent else 0
            self.fallback[state] = shorter
            mine = () if own[state] is None else (own[state],)
            self.tokens[state] = mine + self.tokens[shorter]
            queue.extend((state, b, below) for b, below in self.next[state].items())

    def step(self, state: int, byte: int) -> int:
        while True:
            found = self.next[state].get(byte)
            if found is not None:
                return found
            if not state:
                return 0
            state = self.fallback[state]


class TrieEncoder:
    """Encodings of pieces by last-token states on a trie."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        self.vocabulary = vocabulary
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = list(map(len, vocabulary.bytes))
        # Tokens whose own bytes do not merge back into them are in no encoding.
        self.suffixes = Suffixes({t: i for t, i in vocabulary.ids.items() if self.is_whole(i)})
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's bytes ends in the token."""
        v = self.vocabulary
        if len(v.bytes[token]) == 1:
            return True
        return token in v.halves and v.merge(v.bytes[token]) == [token]

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts down one edge of a token's merge tree, with the rank that ends each."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, until = [], token, float("inf")
            while True:
                found.append((part, until))
                if part not in self.vocabulary.halves:
                    break
                *halves, until = self.vocabulary.halves[part]
                part = halves[side]
            self.edges[token, side] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        pair = left << 24 | right
        answer = self.pairs.get(pair)
        if answer is None:
            if len(self.pairs) > 4 * self.kept:
                self.pairs.clear()
            answer = self.pairs[pair] = not self.joins(left, right)
        return answer

    def joins(self, left: int, right: int) -> bool:
        """Whether some merge joins a part of ``left`` with one of ``right``."""
        ranks = self.vocabulary.ranks
        ends = self.edge(right, 0)
        for part, until in self.edge(left, 1):
            for other, other_until in ends:
                merge = ranks.get((part, other))
                # Of equal merges the leftmost comes first.
                if merge and merge[0] < until and merge[0] <= other_until:
                    return True
        return False

    def last_token(self, state: int, depth: int, states: list[int]) -> int:
        """The last token of a path of ``depth`` bytes that the automaton has read.

        ``states[d]`` is the last token of the path's first ``d`` bytes.
        """
        for token in self.suffixes.tokens[state]:
            before = depth - self.sizes[token]
            if not before or self.may_follow(states[before], token):
                return token
        raise ValueError("the vocabulary has no token for a byte")

    def read_back(self, depth: int, states: list[int]) -> bytes:
        tokens, sizes = [], self.sizes
        while depth:
            tokens.append(states[depth])
            depth -= sizes[states[depth]]
        tokens.reverse()
        return array.array("I", tokens).tobytes()

    def encode_distinct(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        root: dict = {}
        result: dict[str, bytes] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            if len(data) > LONGEST_KEPT:
                result[piece] = self.encode_alone(data)
                continue
            node = root
            for byte in data:
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[END] = piece
        # Depth first: states are cut back to a node's depth before its own is added.
        states, step = [-1], self.suffixes.step
        stack = [(1, byte, 0, below) for byte, below in root.items()]
        while stack:
            depth, byte, above, node = stack.pop()
            at = step(above, byte)
            del states[depth:]
            states.append(self.last_token(at, depth, states))
            for below_byte, below in node.items():
                if below_byte == END:
                    result[below] = self.read_back(depth, states)
                else:
                    stack.append((depth + 1, below_byte, at, below))
        return result

    def encode_alone(self, data: bytes) -> bytes:
        """One long piece: the trie is a single path."""
        states, at = [-1], 0
        for depth, byte in enumerate(data, 1):
            at = self.suffixes.step(at, byte)
            states.append(self.last_token(at, depth, states))
        return self.read_back(len(data), states)

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, which is given by its pieces."""
        known = self.known
        new = set().union(*texts).difference(known)
        long: dict[str, bytes] = {}
        if new:
            for piece, ids in self.encode_distinct(sorted(new)).items():
                (known if len(piece) <= LONGEST_KEPT // 4 else long)[piece] = ids
        if long:
            out = [b"".join([known[p] if p in known else long[p] for p in t]) for t in texts]
        else:
            out = [b"".join(map(known.__getitem__, t)) for t in texts]
        if len(known) > self.kept:
            known.clear()
        return out


class Codec:
    """Encode and decode whole texts."""

    def __init__(self, path: str, added_as_text: bool = False):
        self.vocabulary = Vocabulary(path)
        self.encoder = TrieEncoder(self.vocabulary)
        self.pattern = regex.compile(PIECES)
        added = [] if added_as_text else sorted(self.vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [t for t in texts if not (self.special and self.special.search(t))]
        if len(plain) == len(texts):
            return self.encoder.encode([self.pieces(t) for t in texts])
        return [self.encode_mixed(t) for t in texts]

    def encode_mixed(self, text: str) -> bytes:
        """A text in which strings of added tokens stand for those tokens."""
        if not self.special:
            return self.encoder.encode([self.pieces(text)])[0]
        out, at = [], 0
        for found in self.special.finditer(text):
            out.append(self.encoder.encode([self.pieces(text[at : found.start()])])[0])
            out.append(self.vocabulary.added[found[0]].to_bytes(4, "little"))
            at = found.end()
        out.append(self.encoder.encode([self.pieces(text[at:])])[0])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(tokens).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(path: str, added_as_text: bool = False) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, added_as_text)


def encode(docs: DataFrame, path: str, added_as_text: bool = False) -> DataFrame:
    """``doc_id, ids, decoded``: token ids (little-endian u32) and the text they give."""
    (id_type,) = [f.dataType for f in docs.schema if f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, added_as_text)
        for batch in batches:
            # Texts are handled a few at a time, so that long ones do not pile up.
            for ids, texts in _portions(batch):
                encoded = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(encoded, pa.binary()),
                        pa.array([own.decode(e) for e in encoded], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, ids binary, decoded string"
    )


def digest(docs: DataFrame, path: str, added_as_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document's round trip."""
    (id_type,) = [f.dataType for f in docs.schema if f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, added_as_text)
        for batch in batches:
            for ids, texts in _portions(batch):
                encoded = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(e) // 4 for e in encoded], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                        pa.array(
                            [
                                hashlib.sha256(own.decode(e).encode("utf-8")).hexdigest()
                                for e in encoded
                            ],
                            pa.string(),
                        ),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def _portions(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
