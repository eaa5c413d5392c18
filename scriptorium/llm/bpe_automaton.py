"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the sequences that the merges
give for some text.  It starts as one state with an arc for each byte, and each
merge ``u v -> w``, in order, adds its gadget: the state ``p`` behind the arcs
of ``u`` is copied without its arc ``v``, the arcs ``u`` now lead to the copy,
and every state that had ``u`` followed by ``v`` gets an arc ``w`` to where
``v`` led (the state as it was, which matters when u = v).

All arcs of a token lead to one state, so states are named by tokens.  Copies
share all arcs but the one removed; what is stored is, for every token, the
arcs removed from its copies and when, and for every token when its arc was
added and through which left part.  An arc ``t`` leaves a state if no left part
of ``t`` had been removed before it was used, nor ``t`` itself later; a state
made by a merge carries the removals of its right part up to that merge.  A
table of all arcs of all states can't be held (see the README for figures);
the table of transitions holds those that texts have asked for, up to ``ARCS``.

Every prefix of a word has exactly one correct sequence of tokens, so every
position of a word is reached by exactly one arc, from an earlier position.
Encoding steps over the positions once and finds that arc among the tokens that
end there (a trie of reversed labels lists them); nothing is taken back.
Decoding emits the labels (bytes) of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents
from .tokens import END_OF_TEXT, PieceCache, WordCache

#: The pattern that splits text before merges, as the tokenizers library's byte-level splitter has it.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_LATIN = regex.compile("[^\x00-ɏ‐-‧]")
NEVER = 1 << 60
#: Transitions that a worker holds at most (some 15 MB).
ARCS = 100_000
#: Bytes of the beginnings of words whose arcs are held, and how many of these (some 10 MB).
HEAD, HEADS = 5, 20_000
#: Encoded words that a worker holds at most, and as many older ones; pieces of texts that aren't cut into words among them.
KEPT, ODD_KEPT = 150_000, 30_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BpeAutomaton:
    """The automaton of a vocabulary file; ``encode_word`` and ``decode`` are its two uses."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocabulary = {bytes(of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.labels: dict[int, bytes] = {i: t for t, i in vocabulary.items()} | {i: s.encode() for s, i in self.special.items()}
        self.tokens = vocabulary
        size = max(self.labels, default=0) + 1
        #: The parts of each token's merge (-1: a byte) and its time.
        self.left, self.right, self.added = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [0]) * size
        self.removed: dict[int, int] = {}
        for time, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]):
            self._gadget(time, vocabulary[bytes(of[c] for c in a)], vocabulary[bytes(of[c] for c in b)])
        self.arcs: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        # The trie of reversed labels: the child of a node by a byte, and the token that ends at a node.
        self.children: dict[int, int] = {}
        self.ending = array("i", [-1])
        for label, token in vocabulary.items():
            node = 0
            for byte in reversed(label):
                child = self.children.get(node << 8 | byte)
                if child is None:
                    child = self.children[node << 8 | byte] = len(self.ending)
                    self.ending.append(-1)
                node = child
            self.ending[node] = token

    def _gadget(self, time: int, u: int, v: int) -> None:
        w = self.tokens[self.labels[u] + self.labels[v]]
        self.removed.setdefault(u << 20 | v, time)
        if self.left[w] < 0:
            self.left[w], self.right[w], self.added[w] = u, v, time

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` has an arc ``token``."""
        removed, left, right, added = self.removed, self.left, self.right, self.added
        until = NEVER
        while True:
            part, used = token, NEVER
            while True:
                gone = removed.get(state << 20 | part)
                if gone is not None and gone < until and gone <= used:
                    return False
                if left[part] < 0:
                    break
                used, part = added[part], left[part]
            if right[state] < 0:
                return True
            until, state = added[state], right[state]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word: the arc that reaches each position, and those on the way to the last one."""
        if (whole := self.tokens.get(word)) is not None:
            return [whole]
        children, ending, arcs = self.children, self.ending, self.arcs
        if len(arcs) > ARCS:
            arcs.clear()
        head = word[:HEAD]
        if (known := self.heads.get(head)) is not None:
            came, start = known[0].copy(), known[1].copy()
        else:
            came, start = [-1], [0]
        for end in range(len(came), len(word) + 1):
            at, node = end, 0
            while True:
                at -= 1
                node = children[node << 8 | word[at]]
                token = ending[node]
                if token < 0:
                    continue
                if not at:
                    break
                key = came[at] << 20 | token
                arc = arcs.get(key)
                if arc is None:
                    arc = arcs[key] = self.has_arc(came[at], token)
                if arc:
                    break
            came.append(token)
            start.append(at)
            if end == HEAD:
                if len(self.heads) > HEADS:
                    self.heads.clear()
                self.heads[head] = came.copy(), start.copy()
        out, at = [], len(word)
        while at:
            out.append(came[at])
            at = start[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(text.split(END_OF_TEXT) if END_OF_TEXT in self.special else [text]):
            if k:
                out.append(self.special[END_OF_TEXT])
            for word in split_words(part):
                out += self.encode_word(word.encode())
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def split_words(text: str) -> list[str]:
    """The words that merges stay within.

    Scripts beyond Latin go through the tokenizers library's splitter, whose
    edition of Unicode decides what is a letter.
    """
    if _LATIN.search(text):
        return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]
    return PATTERN.findall(text)


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> BpeAutomaton:
    return BpeAutomaton(path)


@functools.lru_cache(maxsize=1)
def kept_pieces(path: str) -> tuple[WordCache, BpeAutomaton]:
    auto = automaton(path)
    pieces = PieceCache(lambda text: array("i", auto.encode(text)).tobytes(), ODD_KEPT)
    split = set(auto.special) <= {END_OF_TEXT}
    words = lambda new: [array("i", auto.encode_word(w)).tobytes() for w in new]
    return WordCache(words if split else None, pieces.encode, KEPT - ODD_KEPT), auto


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs(doc_id, text)``.

    A null text counts as empty: no ids, and the hash of an empty string twice.
    Each row, of any length, is encoded whole, by itself, in its own partition;
    nothing is shuffled.  Repeated rows give repeated results, ties don't arise,
    other columns, whatever their names, are ignored, and an empty table gives
    no rows.
    """

    def run(batches):
        cache, auto = kept_pieces(path or vocabulary_path())
        shown = pa.array([b"%d," % i for i in range(max(auto.labels) + 1)], pa.large_binary())
        label = pa.array([auto.labels.get(i, b"") for i in range(max(auto.labels) + 1)], pa.large_binary())

        def joined(table, ids, bounds):
            """What ``table`` has for the ids of each document, one after the other."""
            found = table.take(ids)
            at, whole = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[bounds].tolist(), memoryview(found.buffers()[2] or b"")
            return [bytes(whole[a:b]) for a, b in zip(at, at[1:])]

        for batch in batches_of(batches):
            encoded = cache.encode_column(batch.column("text"))
            bounds = np.cumsum([0, *map(len, encoded)]) // 4
            ids = pa.array(np.frombuffer(b"".join(encoded), np.int32))
            decoded = [x.decode("utf-8", "replace").encode() for x in joined(label, ids, bounds)]
            columns = [pa.array(np.diff(bounds)), pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in joined(shown, ids, bounds)]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 1 + len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir))
