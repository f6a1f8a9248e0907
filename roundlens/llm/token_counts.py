"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary's pieces go into a trie over bytes, the last byte of a word being
a symbol of its own. Each node has a failure link and the number of pieces that
taking the link emits, so a word is read once, left to right, and greedy
longest-match lengths come out without any piece being built.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import map_rows, text_column

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256
#: Characters of distinct words (some 25 bytes each, with their counts) that a task keeps; beyond, the memo starts anew.
MEMO_CHARS = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain}
    back.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return back


class LongestMatch:
    """Counts greedy longest-match pieces of a word in time linear in its bytes."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.go: dict[tuple[int, int], int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                nxt = self.go.get((node, symbol))
                if nxt is None:
                    nxt = self.go[node, symbol] = len(final)
                    children[node].append((symbol, nxt))
                    children.append([])
                    final.append(False)
                node = nxt
            final[node] = True
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque(children[0])
        parent = {child: 0 for _, child in children[0]}
        while queue:
            symbol, node = queue.popleft()
            up = parent.pop(node)
            if final[node]:
                self.link[node], self.popped[node] = 0, 1
            elif up:
                back, count = self.link[up], self.popped[up]
                while back >= 0 and (back, symbol) not in self.go:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[node], self.popped[node] = self.go[back, symbol], count
            for s, child in children[node]:
                parent[child] = node
                queue.append((s, child))

    def count(self, symbols: list[int]) -> int:
        """Pieces of the word; 1 for a word that the vocabulary can't cover, as for an unknown token."""
        node, total, go = 0, 0, self.go
        for symbol in symbols:
            while (nxt := go.get((node, symbol))) is None:
                total += self.popped[node]
                node = self.link[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 0:
            total += self.popped[node]
            node = self.link[node]
        return total if node == 0 else 1


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton, self.chars = automaton, 0

    def __missing__(self, word: str) -> int:
        symbols = list(word.encode())
        symbols[-1] += END
        if self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(word)
        got = self[word] = self.automaton.count(symbols)
        return got


@lru_cache(2)
def load(vocabulary: str) -> tuple[regex.Pattern, _Memo]:
    """The vocabulary's own word pattern and the automaton of its pieces, once a Python worker."""
    with open(vocabulary, encoding="utf-8") as f:
        parts = json.load(f)
    back, suffix = byte_symbols(), parts["model"]["end_of_word_suffix"]
    pieces = []
    for piece in parts["model"]["vocab"]:
        last = piece.endswith(suffix) and piece != suffix
        symbols = [back[c] for c in (piece[: -len(suffix)] if last else piece)]
        symbols[-1] += END * last
        pieces.append(tuple(symbols))
    split = next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return regex.compile(split["pattern"]["Regex"]), _Memo(LongestMatch(pieces))


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> tuple[int, int]:
    """(words, greedy pieces) of one text."""
    pattern, memo = load(vocabulary)
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    words = pattern.findall(text.lower())
    return len(words), sum(map(memo.__getitem__, words))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_words and n_tokens, longs, of every whole text.

    Null and empty texts count 0; texts of any length are read whole, in time linear
    in them; repeated rows are counted each, so there are no ties; columns named
    n_words or n_tokens are replaced, all others pass; an empty table gives an empty
    one. No shuffle.
    """
    at = docs.columns.index(text)

    def per_batch(batch):
        words, tokens = [], []
        for x in batch.column(at):
            w, t = count_tokens(x.as_py(), vocabulary)
            words.append(w)
            tokens.append(t)
        return {"n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

    return map_rows(text_column(docs, text), per_batch, [("n_words", T.LongType()), ("n_tokens", T.LongType())])
