"""SentencePiece encoding and decoding by a Viterbi pass that words share by prefix.

Texts are marked (a blank becomes U+2581, one is put in front) and cut into
marked words. The distinct words of a batch are sorted, which lays them out as
the depth-first order of a trie: the forward state of each prefix stays on a
stack, and the next word starts from the longest prefix it shares with the last.

What a forward state holds depends on the model. For a unigram model it is the
best total score and its last piece. The public model here is a BPE model, whose
scores are merge ranks and don't add up; there the forward state of a prefix is
the one last piece with which the prefix's BPE encoding ends. No merge crosses a
boundary between final pieces, so a prefix up to one is encoded as it is within
the word, and a sequence is the BPE encoding just when each adjacent pair is.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import map_rows, text_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of distinct words (some 30 bytes each, with their ids) and pairs of pieces (130 bytes each) that a task keeps; beyond, the memo starts anew.
MEMO_CHARS = 1_500_000
MEMO_PAIRS = 500_000
#: Texts are encoded together up to so many characters.
BATCH_CHARS = 4_000_000


class PieceModel:
    """Pieces, scores and bytes of a model file, and the forward pass over marked words."""

    def __init__(self, path: str, unigram: bool = False):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.unigram = unigram
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        #: Every end of a piece, with its id if it is a piece itself and -1 otherwise.
        self.tails = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).encode() for i in range(n)]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        assert not any(MARK in p.lstrip(MARK) for p in self.ids), "a piece goes on past a blank: words can't be cut there"
        lone = "".join(c for c in "\n\r\t" if c not in inside)
        self.words = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_chars = 0

    def merged(self, word: str) -> list[str]:
        """Plain BPE: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def holds(self, key: int, left: str, right: str) -> bool:
        """Whether BPE keeps the two pieces apart where they meet; with an empty one, whether it builds the other at all."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self.merged(left + right) == ([left, right] if right else [left])
        return got

    def best_scored(self, word: str, end: int, state: list[tuple[float, str]]) -> tuple[float, str]:
        """The forward state of word[:end] of a unigram model: the best total score, and its last piece."""
        best, start, piece = None, end, ""
        while start:
            start -= 1
            piece = word[start:end]
            if piece not in self.tails and end - start > 1:
                break
            if piece in self.score or end - start == 1:
                worth = state[start][0] + self.score.get(piece, -1e6), piece
                best = worth if best is None or worth[0] > best[0] else best
        return best

    def last_pieces(self, word: str, shared: int, pieces: list[str], numbers: list[int]) -> None:
        """Append the forward states of word[:end] beyond ``shared`` of a BPE model: the one piece that each prefix ends with, and its number.

        A piece is numbered by its id; what isn't in the vocabulary is a single character. The longest piece that holds is the one.
        """
        ids, pairs, tails, beyond = self.ids.get, self.pairs.get, self.tails.get, len(self.raw)
        for end in range(shared + 1, len(word) + 1):
            start = end - 1
            piece = word[start]
            number = ids(piece)
            fits = [(start, piece, beyond + ord(piece) if number is None else number)]
            while start:
                start -= 1
                piece = word[start:end]
                number = tails(piece)
                if number is None:
                    break
                if number >= 0:
                    fits.append((start, piece, number))
            for at, piece, number in reversed(fits):
                if at:
                    key = (numbers[at] << 32) | (number + 1)
                    ok = pairs(key)
                    if ok is None:
                        ok = self.holds(key, pieces[at], piece)
                    if not ok:
                        continue
                if len(piece) == 1:
                    break
                ok = pairs(number << 32)
                if self.holds(number << 32, piece, "") if ok is None else ok:
                    break
            pieces.append(piece)
            numbers.append(number)

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of sorted distinct words into the memo, prefixes shared."""
        state: list[tuple[float, str]] = [(0.0, "")]
        ends, numbers, beyond = [""], [-1], 0 if self.unigram else len(self.raw)
        last = ""
        for word in words:
            if word in self.memo:
                continue
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            if self.unigram:
                del state[shared + 1 :]
                for end in range(shared + 1, len(word) + 1):
                    state.append(self.best_scored(word, end, state))
                ends = [piece for _, piece in state]
            else:
                del ends[shared + 1 :], numbers[shared + 1 :]
                self.last_pieces(word, shared, ends, numbers)
            found, at = [], len(word)
            if not self.unigram:  # pieces are numbered by their ids, but for those that aren't in the vocabulary
                while at:
                    found.append(numbers[at])
                    at -= len(ends[at])
                found.reverse()
                at = 0 if max(found) < beyond else len(word)
            if at:
                found = []
                while at:
                    found.append(ends[at])
                    at -= len(found[-1])
                found = self.to_ids(found[::-1])
            self.memo[word] = tuple(found)
            self.memo_chars += len(word)
            last = word

    def cut(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is part of a cycle, and looking for some would cross the memo again and again
        try:
            cut = [self.cut(t) for t in texts]
            distinct = set().union(*cut)
            if self.memo_chars > MEMO_CHARS:  # words that come again are kept, while they are the smaller part
                again = {w: self.memo[w] for w in distinct if w in self.memo}
                self.memo_chars = sum(map(len, again))
                self.memo = again if self.memo_chars <= MEMO_CHARS // 2 else {}
                self.memo_chars *= bool(self.memo)
            self.encode_words(sorted(distinct.difference(self.memo)))
            return [list(chain.from_iterable(map(self.memo.__getitem__, words))) for words in cut]
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD, the blank put in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with token_ids (array of int), n_tokens (long) and roundtrip (boolean).

    Every whole text is encoded, and the ids are decoded again and compared with
    the text as the model sees it (U+2581 and a blank are one and the same).
    Null and empty texts give no ids and round-trip; texts of any length are encoded
    word by word to their end; columns of these names are replaced and all others
    pass; repeated rows are encoded each; an empty table gives an empty one. No shuffle.
    """
    at = docs.columns.index(text)

    def per_batch(batch):
        m = load(model)
        flat, sizes, same = [], [], []
        column = batch.column(at)
        pending: list[str] = []

        def flush():
            for t, ids in zip(pending, m.encode(pending), strict=True):
                flat.append(np.array(ids, np.int32))
                sizes.append(len(ids))
                same.append(m.decode(ids) == t.replace(MARK, " "))
            pending.clear()

        size = 0
        for x in column:
            t = x.as_py() or ""
            pending.append(t)
            size += len(t)
            if size > BATCH_CHARS:
                flush()
                size = 0
        flush()
        values = np.concatenate(flat) if flat else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return {"token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "n_tokens": pa.array(sizes, pa.int64()), "roundtrip": pa.array(same, pa.bool_())}

    return map_rows(text_column(docs, text), per_batch, [("token_ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("roundtrip", T.BooleanType())])


def decode_pieces(docs: DataFrame, ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``docs`` with decoded (string): the text of each row's ids.

    Null and empty ids give an empty text; lists of any length are decoded whole;
    repeated rows are decoded each; a column named decoded is replaced and all others
    pass; an empty table gives an empty one. No shuffle.
    """
    at = docs.columns.index(ids)

    def per_batch(batch):
        m = load(model)
        return {"decoded": pa.array([m.decode(x.as_py() or []) for x in batch.column(at)], pa.string())}

    return map_rows(docs, per_batch, [("decoded", T.StringType())])
