"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is a space in front of it and its code points, with spaces written as the piece mark. No piece has the mark behind another
character, so a text falls into words that cannot merge with each other. The different words of a batch lie behind one another in
one flat numpy array of symbols. A round takes, per word, the least rank among its neighbouring pairs (``minimum.reduceat``),
merges all its pairs of that rank that do not overlap from the left, and compacts the arrays; words without a pair left are set aside. Rounds go on until
none remains. Symbols without a piece become the pieces of their UTF-8 bytes.

Merging all pairs of a rank at once equals merging them one by one as long as no merge brings up a pair of the same or a lower
rank. Pieces that can (``hasty``) are known from the vocabulary. Where one is made, the new pairs are looked up first, and a word's
round ends with the first merge that brings up such a pair.

Vocabulary and scores are read from a model file on the driver and sent along, so executors need no file (its size is that of the vocabulary).
Words met before are remembered up to ``REMEMBERED`` a task; longer words are encoded like all others and not remembered.

Defined cases: null is an empty text; an empty text has the end id alone and decodes to an empty text. Repeated rows give
repeated rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows

MARK = "▁"
# Words remembered by a task, and the characters up to which a word is.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
# Characters whose new words are encoded together.
BLOCK = 200_000

NONE = np.iinfo(np.int64).max


class Pieces:
    """Encoder and decoder of one BPE model with byte fallback and no text normalization."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = library.get_piece_size()
        self.end = library.eos_id()
        ids = range(self.size)
        self.pieces = [library.id_to_piece(k) for k in ids]
        bytes_of = {k: int(self.pieces[k][3:5], 16) for k in ids if library.is_byte(k)}
        self.byte_ids = {value: k for k, value in bytes_of.items()}
        special = {k for k in ids if library.is_byte(k) or library.is_control(k) or library.is_unknown(k)}
        self.ids = {piece: k for k, piece in enumerate(self.pieces) if k not in special}
        # What each id adds to a decoded text; a byte above 127 is a lone surrogate until it is put together with its neighbours.
        self.surface = ["" if k in special else self.pieces[k].replace(MARK, " ") for k in ids]
        for k, byte in bytes_of.items():
            self.surface[k] = bytes([byte]).decode("ascii", "surrogateescape")
        # The symbol of each code point: its piece, or a number above all ids.
        self.letters = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = k
        scores = np.array([library.get_score(k) for k in ids])
        # Equal scores share a rank; better scores come first.
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self._pair_table()
        inner = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        # A word: marks and what follows up to the next mark.
        self.word = re.compile(f"(?s:.+)" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[int, ...]] = {}

    def symbol(self, text: str) -> int | None:
        """Id of a piece, or one above all ids for a single character that is none."""
        found = self.ids.get(text)
        if found is None and len(text) == 1:
            found = self.size + ord(text)
        return found

    def _pair_table(self) -> None:
        """Every pair of symbols that makes a piece, as one sorted key, with the piece."""
        self.base = self.size + 0x110000
        table = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    table[left * self.base + right] = k
        keys = np.array(sorted(table), np.int64)
        self.keys, self.made = keys, np.array([table[k] for k in keys.tolist()], np.int64)
        # Pieces that may take part in a pair of the same or a lower rank right after they are made.
        self.hasty = np.zeros(self.size, bool)
        for side in (keys // self.base, keys % self.base):
            piece = side < self.size
            early = self.ranks[self.made[piece]] <= self.ranks[side[piece]]
            self.hasty[side[piece][early]] = True

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], -1)

    def merged(self, words: list[str]) -> list[list[int]]:
        """Symbols that are left of each (non-empty) word, by merge rounds over all words together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.letters[points]
        word = np.repeat(np.arange(len(words)), lengths)
        made = self._pairs(symbols, word)
        out: list[list[int]] = [[] for _ in words]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.where(made >= 0, self.ranks[made], NONE)
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = least == NONE
            if done.any():
                stay = np.repeat(~done, sizes)
                flat, at = symbols[~stay].tolist(), 0
                for k, size in zip(word[starts[done]].tolist(), sizes[done].tolist()):
                    out[k] = flat[at : at + size]
                    at += size
                symbols, word, made, rank = symbols[stay], word[stay], made[stay], rank[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            # In a run of overlapping pairs every second one merges.
            opens = np.r_[True, hits[1:] != hits[:-1] + 1]
            since = hits - hits[opens][np.cumsum(opens) - 1]
            hits = self._timely(hits[since % 2 == 0], symbols, word, made)
            symbols[hits] = made[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, word, made = symbols[stay], word[stay], made[stay]
            # Only pairs at a merged symbol are new.
            now = hits - np.arange(len(hits))
            new = np.zeros(len(symbols), bool)
            new[now] = True
            new[now[now > 0] - 1] = True
            fresh = np.flatnonzero(new)
            made[fresh] = self._pairs(symbols, word, fresh)
        return out

    def _timely(self, hits: np.ndarray, symbols: np.ndarray, word: np.ndarray, made: np.ndarray) -> np.ndarray:
        """The hits that may merge together: of each word those up to the first one that brings up a pair to be merged before the rest."""
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        doubtful = self.hasty[made[hits]]
        if first.all() or not doubtful.any():
            return hits
        ask = np.flatnonzero(doubtful)
        at, piece = hits[ask], made[hits[ask]]
        # Left of a merge its left neighbour may have merged already, right of it nothing has.
        follows = (ask > 0) & (hits[ask - 1] == at - 2)
        left = np.where(follows, made[hits[ask - 1]], symbols[at - 1])
        after = np.minimum(at + 2, len(symbols) - 1)
        early = np.zeros(len(hits), bool)
        for inside, pair in (
            ((at > 0) & (word[at - 1] == word[at]), self._merges(left, piece)),
            ((at + 2 < len(symbols)) & (word[after] == word[at]), self._merges(piece, symbols[after])),
        ):
            early[ask] |= inside & (pair >= 0) & (self.ranks[pair] <= self.ranks[piece])
        so_far = np.cumsum(early)
        of = np.cumsum(first) - 1
        return hits[so_far - early == (so_far - early)[first][of]]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The piece that the symbol at each place makes with the next one of its word, or -1."""
        at = np.arange(len(symbols)) if at is None else at
        made = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        made[inner] = self._merges(symbols[at[inner]], symbols[at[inner] + 1])
        return made

    def _ids(self, symbols: list[int]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                ids += [self.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        split = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new, size, long = [], 0, []
        for w in set(chain.from_iterable(split)).difference(known):
            new.append(w)
            size += len(w)
            if len(w) > LONGEST_REMEMBERED:
                long.append(w)
            if size >= BLOCK:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)
        out = [[*chain.from_iterable(map(known.__getitem__, words)), self.end] for words in split]
        for w in long:
            del known[w]
        return out

    def _learn(self, words: list[str]) -> None:
        for w, symbols in zip(words, self.merged(words)):
            # Tuples of numbers are left out of garbage collection.
            self.known[w] = tuple(symbols if max(symbols) < self.size else self._ids(symbols))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes put together, marks as spaces, the space in front taken off; the end id says nothing."""
        text = "".join(map(self.surface.__getitem__, ids))
        try:
            whole = text.encode()
        except UnicodeEncodeError:
            whole = text.encode("utf-8", "surrogateescape")
        text = whole.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """One encoder per worker process and model."""
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (the end id last) and decoded text of every document."""
    model = read_model(model_path)

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        coder = pieces(model)

        def block(held: list[tuple]) -> Iterator[tuple]:
            for (doc_id, _), ids in zip(held, coder.encode([text for _, text in held])):
                yield doc_id, ids, coder.decode(ids)

        held, size = [], 0
        for doc_id, text in rows:
            held.append((doc_id, text or ""))
            size += len(text or "")
            if size >= BLOCK or len(held) >= 1000:
                yield from block(held)
                held, size = [], 0
        yield from block(held)

    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", task)


def encoding_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = encode_and_decode(docs, model_path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
