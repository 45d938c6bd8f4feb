"""Byte-level BPE by walking the prefixes of distinct words.

The last token of a prefix's encoding determines the encoding: it is the one token t that ends the
prefix, such that t may follow the last token of the prefix without t. So a word needs one state
per prefix, its last token, and words that share a prefix share its states. The distinct words of
a slice form a trie; here it is kept as the sorted words, and going through them with a stack of
states is the depth-first walk: the stack keeps the states of the prefix that the next word
shares with the last one, so each trie node is computed once.

Words come from whole texts. A text is cut where one space lies between two characters that are
not white space; the splitting pattern starts a new piece there whatever stands around, so pieces
are split into words once per distinct piece, by the tokenizer's own splitter. Known pieces are
kept per task in a table of bounded size; when it is full it is started anew.

Defined cases: null is the empty text with no tokens; special strings inside a text become their
special token; ids that are no token decode to nothing; an empty table gives an empty table; only
the id and text columns are read, so other columns cannot clash. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import give_back, lists, slices

MAX_PIECES = 700_000
MAX_WORDS = 1_000_000
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_PLAIN = r"A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~"
#: Pieces whose words need no Unicode tables: Latin letters, digits, signs but the apostrophe, single line ends.
PLAIN = re.compile(rf" ?[{_PLAIN}]+(?:\n[{_PLAIN}]+)*")
PLAIN_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")


class Vocabulary:
    """Merges and tokens of a tokenizer file, in its own alphabet of 256 characters for bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The length of the longest token by its last two characters.
        self.longest: dict[str, int] = {}
        for token in self.ids:
            if len(token) > self.longest.get(token[-2:], 1):
                self.longest[token[-2:]] = len(token)
        self.rank: dict[tuple[str, str], int] = {}
        #: How a token was merged: rank, left and right part.
        self.made: dict[str, tuple[int, str, str]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((left, right), n)
            self.made.setdefault(left + right, (n, left, right))
        self._follows: dict[tuple[str, str], bool] = {}
        self._sure: set[str] = set()
        chars = byte_characters()
        self.spelled = {b: c for c, b in chars.items()}
        size = max([*self.ids.values(), *self.special.values()], default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens at one border of `token` from its first character on, and the rank that ends each."""
        out: list[tuple[str, float]] = [(token, float("inf"))]
        while out[-1][0] in self.made:
            rank, *parts = self.made[out[-1][0]]
            out.append((parts[side], rank))
        return out[::-1]

    def follows(self, a: str, b: str) -> bool:
        """Whether `a` and `b` side by side stay two tokens: no merge ever crosses the border.

        Both borders grow by merges in order of rank; a pair that faces each other at some time
        merges if its rank comes before the merges that replace either. Of equal ranks the left
        one comes first.
        """
        left, right, i, j, free = self.spine(a, 1), self.spine(b, 0), 0, 0, True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                free = False
                break
            if x_ends <= y_ends:
                if i + 1 == len(left):
                    break
                i += 1
            else:
                j += 1
        if len(self._follows) > 1_000_000:
            self._follows.clear()
        self._follows[a, b] = free
        return free

    def whole(self, token: str) -> bool:
        """Whether the merges turn the characters of `token` into that one token."""
        parts = list(token)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                return False
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._sure.add(token)
        return True

    def words(self, piece: str) -> list[str]:
        """The words of a piece as the tokenizer's splitter gives them, spelled in its alphabet."""
        if PLAIN.fullmatch(piece):
            return [w.encode().decode("latin-1").translate(self.spelled) for w in PLAIN_WORD.findall(piece)]
        return [w for w, _ in self.split(piece)]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of every word; a prefix that several words share is worked out once."""
        out, last, before = {}, [], ""
        ids, longest, borders, sure = self.ids, self.longest, self._follows, self._sure
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                most = longest.get(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(end - most if end > most else 0, end):
                    token = word[start:end]
                    if token not in ids or (token not in sure and not self.whole(token)):
                        continue
                    if start:
                        free = borders.get((last[start - 1], token))
                        if free is None:
                            free = self.follows(last[start - 1], token)
                        if not free:
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            own, at = [], len(word)
            while at:
                own.append(ids[last[at - 1]])
                at -= len(last[at - 1])
            out[word], before = pack(f"<{len(own)}I", *own[::-1]), word
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids, and the row offsets into them."""
        ids = ids[(known := (ids >= 0) & (ids < len(self.sizes)))] if (len(ids) and len(self.sizes)) else ids[:0]
        if not known.all() if len(ids) else False:
            offsets = np.concatenate([[0], np.cumsum(known)])[offsets]
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(ends[-1]) + np.repeat(self.places[ids] - ends[:-1], sizes)
        return self.flat[places], ends[np.minimum(offsets, len(ids))]


def byte_characters() -> dict[str, int]:
    """The alphabet of byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes lists of texts with a table of known pieces."""

    def __init__(self, vocab: Vocabulary, max_pieces: int = MAX_PIECES) -> None:
        self.vocab, self.max_pieces = vocab, max_pieces
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        special = sorted(vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        """Pieces that are encoded on their own and give the text back when put together."""
        if self.special is not None and (found := self.special.split(text))[1:]:
            return list(chain.from_iterable([x] if x in self.vocab.special else self.pieces(x) for x in found))
        if not text:
            return []
        parts = SAFE_CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return [parts[0], *(" " + x for x in parts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > self.max_pieces:
            self.known = {}
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.words) > MAX_WORDS:
            self.words = {}
        split = {}
        for piece in fresh:
            if piece in self.vocab.special:
                self.known[piece] = self.vocab.special[piece].to_bytes(4, "little")
            else:
                split[piece] = self.vocab.words(piece)
        self.words |= self.vocab.encode_words(set(chain.from_iterable(split.values())).difference(self.words))
        ids = self.words
        for piece, own in split.items():
            self.known[piece] = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]


def encode_batches(
    batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, with_digests: bool
) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary(path))
    for batch, _, _ in slices(batches, "text"):
        rows = encoder.encode(batch.column(1).to_pylist())
        counts = np.array([len(x) // 4 for x in rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
        if with_digests:
            data, ends = encoder.vocab.decode(ids, offsets)
            out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
            out["decoded_sha256"] = pa.array(
                [
                    hashlib.sha256(data[a:b].tobytes().decode("utf-8", "replace").encode()).hexdigest()
                    for a, b in zip(ends[:-1], ends[1:], strict=True)
                ],
                pa.string(),
            )
        if with_ids:
            out["ids"] = lists(ids.astype(np.int32), offsets, pa.int32())
        yield pa.record_batch(list(out.values()), list(out))
    encoder.vocab._follows.clear()
    del encoder
    give_back()


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False
) -> DataFrame:
    """Per row the id column, `n_tokens`, and on demand `ids` and the digests of ids and decoded text."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long"
    schema += ", ids_sha256 string, decoded_sha256 string" * digests + ", ids array<int>" * ids

    def run(batches):
        for batch in encode_batches(batches, path, ids, digests):
            yield batch.rename_columns([id_col, *batch.schema.names[1:]])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from an array of ids; bytes that are no UTF-8 become the replacement character."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                data, _ = vocab.decode(np.array(ids or [], np.int64), np.array([0, len(ids or [])]))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, text string")
