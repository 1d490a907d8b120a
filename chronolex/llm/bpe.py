"""BPE encoding and decoding by batched merge rounds in numpy.

The words of a batch that were not met before are laid out as symbol ids in
one flat array. A round looks up every adjacent pair by binary search in the
sorted pair keys, takes the lowest rank in each word, merges all its
occurrences and closes the gaps; words without a pair left leave the array.

Null text encodes as empty text: no ids, empty decoded string. Repeated rows
are encoded alike. Very long texts are encoded whole, a very long word in as many
rounds as it has merges of different rank, each over what is left of it. An empty
table gives an empty result. Other columns of the table are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MEMO_WORDS = 400_000
MEMO_CHARACTERS = 8_000_000
"""Words, and characters of them, whose ids are remembered in a worker; beyond either the memo starts anew (speed only)."""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends and dropped white space."""

    def __init__(self, file: str):
        """``file`` is the text of a vocabulary file."""
        spec = json.loads(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.name[i] = text
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.width = np.int64(len(self.name))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        # the same pattern for lower-case ASCII, in the faster module
        plain = split.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r" \t-\ra-z0-9")
        self.find_ascii = re.compile(plain).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens. White space parts words and is dropped, so runs of it need no folding."""
        if text.isascii():
            return self.find_ascii(text.lower())
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all of them at once."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        ids[at[1:] - 1] = self.last[data[at[1:] - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        none = np.int32(len(self.keys))
        while len(ids):
            rank = np.full(len(ids), none, np.int32)
            key = ids[:-1].astype(np.int64) * self.width + ids[1:]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[where] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.rank[where[hit]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(ids)])
            best = np.minimum.reduceat(rank, first)
            ended = best == none
            for k in np.flatnonzero(ended):
                done[word[first[k]]] = ids[first[k] : first[k] + length[k]]
            spread = np.repeat(best, length)
            take = (rank == spread) & (rank < none)
            # in a run of equal symbols only every other pair can merge, from the left
            run = np.flatnonzero(take)
            if len(run) > 1:
                new = np.r_[True, np.diff(run) != 1]
                take[run[(np.arange(len(run)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 1]] = False
            ids = ids.copy()
            ids[take] = self.made[rank[take]]
            keep = ~np.repeat(ended, length)
            keep[1:] &= ~take[:-1]
            ids, word = ids[keep], word[keep]
        return done

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS or self.held + sum(map(len, new)) > MEMO_CHARACTERS:
            self.memo.clear()
            self.held = 0
            new = list(words)
        if new:
            self.held += sum(map(len, new))
            self.memo.update(zip(new, (tuple(x.tolist()) for x in self.merge(new)), strict=True))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        parts = []
        for text in texts:
            if "<|" in text:
                parts.append([x if x in self.special else self.pieces(x) for x in self.cut.split(text)])
            else:
                parts.append([self.pieces(text)])
        self.learn({w for p in parts for x in p if isinstance(x, list) for w in x})
        memo, out = self.memo, []
        for p in parts:
            ids: list[int] = []
            for x in p:
                if isinstance(x, list):
                    for w in x:
                        ids += memo[w]
                else:
                    ids.append(self.special[x])
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """Token texts joined by one space, as of a vocabulary without a decoder."""
        return " ".join(self.name[np.asarray(ids, np.int64)])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` array<int> and ``decoded`` string of every row; ``vocabulary`` is a path on the driver, which sends the file's text along."""
    with open(vocabulary, encoding="utf-8") as f:
        file = f.read()

    def run(batches):
        coder = WordBpe(file)
        for batch in batches:
            for part, _, _ in slices(batch, text):
                ids = coder.encode_batch([t or "" for t in part.column(text).to_pylist()])
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, at[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array([coder.decode(x) if x else "" for x in ids], pa.string())],
                    [key, "ids", "decoded"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digests of what ``encode`` returns, after the columns to ``carry``."""
    return encoded.select(
        key,
        *carry,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
