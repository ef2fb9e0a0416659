"""Byte-level BPE encoding and decoding by speculation: longest matches propose tokens, pairs are verified, failures merged.

Text is split into words by the vocabulary's pattern. For the new words of a batch, greedy longest match proposes tokens. A
proposal is the exact encoding if, for each adjacent pair of tokens, merging the bytes of the two alone gives these two (of a
word that is one token: if its bytes merge to that); the
distinct pairs of a batch are checked in one vectorised step against those known, and only pairs not met before are merged.
Words with a failing pair undergo exact merging, by rank and then from the left, on a heap. Words already encoded are kept,
CACHE_WORDS of them at most.

Defined results: a null text is an empty one and has no tokens. The special tokens of the file are recognised in text, as
its library does by default. Decoding joins the bytes of tokens; bytes that are not UTF-8 become U+FFFD. Repeated rows are
encoded alike, very long texts whole. An empty table gives no rows. Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import steps

#: Words whose tokens a worker remembers, about 200 bytes each.
CACHE_WORDS = 500_000
#: Bytes of a word up to which merges are found by a look at all ranks.
SHORT, NEVER = 24, 1 << 60
#: The split of byte-level BPE; white space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in the file, the other way round."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        of = byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.vocab = vocab
        self.reach: dict[bytes, int] = {}  # the longest token that begins with three bytes
        for t in vocab:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(of[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pairs: dict[int, bool] = {}
        self.singles: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def exact(self, word: bytes) -> list[int]:
        """Merge by least rank, then leftmost, until no pair merges."""
        ids = [self.single[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """By a look at all ranks for each merge, which costs less than a heap while they are few."""
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """On a heap of places, with links to the neighbours that are left."""
        n, ranks, made = len(ids), self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [x for x in ids if x >= 0]

    def longest_match(self, word: bytes) -> list[int]:
        out, i, n, vocab, reach = [], 0, len(word), self.vocab, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 3], 2))
            while (t := vocab.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def learn(self, new: list[str]) -> None:
        """Encode words into the cache: propose, verify all pairs at once, merge those that fail."""
        raw = [w.encode() for w in new]
        proposed = [self.longest_match(w) for w in raw]
        sizes = np.array([len(x) for x in proposed])
        flat = np.fromiter((t for x in proposed for t in x), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inner = word[1:] == word[:-1]
        codes = ((flat[:-1] << 32) | flat[1:])[inner]
        kinds, which = np.unique(codes, return_inverse=True)
        fits = np.array([self.fits(int(c)) for c in kinds], bool)
        wrong = sizes == 1  # a token need not be what its bytes merge to
        wrong[sizes == 1] = [not self.alone(x[0]) for x in proposed if len(x) == 1]
        wrong[word[1:][inner][~fits[which]]] = True
        for k, w in enumerate(new):
            ids = self.exact(raw[k]) if wrong[k] else proposed[k]
            self.words[w] = pack(ids)

    def fits(self, code: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two."""
        if (known := self.pairs.get(code)) is None:
            a, b = code >> 32, code & 0xFFFFFFFF
            if len(self.pairs) >= 2 * CACHE_WORDS:
                self.pairs.clear()
            known = self.pairs[code] = self.exact(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def alone(self, token: int) -> bool:
        """Whether the bytes of a token merge to it."""
        if (known := self.singles.get(token)) is None:
            known = self.singles[token] = self.exact(self.tokens[token]) == [token]
        return known

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str | int]] = []
        for text in texts:
            if self.cut is None or not any(s in text for s in self.special):
                pieces.append(self.split(text))
            else:
                pieces.append([x for part in self.cut(text) for x in ([self.special[part]] if part in self.special else self.split(part))])
        new = {w for p in pieces for w in p}.difference(self.words)
        new = sorted(w for w in new if isinstance(w, str))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = sorted({w for p in pieces for w in p if isinstance(w, str)})
        if new:
            self.learn(new)
        known = self.words
        out = []
        for p in pieces:
            try:
                out.append(b"".join(map(known.__getitem__, p)))
            except KeyError:  # it holds ids of special tokens
                out.append(b"".join(known[x] if isinstance(x, str) else pack([x]) for x in p))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(shared, name: str) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(shared.value)
    return _codecs[name]


def encode(docs: DataFrame, vocabulary: bytes, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Columns `keep` of docs (all by default) and n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    `vocabulary` is the content of the file; a vocabulary has a fixed size, so it is broadcast."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches):
        codec = _codec(shared, name)
        for whole in batches:
            for batch in steps(whole, "__body"):
                ids = codec.encode_batch(batch.column("__body").fill_null("").to_pylist())
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids])]
                made += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *own[: len(made)]])

    df = docs.select(*keep, F.col(text).alias("__body"))
    fields = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids).fields
    return df.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *fields]))


def vocabulary(path: str | None = None) -> bytes:
    """The content of a vocabulary file, read by the driver; the public 50k byte-level one by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), keep=["doc_id"], with_ids=False)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the token ids of every document."""
    return encode(docs, vocabulary(), keep=["doc_id"])
