"""Operator 6: packing documents into windows with lexically near ones, by a sharded BM25 inverted index over tokens."""

from __future__ import annotations

import base64
import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common, shingles

WINDOW = 1024
#: Documents and tokens of a shard of the index: what one task holds at a time.
SHARD_DOCS, SHARD_TOKENS = 2048, 4_000_000
#: A token that more than this share of a shard's documents have is kept as a row over all of them.
DENSE = 0.12
K1, B = 1.2, 0.75
END_ID = 0
#: Words over which a tokenizer forgets all that it remembers.
CACHE = 1_000_000
#: Bytes of a word over which it is compared by itself.
LONG = 128
#: Binary logarithm of the slots of the table that holds them.
SLOTS = 22


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_specials() -> dict[str, int]:
    """The strings that the vocabulary's JSON form gives an id of their own, in any text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _table(codes: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


_BREAK = _table(b" \n")
_SPACE = _table(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
#: First bytes of the white space outside ASCII.
_FAR = _table(b"\xc2\xe1\xe2\xe3")


def _gathered(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all the spans, one after the other."""
    return data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]


class Encoder:
    """Token ids of texts by byte-level BPE, with a memory of words.

    A space between two characters that aren't white space always begins a pre-token, and so does a line break
    there; so a text without adjacent white space is the concatenation of its words, each encoded with the space or
    line break before it. Each word of a batch is encoded once, and remembered; a remembered word is found by a hash and
    its bytes are compared. Texts with adjacent white space, or white space at either end, are encoded whole. Special
    strings have the ids given, and what stands between them is encoded by itself, as the tokenizers library does it
    with the vocabulary's JSON form.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None):
        import tiktoken

        self._specials = specials or {}
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self._specials, key=lambda s: (-len(s), s)))) + ")").split if self._specials else None
        self._ids = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = np.zeros(65536, np.int64)
        self._bytes[list(ranks.values())] = [len(x) for x in ranks]
        self._adjacent = re.compile(r"\s\s|^\s|\s\Z").search
        self._forget()

    def _forget(self) -> None:
        """An empty open-addressing table of word keys, with each word's place and length in the pool of ids."""
        self._key, self._entry = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self._pool, self._from, self._n = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The words themselves: bytes (eight more at the end), places and lengths, and what stands before them.
        self._text, self._at, self._size, self._lead = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        mask = np.uint64((1 << SLOTS) - 1)
        slot = (key & mask).astype(np.intp)
        there = self._key[slot]
        out = np.where(there == key, self._entry[slot], -1)
        open_ = np.flatnonzero((there != key) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            there = self._key[slot[open_]]
            same = there == key[open_]
            out[open_[same]] = self._entry[slot[open_[same]]]
            open_ = open_[~same & (there != 0)]
        return out

    def _same(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Whether the words are those of their entries. Up to seven bytes the key tells (see _keys()), beyond them the bytes are compared."""
        ok = (self._size[entry] == size) & (self._lead[entry] == lead)
        for i in np.flatnonzero(ok & (size > LONG)).tolist():
            a = self._at[entry[i]]
            ok[i] = np.array_equal(data[starts[i] : starts[i] + size[i]], self._text[a : a + size[i]])
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        there, known = (np.ndarray((len(x) - 7,), "<u8", x, 0, (1,)) for x in (padded, self._text))
        live, step = np.flatnonzero(ok & (size > 7) & (size <= LONG)), 0
        while len(live):
            differs = (there[starts[live] + step] ^ known[self._at[entry[live]] + step]) & shingles.KEEP[np.minimum(size[live] - step, 8)] != 0
            ok[live[differs]] = False
            step += 8
            live = live[~differs & (size[live] > step)]
        return ok

    @staticmethod
    def _keys(h: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Keys of words with what stands before them, never 0. Words of up to seven bytes have keys of their own: their bytes, length
        and lead in 64 bits, through a bijection (whose values 0 and 1, which share a key, come from no word)."""
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        first = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))[starts] & shingles.KEEP[np.minimum(size, 7)]
        own = first ^ ((size | lead << 4).astype(np.uint64) << np.uint64(56))
        return np.maximum(shingles.mix(np.where(size <= 7, own, h + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), np.uint64(1))

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, lead: np.ndarray) -> None:
        """Encode new words and add them to the table. Those after a space or line break are encoded as one text, in which every
        one begins with a pre-token; if some token should cross two of them, or a word begins its text, word by word."""
        before = np.minimum(lead, 1)
        joined = _gathered(data, starts - before, size + before)
        upto = np.cumsum(size + before)
        ids = np.array(self._ids(joined.tobytes().decode()), np.uint16)
        ends = np.cumsum(self._bytes[ids])
        at = np.searchsorted(ends, upto)
        n = np.diff(at, prepend=-1)
        if (lead == 0).any() or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], upto):
            lists = [self._ids(joined[b - k : b].tobytes().decode()) for b, k in zip(upto.tolist(), (size + before).tolist())]
            n, ids = np.array([len(x) for x in lists], np.int64), np.fromiter(itertools.chain.from_iterable(lists), np.uint16)
        entry = np.arange(len(self._n), len(self._n) + len(keys), dtype=np.int32)
        slot, left = (keys & np.uint64((1 << SLOTS) - 1)).astype(np.intp), np.arange(len(keys))
        while len(left):
            free = left[self._key[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            self._key[slot[free]], self._entry[slot[free]] = keys[free], entry[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            slot[left] = slot[left] + 1 & (1 << SLOTS) - 1
        self._from = np.concatenate((self._from, len(self._pool) + np.cumsum(n) - n))
        self._n, self._pool = np.concatenate((self._n, n)), np.concatenate((self._pool, ids))
        self._at = np.concatenate((self._at, len(self._text) - 8 + np.cumsum(size) - size))
        self._size, self._lead = np.concatenate((self._size, size)), np.concatenate((self._lead, lead))
        self._text = np.concatenate((self._text[:-8], _gathered(data, starts, size), np.zeros(8, np.uint8)))

    def _whole_ids(self, text: str) -> list[int]:
        if self._parts is None:
            return self._ids(text)
        return [i for x in self._parts(text) for i in ((self._specials[x],) if x in self._specials else self._ids(x))]

    def _whole(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        space = _SPACE[data]
        some = off[1:] > off[:-1]
        out = np.zeros(len(some), bool)
        out[some] = space[off[:-1][some]] | space[off[1:][some] - 1]
        pair = np.flatnonzero(space[1:] & space[:-1])
        out[np.searchsorted(off, pair, side="right") - 1] = True
        far = np.unique(np.searchsorted(off, np.flatnonzero(_FAR[data]), side="right") - 1)
        for i in far[~out[far]].tolist():
            out[i] = self._adjacent(data[off[i] : off[i + 1]].tobytes().decode()) is not None
        return out

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, as little-endian 16-bit numbers."""
        data, off = shingles.raw(texts)
        if len(data) == 0:
            return [b""] * len(texts)
        whole = self._whole(data, off)
        for x in self._specials:
            whole |= pc.match_substring(pc.fill_null(texts, ""), x).to_numpy(zero_copy_only=False)
        if len(self._n) > CACHE:
            self._forget()
        h, starts, ends = shingles.spans(data, off, ~_BREAK)
        first = np.searchsorted(starts, off)
        lead = np.where(data[np.maximum(starts, 1) - 1] == 32, 1, 2)
        lead[first[:-1][first[:-1] < first[1:]]] = 0
        size = ends - starts
        key = self._keys(h, data, starts, size, lead)
        at = self._find(key)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            new, where = np.unique(key[lost], return_index=True)
            for own in (lead[lost[where]] == 0, lead[lost[where]] > 0):
                if own.any():
                    i = lost[where[own]]
                    self._learn(new[own], data, starts[i], size[i], lead[i])
            at[lost] = self._find(key[lost])
        other = np.flatnonzero(~self._same(at, data, starts, size, lead))
        whole[np.searchsorted(off, starts[other], side="right") - 1] = True
        n = self._n[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = self._pool[np.repeat(self._from[at] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[first].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self._whole_ids(data[off[i] : off[i + 1]].tobytes().decode()), np.uint16).tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, Encoder] = {}


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, specials: dict[str, int] | None = None) -> DataFrame:
    """(_i, _ids): each row's id and its tokens with the closing id, as 16-bit numbers."""
    import public_tokenizers

    spark = docs.sparkSession
    specials = specials if specials is not None else default_specials() if vocabulary is None else {}
    vocabulary = vocabulary or default_vocabulary()
    name = f"{vocabulary} {sorted(specials.items())}"
    shared = spark.sparkContext.broadcast((read_ranks(vocabulary), public_tokenizers.PATTERN, specials))
    src = docs.select(F.col(id_col).alias("_i"), common.text_of(text_col).alias("_t"))
    close = np.array([END_ID], np.uint16).tobytes()

    def run(b: pa.RecordBatch) -> dict:
        enc = _ENCODERS.get(name) or _ENCODERS.setdefault(name, Encoder(*shared.value))
        return {"_i": b.column("_i"), "_ids": pa.array([x + close for x in enc.batch(b.column("_t"))], pa.binary())}

    return common.map_text(src, run, f"_i {src.schema['_i'].dataType.simpleString()}, _ids binary")


def _sorted_tokens(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each document in order, their frequencies, and the documents' offsets."""
    off = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        flat[a:b].sort()
    return shingles.distinct(flat, off)


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many of all documents have each token, how many documents there are, and their mean length.

    Every task sums its own documents into a vector over the vocabulary; at most 65,536 sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(65536, np.int64), 0, 0
        for batch in batches:
            for part in common.slices(batch, "_ids"):
                ids = [np.frombuffer(x, np.uint16) for x in part.column("_ids").to_pylist()]
                df += np.bincount(_sorted_tokens(ids)[0], minlength=65536)
                n, total = n + len(ids), total + sum(map(len, ids))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"_k": pa.array(np.concatenate((at, [-1, -2])), pa.int32()), "_v": pa.array(np.concatenate((df[at], [n, total])), pa.int64())})

    got = tokens.select("_ids").mapInArrow(run, "_k int, _v long").groupBy("_k").agg(F.sum("_v").alias("_v")).toPandas()
    df = np.zeros(65536, np.int64)
    own = dict(zip(got["_k"].tolist(), got["_v"].tolist()))
    n, total = own.pop(-1, 0), own.pop(-2, 0)
    df[list(own)] = list(own.values())
    return df, n, total / max(n, 1)


def _telling(ids: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's two rarest tokens, as their places in the order of rarity (65536: none)."""
    tok, _, off = _sorted_tokens(ids)
    at = np.append(place[tok], 65536)
    some = off[1:] > off[:-1]
    first, second = np.full(len(ids), 65536), np.full(len(ids), 65536)
    if some.any():
        first[some] = np.minimum.reduceat(at, off[:-1][some])[: some.sum()]
        at[:-1][at[:-1] == np.repeat(first, np.diff(off))] = 65536
        second[some] = np.minimum.reduceat(at, off[:-1][some])[: some.sum()]
    return first, second


def colocated(tokens: DataFrame, df: np.ndarray, n_parts: int) -> DataFrame:
    """(_i, _ids) with documents of the whole table side by side that have their rarest tokens in common.

    Of the tokens that several documents have, a document's rarest is its key, and the next one orders documents of one
    key. Tokens are counted by key, so that partitions are equal ranges of keys; a key of over a quarter of a partition is
    dealt by a hash of its rows. Depends on the rows alone, not on how they come. At most 65,537 counts reach the driver.
    """
    spark = tokens.sparkSession
    rare = np.lexsort((np.arange(65536), np.where(df > 1, df, 1 << 62)))
    place = np.empty(65536, np.int64)
    place[rare] = np.arange(65536)
    place[df <= 1] = 65536
    shared = spark.sparkContext.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(65537, np.int64)
        for batch in batches:
            for part in common.slices(batch, "_ids"):
                ids = [np.frombuffer(x, np.uint16) for x in part.column("_ids").to_pylist()]
                np.add.at(size, _telling(ids, shared.value)[0], [len(x) for x in ids])
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_pydict({"_k": pa.array(at, pa.int32()), "_v": pa.array(size[at], pa.int64())})

    got = tokens.select("_ids").mapInArrow(count, "_k int, _v long").groupBy("_k").agg(F.sum("_v").alias("_v")).toPandas()
    size = np.zeros(65537)
    size[got["_k"].to_numpy(int)] = got["_v"].to_numpy(float)
    each = max(size.sum(), 1.0) / n_parts
    known = spark.sparkContext.broadcast((np.cumsum(size) - size, np.where(size > each / 4, size, 0.0)))

    def deal(part: pa.RecordBatch) -> dict:
        before, hot = known.value
        first, second = _telling([np.frombuffer(x, np.uint16) for x in part.column("_ids").to_pylist()], shared.value)
        share = (part.column("_h").to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0**-53
        to = np.clip((before[first] + hot[first] * share) / each, 0, n_parts - 1).astype(np.int32)
        return {"_i": part.column("_i"), "_ids": part.column("_ids"), "_h": part.column("_h"), "_p": pa.array(to), "_k1": pa.array(first.astype(np.int32)), "_k2": pa.array(second.astype(np.int32))}

    named = tokens.select("_i", "_ids", F.xxhash64("_i", "_ids").alias("_h"))
    dealt = common.map_text(named, deal, f"_i {named.schema['_i'].dataType.simpleString()}, _ids binary, _h long, _p int, _k1 int, _k2 int", "_ids")
    return dealt.repartitionById(n_parts, F.col("_p")).sortWithinPartitions("_k1", "_k2", "_i", "_h").select("_i", "_ids")


class Shard:
    """Documents with an inverted index of their tokens' BM25 weights; search() finds the best unused ones."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(ids)
        self.size = np.array([len(x) for x in ids])
        tok, tf, off = _sorted_tokens([x[:-1] for x in ids])
        doc = np.repeat(np.arange(self.n), np.diff(off))
        weight = idf[tok] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[doc] / mean)))
        order = np.argsort(tok, kind="stable")
        self._doc, self._weight = doc[order], weight[order]
        self._start = np.searchsorted(tok[order], np.arange(65537))
        self._tok, self._off = tok, off
        often = np.flatnonzero(np.diff(self._start) > DENSE * self.n)
        self._row = np.full(65536, -1)
        self._row[often] = np.arange(len(often))
        self._dense = np.zeros((len(often), self.n), np.float32)
        for i, t in enumerate(often.tolist()):
            at = slice(self._start[t], self._start[t + 1])
            self._dense[i, self._doc[at]] = self._weight[at]
        self.unused = np.ones(self.n, bool)

    def search(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for all of the seed's tokens."""
        t = self._tok[self._off[seed] : self._off[seed + 1]].astype(np.int64)
        row = self._row[t]
        out = self._dense[row[row >= 0]].sum(axis=0).astype(np.float64)
        t = t[row < 0]
        lo, n = self._start[t], self._start[t + 1] - self._start[t]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return out + np.bincount(self._doc[at], self._weight[at], self.n)


class Packer:
    """Fills windows one after the other: the rest of the last document, or else the next one, is a window's seed."""

    def __init__(self, first: int, window: int):
        self.window, self.sequence, self.filled, self.rows = window, first, 0, []

    def put(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Append a document, cut at window ends. Whether the window that it ends in is still its seed's."""
        start, same = 0, True
        while start < len(ids):
            n = min(len(ids) - start, self.window - self.filled)
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.sequence, self.filled))
            start += n
            self.filled += n
            if self.filled == self.window:
                self.sequence, self.filled, same = self.sequence + 1, 0, False
        return same

    def pack(self, names: list, ids: list[np.ndarray], shard: Shard) -> None:
        at, scores = 0, None
        while True:
            best = -1
            if scores is not None:
                best = int(np.argmax(scores))
                if scores[best] <= 0:
                    best = -1
            if best < 0:
                while at < shard.n and not shard.unused[at]:
                    at += 1
                if at == shard.n:
                    return
                best = at
            shard.unused[best] = False
            same = self.put(names[best], ids[best])
            if not same or scores is None:
                # It now fills the start of a window: the seed that the window's neighbours are asked for.
                scores = np.where(shard.unused, shard.search(best), 0.0) if self.filled else None
            else:
                scores[best] = 0.0

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*self.rows))
        self.rows = []
        kinds = [kind, *[pa.int64()] * 6]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, cols or [[]] * 7, kinds)})


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, specials: dict[str, int] | None = None, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokens are written once to the shared folder; document frequencies and the mean length are counted over all
    of them. The documents of the whole table are then dealt by their rarest tokens, see colocated(). A shard is a run of
    consecutive documents of that order, bounded by documents and tokens; it has an inverted index with BM25 weights
    from those counts. Neighbours in other shards are not found; the README gives the measured recall. A window's seed is the document that it starts with; the
    shard's unused documents of the highest score for the seed fill it, then those in order. A document that
    overflows a window is cut and seeds the next one, so windows have no gaps, and one window of each partition stays
    short. The tokens are shuffled once.

    Null text counts as empty: its piece is the closing id alone. Repeated rows are packed each. Null ids stay null; ids may be
    of any type. A text longer than a window is cut into pieces, none is left out. An empty table gives no pieces. Ties go
    to the earlier document in the shard's order. Other columns, whatever their names, are ignored. `specials` are strings
    that have an id of their own in any text, by default those of the default vocabulary.
    """
    spark = docs.sparkSession
    tokens = common.stored(encoded(docs, id_col, text_col, vocabulary, specials), "tokens")
    df, n, mean = document_frequencies(tokens)
    known = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), max(mean, 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, avg = known.value
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        names, ids, total, kind = [], [], 0, pa.int64()
        for batch in batches:
            kind = batch.column("_i").type
            for name, raw in zip(batch.column("_i").to_pylist(), batch.column("_ids").to_pylist()):
                names.append(name)
                ids.append(np.frombuffer(raw, np.uint16))
                total += len(ids[-1])
                if len(ids) == shard_docs or total > shard_tokens:
                    packer.pack(names, ids, Shard(ids, idf, avg))
                    yield packer.take(kind)
                    names, ids, total = [], [], 0
        if ids:
            packer.pack(names, ids, Shard(ids, idf, avg))
            yield packer.take(kind)

    parts = max(1, math.ceil(n / (4 * shard_docs)), math.ceil(n * mean / (4 * shard_tokens)))
    return colocated(tokens, df, parts).mapInArrow(run, f"doc_id {tokens.schema['_i'].dataType.simpleString()}, {PIECES}")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
