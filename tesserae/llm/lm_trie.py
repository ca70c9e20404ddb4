"""An n-gram language model in Elias-Fano tries, built and queried in shards.

The model is a hierarchical Dirichlet bigram. With c training counts, k the prior and
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)):

    p(w | v) = (c(v w) + k p(w)) / (c(v) + k)

Its logarithm falls into a part that needs only the counts of w with its contexts and a part
that needs only the count of v, which v adds where it stands as a word itself. So tokens are
dealt by their word alone: a shard holds all contexts of its words, builds their trie and adds
up its part of every document's score; documents never meet the whole model.

No shard outgrows its tokens. A word that occurs an eighth of a shard's tokens or more, in
training or not, is hot and dealt by word and context; a pair of hot words that occurs as often
is hot too and is scored where its tokens are, from a trie of the hot pairs alone, so its tokens
never travel. Both tables hold at most eight rows for each shard; they are written to the shared
folder, and workers read them there, not from the driver.

Texts are split into tokens once, into a table of chunks of about FLUSH_TOKENS tokens.

A trie has the words' level, monotone pointers to the level of contexts, and that level: for
each word the ranks of its contexts, raised by the last value of the word before, so that the
whole level is one monotone sequence. A context is found by a successor search relative to its
word. Weights are quantised to 16 bits. The levels lie in one file for each shard in the shared
folder and are memory-mapped where that folder is a file system.

Words are known by their 64-bit xxHash: words that share one (two of a billion do with probability
0.03) would count as one, in n_known and base_score too; the contexts of one word are told apart by 48
of these bits. Defined cases: a null or empty text is its
end token alone; null keys count as '' for the split; repeated rows are trained on and scored each; an
empty table gives an empty result; without training rows all scores are those of unseen words;
only the key of the input is kept, so no name clashes; a text of any length is in one chunk, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, pieces, quoted, stream_groups
from .zip_warc import file_system

PRIOR, PSEUDO = 300.0, 0.1
#: Tokens that a shard holds, about; what part of that makes a word or pair hot; tokens of a chunk.
SHARD_TOKENS, HOT_PART, FLUSH_TOKENS = 5_000_000, 8, 2_000_000
#: Bytes of text read at a time, and words a worker knows at most.
STEP, KNOWN_WORDS = 1 << 20, 300_000
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- Elias-Fano ----------------------------------------------------------------------------

_BYTE = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.uint8)
_POP = _BYTE.sum(axis=1).astype(np.uint8)
_SELECT = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.int64)


class EliasFano:
    """A sorted sequence of unsigned 64-bit integers: low bits packed, high bits in unary."""

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits = int(header[0]), int(header[1])
        self.low, self.high, self.ones = low, high.view("<u8").reshape(-1, 8), ones
        self.zeros = np.arange(ones.size, dtype=np.int64) * 512 - ones
        self.windows = np.ndarray((max(0, low.size - 7),), dtype="<u8", buffer=low.data if isinstance(low, np.ndarray) else low, strides=(1,)) if low.size >= 8 else None

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        values = np.asarray(values, dtype=np.uint64)
        n = values.size
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        low = np.zeros((n * bits + 7) // 8 + 16, dtype=np.uint8)
        step = 1 << 16  # rows at a time; a multiple of 8, so that each stretch starts on a byte
        for at in range(0, n if bits else 0, step):
            part = values[at : at + step]
            spread = (part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            packed = np.packbits(spread.astype(np.uint8).ravel(), bitorder="little")
            low[at * bits // 8 : at * bits // 8 + packed.size] = packed
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 2 if n else 2) + 511
        flags = np.zeros(size // 512 * 512 + 512, dtype=np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POP[high].reshape(-1, 64).sum(axis=1, dtype=np.int64))]).astype(np.int64)
        return [np.array([n, bits], dtype=np.int64), low, high, ones]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero: block, 64-bit word, byte, bit."""
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        rest = k - directory[block]
        row = np.arange(k.size)
        words = self.high[block] if ones else ~self.high[block]
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int16)
        word = (sums <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, sums[row, np.maximum(word - 1, 0)], 0)
        octets = np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_POP[octets], axis=1, dtype=np.int16)
        byte = (sums <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(byte > 0, sums[row, np.maximum(byte - 1, 0)], 0)
        return block * 512 + word * 64 + byte * 8 + _SELECT[octets[row, byte], rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        if not i.size:
            return np.zeros(0, dtype=np.uint64)
        out = (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)
        return out | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(i.size, dtype=np.uint64)
        at = i * self.bits
        return (self.windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x; n if there is none."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n or not x.size:
            return np.zeros(x.size, dtype=np.int64)
        group = (x >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        past = group >= last
        group = np.minimum(group, last - 1)
        lo = np.where(group > 0, self._select(np.maximum(group - 1, 0), False) - (group - 1), 0)
        hi = self._select(group, False) - group
        low = x & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(x.size, dtype=np.uint64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return np.where(past, self.n, np.minimum(lo, self.n))


# --- a shard's trie ------------------------------------------------------------------------


def quantised(values: np.ndarray) -> list[np.ndarray]:
    low, high = (float(values.min()), float(values.max())) if values.size else (0.0, 0.0)
    step = (high - low) / 65535 or 1.0
    return [np.array([low, step]), np.rint((values - low) / step).astype(np.uint16)]


def restored(head: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return head[0] + codes * head[1]


def trie_arrays(words: np.ndarray, counts: np.ndarray, owner: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, pair_counts: np.ndarray, rest: np.ndarray, prior: float) -> list[np.ndarray]:
    """Levels of a trie. words, vocabulary: sorted hashes of words and of contexts; rest: prior *
    p(w) of each word; owner, rank and pair_counts: by word, then by context, the pairs' word
    index, context index and count."""
    pointers = np.searchsorted(owner, np.arange(words.size + 1))
    lasts = np.zeros(words.size, dtype=np.int64)
    filled = pointers[1:] > pointers[:-1]
    lasts[filled] = rank[pointers[1:][filled] - 1]
    base = np.cumsum(lasts) - lasts
    weights = np.log10(pair_counts + rest[owner]) if owner.size else np.zeros(0)
    return [*EliasFano.arrays(words), *EliasFano.arrays(vocabulary), *EliasFano.arrays(pointers), *EliasFano.arrays(rank + base[owner]),
            *quantised(weights), *quantised(np.log10(rest)), *quantised(-np.log10(counts + prior)), counts.astype(np.int64)]


class Trie:
    def __init__(self, arrays: list[np.ndarray]):
        self.words, self.vocabulary, self.pointers, self.children = (EliasFano(*arrays[i : i + 4]) for i in (0, 4, 8, 12))
        self.weights, self.alone, self.as_context, self.counts = arrays[16:18], arrays[18:20], arrays[20:22], arrays[22]

    def find(self, level: EliasFano, x: np.ndarray) -> np.ndarray:
        """Index in a level of distinct values, -1 where x is missing."""
        if not level.n:
            return np.full(x.size, -1)
        at = level.successor(x)
        return np.where((at < level.n) & (level.get(np.minimum(at, level.n - 1)) == x), at, -1)

    def numerators(self, entries: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10(c(v w) + k p(w)) for pairs of word and context, which are indexes into
        entries (places in the words' level) and contexts (hashes)."""
        rank = self.find(self.vocabulary, contexts)
        start, stop = (self.pointers.get(entries + d).astype(np.int64) for d in (0, 1))
        base = np.zeros(entries.size, dtype=np.uint64)
        inner = (start > 0) & (stop > start)
        base[inner] = self.children.get(start[inner] - 1)
        out = restored(self.alone[0], self.alone[1][entries])[word]
        known = np.flatnonzero((rank[context] >= 0) & (stop > start)[word])
        for at in range(0, known.size, 1 << 17):
            some = known[at : at + (1 << 17)]
            w, x = word[some], base[word[some]] + rank[context[some]].astype(np.uint64)
            found = np.maximum(self.children.successor(x), start[w])
            fits = found < stop[w]
            fits[fits] = self.children.get(found[fits]) == x[fits]
            out[some[fits]] = restored(self.weights[0], self.weights[1][found[fits]])
        return out


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    files, at = file_system(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    import os
    import uuid

    part = f"{at}.{os.getpid()}-{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(part) as out:
        table = [(str(a.dtype), a.size) for a in arrays]
        head = repr(table).encode().ljust(4096)
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))
    files.move(part, at)


def mapped_arrays(path: str) -> list[np.ndarray]:
    import ast

    from pyarrow import fs as pafs

    files, at = file_system(path)
    buffer = pa.memory_map(at).read_buffer() if isinstance(files, pafs.LocalFileSystem) else pa.py_buffer(files.open_input_stream(at).read())
    size = int.from_bytes(buffer[:8].to_pybytes(), "little")
    out, start = [], 8 + size
    for kind, n in ast.literal_eval(buffer[8 : 8 + size].to_pybytes().decode().strip()):
        out.append(np.frombuffer(buffer, dtype=kind, count=n, offset=start))
        start += -(-n * np.dtype(kind).itemsize // 8) * 8
    return out


# --- tokens --------------------------------------------------------------------------------


class Words(dict):
    """Word bytes to dense ids, with the hash of each id; 0 is the end of a text, 1 its start."""

    def __init__(self):
        super().__init__()
        self.hashes = [int(END), int(START)]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def forget(self) -> None:
        self.clear()
        del self.hashes[2:]


def tokens_of(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with an end after each text, and the tokens of each text. Only A-Z become lower
    case, and only ASCII white space separates words."""
    split: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "replace").lower().split()
        sizes[i] = len(own)
        split += own
    flat = np.fromiter(map(words.__getitem__, split), dtype=np.int32, count=len(split))
    return np.insert(flat, np.cumsum(sizes), 0), sizes + 1


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes. Small numbers are common (words are numbered by
    their frequency in a chunk), so the upper planes nearly vanish."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return values.size.to_bytes(8, "little") + values.itemsize.to_bytes(1, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), raw[8]
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], n * size), dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel()


def six_bytes(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of hashes."""
    return np.ascontiguousarray((hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def of_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


CHUNKS = "chunk long, keys array<KEY>, docs binary, sizes binary, flat binary, hashes binary, all_counts binary, train_counts binary"


def _columns(spec: str) -> list[str]:
    return [x.split()[0] for x in spec.split(", ")]


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row number, held out, text, key) to chunks. A chunk is named by the number of its
    first row; docs has twice a text's place in it, plus 1 for held-out texts. Tokens are indexes
    into hashes."""
    words, held, held_n = Words(), [], 0

    def flush() -> pa.RecordBatch:
        flat, sizes = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        docs = np.concatenate([x[4] for x in held]).astype(np.int32) + 2 * np.arange(sizes.size, dtype=np.int32)
        keys = pa.chunked_array([x[3] for x in held]).combine_chunks()
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        every = np.bincount(flat, minlength=len(words.hashes))
        some = np.argsort(-every, kind="stable")[: np.count_nonzero(every)]
        local = np.zeros(len(words.hashes), dtype=np.int32)
        local[some] = np.arange(some.size)
        flat, every = local[flat], every[some]
        train = np.bincount(flat[np.repeat(docs % 2 == 0, sizes)], minlength=some.size)
        hashes = np.array(words.hashes, dtype=np.uint64)[some]
        blobs = [packed(docs), packed(sizes.astype(np.uint32)), packed(flat), hashes.tobytes(), packed(every.astype(np.uint32)), packed(train.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([held[0][2]]), keys, *[pa.array([x], pa.binary()) for x in blobs]], names=_columns(CHUNKS))

    for batch in batches:
        for part in pieces(batch, "text", STEP):
            flat, sizes = tokens_of(part.column(2).to_pylist(), words)
            held.append((flat, sizes, part.column(0)[0].as_py(), part.column(3), part.column(1).to_numpy(zero_copy_only=False)))
            held_n += flat.size
            if held_n >= FLUSH_TOKENS or len(words) >= KNOWN_WORDS:
                yield flush()
                held, held_n = [], 0
                if len(words) >= KNOWN_WORDS:
                    words.forget()
    if held:
        yield flush()


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            words, every, train = np.frombuffer(row[0], dtype=np.int64), unpacked(row[1]), unpacked(row[2])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(every.astype(np.int64)), pa.array(train.astype(np.int64))], names=["word", "every", "n"])


def _small(index: np.ndarray, n: int) -> np.ndarray:
    return index.astype(np.uint16 if n <= 1 << 16 else np.uint32)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (a ^ (a >> np.uint64(27))) >> np.uint64(11)


class Chunk:
    """The tokens of one row of CHUNKS."""

    def __init__(self, row: dict):
        self.name, self.keys = row["chunk"], row["keys"]
        self.docs, self.sizes = unpacked(row["docs"]).astype(np.int32), unpacked(row["sizes"]).astype(np.int64)
        self.flat, self.hashes = unpacked(row["flat"]).astype(np.int32), np.frombuffer(row["hashes"], dtype=np.uint64)
        self.owner = np.repeat(np.arange(self.docs.size, dtype=np.int32), self.sizes)
        #: A token's context, as an index into hashes and START after them.
        self.context = np.concatenate([[0], self.flat[:-1]]).astype(np.int32)
        self.context[np.cumsum(self.sizes) - self.sizes] = self.hashes.size
        self.contexts = np.append(self.hashes, START)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})


def index_in(level: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted array, -1 where it is missing."""
    if not level.size:
        return np.full(x.size, -1)
    at = np.minimum(np.searchsorted(level, x), level.size - 1)
    return np.where(level[at] == x, at, -1)


def read_columns(path: str, names: list[str]) -> list[np.ndarray]:
    import pyarrow.dataset as ds

    files, at = file_system(path)
    table = ds.dataset(at, filesystem=files, format="parquet").to_table(names)
    return [table.column(c).to_numpy() for c in names]


class Known:
    """What is known of words and pairs: counts of pairs by code (word index * contexts + context
    index), and what each pair adds to a text."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, norm: float, prior: float):
        self.words, self.counts, self.contexts, self.norm, self.prior = words, counts, contexts, norm, prior

    def arrays(self, pairs: np.ndarray, pair_counts: np.ndarray) -> list[np.ndarray]:
        """The trie of the training pairs."""
        word, context = np.divmod(pairs, max(1, self.contexts.size))
        seen = np.flatnonzero(self.counts > 0)
        place = np.full(self.words.size, -1)
        place[seen] = np.arange(seen.size)
        rest = self.prior * 10 ** (np.log10(self.counts[seen] + PSEUDO) - self.norm)
        used = np.bincount(context, minlength=self.contexts.size) > 0
        rank = (np.cumsum(used, dtype=np.int32) - np.int32(1))[context]
        return trie_arrays(self.words[seen], self.counts[seen], place[word], self.contexts[used], rank, pair_counts, rest, self.prior)

    def ask(self, trie: Trie) -> None:
        """What a word adds whatever its context."""
        self.trie, self.entry = trie, trie.find(trie.words, self.words)
        self.met = self.entry >= 0
        self.count = np.zeros(self.words.size, dtype=np.int64)
        self.count[self.met] = trie.counts[self.entry[self.met]]
        self.base = np.log10(self.count + PSEUDO) - self.norm
        self.as_context = np.full(self.words.size, -math.log10(self.prior))
        self.as_context[self.met] = restored(trie.as_context[0], trie.as_context[1][self.entry[self.met]])
        self.as_context[self.words == END] = 0.0  # nothing follows the end

    def added(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: whether its word is known, the base and the model's logarithm."""
        word, context = np.divmod(pairs, max(1, self.contexts.size))
        part = math.log10(self.prior) + self.base[word]
        found = np.flatnonzero(self.met[word])
        if found.size:
            words, word_at = np.unique(word[found], return_inverse=True)
            contexts, context_at = np.unique(context[found], return_inverse=True)
            part[found] = self.trie.numerators(self.entry[words], self.contexts[contexts], word_at, context_at)
        return (self.count[word] > 0).astype(np.uint32), self.base[word], part + self.as_context[word]


@lru_cache(maxsize=2)
def hot_of(folder: str, norm: float, prior: float) -> tuple[np.ndarray, np.ndarray, Known, np.ndarray, tuple]:
    """Hot words with their training counts; of the hot pairs what is known, their codes and what each adds."""
    words, counts = read_columns(f"{folder}/hot_words", ["word", "n"])
    order = np.argsort(words.view(np.uint64))
    words, counts = words.view(np.uint64)[order], counts[order]
    of, context, n = read_columns(f"{folder}/hot_pairs", ["word", "context", "n"])
    contexts = np.unique(context.view(np.uint64))
    known = Known(words, counts, contexts, norm, prior)
    codes = np.searchsorted(words, of.view(np.uint64)) * np.int64(contexts.size) + np.searchsorted(contexts, context.view(np.uint64))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    known.ask(Trie(known.arrays(codes[n > 0], n[n > 0])))
    return words, counts, known, codes, known.added(codes)


def _hot_pairs(folder: str):
    """(word, context, every, n) of the pairs of hot words in each chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.sort(read_columns(f"{folder}/hot_words", ["word"])[0].view(np.uint64))
        contexts = np.unique(np.append(hot, START))
        for chunk in _chunks(batches):
            word, context = index_in(hot, chunk.hashes)[chunk.flat], index_in(contexts, chunk.contexts)[chunk.context]
            both = np.flatnonzero((word >= 0) & (context >= 0))
            code, at, every = np.unique(word[both] * np.int64(contexts.size) + context[both], return_inverse=True, return_counts=True)
            train = np.bincount(at[chunk.docs[chunk.owner[both]] % 2 == 0], minlength=code.size)
            of, by = np.divmod(code, contexts.size)
            yield pa.RecordBatch.from_arrays([pa.array(hot[of].view(np.int64)), pa.array(contexts[by].view(np.int64)), pa.array(every), pa.array(train)], names=["word", "context", "every", "n"])

    return count


SCORED = "chunk long, docs binary, sizes binary, known binary, base binary, score binary, keys array<KEY>"
#: What goes to a shard: a part of a chunk's tokens, or what the chunk scored itself.
DEALT = "shard int, words binary, contexts binary, word_at binary, context_at binary, " + SCORED
SUMS = "key KEY, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _deal(folder: str, shards: int, norm: float, prior: float, key_type: pa.DataType):
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), *[pa.binary()] * 5, pa.list_(key_type)]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names=_columns(DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, _, known, codes, (hot_known, hot_base, hot_part) = hot_of(folder, norm, prior)
        for chunk in _chunks(batches):
            word_place = index_in(hot_words, chunk.hashes)
            word, context = word_place[chunk.flat], index_in(known.contexts, chunk.contexts)[chunk.context]
            both = np.flatnonzero((word >= 0) & (context >= 0))
            place = index_in(codes, word[both] * np.int64(known.contexts.size) + context[both])
            own, place = both[place >= 0], place[place >= 0]
            n = chunk.docs.size
            sums = lambda x: np.bincount(chunk.owner[own], weights=x[place], minlength=n)
            here = np.bincount(chunk.owner[own], minlength=n).astype(np.uint32)
            yield row(chunk.name % shards, None, None, None, None, chunk.name, packed(chunk.docs), packed(here), packed(sums(hot_known).astype(np.uint32)), sums(hot_base).tobytes(), sums(hot_part).tobytes(), chunk.keys)

            shard = (_mix(chunk.hashes) % np.uint64(shards)).astype(np.int32)[chunk.flat]
            wide = np.flatnonzero(word >= 0)
            pair = chunk.hashes[chunk.flat[wide]] ^ chunk.contexts[chunk.context[wide]] * np.uint64(0x9FB21C651E98DF25)
            shard[wide] = (_mix(pair) % np.uint64(shards)).astype(np.int32)
            shard[own] = shards  # stays
            shard = shard.astype(np.uint16) if shards < 1 << 16 else shard
            order = np.argsort(shard, kind="stable")
            shard, owner, flat, context = shard[order], chunk.owner[order], chunk.flat[order], chunk.context[order]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            local = np.zeros(chunk.contexts.size, dtype=np.int32)

            def indexed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                some = np.unique(ids)
                local[some] = np.arange(some.size)
                return chunk.contexts[some], _small(local[ids], some.size)

            for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                a, b = edges[k], edges[k + 1]
                words, word_at = indexed(flat[a:b])
                contexts, context_at = indexed(context[a:b])
                mine = owner[a:b]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                counted = np.diff(np.append(first, b - a)).astype(np.uint32)
                yield row(k, words.tobytes(), six_bytes(contexts), packed(word_at), packed(context_at), chunk.name, packed(chunk.docs[mine[first]]), packed(counted), None, None, None, None)

    return deal


def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their counts summed."""
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    code, count = code[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if code.size else np.zeros(0, dtype=np.int64)
    return code[first], np.add.reduceat(count, first) if first.size else count


def _score(folder: str, norm: float, prior: float):
    u64 = lambda x: np.frombuffer(x, dtype=np.uint64)
    names = _columns(SCORED)

    def shard_rows(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Two passes over the shard's chunks, one chunk in hand at a time: the first counts the
        training pairs and builds the trie, the second scores."""
        ready = table.column("words").is_null()
        yield from table.filter(ready).select(names).to_batches()
        table = table.filter(pa.compute.invert(ready))
        if not table.num_rows:
            return
        one = lambda c, i: table.column(c)[i].as_py()
        n = table.num_rows
        all_words = np.unique(np.concatenate([np.unique(u64(one("words", i))) for i in range(n)]))
        all_contexts = np.unique(np.concatenate([np.unique(of_six_bytes(one("contexts", i))) for i in range(n)]))

        def chunk_of(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pair codes of the tokens, their texts, and how many tokens each text has."""
            word = np.searchsorted(all_words, u64(one("words", i)))[unpacked(one("word_at", i))]
            context = np.searchsorted(all_contexts, of_six_bytes(one("contexts", i)))[unpacked(one("context_at", i))]
            return word * np.int64(all_contexts.size) + context, unpacked(one("docs", i)).astype(np.int32), unpacked(one("sizes", i)).astype(np.int64)

        codes, counts_of, waiting = [], [], 0
        for i in range(n):
            code, docs, sizes = chunk_of(i)
            code, count = np.unique(code[np.repeat(docs % 2 == 0, sizes)], return_counts=True)
            codes.append(code)
            counts_of.append(count.astype(np.int32))
            waiting += code.size
            if waiting > FLUSH_TOKENS:
                code, count = added(codes, counts_of)
                codes, counts_of, waiting = [code], [count], 0
        pairs, pair_counts = added(codes, counts_of)
        del codes, counts_of
        counts = np.bincount(pairs // all_contexts.size, weights=pair_counts, minlength=all_words.size).astype(np.int64)
        hot_words, hot_counts, *_ = hot_of(folder, norm, prior)
        place = index_in(hot_words, all_words)
        counts[place >= 0] = hot_counts[place[place >= 0]]
        known = Known(all_words, counts, all_contexts, norm, prior)
        path = f"{folder}/model/shard-{number:06d}.trie"
        write_arrays(path, known.arrays(pairs, pair_counts))
        del pairs, pair_counts, counts
        known.ask(Trie(mapped_arrays(path)))
        for i in range(n):
            code, docs, sizes = chunk_of(i)
            pairs, pair_at = np.unique(code, return_inverse=True)
            first = np.cumsum(sizes) - sizes
            seen, base, score = (np.add.reduceat(x[pair_at], first) for x in known.added(pairs))
            values = [one("chunk", i), one("docs", i), one("sizes", i), packed(seen.astype(np.uint32)), base.tobytes(), score.tobytes(), None]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [table.schema.field(c).type for c in names])], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), table in stream_groups(batches, ["shard"]):
            yield from shard_rows(int(number), table)

    return score


def _gather(start: float):
    """Adds up the shards' parts of the texts of each chunk; start is each text's own part."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in stream_groups(batches, ["chunk"]):
            joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
            whole = lambda c: np.concatenate([unpacked(x) for x in table.column(c).to_pylist()])
            docs = whole("docs").astype(np.int32)
            n = int(docs.max()) // 2 + 1
            held = np.zeros(n, dtype=bool)
            held[docs // 2] = docs % 2 == 1
            sums = lambda values: np.bincount(docs // 2, weights=values, minlength=n)
            keys = table.column("keys").combine_chunks().flatten()  # of the one row that has them
            keys = pa.chunked_array([keys]).combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
            columns = [keys, pa.array(held), pa.array(sums(whole("sizes")).astype(np.int64)), pa.array(sums(whole("known")).astype(np.int64)), pa.array(sums(joined("base", np.float64))), pa.array(sums(joined("score", np.float64)) + start)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUMS.split(", ")])

    return gather


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10, held_fold: int = 0, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """Per row: the key, held_out, n_tokens, n_known, train_tokens, base_score, score. The model
    is trained on the rows outside held_fold; its tries stay in the scratch folder's `model`."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"), (crc_bucket(quoted(key), folds) == held_fold).alias("held"))
    kind = "long" if rows.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    # A text's number exists within this one pass only: the key rides along with it.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "held", "text", F.col("key").cast(kind).alias("key"))
    chunks = scratch.keep(numbered.mapInArrow(_tokenise, CHUNKS.replace("KEY", kind)), "chunks")
    unigrams = chunks.select("hashes", "all_counts", "train_counts").mapInArrow(_unigrams, "word long, every long, n long").groupBy("word").agg(F.sum("every").alias("every"), F.sum("n").alias("n"))
    unigrams = scratch.keep(unigrams, "unigrams")
    sums = unigrams.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), (F.col("n") > 0).cast("long"), F.col("every"), F.when(F.col("word") == int(END.view(np.int64)), F.col("n")))])
    total, distinct, every, train_docs = map(int, sums.first())
    shards = max(16, -(-every // shard_tokens))
    least = max(2, shard_tokens // HOT_PART)
    scratch.keep(unigrams.filter(F.col("every") >= least).select("word", "n").repartition(1), "hot_words")
    scratch.drop("unigrams")
    folder = scratch.path("")[:-1]
    pairs = chunks.mapInArrow(_hot_pairs(folder), "word long, context long, every long, n long").groupBy("word", "context").agg(F.sum("every").alias("every"), F.sum("n").alias("n"))
    scratch.keep(pairs.filter(F.col("every") >= least).select("word", "context", "n").repartition(1), "hot_pairs")
    norm = math.log10(total + PSEUDO * (distinct + 1))
    dealt = chunks.mapInArrow(_deal(folder, shards, norm, prior, pa.int64() if kind == "long" else pa.string()), DEALT.replace("KEY", kind))
    # A shard is a partition: hashed numbers of shards would put several into one.
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    scored = dealt.mapInArrow(_score(folder, norm, prior), SCORED.replace("KEY", kind))
    start = -math.log10(train_docs + prior)  # the start of a text as the context of its first token
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = scored.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_gather(start), SUMS.replace("KEY", kind))
    return sums.select(F.col("key").cast(rows.schema["key"].dataType).alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    return score_texts(docs, scratch=scratch)
