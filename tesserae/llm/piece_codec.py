"""SentencePiece encoding and decoding for BPE models with byte fallback.

Texts are cut where no piece of the vocabulary holds the two characters side by side: no merge
can ever cross such a cut, so each part is encoded by itself. Parts not met before are merged
together in numpy: flat symbol arrays, in each round the least pair rank of each word, all its
leftmost non-overlapping occurrences at once, then compaction, until no pair remains. Where a new
piece makes a pair with its neighbours that is as good as the one merged or better (the model's
rank inversions), a word's round ends with that occurrence, so the order is that of one merge at a
time.

Decoding is a gather of piece bytes by id over flat arrays.

Defined cases: a null text is the empty text, whose ids are the end id only; long texts are
handled whole; repeated rows are encoded alike; an empty table gives an empty result; input
columns named as an output give way to it. Decoding ignores nulls inside ids and turns control
ids into nothing and invalid bytes into U+FFFD, as the library does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import ship

from .common import pieces, quoted, small_batches

SPACE = "▁"
#: Words known to a worker at most; beyond that its table starts anew.
KNOWN_WORDS, KNOWN_IDS = 100_000, 1_000_000
#: Rounds after which a word that is not finished goes on with a heap, in the same order of merges.
#: Only runs of thousands of spaces were seen to need them; each of their rounds settles few.
ROUNDS = 500
NONE = np.int32(2**31 - 1)


class PieceModel:
    """The vocabulary of a SentencePiece BPE model and what encoding needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.unk, self.eos, self.bos = lib.unk_id(), lib.eos_id(), lib.bos_id()
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        plain = [i for i in range(n) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))]
        scores = {i: lib.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.id_of = {names[i]: i for i in plain}
        self.rank_of = {i: order[scores[i]] for i in plain}
        self.adjacent = np.array(sorted({ord(a) << 21 | ord(b) for p in self.id_of for a, b in zip(p, p[1:])}), dtype=np.int64)
        #: Symbols beyond the vocabulary are single characters without an id: n + code point.
        self.size = n
        pairs, careful = {}, set()
        for piece, whole in self.id_of.items():
            for k in range(1, len(piece)):
                left, right = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if left is None or right is None:
                    continue  # a single character without an id never starts a merge of pieces
                pairs[left * n + right] = whole
                for part in (left, right):
                    if self.rank_of[whole] <= self.rank_of[part]:
                        careful.add(part)
        # A multi-character piece may also hold characters that have no id of their own.
        for piece, whole in self.id_of.items():
            if any(c not in self.id_of for c in piece) and len(piece) > 1:
                raise ValueError("a piece holds a character that the vocabulary lacks")
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32)
        self.rank = np.full(n, NONE, dtype=np.int32)
        for i, r in self.rank_of.items():
            self.rank[i] = r
        self.careful = np.zeros(n, dtype=bool)
        self.careful[list(careful)] = True
        # decoding: bytes of each id, flat
        raw = [b"" if (lib.is_control(i)) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        raw[self.unk] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.raw_length = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.starts_with_space = np.array([names[i].startswith(SPACE) for i in range(n)])
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.counts = np.zeros(1 << 12, dtype=np.int64)

    # -- encoding ---------------------------------------------------------------------------

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and how many each word has."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        distinct, where = np.unique(code, return_inverse=True)
        symbol = np.array([self.id_of.get(chr(c), self.size + c) for c in distinct.tolist()], dtype=np.int64)[where]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        # parts: a new one at each word, and wherever no piece holds both neighbours
        side = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(self.adjacent, side), self.adjacent.size - 1)
        apart = np.ones(code.size, dtype=bool)
        apart[1:] = (self.adjacent[at] != side) | (owner[1:] != owner[:-1])
        word = np.cumsum(apart, dtype=np.int32) - np.int32(1)
        of_part = owner[apart]
        done_symbols, done_words = [], []
        rounds = 0
        while symbol.size:
            left, right = symbol[:-1], symbol[1:]
            key = np.where((word[:-1] == word[1:]) & (left < self.size) & (right < self.size), left * self.size + right, -1)
            at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            hit = self.pair_keys[at] == key
            made = np.where(hit, self.pair_ids[at], 0)
            rank = np.where(hit, self.rank[made], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(np.concatenate([rank, [NONE]]).astype(np.int32), first)
            live = least != NONE
            spans = np.diff(np.concatenate([first, [symbol.size]]))
            if not live.all():  # finished words leave
                out = np.repeat(~live, spans)
                done_symbols.append(symbol[out])
                done_words.append(word[out])
                if not live.any():
                    break
                keep = ~out
                pair_keep = keep[:-1]
                symbol, word = symbol[keep], word[keep]
                rank = rank[pair_keep][: symbol.size - 1]
                made = made[pair_keep][: symbol.size - 1]
                least, spans = least[live], spans[live]
                first = np.concatenate([[0], np.cumsum(spans)[:-1]])
            if rounds >= ROUNDS:
                for a, b in zip(first.tolist(), (first + spans).tolist()):
                    rest = self._heap(symbol[a:b].tolist())
                    done_symbols.append(np.array(rest, dtype=np.int64))
                    done_words.append(np.full(len(rest), word[a], dtype=np.int32))
                break
            rounds += 1
            best = np.repeat(least, spans)
            take = np.flatnonzero(rank == best[:-1]) if rank.size else np.zeros(0, dtype=np.int64)
            # leftmost of overlapping runs: every second of positions that follow each other
            run = np.concatenate([[True], np.diff(take) != 1])
            starts = np.flatnonzero(run)
            offset = np.arange(take.size) - np.repeat(starts, np.diff(np.concatenate([starts, [take.size]])))
            take = take[offset % 2 == 0]
            # up to the first in a word after which a pair as good or better stands beside it
            if (risky := np.flatnonzero(self.careful[made[take]])).size:
                i = take[risky]
                new = made[i]
                joined = np.zeros(i.size, dtype=bool)  # whether the piece before was made just now
                joined[risky > 0] = take[risky[risky > 0] - 1] == i[risky > 0] - 2
                left = np.where(joined, made[np.maximum(i - 2, 0)], symbol[np.maximum(i - 1, 0)])
                right = symbol[np.minimum(i + 2, symbol.size - 1)]
                left_in = (i > 0) & (word[np.maximum(i - 1, 0)] == word[i])
                right_in = (i + 2 < symbol.size) & (word[np.minimum(i + 2, symbol.size - 1)] == word[i])
                near = np.minimum(self._pair_rank(left, new, left_in), self._pair_rank(new, right, right_in))
                ends = np.zeros(take.size, dtype=np.int64)
                ends[risky[near <= best[i]]] = 1
                lead = np.flatnonzero(np.concatenate([[True], word[take][1:] != word[take][:-1]]))
                before = np.cumsum(ends) - ends
                take = take[before == np.repeat(before[lead], np.diff(np.append(lead, take.size)))]
            symbol = symbol.copy()
            symbol[take] = made[take]
            stay = np.ones(symbol.size, dtype=bool)
            stay[take + 1] = False
            symbol, word = symbol[stay], word[stay]
        symbols, owners = np.concatenate(done_symbols or [symbol]), np.concatenate(done_words or [word])
        order = np.argsort(owners, kind="stable")
        symbols, owners = symbols[order], owners[order]
        return self._with_bytes(symbols, of_part[owners], len(words))

    def _heap(self, symbols: list[int]) -> list[int]:
        """One merge at a time: least rank, then leftmost."""
        n, size = len(symbols), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] < size and symbols[j] < size and (made := self.pairs.get(symbols[i] * size + symbols[j])) is not None:
                heapq.heappush(heap, (self.rank_of[made], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a * size + b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s in symbols if s >= 0]

    def _pair_rank(self, left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs make, NONE where they make none or are not valid."""
        key = np.where(valid & (left < self.size) & (right < self.size), left * np.int64(self.size) + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.rank[np.where(hit, self.pair_ids[at], 0)], NONE)

    def _with_bytes(self, symbols: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without an id become the ids of their bytes."""
        odd = symbols >= self.size
        if odd.any():
            spelled = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in (symbols[odd] - self.size).tolist()]
            times = np.ones(symbols.size, dtype=np.int64)
            times[odd] = [len(x) for x in spelled]
            out = np.repeat(symbols, times)
            out[np.repeat(odd, times)] = np.concatenate(spelled)
            symbols, owners = out, np.repeat(owners, times)
        return symbols.astype(np.int32), np.bincount(owners, minlength=n)

    def _learn(self, words: list[str]) -> None:
        """Adds words to the table, each encoded with the space mark before it."""
        ids, total = self.merge_words([SPACE + w.replace(" ", SPACE) for w in words])
        have = len(self.known)
        while self.used + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + len(words) > self.starts.size:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[self.used : self.used + ids.size] = ids
        self.starts[have : have + len(words)] = self.used + np.cumsum(total) - total
        self.counts[have : have + len(words)] = total
        self.known.update(zip(words, range(have, have + len(words))))
        self.used += ids.size

    def encode(self, texts: list[str | None], eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offset of each text's first."""
        split: list[str] = []
        sizes = []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            text = text.replace(SPACE, " ")
            words = (" " + text).split(" ")[1:]
            if "" in words:  # runs of spaces: a space before a space belongs to the next word
                words = spaced(words)
            sizes.append(len(words))
            split += words
        if len(self.known) > KNOWN_WORDS or self.used > KNOWN_IDS:
            self._forget()
        known = self.known
        if new := set(split).difference(known):
            self._learn(list(new))
        index = np.fromiter(map(known.__getitem__, split), dtype=np.int64, count=len(split))
        counts = self.counts[index]
        ids, _ = gather(self.flat, self.starts[index], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        text_ends = ends[np.cumsum(sizes, dtype=np.int64)] if sizes else np.zeros(0, dtype=np.int64)
        if eos:
            ids = np.insert(ids, text_ends, self.eos)
            text_ends = text_ends + np.arange(1, len(sizes) + 1)
        return ids, np.concatenate([[0], text_ends]).astype(np.int64)

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = self.raw_length[ids].copy()
        begins = self.raw_start[ids].copy()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):  # the space put before the text
            while a < b and self.silent[ids[a]]:
                a += 1
            if a < b and self.starts_with_space[ids[a]]:
                begins[a] += 1
                lengths[a] -= 1
        flat, _ = gather(self.raw, begins, lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        body = flat.tobytes()
        return [repaired(body[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def spaced(words: list[str]) -> list[str]:
    """['', '', 'a'] (two spaces before 'a' beyond its own) to ['  a']; trailing ones stay."""
    out, run = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    last = words[-1]
    out.append(" " * run + last)
    return out


def repaired(raw: bytes) -> str:
    """UTF-8, with U+FFFD for every byte that is no part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            try:
                out.append(raw[i : i + n].decode())
                i += n
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat one after another."""
    total = int(lengths.sum())
    shift = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)], lengths


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


#: Bytes of text that a worker handles at a time.
STEP = 1 << 19


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids", eos: bool = True, keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """docs (or its columns in keep) with the ids of the text, array<int>; with decoded, also
    the text that these ids decode to, in the same pass."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    outputs = {ids.lower(), (decoded or ids).lower()}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in outputs]
    packed = docs.select(F.struct(*[quoted(c) for c in names], F.lit(0).alias("__tsr")).alias("row"), quoted(text).cast("string").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model_at(model)
        for batch in batches:
            for part in pieces(batch, "__text", STEP):
                flat, offsets = codec.encode(part.column(1).to_pylist(), eos)
                columns = [part.column(0), _lists(flat, offsets)]
                if decoded:
                    columns.append(pa.array(codec.decode(flat, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "decoded"][: len(columns)])

    fields = [packed.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), True), True), T.StructField("decoded", T.StringType(), True)]
    out = packed.mapInArrow(encode, T.StructType(fields if decoded else fields[:2]))
    return out.select("row.*", F.col("ids").alias(ids), *([F.col("decoded").alias(decoded)] if decoded else [])).drop("__tsr")


def decode_ids(encoded: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the decoded text; null ids decode to null."""
    ship(encoded.sparkSession)
    small_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c.lower() != out.lower()]
    packed = encoded.select(F.struct(*[quoted(c) for c in names]).alias("row"), F.filter(quoted(ids), lambda x: x.isNotNull()).alias("__ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model_at(model)
        for batch in batches:
            step = max(1, batch.num_rows * STEP // max(1, len(batch.column(1).flatten())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                lengths = np.array([x or 0 for x in lists.value_lengths().to_pylist()], dtype=np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = codec.decode(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
                texts = [t if valid else None for t, valid in zip(texts, lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    schema = T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType(), True)])
    return packed.mapInArrow(decode, schema).select("row.*", F.col("decoded").alias(out))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    model = default_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode_texts(docs, model, keep=["doc_id"], decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
