"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut into words at runs of the space mark (no piece goes on after a space mark inside it, which is
checked when the model is loaded) and around line feeds if no longer piece holds one.  Words not met before are
merged together: one flat numpy array holds the symbols of all of them; each round finds the best pair rank of
every word by a segmented minimum, merges that pair's leftmost non-overlapping places at once, and compacts the
array; words without a pair left drop out.  Where a merge makes a pair that ranks as well or better, later places
might have to wait for it: such a word merges only its leftmost place in that round, which keeps the result that
of the sequential algorithm.  Words of over ``LONG_WORD`` symbols go through the same rounds one by one, over linked
symbols: a round then costs as much as the places of its rank, not as the word.

A worker keeps the ids of words met before, of ``CACHE_WORD`` characters at most and ``CACHE_BYTES`` in all.

Defined results: a null or empty text has no ids and decodes to the empty text; any code point without a piece
becomes its UTF-8 bytes; repeated rows repeat their result; an empty table gives an empty result; other columns
are carried through, and one of the name of an output column is replaced.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, batch_chunks, chunks, gather_spans, lean, list_array, read

SPACE = "▁"
LONG_WORD = 4096
CACHE_WORD = 64
CACHE_BYTES = 64 << 20
#: What Python keeps for a word besides its characters, about.
WORD_BYTES = 160
NO_RANK = np.iinfo(np.int64).max


@dataclass
class PieceModel:
    """Tables of a model; symbols are the pieces' ids, and from ``n_pieces`` on characters that are no piece."""

    n_pieces: int
    surfaces: list  # bytes that a piece decodes to; None for a byte piece
    byte_ids: np.ndarray  # id of the piece of each byte
    chars: np.ndarray  # sorted code points that occur in pieces
    char_symbols: np.ndarray
    extra: dict  # symbol -> code point of those that are no piece
    pair_keys: np.ndarray  # sorted left * base + right
    pair_ranks: np.ndarray
    pair_symbols: np.ndarray
    base: int
    split_newline: bool
    table: tuple | None = None  # of the pairs, made at first use

    @property
    def pattern(self) -> re.Pattern:
        return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+") if self.split_newline else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load_model(path: str) -> PieceModel:
    """Read a BPE model with byte fallback, an identity normaliser and a dummy prefix."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ids, surfaces, byte_ids = {}, [], np.zeros(256, np.int32)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surfaces.append(None)
        elif sp.is_control(i):
            surfaces.append(b"")
        elif sp.is_unknown(i):
            surfaces.append(" ⁇ ".encode())
        else:
            ids[piece] = i
            surfaces.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece goes on after a space mark: words can't be merged apart")
    points = sorted({ord(c) for p in ids for c in p})
    symbols, extra = [], {}
    for c in points:
        if chr(c) not in ids:
            extra[n + len(extra)] = c
        symbols.append(ids.get(chr(c), n + len(extra) - 1))
    char_of = dict(zip(map(chr, points), symbols))
    base = 1 << 22  # over all symbols, unknown characters included
    symbol = lambda p: ids[p] if p in ids else char_of.get(p) if len(p) == 1 else None
    order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for p, i in ids.items() if len(p) > 1}))}
    keys, ranks, merged = [], [], []
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = symbol(p[:k]), symbol(p[k:])
            if a is not None and b is not None:
                keys.append(a * base + b)
                ranks.append(order[-sp.get_score(i)])
                merged.append(i)
    at = np.argsort(keys)
    take = lambda x: np.asarray(x, np.int64)[at]
    newline = not any("\n" in p for p in ids if len(p) > 1)
    return PieceModel(n, surfaces, byte_ids, np.array(points, np.int64), np.array(symbols, np.int64), extra, take(keys), take(ranks), take(merged), base, newline)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Open addressing with linear probing: (slot -> key or -1, slot -> place in ``keys``, shift of the hash)."""
    bits = max(4, int(len(keys) * 4).bit_length())
    shift = np.uint64(64 - bits)
    slots, places = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
    todo = np.arange(len(keys))
    at = ((keys.astype(np.uint64) * _SPREAD) >> shift).astype(np.int64)
    while len(todo):
        free = slots[at] == -1
        _, first = np.unique(at[free], return_index=True)
        win = np.flatnonzero(free)[first]
        slots[at[win]], places[at[win]] = keys[todo[win]], todo[win]
        left = np.ones(len(todo), bool)
        left[win] = False
        todo, at = todo[left], (at[left] + 1) & ((1 << bits) - 1)
    return slots, places, shift


def _pairs(model: PieceModel, left: np.ndarray, right: np.ndarray):
    """(rank, merged symbol) of pairs of symbols; no rank where they are no pair."""
    if model.table is None:
        model.table = _hash_table(model.pair_keys)
    slots, places, shift = model.table
    key = left * model.base + right
    at = ((key.astype(np.uint64) * _SPREAD) >> shift).astype(np.int64)
    rank, made = np.full(len(key), NO_RANK), np.zeros(len(key), np.int64)
    todo = None
    while True:
        seen = slots[at]
        same = seen == key
        hit = np.flatnonzero(same)
        where = hit if todo is None else todo[hit]
        place = places[at[hit]]
        rank[where], made[where] = model.pair_ranks[place], model.pair_symbols[place]
        go = np.flatnonzero(~same & (seen != -1))
        if not len(go):
            return rank, made
        todo = go if todo is None else todo[go]
        key, at = key[go], (at[go] + 1) & (len(slots) - 1)


def merge_long(model: PieceModel, sym: np.ndarray) -> np.ndarray:
    """Merge rounds on one long word: as in ``merge_words``, but a round looks only at the places of the least pair rank.

    Symbols stay where they are, linked to their neighbours; the places of every rank wait in a list of arrays, and a
    merge adds the places of the pairs that it makes.
    """
    n = len(sym)
    sym, alive = np.append(sym, -1), np.append(np.ones(n, bool), False)
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    waiting: dict[int, list] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[(places >= 0) & (nxt[places] < n)]
        if not len(places):
            return
        rank, _ = _pairs(model, sym[places], sym[nxt[places]])
        places, rank = places[rank < NO_RANK], rank[rank < NO_RANK]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
        for r, part in zip(rank[cuts].tolist() if len(rank) else [], np.split(places, cuts[1:]) if len(rank) else []):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(part)

    wait(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        places = np.unique(np.concatenate(waiting.pop(r)))
        places = places[alive[places] & (nxt[places] < n)]
        rank, made = _pairs(model, sym[places], sym[nxt[places]])
        places, made = places[rank == r], made[rank == r]
        if not len(places):
            continue
        run = np.concatenate([[True], nxt[places[:-1]] != places[1:]])
        nth = np.arange(len(places)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        chosen, now = places[nth % 2 == 0], made[nth % 2 == 0]
        behind = nxt[nxt[chosen]]
        # Pairs that a merge makes with its neighbours as they are at that moment: all places to the left done.
        joined = np.concatenate([[False], behind[:-1] == chosen[1:]])
        left = np.where(joined, np.concatenate([[0], now[:-1]]), sym[np.maximum(prv[chosen], 0)])
        bad = (prv[chosen] >= 0) & (_pairs(model, left, now)[0] <= r) | (behind < n) & (_pairs(model, now, sym[np.minimum(behind, n)])[0] <= r)
        if bad.any() and len(places) > 1:
            wait(places[1:])
            chosen, now, behind = chosen[:1], now[:1], behind[:1]
        gone = nxt[chosen]
        alive[gone] = False
        sym[chosen] = now
        nxt[chosen] = behind
        prv[behind] = chosen
        wait(np.unique(np.concatenate([prv[chosen], chosen])))
    return sym[:n][alive[:n]]


def merge_words(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, offsets) in merge rounds."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(model.chars, points), len(model.chars) - 1)
    known = model.chars[at] == points
    first_unknown = model.n_pieces + len(model.extra)
    sym = np.where(known, model.char_symbols[at], first_unknown + points)
    word = np.repeat(np.arange(len(words)), lengths)
    done_sym, done_word = [], []
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for w in np.flatnonzero(lengths > LONG_WORD):
        got = merge_long(model, sym[starts[w] : starts[w + 1]])
        done_sym.append(got)
        done_word.append(np.full(len(got), w))
    if done_sym:
        keep = lengths[word] <= LONG_WORD
        sym, word = sym[keep], word[keep]
    while len(sym):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.concatenate([begins, [len(sym)]]))
        rank = np.full(len(sym), NO_RANK)
        made = np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = _pairs(model, sym[:-1], sym[1:])
        rank[begins + size - 1] = NO_RANK
        best = np.minimum.reduceat(rank, begins)
        over = best == NO_RANK
        if over.any():
            out = np.repeat(over, size)
            done_sym.append(sym[out])
            done_word.append(word[out])
            sym, word, rank, made = sym[~out], word[~out], rank[~out], made[~out]
            if not len(sym):
                break
            best, size = best[~over], size[~over]
        limit = np.repeat(best, size)
        wanted = np.flatnonzero(rank == limit)
        run = np.concatenate([[True], np.diff(wanted) != 1])
        nth = np.arange(len(wanted)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        chosen = wanted[nth % 2 == 0]
        # Pairs that a merge makes with its neighbours as they are at that moment: all places to the left done.
        now, r = made[chosen], limit[chosen]
        left_ok = (chosen > 0) & (word[np.maximum(chosen - 1, 0)] == word[chosen])
        joined = np.concatenate([[False], np.diff(chosen) == 2])
        left = np.where(joined, np.concatenate([[0], now[:-1]]), sym[np.maximum(chosen - 1, 0)])
        nxt = np.minimum(chosen + 2, len(sym) - 1)
        right_ok = (chosen + 2 < len(sym)) & (word[nxt] == word[chosen])
        bad = (left_ok & (_pairs(model, left, now)[0] <= r)) | (right_ok & (_pairs(model, now, sym[nxt])[0] <= r))
        if bad.any():
            unsafe = np.zeros(len(words), bool)
            unsafe[word[chosen[bad]]] = True
            leader = np.concatenate([[True], word[chosen[1:]] != word[chosen[:-1]]])
            chosen = chosen[leader | ~unsafe[word[chosen]]]
        sym = sym.copy()
        sym[chosen] = made[chosen]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        sym, word = sym[keep], word[keep]
    sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    odd = np.flatnonzero(sym >= model.n_pieces)
    if len(odd):
        width = np.ones(len(sym), np.int64)
        raw = [chr(model.extra.get(s, s - first_unknown)).encode("utf-8", "surrogatepass") for s in sym[odd].tolist()]
        width[odd] = [len(b) for b in raw]
        place = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(sym, width)
        out[gather_spans(place[odd], width[odd])] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        sym, word = out, np.repeat(word, width)
    return sym.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


class Encoder:
    """Encodes texts; keeps the ids of words met before, cleared when there are too many."""

    def __init__(self, model: PieceModel):
        self.model, self.pattern = model, model.pattern
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        if self.held > CACHE_BYTES:
            self.clear()
        split = [self.pattern.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.known)) if split else []
        if fresh:
            fresh.sort(key=len)
            flat, at = merge_words(self.model, fresh)
            n = len(self.known)
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            self.start = np.concatenate([self.start, at[:-1] + len(self.flat)])
            self.length = np.concatenate([self.length, np.diff(at)])
            self.flat = np.concatenate([self.flat, flat])
            self.held += sum(map(len, fresh)) + WORD_BYTES * len(fresh) + 4 * len(flat)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.known.__getitem__
        index = np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.length[index]
        ids = self.flat[gather_spans(self.start[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if fresh and len(fresh[-1]) > CACHE_WORD:
            self._forget(fresh, at)
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _forget(self, fresh: list[str], at: np.ndarray) -> None:
        """Drops the long ones of the words merged last, which are sorted by length."""
        short = bisect_right(fresh, CACHE_WORD, key=len)
        for w in fresh[short:]:
            del self.known[w]
        kept = len(self.flat) - int(at[-1] - at[short])
        self.held -= sum(map(len, fresh[short:])) + WORD_BYTES * (len(fresh) - short) + 4 * (len(self.flat) - kept)
        n = len(self.start) - (len(fresh) - short)
        self.flat, self.start, self.length = self.flat[:kept].copy(), self.start[:n], self.length[:n]


class Decoder:
    """Decodes ids; bytes that are no UTF-8 become the replacement character, one each."""

    def __init__(self, model: PieceModel):
        byte_of = {int(i): b for b, i in enumerate(model.byte_ids)}
        raw = [bytes([byte_of[i]]) if s is None else s for i, s in enumerate(model.surfaces)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(b) for b in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.spaced = np.array([s is not None and s[:1] == b" " for s in model.surfaces])

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        length, start = self.length[ids], self.start[ids]
        first = offsets[:-1][np.diff(offsets) > 0]
        first = first[self.spaced[ids[first]]]
        start[first] += 1  # the dummy prefix
        length[first] -= 1
        data = self.bytes[gather_spans(start, length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[offsets]
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        try:
            data.decode()
            return out
        except UnicodeDecodeError:
            return [b.decode("utf-8", "piece_bytes").encode() for b in out]


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


import codecs  # noqa: E402

codecs.register_error("piece_bytes", _each_byte)

_ENCODERS: dict[str, Encoder] = {}


def _encoder(model_path: str, shared) -> Encoder:
    """A worker's encoder, with the words that it knows from earlier tasks."""
    if model_path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model_path] = Encoder(shared.value)
    return _ENCODERS[model_path]


def _put(batch: pa.RecordBatch, name: str, column: pa.Array, drop: tuple = ()) -> pa.RecordBatch:
    kept = [f for f in batch.schema.names if f != name and f not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f)) for f in kept), column], [*kept, name])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ``ids``: array of piece ids."""
    spark = docs.sparkSession
    docs = docs.drop(ids)
    shared = spark.sparkContext.broadcast(load_model(model_path))  # a vocabulary file: of fixed size

    def run(batches):
        encoder = _encoder(model_path, shared)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b, _, _ in batch_chunks(batch, text):
                flat, at = encoder(column.slice(a, b - a).fill_null("").to_pylist())
                yield _put(batch.slice(a, b - a), ids, list_array(flat, at))

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column ``decoded``: the text of the ids; null ids give the empty text."""
    spark = encoded.sparkSession
    encoded = encoded.drop(text)
    shared = spark.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            for a, b in chunks(sizes, CHUNK_BYTES // 4):
                part = column.slice(a, b - a)
                at = sizes[a : b + 1] - sizes[a]
                out = decoder(np.asarray(part.flatten()).astype(np.int64), at)
                yield _put(batch.slice(a, b - a), text, pa.array([x.decode() for x in out], pa.string()))

    return encoded.mapInArrow(lean(run), T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the batches: columns ``ids`` and ``decoded`` instead of ``text``."""
    docs = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        encoder = _encoder(model_path, shared)
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b, _, _ in batch_chunks(batch, text):
                flat, at = encoder(column.slice(a, b - a).fill_null("").to_pylist())
                out = _put(batch.slice(a, b - a), "ids", list_array(flat, at), (text,))
                yield _put(out, "decoded", pa.array([x.decode() for x in decoder(flat.astype(np.int64), at)], pa.string()))

    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(lean(run), T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or default_model()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode(docs, path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
