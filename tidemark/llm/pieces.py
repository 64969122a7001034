"""SentencePiece BPE encoding and decoding with merges done in vectorised rounds.

A text becomes words that no piece of the vocabulary can span. The distinct words of a batch lie in flat numpy arrays of
symbols; every round finds the best pair of each word by a segmented minimum, merges all its leftmost occurrences at
once, compacts the arrays, and sets aside the words without any pair. A word in which merging at once could change the
order of merges (a new pair that is at least as good as the one merged) goes through an agenda of single merges instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.text import plain_names

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Bytes of text that one vectorised pass takes, and distinct words kept between passes.
PASS_CHARS, KEPT_WORDS = 500_000, 150_000


class PieceModel:
    """Vocabulary and pair ranks of a BPE model with byte fallback and without normalisation rules."""

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        if reader.encode("a  b ", out_type=str)[0][:1] != SPACE or reader.normalize("ﬁ Ω  ") != f"{SPACE}ﬁ{SPACE}Ω{SPACE}{SPACE}":
            raise ValueError("the model has normalisation rules that this encoder does not know")
        size = reader.vocab_size()
        pieces = [reader.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
        self.byte_ids = np.array([reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {pieces[i]: i for i in plain}
        # Symbols: ids of pieces, then characters that occur in pieces but are none; -1 is any other character.
        self.size = size
        symbols = dict(ids)
        for piece in list(ids):
            for char in piece:
                symbols.setdefault(char, size + len(symbols))
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.char_symbol[ord(text)] = symbol
        self.base = max(symbols.values()) + 1
        order = {score: rank for rank, score in enumerate(sorted({reader.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[reader.get_score(i)], i)
        self.pairs = pairs
        self.tables = _hash_tables(pairs)
        # Cuts that no piece spans: before a space that follows something else, and around characters found in no
        # longer piece.
        inner = {char for piece in ids if len(piece) > 1 for char in piece}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in inner))
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in ids):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        surface = []
        for i, piece in enumerate(pieces):
            if reader.is_byte(i):
                surface.append(bytes([int(piece[3:5], 16)]))
            elif reader.is_control(i):
                surface.append(b"")
            elif reader.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(piece.replace(SPACE, " ").encode())
        self.silent = np.array([reader.is_control(i) for i in range(size)])
        self.spaced = np.array([i in plain_set and pieces[i].startswith(SPACE) for plain_set in [set(plain)] for i in range(size)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the two form no piece) and id of the piece that two symbols form."""
        keys = left.astype(np.int64) * self.base + right
        keys[(left < 0) | (right < 0)] = -1
        ranks, ids = np.full(len(keys), NONE, np.int32), np.zeros(len(keys), np.int32)
        for factor, table_keys, table_ranks, table_ids in self.tables:
            at = _slot(keys, factor, len(table_keys))
            found = np.flatnonzero(table_keys[at] == keys)
            ranks[found], ids[found] = table_ranks[at[found]], table_ids[at[found]]
        return ranks, ids

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and the number of ids of each word."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place, sym = np.arange(len(chars)), self.char_symbol[chars]
        done = []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            new = np.zeros(len(sym), np.int32)
            rank[:-1], new[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NONE
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = best == NONE
            if over.any():
                done.append((owner[over], place[over], sym[over]))
                keep = ~over
                owner, place, sym, rank, new, best = owner[keep], place[keep], sym[keep], rank[keep], new[keep], best[keep]
                if not len(sym):
                    break
            hit = rank == best
            # Of overlapping occurrences every second one is merged, from the left.
            at = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
            hit &= (at - run_start) % 2 == 0
            chosen = np.flatnonzero(hit)
            risky = self._risky(sym, new, owner, hit, chosen, best)
            if len(risky):
                for word in risky:
                    mine = owner == word
                    places, symbols = self._agenda(place[mine], sym[mine])
                    done.append((np.full(len(places), word), places, symbols))
                keep = ~np.isin(owner, risky)
                hit &= keep
                chosen = np.flatnonzero(hit)
            else:
                keep = np.ones(len(sym), bool)
            sym = sym.copy()
            sym[chosen] = new[chosen]
            keep[chosen + 1] = False
            owner, place, sym = owner[keep], place[keep], sym[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        owner, place, sym = owner[order], place[order], sym[order]
        return self._with_bytes(owner, sym, chars[place], len(words))

    def _risky(self, sym, new, owner, hit, chosen, best) -> np.ndarray:
        """Words with several merges at once of which one makes a pair as good as those merged."""
        merged = new[chosen]
        after = np.minimum(chosen + 2, len(sym) - 1)
        right, _ = self.look_up(merged, sym[after])
        right[(chosen + 2 >= len(sym)) | (owner[after] != owner[chosen])] = NONE
        # To the left stands what an earlier merge has made, if there was one.
        before = np.maximum(chosen - 1, 0)
        joined = hit[np.maximum(chosen - 2, 0)] & (chosen >= 2)
        left_symbol = np.where(joined, new[np.maximum(chosen - 2, 0)], sym[before])
        left, _ = self.look_up(left_symbol, merged)
        left[(chosen == 0) | (owner[before] != owner[chosen])] = NONE
        bad = np.minimum(left, right) <= best[chosen]
        if not bad.any():
            return np.zeros(0, np.int64)
        words, counts = np.unique(owner[chosen], return_counts=True)
        return np.intersect1d(np.unique(owner[chosen][bad]), words[counts > 1])

    def _agenda(self, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word by single merges, best pair first and leftmost of equals."""
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def add(a: int, b: int) -> None:
            if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0 and (found := self.pairs.get(sym[a] * self.base + sym[b])):
                heapq.heappush(agenda, (found[0], a, b, sym[a], sym[b]))

        for a in range(n - 1):
            add(a, a + 1)
        gone = [False] * n
        while agenda:
            _, a, b, x, y = heapq.heappop(agenda)
            if gone[a] or gone[b] or sym[a] != x or sym[b] != y or after[a] != b:
                continue
            sym[a] = self.pairs[x * self.base + y][1]
            gone[b] = True
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            add(before[a], a)
            add(a, after[a])
        left = [i for i in range(n) if not gone[i]]
        return places[left], np.array([sym[i] for i in left], symbols.dtype)

    def _with_bytes(self, owner, sym, chars, n_words) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(unknown):
            spelled = [chr(c).encode() for c in chars[unknown].tolist()]
            times = np.ones(len(sym), np.int64)
            times[unknown] = [len(s) for s in spelled]
            wide = np.repeat(sym, times)
            starts = np.cumsum(times) - times
            at = np.repeat(starts[unknown] - np.cumsum(times[unknown]) + times[unknown], times[unknown]) + np.arange(times[unknown].sum())
            wide[at] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            sym, owner = wide, np.repeat(owner, times)
        return sym.astype(np.int32), np.bincount(owner, minlength=n_words)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive stretches of ``ids``."""
        sizes = self.surface_size[ids]
        flat = self.surface[_gather(self.surface_start[ids], sizes)]
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        raw, out, start, first = flat.tobytes(), [], 0, 0
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            at = first
            while at < first + count and self.silent[ids[at]]:
                at += 1
            skip = int(at < first + count and self.spaced[ids[at]])
            out.append(raw[start + skip : end].decode("utf-8", "each_byte"))
            start, first = end, first + count
        return out


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _slot(keys: np.ndarray, factor: int, size: int) -> np.ndarray:
    shift = np.uint64(64 - size.bit_length() + 1)
    return ((keys.astype(np.uint64) * np.uint64(factor)) >> shift).astype(np.int64)


def _hash_tables(pairs: dict[int, tuple[int, int]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of a power of two of slots, each pair alone in a slot of one of them."""
    keys, tables, factor = np.array(sorted(pairs), np.int64), [], 0x9E3779B97F4A7C15
    while len(keys):
        size = 1 << (16 * len(keys)).bit_length()
        factor = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1
        at = _slot(keys, factor, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        table = (np.full(size, -2, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32))
        mine = keys[alone]
        table[0][at[alone]] = mine
        table[1][at[alone]] = [pairs[k][0] for k in mine.tolist()]
        table[2][at[alone]] = [pairs[k][1] for k in mine.tolist()]
        tables.append((factor, *table))
        keys = keys[~alone]
    return tables


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + size), one after the other."""
    shifts = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shifts, sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Encodes texts batch by batch and keeps the words seen so far, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        find = self.model.words.findall
        split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        if new:
            ids, sizes = self.model.merge_words(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids = np.concatenate([self.ids, ids])
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        sizes = self.sizes[codes]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        sums = np.concatenate([[0], np.cumsum(sizes)])[ends] if len(ends) else np.zeros(0, np.int64)
        return self.ids[_gather(self.starts[codes], sizes)], np.diff(np.concatenate([[0], sums]))


def _passes(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about PASS_CHARS in all; a longer text is one of its own."""
    start = held = 0
    for at, length in enumerate(lengths):
        if held and held + length > PASS_CHARS:
            yield start, at
            start, held = at, 0
        held += length
    if start < len(lengths):
        yield start, len(lengths)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


@plain_names
def encode(documents: DataFrame, model: bytes, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``documents`` with the token ids of the text as array<int>; a null or empty text has no ids.

    The texts are encoded whole, without begin or end ids. The model (its bytes, some hundred kB) travels with the tasks.
    """
    kept = [c for c in documents.columns if c.lower() != ids_column.lower()]
    at = [c.lower() for c in kept].index(text_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel(model))
        for batch in batches:
            column = batch.column(at)
            for start, end in _passes(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                ids = _lists(*encoder.encode([t or "" for t in column.slice(start, end - start).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, ids], names=[*kept, ids_column])

    rows = documents.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))]))


@plain_names
def decode(rows: DataFrame, model: bytes, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null or no ids give an empty text, bytes that are no UTF-8 give U+FFFD each."""
    kept = [c for c in rows.columns if c.lower() != text_column.lower()]
    at = [c.lower() for c in kept].index(ids_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import codecs

        codecs.register_error("each_byte", _each_byte)
        decoder = PieceModel(model)
        for batch in batches:
            lists = batch.column(at)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            firsts = np.cumsum(counts) - counts
            for start, end in _passes(counts.tolist()):
                first = int(firsts[start])
                texts = decoder.decode(ids[first : first + int(counts[start:end].sum())], counts[start:end])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, pa.array(texts, pa.string())], names=[*kept, text_column])

    rows = rows.select(*[f"`{c}`" for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_column, T.StringType())]))


@plain_names
def round_trip(documents: DataFrame, model: bytes, text_column: str = "text", ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of what it gave, in one task with one model in memory."""
    dropped = {ids_column.lower(), decoded_column.lower()}
    kept = [c for c in documents.columns if c.lower() not in dropped]
    at = [c.lower() for c in kept].index(text_column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import codecs

        codecs.register_error("each_byte", _each_byte)
        encoder = Encoder(PieceModel(model))
        for batch in batches:
            column = batch.column(at)
            for start, end in _passes(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                ids, counts = encoder.encode([t or "" for t in column.slice(start, end - start).to_pylist()])
                texts = pa.array(encoder.model.decode(ids, counts), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, end - start).columns, _lists(ids, counts), texts], names=[*kept, ids_column, decoded_column]
                )

    rows = documents.select(*[f"`{c}`" for c in kept])
    added = [T.StructField(ids_column, T.ArrayType(T.IntegerType())), T.StructField(decoded_column, T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
