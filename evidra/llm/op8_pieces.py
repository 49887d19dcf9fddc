"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

A word (blanks and what follows up to the next blank) starts as its characters. The agenda holds each pair of
neighbours whose union is a piece; the best score goes first, of equal ones the leftmost. A candidate is
skipped if the keyed hash of (seed, document's id, word's place in the text, place in the word, piece) falls below
``dropout``. So every occurrence of a word is cut by itself, and a run can be repeated exactly. With dropout 0
the ids are those of the library. Characters without a piece become byte pieces.

A skipped candidate that is not among the merges of a run changes nothing in it. So a task keeps the plain run of
each word that it meets again and looks up the hashes of its merges for each occurrence. The first merge that an occurrence skips
leads to the run without it, and so on until a run has none to skip; runs that several occurrences of a batch come to are
kept too. The others go through the agenda by themselves, side by side, one merge for each word and round,
as array operations. Words of more than ``LONG`` characters have an agenda of their own, a heap over linked symbols.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import lean, mix, small_batches

DROPOUT = 0.1
SEED = 17
#: Runs that a task keeps, after which its table is emptied.
RUNS = 250_000
#: Characters that run through the agenda at once, and those of texts that are encoded at once.
BLOCK = 500_000
TEXTS = 2_000_000
#: Longer words have an agenda of their own.
LONG = 160
_NONE = np.int64(1) << np.int64(62)
_64 = (1 << 64) - 1


def _draw(key: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The hash that decides about a candidate: of the occurrence's key, its place in the word, and the piece."""
    return mix(key + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _draw_one(key: int, at: int, piece: int) -> int:
    x = (key + at * 0x9E3779B97F4A7C15 + piece * 0xD1B54A32D192ED03) & _64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _64
    return x ^ (x >> 31)


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Rows:
    """Arrays of several numbers a row, one after the other, that grow."""

    def __init__(self, *types):
        self.data = [np.empty(1 << 16, t) for t in types]
        self._starts, self.n = np.zeros(1 << 14, np.int32), 0

    @property
    def starts(self) -> np.ndarray:
        """Where each row starts, and the end."""
        return self._starts[: self.n + 1]

    def add(self, lengths: np.ndarray, *columns: np.ndarray) -> None:
        a = int(self._starts[self.n])
        b, n = a + len(columns[0]), self.n + len(lengths)
        while b > len(self.data[0]):
            self.data = [np.concatenate([x, np.empty_like(x)]) for x in self.data]
        while n >= len(self._starts):
            self._starts = np.concatenate([self._starts, np.empty_like(self._starts)])
        for x, c in zip(self.data, columns):
            x[a:b] = c
        self._starts[self.n + 1 : n + 1] = a + np.cumsum(lengths)
        self.n = n


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, runs: int = RUNS, block: int = BLOCK):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        self.table: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.table.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.table.append(b"")
            else:
                p = p.replace("▁", " ")
                pieces[p] = i
                self.table.append(p.encode())
        self.chars = np.full(0x110000, -1, np.int32)
        keys, made = [], []
        for p, i in pieces.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made, self.n = np.array(keys, np.int64)[order], np.array(made, np.int64)[order], n
        by_score = np.argsort([-sp.get_score(i) for i in range(n)], kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[by_score] = np.arange(n)
        self.piece_of = by_score.astype(np.int64)
        self.least = min(_64, int(dropout * (1 << 64)))
        self.dropout, self.seed, self.runs, self.block = dropout, seed, runs, block
        self.pairs = dict(zip(self.keys.tolist(), self.made.tolist()))
        self._empty()

    def _empty(self) -> None:
        #: The plain run of each word; of each run its word, what it skips (place, piece), its merges (place, piece)
        #: and its ids; and the run that follows if a run's j-th merge is skipped, by run << 8 | j.
        self.known: dict[str, int] = {}
        self.seen: set[str] = set()  # words met once
        self.word_of: list[str] = []
        self.skips: list[tuple] = []
        self.merges, self.results = _Rows(np.int32, np.int32), _Rows("<u4")
        self.next: dict[int, int] = {}

    def _candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, word: np.ndarray, same: np.ndarray, keys: np.ndarray | None, gone: np.ndarray | None) -> np.ndarray:
        """Agenda entries of pairs; none for those that make no piece or are skipped."""
        out = np.full(len(left), _NONE)
        some = np.flatnonzero(same & (left >= 0) & (right >= 0))
        pair = left[some] * self.n + right[some]
        to = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ok = self.keys[to] == pair
        some, made = some[ok], self.made[to[ok]]
        if keys is not None:
            stay = _draw(keys[word[some]], at[some], made) >= np.uint64(self.least)
            some, made = some[stay], made[stay]
        if gone is not None and len(gone):
            code = word[some] << 40 | at[some] << 20 | made
            stay = gone[np.minimum(np.searchsorted(gone, code), len(gone) - 1)] != code
            some, made = some[stay], made[stay]
        out[some] = self.rank[made] << 20 | at[some]
        return out

    def _ids(self, first: np.ndarray, ids: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From symbols (first character, piece or -1) in order: the ids, with bytes for characters without a
        piece, and how many each word has."""
        out = ids.astype("<u4")
        ends = np.searchsorted(first, np.cumsum(lengths))
        none = ids < 0
        if none.any():
            c = points[first[none]]
            raw = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            sizes = np.ones(len(ids), np.int64)
            sizes[none] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            spread = np.repeat(none, sizes)
            out = np.empty(len(spread), "<u4")
            out[spread], out[~spread] = self.byte_ids[raw], ids[~none]
            ends = np.append(0, np.cumsum(sizes))[ends]
        return out, np.diff(ends, prepend=0)

    def _block(self, words: list[str], keys: np.ndarray | None, gone: list[tuple] | None) -> tuple[np.ndarray, np.ndarray, list]:
        """Ids of words, how many each has, and the merges (word, place, piece) of each round. What a word skips follows from
        its key, or is named in ``gone``."""
        if gone is not None:
            gone = np.sort(np.array([i << 40 | at << 20 | made for i, g in enumerate(gone) for at, made in g], np.int64))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        at = _within(np.zeros(len(words), np.int64), lengths)
        ids = self.chars[points].astype(np.int64)
        first = np.arange(len(points))  # the character that each symbol starts with
        done: list[tuple[np.ndarray, np.ndarray]] = []
        merges = []
        agenda = np.full(len(ids), _NONE)  # of the pair of each symbol and the next: rank, then place
        todo = np.arange(len(ids) - 1)
        while len(ids):
            w = word[todo]
            agenda[todo] = self._candidates(ids[todo], ids[todo + 1], at[todo], w, w == word[todo + 1], keys, gone)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(agenda, heads)
            best = np.repeat(best, np.diff(np.append(heads, len(ids))))
            active = best < _NONE
            if not active.all():
                done.append((first[~active], ids[~active]))
            where = np.flatnonzero(active & (agenda == best))
            ids[where] = self.piece_of[agenda[where] >> 20]
            if keys is None:
                merges.append((word[where], at[where], ids[where]))
            keep = active
            keep[where + 1] = False
            moved = np.cumsum(keep) - 1
            ids, word, at, first, agenda = ids[keep], word[keep], at[keep], first[keep], agenda[keep]
            where = moved[where]
            agenda[where] = _NONE
            todo = np.concatenate([where, where[where > 0] - 1])
            todo = todo[todo < len(ids) - 1]
        first, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(first, kind="stable")
        return *self._ids(first[order], ids[order], points, lengths), merges

    def _blocks(self, words: list[str], keys: np.ndarray | None = None, gone: list[tuple] | None = None):
        """``_block`` over parts of about BLOCK characters: (first word, result)."""
        a = size = 0
        for i, w in enumerate(words, 1):
            size += len(w)
            if size >= self.block or i == len(words):
                yield a, self._block(words[a:i], None if keys is None else keys[a:i], None if gone is None else gone[a:i])
                a, size = i, 0

    def _heap(self, word: str, key: int) -> np.ndarray:
        """The ids of one long word."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, ids = len(points), self.chars[points].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, rank, piece, size, least = self.pairs, self.rank.tolist(), self.piece_of.tolist(), self.n, self.least
        agenda = [-1] * n  # the entry of each symbol and the next
        heap: list[int] = []

        def look(a: int) -> int:
            b = after[a]
            made = pairs.get(ids[a] * size + ids[b]) if b < n and ids[a] >= 0 and ids[b] >= 0 else None
            return -1 if made is None or (least and _draw_one(key, a, made) < least) else rank[made] << 40 | a

        for a in range(n):
            agenda[a] = look(a)
        heap = [e for e in agenda if e >= 0]
        heapq.heapify(heap)
        while heap:
            e = heapq.heappop(heap)
            a = e & ((1 << 40) - 1)
            if agenda[a] != e:
                continue
            b = after[a]
            ids[a], ids[b], agenda[b] = piece[e >> 40], None, -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            for x in (a, before[a]):
                if x >= 0:
                    agenda[x] = look(x)
                    if agenda[x] >= 0:
                        heapq.heappush(heap, agenda[x])
        first = [i for i, x in enumerate(ids) if x is not None]
        return self._ids(np.array(first, np.int64), np.array([ids[i] for i in first], np.int64), points, np.array([n]))[0]

    def _learn(self, words: list[str], skips: list[tuple]) -> None:
        """Keep the runs of words that skip just these candidates."""
        for _, (ids, n, merges) in self._blocks(words, gone=skips):
            word, at, piece = (np.concatenate(x) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
            order = np.argsort(word, kind="stable")
            self.merges.add(np.bincount(word, minlength=len(n)), at[order], piece[order])
            self.results.add(n, ids)
        self.word_of += words
        self.skips += skips

    def _runs(self, run: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The run that each occurrence comes to from its plain run; -1 if it is not kept."""
        out, todo = run.copy(), np.arange(len(run))
        while len(todo):
            starts = self.merges.starts
            now = out[todo]
            n = starts[now + 1] - starts[now]
            some = _within(starts[now], n)
            skipped = np.flatnonzero(_draw(np.repeat(key[todo], n), self.merges.data[0][some], self.merges.data[1][some]) < np.uint64(self.least))
            owner = np.repeat(np.arange(len(todo)), n)[skipped]
            first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
            owner, skipped = owner[first], skipped[first]
            edge = now[owner] << 8 | skipped - (np.cumsum(n) - n)[owner]
            edges, of, times = np.unique(edge, return_inverse=True, return_counts=True)
            to = np.array([self.next.get(e, -1) for e in edges.tolist()], np.int64)
            if len(self.word_of) < self.runs:
                new = edges[(to < 0) & (times > 1)].tolist()
                made = [(e, int(starts[e >> 8]) + (e & 255)) for e in new]
                skips = [(*self.skips[e >> 8], (int(self.merges.data[0][m]), int(self.merges.data[1][m]))) for e, m in made]
                at = len(self.word_of)
                self._learn([self.word_of[e >> 8] for e in new], skips)
                self.next.update(zip(new, range(at, at + len(new))))
                to[(to < 0) & (times > 1)] = np.arange(at, at + len(new))
            todo = todo[owner]
            out[todo] = to[of]
            todo = todo[to[of] >= 0]
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """Words with the blanks before them; one blank is put before the text."""
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts:
            return [" " + p for p in parts]
        out, blanks = [], 0
        for p in parts:
            blanks += 1
            if p:
                out.append(" " * blanks + p)
                blanks = 0
        return out + ([" " * blanks] if blanks else [])

    def occurrences(self, ids: list, counts: list[int]) -> np.ndarray:
        """The key of each occurrence: of the seed, its document's id, and its place among the words."""
        docs = np.fromiter((xxhash.xxh64_intdigest(str(i), self.seed) for i in ids), np.uint64, len(ids))
        n = np.array(counts, np.int64)
        return mix(np.repeat(docs, n) + _within(np.zeros(len(n), np.int64), n).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def encode(self, texts: list[str], doc_ids: list) -> tuple[list[bytes], list[int]]:
        """For each text its ids as little-endian 32-bit integers (an empty one has none), and how many words it has."""
        cut = [self.words(t) for t in texts]
        counts = list(map(len, cut))
        flat = list(chain.from_iterable(cut))
        if len(self.word_of) > self.runs:
            self._empty()
        if len(self.seen) > self.runs:
            self.seen.clear()
        times = Counter(flat)
        new = [w for w in times.keys() - self.known.keys() if len(w) <= LONG and (times[w] > 1 or w in self.seen)]
        self.known.update(zip(new, range(len(self.word_of), len(self.word_of) + len(new))))
        self._learn(new, [()] * len(new))
        once = times.keys() - self.known.keys()
        self.seen.update(w for w in once if len(w) <= LONG)
        self.known.update(dict.fromkeys(once, -1))
        plain = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for w in once:
            del self.known[w]
        short, key = np.flatnonzero(plain >= 0), self.occurrences(doc_ids, counts)
        run = plain.copy()
        if self.dropout:
            run[short] = self._runs(plain[short], key[short])
        starts, out_n = self.results.starts, np.zeros(len(flat), np.int64)
        kept, again = np.flatnonzero(run >= 0), np.flatnonzero(run < 0)
        large = np.fromiter((len(flat[i]) > LONG for i in again), bool, len(again))
        again, long = again[~large], again[large]
        out_n[kept] = starts[run[kept] + 1] - starts[run[kept]]
        parts = [self._heap(flat[i], int(key[i])) for i in long]
        out_n[long] = list(map(len, parts))
        blocks = [r for _, r in self._blocks([flat[i] for i in again], keys=key[again])]
        if blocks:
            out_n[again] = np.concatenate([r[1] for r in blocks])
        at = np.cumsum(out_n) - out_n
        ids = np.empty(int(out_n.sum()), "<u4")
        ids[_within(at[kept], out_n[kept])] = self.results.data[0][_within(starts[run[kept]], out_n[kept])]
        if blocks:
            ids[_within(at[again], out_n[again])] = np.concatenate([r[0] for r in blocks])
        for i, x in zip(long, parts):
            ids[at[i] : at[i] + len(x)] = x
        data, ends = ids.tobytes(), np.append(0, np.cumsum(counts)).astype(np.int64)
        edges = (4 * np.append(at, len(ids))[ends]).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])], counts

    def decode(self, ids: bytes) -> str:
        """The text of its ids, whatever the segmentation."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "replace")


_open: dict[tuple, Pieces] = {}


def pieces(path: str, dropout: float = DROPOUT, seed: int = SEED, runs: int = RUNS, block: int = BLOCK) -> Pieces:
    key = (path, dropout, seed, runs, block)
    if key not in _open:
        _open[key] = Pieces(*key)
    return _open[key]


def _sliced(batches, size: int):
    """Batches in parts of about ``size`` bytes of text; a longer text is a part of its own."""
    for b in batches:
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
        while a < b.num_rows:
            k = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield b.slice(a, k - a)
            a = k


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = False, chars: int = TEXTS, runs: int = RUNS) -> DataFrame:
    """``doc_id, n_words, n_tokens, ids_crc32, decoded_crc32, lossless`` and, if asked for, ``ids`` (32-bit
    little-endian).

    ``n_words``: runs of other characters than blanks, and blanks that end a text. ``lossless``: decoding the ids gives
    the text again. A null text is empty and has no ids. Rows that repeat an id, or have none, are encoded each; if
    they repeat the text too, their ids are equal. Words of any length are encoded whole. Other columns are
    ignored; an empty table gives an empty result. ``chars`` of texts are encoded at once, and a task keeps ``runs`` runs: they
    bear on memory and time only.
    """
    fields = [("n_words", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("lossless", pa.bool_()), *([("ids", pa.binary())] if with_ids else [])]
    schema = pa.schema(fields)

    def run(batches):
        coder = pieces(model, dropout, seed, runs, min(BLOCK, chars // 3))
        held, size = [], 0
        for b in chain(_sliced(batches, chars), [None]):  # a part of a batch, or several, about ``chars`` bytes at once
            if b is not None and b.num_rows:
                held.append(b)
                size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0  # a part's own bytes
            if held and (b is None or size >= chars):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                names, some = whole.column(0), [t or "" for t in whole.column(1).to_pylist()]
                held, size = [], 0
                ids, n_words = coder.encode(some, names.to_pylist())
                back = [coder.decode(x) for x in ids]
                columns = (n_words, [len(x) // 4 for x in ids], map(zlib.crc32, ids), (zlib.crc32(t.encode()) for t in back), (x == t for x, t in zip(back, some)), ids)
                yield pa.RecordBatch.from_arrays([names, *(pa.array(list(c), f.type) for c, f in zip(columns, schema))], names=["id", *schema.names])
        coder._empty()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lean(run), f"id {kind}, n_words bigint, n_tokens bigint, ids_crc32 bigint, decoded_crc32 bigint, lossless boolean" + (", ids binary" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """``encode_pieces`` with the model of 32,000 pieces over all documents; rows as its docstring says."""
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
