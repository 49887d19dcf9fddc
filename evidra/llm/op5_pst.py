"""Language-model scores by a probabilistic suffix tree over words.

A text is its lower-cased words (between ASCII white space) and one end symbol. The tree's states are contexts of 0 to
``depth`` words; a text begins with one start symbol. A context is a state if it occurs ``LEAST`` times or more in the
training texts and its next-symbol distribution diverges from that of its suffix by the G test (2 N KL >=
``DIVERGENCE``). The root is the add-one unigram over the training tokens, in which all unknown words are one symbol. A
state's distribution is smoothed with that of its longest proper suffix that is a state, by absolute discounting: (max(n - D,
0) + D T p_suffix) / N for a symbol seen n times after it, T different symbols and N in all. A token is scored by the longest
state that ends its context.

How it runs. Documents are packed into chunks of about ``CHUNK_BYTES``, one row each, as numbers of their words. No context or symbol
is a group of its own, so a common one is no hot spot: a chunk sends its distinct words and grams (a context and the
symbol after it), as sorted hashes with their training counts, to buckets by hash range, one entry for each chunk; a bucket
adds up and answers each chunk with the corpus counts of its own grams, in its own order. It goes level by level: a context of d words can
be a state only if it occurs ``LEAST`` times and less often than its suffix, which the counts of the level before tell, so longer grams are sent for such contexts
alone. Chunks are dealt out once, and each round's answers come to where they are. Of the chunks that train on a gram one owns it. Knowing all counts of its grams, and of their suffixes, the owner adds the gram's term to its context's
divergence; a last round sums these by context and answers with what is a state. Then each chunk scores its documents. The
model is never in one place: nothing but three totals passes through the driver. Buckets hold what about ``BUCKET_BYTES`` of text
send; a chunk's entry for a bucket gets smaller as there are more of them, so both sizes should be raised beyond a terabyte or so.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, drop, groups, mix, partitions

#: Words of a context at most.
DEPTH = 5
DIVERGENCE = 12.0
LEAST = 2
DISCOUNT = 0.75
CHUNK_BYTES = 10_000_000
BUCKET_BYTES = 16_000_000
_START, _END = np.uint64(0x51A7), np.uint64(0xE4D)
#: What the hash of a gram lacks of 64 bits.
_BITS = np.uint64(8)
#: Kinds of rows beside grams, whose kind is their level: words, states (and the level), counts by token (and the level), training
#: documents, totals.
WORDS, STATES, SEEN, DOCS, TOTAL = 0, 100, 200, 1000, 1001


def held_out(doc_id) -> bool:
    """Whether a document is kept from training; a null id trains."""
    return zlib.crc32(str(doc_id).encode() if doc_id is not None and doc_id == doc_id else b"") % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes first."""
    import zstandard

    bits = x.view(f"u{x.itemsize}")
    return zstandard.ZstdCompressor(level=1).compress(b"".join((bits >> bits.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(x.itemsize)))


def _expand(data: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    bits = parts[0].astype(f"u{size}")
    for i in range(1, size):
        if parts[i].any():
            bits |= parts[i].astype(bits.dtype) << bits.dtype.type(8 * i)
    return bits.view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers, as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, np.uint64), dtype=np.uint64)


def _split(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """How many words each text has, the distinct words, and the number of each word in turn; words as ``tokens`` cuts them."""
    n, words, codes, size = [np.zeros(0, np.int32)], [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)], 0
    for a in range(0, len(texts), 500):
        part = pa.array([(t or "").encode("utf-8", "replace") for t in texts[a : a + 500]], pa.large_binary()).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # a text may begin or end with white space
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        n.append(np.diff(np.append(0, np.cumsum(full))[ends]).astype(np.int32))
        coded = flat.filter(pa.array(full, pa.bool_())).cast(pa.large_binary()).dictionary_encode()
        codes.append(coded.indices.to_numpy() + size)
        words.append(coded.dictionary)
        size += len(coded.dictionary)
    once = pa.concat_arrays(words).dictionary_encode()
    return np.concatenate(n), once.dictionary.to_pylist(), once.indices.to_numpy()[np.concatenate(codes)]


def pack(batches, chunk_bytes: int):
    """Rows ``(id, text)`` -> ``(chunk, ids, lengths, words, codes, size)``: tokens of each text, the chunk's distinct word
    hashes, and which of them each token is (the last number for an end)."""
    from pyspark import TaskContext

    first, k = TaskContext.get().partitionId() << 24, 0
    ids, texts, size = [], [], 0
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.string())), ("lengths", pa.binary()), ("words", pa.binary()), ("codes", pa.binary()), ("size", pa.int64())])

    def made():
        n, distinct, codes = _split(texts)
        words, place = np.unique(np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct)), return_inverse=True)
        n += np.int32(1)
        every = np.full(int(n.sum()), len(words), np.uint32)
        inside = np.ones(len(every), bool)
        inside[np.cumsum(n) - 1] = False
        every[inside] = place.astype(np.uint32)[codes]
        row = (first + k, ids, _squeeze(n), _pack_keys(words), _squeeze(every), size)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    for b in batches:
        for a in range(0, b.num_rows, 500):
            part = b.slice(a, 500)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 1
                if size >= chunk_bytes:
                    yield made()
                    ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield made()


def _grams(context: np.ndarray, symbol: np.ndarray, d: int) -> np.ndarray:
    """Hashes of contexts of d words and the symbols after them, in parts that a cache holds."""
    out = np.empty(len(context), np.uint64)
    for a in range(0, len(out), 1 << 14):
        part = context[a : a + (1 << 14)] * np.uint64(0x9E3779B97F4A7C15)
        part += symbol[a : a + (1 << 14)] * np.uint64(0xD1B54A32D192ED03)
        part += np.uint64(d)
        out[a : a + (1 << 14)] = mix(part) >> _BITS
    return out


class Chunk:
    """The tokens of a chunk's documents, one after the other.

    ``word``: the number of each token among ``words``. By level d from 1: ``context[d]``, the hash of the d words before each
    token, ``gram[d]``, that of them and the token, and ``whole[d]``, whether the text reaches back so far.
    """

    def __init__(self, ids, lengths: bytes, words: bytes, codes: bytes, depth: int = DEPTH):
        self.ids = list(ids)
        n = _expand(lengths, np.int32).astype(np.int64)
        self.words, self.word = _unpack_keys(words), _expand(codes, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.train = ~np.array([held_out(i) for i in self.ids], bool)
        self.trains = self.train[self.doc]
        symbol = np.append(self.words, _END)[self.word]
        inner = np.arange(len(symbol)) - np.repeat(np.cumsum(n) - n, n)  # place within the text
        # the context of d words is the gram of d - 1 words and the next, one token before
        context = np.append(_START, symbol[:-1])
        self.first = inner == 0
        context[self.first] = _START
        self.context, self.gram, self.whole = [None], [None], [None]
        for d in range(1, depth + 1):
            self.context.append(context)
            self.gram.append(_grams(context, symbol, d))
            self.whole.append(inner >= d - 1)
            context = np.append(np.uint64(0), self.gram[d][:-1])

    def counts(self, d: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of a level at ``some`` tokens, and how often they occur there in training texts."""
        k = self.gram[d][some] << np.uint64(1)
        k |= self.trains[some]
        k.sort()
        u = k >> np.uint64(1)
        at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        return u[at], np.add.reduceat((k & np.uint64(1)).astype(np.uint32), at, dtype=np.uint32) if len(at) else np.zeros(0, np.uint32)


def _places(keys: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys under the mask, the place of each token's key among them (-1 elsewhere), and a token of each."""
    where = np.flatnonzero(mask)
    k = keys[where]
    order = np.argsort(k)
    k = k[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    out = np.full(len(keys), -1)
    out[where[order]] = np.cumsum(new) - 1
    return k[new], out, where[order[new]]


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where the range of each bucket starts among sorted keys."""
    step = -(-(1 << 32) // buckets)
    return np.searchsorted(keys >> np.uint64(bits - 32), np.arange(buckets + 1, dtype=np.uint64) * np.uint64(step))


def _sent(kind: int, chunk: int, keys: np.ndarray, values: list[np.ndarray], buckets: int, bits: int):
    """Rows ``(kind, bucket, chunk, keys, a, b)`` of sorted keys and up to two arrays of values."""
    cuts = _cuts(keys, buckets, bits)
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
        x, y = cuts[i], cuts[i + 1]
        yield kind, int(i), chunk, _pack_keys(keys[x:y]), *(_squeeze(v[x:y]) for v in values), *[b""] * (2 - len(values))


def _totals(rows: pd.DataFrame, *kinds) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of a bucket's rows: the places of each one's keys among the distinct ones, how many these are, and the sums of their values."""
    keys = [_unpack_keys(x) for x in rows["keys"]]
    every = np.concatenate(keys)
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    del keys
    order = np.argsort(every, kind="stable")  # merges what is sorted already
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    n = int(new.sum())
    del every, order
    return np.split(at, sizes), n, [np.bincount(at, weights=np.concatenate([_expand(x, k) for x in rows[c]]), minlength=n) for c, k in zip("ab", kinds)]


def _answer_counts(rows: pd.DataFrame):
    """First round: for each chunk the counts of its words or grams, twice each and one more where it owns the gram."""
    kind = int(rows["kind"].iloc[0])
    places, size, (n,) = _totals(rows, np.uint32)
    n = n.astype(np.int64)
    free = np.ones(size, bool)
    for chunk, bucket, at, x in zip(rows["chunk"], rows["bucket"], places, rows["a"]):
        own = free[at] & (_expand(x, np.uint32) > 0)
        free[at[own]] = False
        yield kind, int(chunk), int(bucket), 0, 0, _squeeze(2 * n[at] + own)
    if kind == WORDS:
        yield TOTAL, -1, 0, int(n.sum()), int((n > 0).sum()), b""


def _answer_states(rows: pd.DataFrame):
    """Second round: for each chunk, of its contexts, how many different symbols follow them if they are states; else 0."""
    places, _, (t, g) = _totals(rows, np.uint32, np.float32)
    t = np.where(g >= DIVERGENCE, t, 0).astype(np.int64)
    for kind, chunk, bucket, at in zip(rows["kind"], rows["chunk"], rows["bucket"], places):
        yield int(kind), int(chunk), int(bucket), 0, 0, _squeeze(t[at])


class Counts:
    """A chunk with the corpus counts of its words and grams, up to the levels that have been answered.

    By level: ``seen[d]``, how often the token follows its context of d words (0 where that context is too rare for a state), and
    ``all[d]``, how often that context occurs. Levels that an earlier round has worked out come as they are, the last one as answers.
    """

    def __init__(self, chunk: Chunk, answers: pd.DataFrame, docs: int, total: int, levels: int):
        self.chunk = chunk
        self.answers = answers.sort_values("bucket")
        kinds = set(self.answers["kind"])
        self.seen, self.own, self.sample, self.all = [], [], [], [np.full(len(chunk.word), total)]
        for d in range(levels + 1):
            if d:
                before = np.append(0, self.seen[-1][:-1])
                if d == 1:
                    before[chunk.first] = docs
                self.all.append(before)
            own = one = None
            if SEEN + d in kinds:
                seen = _expand(self.answers.loc[self.answers["kind"] == SEEN + d, "a"].iloc[0], np.uint32 if total < 1 << 32 else np.int64).astype(np.int64)
            elif not d:
                seen = np.append(self.get(WORDS) >> 1, docs)[chunk.word]
            else:
                _, at, one = _places(chunk.gram[d], self.asks(d))
                n = self.get(d)
                seen, own = np.where(at >= 0, n[at] >> 1, 0) if len(n) else np.zeros(len(at), np.int64), (n & 1).astype(bool)
                if d > 1:
                    seen = np.where(self.same(d), self.seen[d - 1], seen)
            self.seen.append(seen)
            self.own.append(own)
            self.sample.append(one)
        self.all.append(np.append(0, self.seen[-1][:-1]))

    def asks(self, d: int) -> np.ndarray:
        """The tokens whose grams of a level are sent: all of the first level, then those whose context may be a state. A context that
        occurs as often as its suffix is followed by the same symbols: it diverges by nothing, and counts are those of the suffix."""
        return self.chunk.whole[d] & (self.all[d] >= LEAST) & (self.all[d] != self.all[d - 1]) if d > 1 else self.chunk.whole[d]

    def same(self, d: int) -> np.ndarray:
        """The tokens whose context of a level is frequent and occurs as often as its suffix."""
        return self.chunk.whole[d] & (self.all[d] >= LEAST) & (self.all[d] == self.all[d - 1])

    def get(self, kind: int) -> np.ndarray:
        """The answers of all buckets, in the order of the chunk's own keys."""
        return np.concatenate([np.zeros(0, np.int64), *(_expand(a, np.int64) for a in self.answers.loc[self.answers["kind"] == kind, "a"])])

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of a level that are frequent enough, and the place of each token's among them."""
        may = self.asks(d) & (self.all[d] >= LEAST)
        if d > 1:
            u, at, _ = _places(self.chunk.context[d], may)
            return u, at
        # a context of one word is the word before, or the start, so nothing is sorted but the words
        keys, place = np.unique(np.append(self.chunk.words, _START) >> _BITS, return_inverse=True)
        before = np.append(0, self.chunk.word[:-1])
        before[self.chunk.first] = len(place) - 1
        at = place[before]
        some = np.zeros(len(keys), bool)
        some[at[may]] = True
        return keys[some], np.where(may, (np.cumsum(some) - 1)[at], -1)

    def divergence(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, different symbols, G) of what the grams that this chunk owns add to their contexts."""
        u, at = self.contexts(d)
        some = self.sample[d][self.own[d]]
        some = some[at[some] >= 0]
        n = self.seen[d][some]
        term = 2 * n * np.log(n / self.all[d][some] * self.all[d - 1][some] / self.seen[d - 1][some])
        return u, np.bincount(at[some], minlength=len(u)).astype(np.uint32), np.bincount(at[some], weights=term, minlength=len(u)).astype(np.float32)


def pst_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Trains on documents whose crc32(id) mod 7 is not 2. ``base_score`` is add-one unigram over words and the end,
    ``score`` the tree's log10 probability of the text. Null texts are empty (one token, the end); very long ones are
    taken whole; rows that repeat an id count each; a row with a null id trains. Words are told apart by 64-bit hashes, grams by
    56 bits. ``depth`` bounds the words of a context, the divergence test decides which are states; ``chunk_bytes`` and ``bucket_bytes`` bear
    on memory only. Other columns are ignored. An empty table gives an empty result; with no training rows the root is all there is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    made = cut(rows.mapInArrow(lambda batches: pack(batches, chunk_bytes), "chunk bigint, ids array<string>, lengths binary, words binary, codes binary, size bigint"))
    chunks, size = made.agg(F.count("*"), F.sum("size")).first()
    buckets = max(8, -(-(size or 0) // bucket_bytes))
    tasks = max(partitions(spark), chunks)
    packed = cut(made.drop("size").repartition(tasks, "chunk").sortWithinPartitions("chunk"), dealt=True)
    drop(made)
    fields = "kind int, bucket int, chunk bigint, keys binary, a binary, b binary"
    answer = "kind int, chunk bigint, bucket int, n bigint, v bigint, a binary"
    sent_names, answer_names = ["kind", "bucket", "chunk", "keys", "a", "b"], ["kind", "chunk", "bucket", "n", "v", "a"]
    whole = ["ids", "lengths", "words", "codes"]

    def counted(batches):
        for b in batches:
            for chunk, *parts in zip(b["chunk"], *(b[x] for x in whole)):
                c = Chunk(*parts, 1)
                n = np.bincount(c.word[c.trains], minlength=len(c.words) + 1)[:-1].astype(np.uint32)
                out = [*_sent(WORDS, int(chunk), c.words, [n], buckets, 64), (DOCS, 0, int(chunk), int(c.train.sum()).to_bytes(8, "little"), b"", b"")]
                u, here = c.counts(1, c.whole[1])
                out += _sent(1, int(chunk), u, [here], buckets, 56)
                for a in range(0, len(out), 64):
                    yield pd.DataFrame(out[a : a + 64], columns=sent_names)

    def answered(batches):
        for g in groups(batches, ["kind", "bucket"]):
            kind = g["kind"].iloc[0]
            if SEEN <= kind < DOCS:  # kept for the chunk itself
                got = zip(g["kind"], g["chunk"], g["bucket"], [0] * len(g), [0] * len(g), g["a"])
            elif kind == DOCS:
                got = [(TOTAL, -1, 1, sum(int.from_bytes(x, "little") for x in g["keys"]), 0, b"")]
            else:
                got = (_answer_counts if kind < STATES else _answer_states)(g)
            held = []
            for row in got:
                held.append(row)
                if len(held) == 64:
                    yield pd.DataFrame(held, columns=answer_names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=answer_names)

    def reply(sent: DataFrame, kinds: int) -> DataFrame:
        n = max(partitions(spark), kinds * buckets)
        return cut(sent.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInPandas(answered, answer))

    first = reply(packed.mapInPandas(counted, fields), 2)
    docs_n = words_n = words_v = 0
    for bucket, n, v in first.where(F.col("kind") == TOTAL).groupBy("bucket").agg(F.sum("n"), F.sum("v")).collect():
        if bucket == 1:
            docs_n = n
        else:
            words_n, words_v = n, v
    total_n, total_v = docs_n + words_n, words_v + (docs_n > 0)
    counts = first.where(F.col("kind") < STATES).select("kind", "chunk", "bucket", "a")

    def by_chunk(answers: DataFrame):
        return packed.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))

    def longer(level: int):
        """A round: what the level before adds to divergences, its counts for the rounds to come, and the grams of this level."""

        def grams(key, d: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            number, chunk = int(d["chunk"].iloc[0]), Chunk(*(d[n].iloc[0] for n in whole), min(level, depth))
            c = Counts(chunk, x, docs_n, total_n, level - 1)
            out = [(SEEN + level - 1, number % buckets, number, b"", _squeeze(c.seen[level - 1].astype(np.uint32 if total_n < 1 << 32 else np.int64)), b"")]
            u, t, g = c.divergence(level - 1)
            out += _sent(STATES + level - 1, number, u, [t, g], buckets, 56)
            if level <= depth:
                u, here = chunk.counts(level, c.asks(level))
                out += _sent(level, number, u, [here], buckets, 56)
            return pd.DataFrame(out, columns=sent_names)

        return grams

    words, known = counts.where(F.col("kind") == WORDS), None
    last = counts.where(F.col("kind") != WORDS)
    for level in range(2, depth + 2):
        told = words.union(last) if known is None else words.union(known.where(F.col("kind") >= SEEN)).union(last)
        got = reply(by_chunk(told).applyInPandas(longer(level), fields), 3)
        got = got.select("kind", "chunk", "bucket", "a")
        last = got.where(F.col("kind") < STATES)
        known = got.where(F.col("kind") >= STATES) if known is None else known.union(got.where(F.col("kind") >= STATES))

    def scored(key, d: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(*(d[n].iloc[0] for n in whole), depth)
        c = Counts(chunk, x, docs_n, total_n, depth)
        p = (c.seen[0] + 1) / (total_n + total_v + 1)
        base, known = np.log10(p), c.seen[0] > 0
        for level in range(1, depth + 1):
            _, at = c.contexts(level)
            follow = c.get(STATES + level)
            t = np.where(at >= 0, follow[at], 0) if len(follow) else np.zeros(len(at))
            on = np.flatnonzero(t)
            p[on] = (np.maximum(c.seen[level][on] - DISCOUNT, 0) + DISCOUNT * t[on] * p[on]) / c.all[level][on]
        n = len(chunk.ids)
        by_doc = lambda v: np.bincount(chunk.doc, weights=v, minlength=n)
        return pd.DataFrame(
            {
                "id": chunk.ids,
                "held_out": ~chunk.train,
                "n_tokens": np.bincount(chunk.doc, minlength=n),
                "n_known": by_doc(known).astype(np.int64),
                "train_tokens": total_n,
                "base_score": by_doc(base),
                "score": by_doc(np.log10(p)),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    out = by_chunk(counts if known is None else words.union(known)).applyInPandas(scored, "id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def op5_pst_score(spark, sf_dir: str) -> DataFrame:
    """``pst_score`` over all documents; rows as its docstring says."""
    return pst_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
