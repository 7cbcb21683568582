"""Language-model scoring with a probabilistic suffix tree over words.

The root predicts each token by its smoothed count. A deeper state is a context of one to ``depth`` preceding words, any words. A context is retained if it was seen often enough and its next-symbol
distribution diverges from that of its parent (its longest retained suffix): the leave-one-out log-likelihood ratio of the symbols that followed it, child against parent, must exceed ``divergence`` nats. Its distribution
is its counts of symbols that followed it at least twice, smoothed by the parent's distribution with weight ``smoothing``, so every state's probabilities sum to one. A token is scored by the
longest retained suffix of the words before it. The start of a document is no context without a word after it.

Text is read once, in blocks. The tree grows a level for each round: a block's state, as it was written, sends its distinct (context, next) pairs, with counts of its training documents and the parent's probability, to slots as packed arrays.
A slot counts the pairs, tests the contexts and answers each block; the answers meet the block's state again. The pairs of a context that makes up much of a slot are dealt over ``SALTS`` slots, and the driver adds up the sums of the test (the number of such contexts is bounded by that of slots).
Word counts are looked up the same way, so tests use exact counts and nothing that grows with the corpus is broadcast.

What can change no result is not sent. A context is made longer only where that can lead to a retained one; left out with certainty are contexts seen fewer than ``least`` times, all that hold such a one, and those with no more than one symbol that followed twice, of count n and
probability p, where n log(1/p), the most that the ratio of any longer context can be, isn't above ``divergence``. A pair whose shorter form was seen once can't be seen twice: only its context is asked for, and how often it was seen. The rounds end when no context is left.

Words are identified by 64-bit hashes, followers within a context by 32 bits; the parents' probabilities go from round to round with 16 bits of mantissa. A null text is an empty one: its only token is the end. A null id counts as the empty text in the choice of the fold. Repeated rows count and are scored each. An empty table gives no rows;
with no training documents all counts are 0. Other columns of the input are not looked at.

Every round writes two tables to the shared folder, states and answers, and the next one starts from these; they are deleted when the next states have been written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, only, slices
from .similar import mix

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Hashes of strings that no word can be, as they hold a space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (" end", " start"))
#: Characters of a block; a longer text is a block of its own.
BLOCK = 6 << 20
#: Places that a round tests for each slot: a slot is unpacked whole, one at a time. Every block writes to every slot, so their number follows what a round has left.
SLOT = 1 << 20
#: Slots of a hot context, and the share of a slot from which a context is hot.
SALTS, HOT = 64, 0.25
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
MESSAGE = "block long, slot int, packed binary"
_NONE = np.zeros(0, dtype=np.int64)
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
#: With this setting Spark removes a write's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_training(doc_id: int | None, folds: int = 5, held_out: int = 1) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds != held_out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' hashes, each token's number among them, and the number of tokens of each text; the end is the last token of a text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    lengths = np.add.reduceat(full.astype(np.int64), parts.offsets.to_numpy()[:-1])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    word = np.full(int(lengths.sum()) + len(texts), len(names), dtype=np.int64)
    codes = coded.indices.to_numpy()
    word[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lengths)] = codes
    return np.append(hashes, END), word, lengths + 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its type, as one compressed string; the low bytes of an array's values come first, then the next ones."""
    head, body = "", []
    for a in arrays:
        head += f"{a.dtype.str}:{len(a)};"
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T))
    return _COMPRESSOR.compress(head.encode() + b"\n" + b"".join(body))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = _DECOMPRESSOR.decompress(raw)
    end = raw.index(b"\n")
    out, at = [], end + 1
    for field in raw[:end].decode().split(";")[:-1]:
        kind, n = np.dtype(field.split(":")[0]), int(field.split(":")[1])
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        whole = np.empty((n, kind.itemsize), dtype=np.uint8)
        for k in range(kind.itemsize):
            whole[:, k] = planes[k]
        out.append(whole.reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Block id, doc ids and texts; the same for the same rows in the same order."""
    number, part = 0, 0
    ids: list = []
    texts: list = []
    size = 0
    for some, more, parts in slices(batches, 1):
        part = parts[0]
        ids += some
        texts += more
        size += sum(len(t) for t in more if t)
        if size >= BLOCK:
            yield part << 24 | number, ids, texts
            ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield part << 24 | number, ids, texts


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows of MESSAGE as one batch: what a block sends, or a slot answers, is of bounded size."""
    blocks, slots, packed = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(blocks, pa.int64()), pa.array(slots, pa.int32()), pa.array(packed, pa.binary())], names=["block", "slot", "packed"])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of an array of unsigned integers, the first place of each, and each place's number among them."""
    if not len(x):
        return x, _NONE, _NONE
    bits = len(x).bit_length()
    if int(x.max()) >> 64 - bits:  # no room for the places beside the values
        coded = pa.array(x).dictionary_encode()
        run, values = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
        one = np.empty(len(values), dtype=np.int64)
        one[run[::-1]] = np.arange(len(run) - 1, -1, -1)
        return values, one, run
    both = np.sort(x.astype(np.uint64) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64))
    place, values = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    new = np.concatenate([[True], values[1:] != values[:-1]])
    run = np.empty(len(x), dtype=np.int64)
    run[place] = np.cumsum(new) - 1
    return values[new].astype(x.dtype), place[new], run


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of integers from 0 to 2 ** 32."""
    return (np.sort(x.astype(np.uint64) << np.uint64(32) | np.arange(len(x), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _short(p: np.ndarray) -> np.ndarray:
    """Probabilities as 32-bit numbers with 16 bits of mantissa."""
    return ((p.astype(np.float32).view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def _retained(whole: np.ndarray, kept: np.ndarray, gain: np.ndarray, smoothing: float, least: int, divergence: float) -> np.ndarray:
    """Which contexts stay, by the sums over their symbols: all counts, counts of at least two, and the latter's part of the ratio."""
    rest = np.maximum(whole - 1 + smoothing, smoothing)
    ratio = gain - kept * np.log(rest) + (whole - kept) * np.log(smoothing / rest)
    return (whole >= least) & (kept > 0) & (ratio > divergence)


def count_words(messages: list[bytes]) -> tuple[list[bytes], bytes]:
    """For each block's words their counts; and the sum and number of the words."""
    parts = [_unpack(m) for m in messages]
    words, _, place = _distinct(np.concatenate([p[0] for p in parts]))
    count = np.bincount(place, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(words)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [_pack(x.astype(np.uint32) if count.max(initial=0) < 1 << 32 else x) for x in np.split(count[place], ends)], _pack(np.array([count.sum(), (count > 0).sum()]))


def weigh_contexts(messages: list[bytes], smoothing: float, least: int, divergence: float) -> tuple[list[bytes], bytes]:
    """For each block's pairs their counts, and of its contexts the counts kept (0: not retained) and whether longer ones are to be tested. Then the sums of hot contexts, and how many are to be made longer.

    A message: keys of contexts, whether each is hot, its training places, its number of pairs; of the pairs the follower, training places, and parent's probability.
    """
    parts = [_unpack(m) for m in messages]
    keys, _, run = _distinct(np.concatenate([p[0] for p in parts]))
    hot = np.zeros(len(keys), dtype=bool)
    hot[run] = np.concatenate([p[1] for p in parts]) > 0
    whole = np.bincount(run, weights=np.concatenate([p[2] for p in parts]).astype(np.float64), minlength=len(keys))
    context = np.repeat(run, np.concatenate([p[3] for p in parts]).astype(np.int64))
    pairs, one, pair = _distinct(context.astype(np.uint64) << np.uint64(32) | np.concatenate([p[4] for p in parts]))
    parent = np.concatenate([p[6] for p in parts])[one].astype(np.float64)
    count = np.bincount(pair, weights=np.concatenate([p[5] for p in parts]).astype(np.float64), minlength=len(pairs))
    twice = count >= 2
    n, seen, p2 = context[one[twice]], count[twice], parent[twice]
    total = lambda weights: np.bincount(n, weights=weights, minlength=len(keys))
    kept, symbols = total(seen), np.bincount(n, minlength=len(keys))
    gain = total(seen * np.log((seen - 1 + smoothing * p2) / p2))
    stays = _retained(whole, kept, gain, smoothing, least, divergence) & ~hot
    p2 = np.where(stays[n], (seen + smoothing * p2) / (kept[n] + smoothing), p2)
    longer = hot | (whole >= least) & (kept > 0) & ((symbols > 1) | (total(seen * -np.log(p2)) > divergence))
    known = np.where(stays, kept, 0).astype(np.uint32)
    out = []
    at = run_at = 0
    for p in parts:
        r = run[run_at : run_at + len(p[0])]
        out.append(_pack(count[pair[at : at + len(p[4])]].astype(np.uint32), known[r], np.packbits(longer[r])))
        at, run_at = at + len(p[4]), run_at + len(p[0])
    return out, _pack(keys[hot], whole[hot], kept[hot], gain[hot], np.array([longer.sum()]))


class _State:
    """What a block knows between rounds: its documents' words and sums, and the places whose contexts are tested."""

    FIELDS = "ids null lengths train vocabulary word count base score known at doc offset p single hot rare".split()

    RISING = ("at", "doc", "offset")  # packed as differences

    def __init__(self, raw: bytes | None = None):
        for f, a in zip(self.FIELDS, _unpack(raw) if raw else []):
            setattr(self, f, np.cumsum(a, dtype=np.uint32) if f in self.RISING else a)

    def packed(self) -> bytes:
        return _pack(*(np.diff(getattr(self, f), prepend=np.uint32(0)) if f in self.RISING else getattr(self, f) for f in self.FIELDS))

    @classmethod
    def of(cls, ids: list, texts: list) -> "_State":
        self = cls()
        self.ids, self.null = np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is None for i in ids])
        self.train = np.array([in_training(i) for i in ids])
        vocabulary, word, self.lengths = tokens(texts)
        order = np.argsort(-np.bincount(word, minlength=len(vocabulary)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        self.vocabulary, self.word = vocabulary[order], rank[word]
        self.base = self.score = np.zeros(len(ids))
        self.known = np.zeros(len(ids), dtype=np.int64)
        self.at = self.doc = self.offset = self.word[:0]
        self.p, self.single = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.uint8)
        self.count, self.hot, self.rare = _NONE, self.single, np.zeros(len(self.word) // 8 + 1, dtype=np.uint8)
        return self

    def _slots(self, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in order of slots, and the bounds of these."""
        slot = (mix(self.vocabulary) % np.uint64(slots)).astype(np.int64)
        order = _order(slot)
        return order, np.searchsorted(slot[order], np.arange(slots + 1))

    def ask_words(self, slots: int) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.word, weights=np.repeat(self.train, self.lengths), minlength=len(self.vocabulary)).astype(np.uint32)
        order, bounds = self._slots(slots)
        for s, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if j > i:
                yield s, _pack(self.vocabulary[order[i:j]], n[order[i:j]])

    def _add(self, doc: np.ndarray, p: np.ndarray) -> None:
        """The final probabilities of some places, by document."""
        self.score = self.score + np.bincount(doc, weights=np.log10(p), minlength=len(self.ids))

    def take_words(self, answers: dict[int, bytes], model: dict) -> tuple[np.ndarray, ...]:
        """Places, their documents and offsets in these, their probabilities at the root, whether their words can't follow twice, and the counts of the words before them."""
        count = np.empty(len(self.vocabulary), dtype=np.int64)
        count[self._slots(model["slots"])[0]] = np.concatenate([_unpack(answers[s])[0] for s in sorted(answers)])
        # Words seen once or never are in no context, and follow none twice: two numbers do for all of them.
        often = np.flatnonzero(count >= 2)
        number = count.astype(np.uint32)
        number[often] = np.arange(2, len(often) + 2)
        self.word = number[self.word]
        self.vocabulary, self.count = np.concatenate([np.array([0, 1], dtype=np.uint64), self.vocabulary[often]]), np.concatenate([[0, 1], count[often]])
        count = self.count[self.word]
        root = self._root(model)[self.word]
        starts = np.cumsum(self.lengths) - self.lengths
        self.base, self.known = np.add.reduceat(np.log10(root), starts), np.add.reduceat((count > 0).astype(np.int64), starts)
        before = np.concatenate([[0], count[:-1]])
        before[starts] = 0  # the start alone is no context
        place, doc = np.arange(len(count)), np.repeat(np.arange(len(self.ids)), self.lengths)
        return place, doc, place - starts[doc], root, count < 2, before

    def _root(self, model: dict) -> np.ndarray:
        return (self.count + 0.5) / (model["total"] + 0.5 * (model["distinct"] + 1))

    def _before(self, level: int, model: dict) -> np.ndarray:
        """The kept places' probabilities before their contexts of ``level`` words are tested."""
        return _short(self._root(model))[self.word[self.at]] if level == 1 else self.p

    def take(self, level: int, answers: dict[int, bytes], model: dict) -> tuple[np.ndarray, ...]:
        """The same after the contexts of ``level`` words are tested; places where no longer context can be retained are scored."""
        if not len(self.at):
            return _NONE, _NONE, _NONE, np.zeros(0), _NONE, _NONE
        parts = [_unpack(answers[s]) for s in sorted(answers)]
        counts, kept = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
        longer = np.concatenate([np.unpackbits(p[2], count=len(p[1])) for p in parts]).astype(bool)
        at, single = self.at.astype(np.int64), self.single.astype(bool)
        key, run, entry, *_ = self._pairs(level, at, self.offset, single, model["slots"], lambda keys, one: np.isin(keys, model["hot"]))
        if len(model["hot"]):
            i = np.minimum(np.searchsorted(model["hot"], key), len(model["hot"]) - 1)
            kept = np.where(model["hot"][i] == key, model["kept"][i], kept)
        seen = np.ones(len(at), dtype=np.int64)
        seen[~single] = counts[entry]
        kept, longer = kept[run], longer[run]
        a = model["smoothing"]
        p = self._before(level, model).astype(np.float64)
        p = np.where(kept > 0, (np.where(seen >= 2, seen, 0) + a * p) / (kept + a), p)
        # A context one word longer ends in the pair of the place before; where that wasn't sent, its count is not known, and not hot.
        held = np.full(len(self.word) + 1, -1, dtype=np.int64)
        held[at + 1] = seen
        before = held[at]
        before[self.offset == 0] = -1
        on = longer & (self.offset >= level)
        self._add(self.doc[~on], p[~on])
        return at[on], self.doc[on].astype(np.int64), self.offset[on].astype(np.int64), p[on], seen[on] < 2, before[on]

    def _shrink(self, at: np.ndarray, offset: np.ndarray, depth: int) -> np.ndarray:
        """Keep only the words of the places ``at`` and of their longest contexts; the places' new numbers."""
        needed = np.zeros(len(self.word), dtype=bool)
        for j in range(depth + 1):
            needed[at[offset >= j] - j] = True
        order, _, word = _distinct(self.word[needed])
        self.rare = np.packbits(np.unpackbits(self.rare, count=len(self.word))[needed])
        self.vocabulary, self.word = self.vocabulary[order], word.astype(np.uint32)
        self.count = self.count[order] if len(self.count) else self.count
        return (np.cumsum(needed) - 1)[at]

    def _pairs(self, level: int, at: np.ndarray, offset: np.ndarray, single: np.ndarray, slots: int, is_hot) -> tuple[np.ndarray, ...]:
        """Contexts and pairs of some places, in order of slots: the key of each run of pairs, each place's run, each pair's number for the places that send one; a place of each pair, its run and follower; slot and heat of each run."""
        if level == 1:
            context = self.word[at - 1].astype(np.int64)
            used = np.bincount(context, minlength=len(self.vocabulary)) > 0
            keys, context = mix(self.vocabulary[used]), (np.cumsum(used) - 1)[context]
            one = np.empty(len(keys), dtype=np.int64)
            one[context] = np.arange(len(at))
        else:
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(1, level + 1):
                h = mix(h * _SPREAD + np.where(offset >= j, self.vocabulary[self.word[np.maximum(at - j, 0)]], START))
            keys, one, context = _distinct(h)
        hot = is_hot(keys, one)
        sends = np.flatnonzero(~single)
        _, first, pair = _distinct(context[sends].astype(np.uint64) * np.uint64(len(self.vocabulary)) + self.word[at[sends]])
        first = sends[first]
        follower = (mix(self.vocabulary[self.word[at[first]]]) >> np.uint64(32)).astype(np.uint32)
        salted = context[first] * SALTS + np.where(hot[context[first]], follower % np.uint32(SALTS), 0)
        lone = np.ones(len(keys), dtype=bool)
        lone[context[first]] = False
        runs, _, of = _distinct(np.concatenate([salted, np.flatnonzero(lone) * SALTS]).astype(np.uint64))
        runs = runs.astype(np.int64)
        key = keys[runs // SALTS]
        slot = (mix(key + (runs % SALTS).astype(np.uint64) * _SPREAD) % np.uint64(slots)).astype(np.int64)
        order = _order(slot)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        home = np.empty(len(keys), dtype=np.int64)
        home[runs[order] // SALTS] = np.arange(len(order))  # of a hot context any of its runs
        pair_run = rank[of[: len(first)]]
        by_run = _order(pair_run)
        number = np.empty(len(first), dtype=np.int64)
        number[by_run] = np.arange(len(first))
        run = home[context]
        run[sends] = pair_run[pair]
        return key[order], run, number[pair], first[by_run], pair_run[by_run], follower[by_run], slot[order], hot[runs[order] // SALTS]

    def select(self, level: int, at: np.ndarray, doc: np.ndarray, offset: np.ndarray, p: np.ndarray, single: np.ndarray, before: np.ndarray, model: dict) -> None:
        """Keep the places whose context of ``level`` words was seen often enough; the others are scored."""
        rare = np.unpackbits(self.rare, count=len(self.word)).astype(bool)
        on = (before >= model["least"]) | (before < 0) & ~((offset > 0) & rare[np.maximum(at - 1, 0)])
        rare[at[~on & (offset > 0)]] = True  # and so is every context that ends here, with the next word
        self.rare = np.packbits(rare)
        self._add(doc[~on], p[~on])
        at, doc, offset, p, single, before = at[on], doc[on], offset[on], p[on], single[on], before[on]
        if len(at) * 4 < len(self.word):
            at = self._shrink(at, offset, model["depth"])
        self.at, self.doc, self.offset = (x.astype(np.uint32) for x in (at, doc, offset))
        self.single, self.hot, self.p = single.astype(np.uint8), np.packbits(before > model["hot_from"]), _short(p)
        if level == 1:
            self.p = self.p[:0]  # known from the words' counts
        else:
            self.count = _NONE

    def ask(self, level: int, model: dict) -> Iterator[tuple[int, bytes]]:
        """The pairs of the places that were kept, by slot."""
        if not len(self.at):
            return
        slots, at, single = model["slots"], self.at.astype(np.int64), self.single.astype(bool)
        hottest = np.unpackbits(self.hot, count=len(at)).astype(bool)
        key, run, entry, first, pair_run, follower, slot, hot = self._pairs(level, at, self.offset, single, slots, lambda keys, one: hottest[one])
        train = self.train[self.doc].astype(np.float64)
        total = np.bincount(run, weights=train, minlength=len(key)).astype(np.uint32)
        size = np.bincount(pair_run, minlength=len(key)).astype(np.uint32)
        count = np.bincount(entry, weights=train[~single], minlength=len(first)).astype(np.uint32)
        parent = self._before(level, model)[first]
        run_bounds = np.searchsorted(slot, np.arange(slots + 1))
        bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[run_bounds]
        for s in np.flatnonzero(np.diff(run_bounds)):
            a, b, i, j = run_bounds[s], run_bounds[s + 1], bounds[s], bounds[s + 1]
            yield int(s), _pack(key[a:b], hot[a:b].astype(np.uint8), total[a:b], size[a:b], follower[i:j], count[i:j], parent[i:j])

    def rows(self, model: dict) -> pa.RecordBatch:
        n = len(self.ids)
        columns = [pa.array(self.ids, mask=self.null.astype(bool)), pa.array(~self.train.astype(bool)), pa.array(self.lengths), pa.array(self.known), pa.array(np.full(n, model["total"], dtype=np.int64)), pa.array(self.base), pa.array(self.score)]
        return pa.record_batch(columns, names=[f.split()[0] for f in SCORES.split(", ")])


def score_documents(docs: DataFrame, depth: int = 2, smoothing: float = 2.0, least: int = 2, divergence: float = 4.0) -> DataFrame:
    """One row per document of ``docs (doc_id, text)``; see SCORES. Held-out documents (crc32 of the id, modulo 5, is 1) teach nothing. ``least`` is 2 at least."""
    if least < 2:
        raise ValueError("a context seen once says nothing when it is left out itself: least must be 2 or more")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))  # of the scan, wherever it stands in a plan
    model = {"depth": depth, "smoothing": smoothing, "least": least, "hot": np.zeros(0, dtype=np.uint64)}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for number, ids, texts in _blocks(batches):
            state = _State.of(ids, texts)
            yield _messages([(number, -1 - len(state.vocabulary), state.packed())])

    def ask(level: int, shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only()
            model = shared.value
            for batch in batches:
                for i in range(batch.num_rows):  # one state at a time
                    block, _, packed = (c[i].as_py() for c in batch.columns)
                    state = _State(packed)
                    found = state.ask(level, model) if level else state.ask_words(model["slots"])
                    yield _messages([(block, s, packed) for s, packed in found])

        return run

    def answer(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only()
            held: dict[int, list] = {}
            for batch in batches:
                for block, slot, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    held.setdefault(slot, []).append((block, packed))
            for slot in list(held):
                rows = held.pop(slot)
                messages = [r[1] for r in rows]
                answers, sums = weigh_contexts(messages, smoothing, least, divergence) if level else count_words(messages)
                yield _messages([*((block, slot, packed) for (block, _), packed in zip(rows, answers)), (-1, slot, sums)])

        return run

    def step(level: int, shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only()
            model = shared.value
            current, state, answers = None, None, {}

            def done() -> Iterator[pa.RecordBatch]:
                if current is None:
                    return
                places = state.take(level, answers, model) if level else state.take_words(answers, model)
                if last:
                    state._add(places[1], places[3])
                    yield state.rows(model)
                    return
                state.select(level + 1, *places, model)
                yield _messages([(current, -1 - len(state.at), state.packed())])

            for batch in batches:
                for number, slot, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    if number != current:
                        yield from done()
                        current, state, answers = number, None, {}
                    if slot < 0:
                        state = _State(packed)
                    else:
                        answers[slot] = packed
            yield from done()

        return run

    def written(df: DataFrame, old: list[str]) -> str:
        """Write a table and drop its shuffle files, then those tables that are done with."""
        path, before = fresh_path(spark, "suffix-tree"), spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "none").parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        for o in old:
            _delete(spark, o)
        return path

    read = lambda path: spark.read.schema(MESSAGE).parquet(path)
    states, old = docs.mapInArrow(begin, MESSAGE), []
    for level in range(depth + 1):
        path = written(states, old)
        asked = read(path).agg(F.sum(-1 - F.col("slot"))).first()[0] or 0  # words, then places
        model["slots"] = max(1, -(-asked // SLOT))
        shared = spark.sparkContext.broadcast(dict(model))
        answers = written(read(path).mapInArrow(ask(level, shared), MESSAGE).repartition("slot").mapInArrow(answer(level), MESSAGE), [])
        old = [path, answers]
        sums = [_unpack(r[0]) for r in read(answers).filter("block = -1").select("packed").toLocalIterator()]
        if level == 0:
            model["total"], model["distinct"] = (sum(int(s[0][i]) for s in sums) for i in (0, 1))
            model["hot_from"] = max(least, HOT * min(model["total"], SLOT))
            more = True
        else:
            keys, place = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(s[0] for s in sums)]), return_inverse=True)
            whole, kept, gain = (np.bincount(place, weights=np.concatenate([np.zeros(0), *(s[i] for s in sums)]), minlength=len(keys)) for i in (1, 2, 3))
            model["hot"], model["kept"] = keys, np.where(_retained(whole, kept, gain, smoothing, least, divergence), kept, 0).astype(np.int64)
            more = any(s[4][0] for s in sums)
        last = level == depth or not more
        shared = spark.sparkContext.broadcast(dict(model))
        met = read(path).unionByName(read(answers).filter("block <> -1")).repartition("block").sortWithinPartitions("block", "slot")
        states = met.mapInArrow(step(level, shared, last), SCORES if last else MESSAGE)
        if last:
            return states


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
