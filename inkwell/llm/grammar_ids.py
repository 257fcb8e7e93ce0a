"""Token ids as grammars: Re-Pair compression of shards, with random access.

Texts are encoded by a public byte-level BPE vocabulary, whole shards of
documents at a time.  Pairs of neighbouring ids of a shard are counted, and
every one that is at least half as frequent as the most frequent is replaced by a
nonterminal of its own; where two of them overlap the more frequent one wins.
That is repeated, for the places whose pairs are that frequent and those next to
new nonterminals, until no pair is; then all pairs are counted anew.  Pairs never
reach over a document's end, and occurrences that overlap count once.  Rounds go
on until no pair occurs twice (`min_count`; or for `rounds`, if given).  As
several pairs are replaced in a round, the grammar isn't that of the sequential
algorithm, but no larger than 1.05 times that on the tested inputs.

A shard is one row: its alphabet (the terminals that occur, then a rule for
each nonterminal), every symbol's expansion length, the sequence in 2 or 4
bytes a symbol, and where each document's symbols begin.  A range of a
document's tokens is decoded by adding up expansion lengths to the range's
begin and expanding only the symbols that it touches.

Cases: an empty or null text is a document without tokens; null identifiers
and repeated rows are kept as they are, in their order in the shard; a text
that is longer than a shard is a shard of its own, whole; an empty table gives
an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public rule of cutting a text into words.
PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 1 << 20
MIN_COUNT = 2
TABLE_BITS = 20
CACHED = 500_000
WORD_BITS = 20
_encoders: dict[int, Encoder] = {}
_ARROW = pa.schema([
    ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("doc_begins", pa.binary()), ("terminals", pa.binary()),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("sequence", pa.binary()), ("n_tokens", pa.int64()),
])
SCHEMA = "shard bigint, doc_ids array<bigint>, doc_tokens array<int>, doc_begins binary, terminals binary, rules binary, lengths binary, width int, sequence binary, n_tokens bigint"


class Encoder:
    """Ids of texts, a word at a time: what the vocabulary makes of a word doesn't depend on the words around it.

    A text is cut before each space that follows another character than a
    space, where the pattern always cuts.  The ids of words of up to LONGEST
    bytes are remembered in a table that is looked up for all words of some
    texts at once: a word's bytes and length are its key, compared whole, so
    nothing is ever mistaken for another word.  A text with
    a run of spaces, or one at its end, isn't cut.
    """

    LONGEST = 14

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((1 << WORD_BITS, 2), np.uint64)
        self.piece = np.zeros(1 << WORD_BITS, np.int64)
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def together(self, data: np.ndarray, begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with its space in front, encoded as one text, and how many each has."""
        ends = np.cumsum(n)
        raw = data[np.repeat(begins - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        ids = np.array(self.bpe.encode_ordinary(raw.tobytes().decode("utf-8")), np.int32)
        return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0)

    def remember(self, key: np.ndarray, mixed: np.ndarray, piece: np.ndarray) -> None:
        for shift in (64 - WORD_BITS, 44 - WORD_BITS):
            slot = (mixed >> np.uint64(shift)).astype(np.int64) & ((1 << WORD_BITS) - 1)
            free = np.flatnonzero(self.keys[slot, 1] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.piece[slot[free]] = key[free], piece[free]
            rest = np.ones(len(slot), bool)
            rest[free] = False
            key, mixed, piece = key[rest], mixed[rest], piece[rest]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after another, and the texts' offsets."""
        if len(self.begin) > CACHED:
            self.clear()
        out, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, data, at in text_slices(texts, 4 << 20):
            tokens, n = self._slice(data, at)
            out.append(tokens)
            sizes.append(n)
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))

    def _slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some texts, and how many each has."""
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        mark = data == 32
        cut = np.flatnonzero(mark)
        last = mark[at[full + 1] - 1]
        mark[at[full]] = True
        whole = np.zeros(len(at) - 1, bool)  # a run of spaces (of one text), or a space at the end
        whole[np.searchsorted(at, cut[:-1][np.diff(cut) == 1], side="right") - 1] = True
        whole[full] |= last
        for r in np.flatnonzero(whole):
            mark[at[r] + 1 : at[r + 1]] = False
        begins = np.flatnonzero(mark)
        ends = np.append(begins[1:], len(data))
        n = ends - begins
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        windows = np.ndarray(len(data) + 8, dtype=">u8", buffer=padded, strides=(1,))
        key = np.empty((len(begins), 2), np.uint64)
        key[:, 0] = windows[begins]
        key[:, 1] = windows[np.minimum(begins + 8, len(data) + 7)]
        short = np.minimum(n, 8).astype(np.uint64)
        key[:, 0] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * short)
        rest = (np.clip(n, 8, 15) - 8).astype(np.uint64)
        key[:, 1] = key[:, 1] >> np.uint64(8) & ~(~np.uint64(0) >> (np.uint64(8) * rest + np.uint64(8))) | np.minimum(n, 255).astype(np.uint64) << np.uint64(56)
        mixed = (key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        which, left = np.zeros(len(begins), np.int64), np.arange(len(begins))
        for shift in (64 - WORD_BITS, 44 - WORD_BITS):  # a word is in one of two slots
            slot = (mixed[left] >> np.uint64(shift)).astype(np.int64) & ((1 << WORD_BITS) - 1)
            known = (self.keys[slot, 0] == key[left, 0]) & (self.keys[slot, 1] == key[left, 1])
            which[left[known]] = self.piece[slot[known]]
            left = left[~known]
        # of the words that weren't found, short ones are encoded once, the others where they stand
        lone = (data[begins[left]] != 32) | whole[np.searchsorted(at, begins[left], side="right") - 1]
        short = left[~lone & (n[left] <= self.LONGEST)]
        _, one, every = np.unique(mixed[short], return_index=True, return_inverse=True)
        one = short[one]
        same = (key[one][every] == key[short]).all(axis=1)
        long = np.concatenate([left[~lone & (n[left] > self.LONGEST)], short[~same]])
        known = len(self.begin) - 1
        ids, m = self.together(data, begins[one], n[one])
        which[short[same]] = known + every[same]
        self.remember(key[one], mixed[one], known + np.arange(len(one)))
        self.flat, self.begin = np.concatenate([self.flat, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(m)])
        which[long] = len(self.begin) - 1 + np.arange(len(long))
        ids, m = self.together(data, begins[long], n[long])
        lone = left[lone]
        which[lone] = len(self.begin) - 1 + len(long) + np.arange(len(lone))
        alone = [self.bpe.encode_ordinary(data[i:j].tobytes().decode("utf-8")) for i, j in zip(begins[lone].tolist(), ends[lone].tolist(), strict=True)]
        flat = np.concatenate([self.flat, ids, np.array([x for some in alone for x in some], np.int32)])
        begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate([m, np.array([len(x) for x in alone], np.int64)]))])
        m = np.diff(begin)[which]
        done = np.concatenate([[0], np.cumsum(m)])
        return flat[np.repeat(begin[which] - done[:-1], m) + np.arange(done[-1])], np.diff(done[np.searchsorted(begins, at)])


def encoder_of(name: int, ranks: dict[bytes, int]) -> Encoder:
    """A vocabulary's encoder; a worker keeps it, and what it remembers, for its next task."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(ranks)
    return _encoders[name]


def _matching(rank: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Which of some neighbouring stretches are taken: those that rank higher than all that they touch, then such ones of what these leave."""
    wins, left = np.zeros(len(rank), bool), rank.copy()
    for _ in range(4):
        best = left >= 0
        best[1:] &= ~touches | (left[1:] > left[:-1])
        best[:-1] &= ~touches | (left[:-1] > left[1:])
        if not best.any():
            break
        wins |= best
        left[best] = -1
        left[1:][touches & best[:-1]] = -1
        left[:-1][touches & best[1:]] = -1
    return wins


def _grouped(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some pairs, equal for equal ones and from 0 on, and the first place of each number."""
    bits, most = max(1, symbols.bit_length()), max(1, len(left).bit_length())
    key = left.astype(np.int64) << bits | right
    if 2 * bits + most > 63:
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return number, first
    key = np.sort(key << most | np.arange(len(key)))  # a place in the low bits: sorted numbers are faster than sorted places
    place = key & ((1 << most) - 1)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] >> most) != (key[:-1] >> most)
    number = np.empty(len(key), np.int64)
    number[place] = np.cumsum(new) - 1
    return number, place[new]


def compress(ids: np.ndarray, at: np.ndarray, rounds: int | None = None, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, sequence, documents' begins in it): symbols count the terminals first, then the rules."""
    min_count = max(2, min_count)  # a pair that occurs once can't be shortened
    terminals = np.flatnonzero(np.bincount(ids))
    dense = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    dense[terminals] = np.arange(len(terminals), dtype=np.int32)
    dense = dense[ids]
    n_docs, symbols = len(at) - 1, len(terminals)
    seq = np.empty(len(ids) + n_docs, np.int32)
    seq[at[1:] + np.arange(n_docs)] = -1 - np.arange(n_docs)  # every document ends with a negative of its own: no pair with one is counted
    seq[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(at))] = dense
    rules: list[np.ndarray] = []
    shift, bar, done = np.uint32(32 - TABLE_BITS), len(seq) + 1, 0
    while bar > min_count and (rounds is None or done < rounds):
        left, right = seq[:-1], seq[1:]
        slot = (((left.view(np.uint32) * np.uint32(0x9E3779B1) + right.view(np.uint32)) * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64)
        # a slot counts all its pairs, none of which is more frequent; only the places of slots that count enough are looked at
        upto = np.bincount(slot, minlength=1 << TABLE_BITS)
        bar = max(min_count, min(bar - 1, int(upto.max(initial=0))) >> 1)
        places = np.flatnonzero((upto >= bar)[slot])
        # replacing makes no pair more frequent but those with the new symbols, so that these places and those next to new symbols are all that counts until the bar falls
        while rounds is None or done < rounds:
            places = places[(seq[places] >= 0) & (seq[places + 1] >= 0)]
            slot, first = _grouped(seq[places], seq[places + 1], symbols)
            held = places[first]
            # in a run of one id only every second place can be replaced
            follows = np.concatenate([[False], (places[1:] == places[:-1] + 1) & (slot[1:] == slot[:-1])]) if len(places) else np.zeros(0, bool)
            heads = np.flatnonzero(~follows)
            odd = ((np.arange(len(places)) - heads[np.cumsum(~follows) - 1]) & 1).astype(bool) if len(places) else follows
            often = np.bincount(slot[~odd], minlength=len(held))[slot]
            chosen = often >= bar
            if not chosen.any():
                break
            places, rank = places[chosen], (often[chosen] << 32) | slot[chosen]
            # neighbours overlap; a stretch of one rank is a run of one id, of which every second place is taken
            near = places[1:] == places[:-1] + 1
            begins = np.concatenate([[True], ~(near & (rank[1:] == rank[:-1]))])
            stretch = np.cumsum(begins) - 1
            first = np.flatnonzero(begins)
            wins = _matching(rank[first], near[first[1:] - 1])
            take = wins[stretch] & ((np.arange(len(places)) - first[stretch]) & 1 == 0)
            taken, slot = places[take], rank[take] & 0xFFFFFFFF
            kept = np.bincount(slot, minlength=len(held))[slot] >= 2  # those of the most frequent pair are
            taken, slot = taken[kept], slot[kept]
            used = np.flatnonzero(np.bincount(slot, minlength=len(held)))
            name = np.zeros(len(held), np.int32)
            name[used] = symbols + np.arange(len(used), dtype=np.int32)
            rules.append(np.stack([seq[held[used]], seq[held[used] + 1]], axis=1))
            symbols += len(used)
            left_over, counts = np.ones(len(seq), bool), np.zeros(len(seq), bool)
            counts[places] = counts[taken] = counts[taken - 1] = True
            counts[-1] = left_over[taken + 1] = False  # the last is a document's end
            seq[taken] = name[slot]
            seq, places = seq[left_over], np.flatnonzero(counts[left_over])
            done += 1
    ends = np.flatnonzero(seq < 0)
    begins_at = np.concatenate([[0], ends - np.arange(n_docs)]).astype(np.int64)
    return terminals.astype(np.int32), np.concatenate(rules or [np.zeros((0, 2), np.int32)]), seq[seq >= 0], begins_at


def expansion_lengths(terminals: int, rules: np.ndarray) -> np.ndarray:
    """How many tokens each symbol stands for."""
    out = np.ones(terminals + len(rules), np.int64)
    done = terminals
    while done < len(out):  # a round's rules only name symbols of earlier rounds
        left, right = rules[done - terminals :].T
        late = np.flatnonzero(np.maximum(left, right) >= done)
        upto = done + (int(late[0]) if len(late) else len(left))
        k = slice(done - terminals, upto - terminals)
        out[done:upto] = out[rules[k, 0]] + out[rules[k, 1]]
        done = upto
    return out


def expand(symbols: np.ndarray, terminals: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The tokens that a run of symbols stands for."""
    n = len(terminals)
    while (deep := symbols >= n).any():
        at = np.arange(len(symbols)) + np.cumsum(deep) - deep
        out = np.empty(len(symbols) + int(deep.sum()), symbols.dtype)
        rule = rules[symbols[deep] - n]
        out[at[~deep]] = symbols[~deep]
        out[at[deep]], out[at[deep] + 1] = rule[:, 0], rule[:, 1]
        symbols = out
    return terminals[symbols]


def decode_range(shard: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens start to stop of a shard's doc-th document; only symbols that the range touches are expanded."""
    kind = np.uint16 if shard["width"] == 2 else np.uint32
    begins = np.frombuffer(shard["doc_begins"], np.int64)
    lengths = np.frombuffer(shard["lengths"], np.int64)
    symbols = np.frombuffer(shard["sequence"], kind)[begins[doc] : begins[doc + 1]].astype(np.int32)
    after = np.cumsum(lengths[symbols])
    total = int(after[-1]) if len(after) else 0
    start, stop = min(max(0, start), total), total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.int32)
    lo, hi = int(np.searchsorted(after, start, side="right")), int(np.searchsorted(after, stop, side="left")) + 1
    skipped = int(after[lo - 1]) if lo else 0
    tokens = expand(symbols[lo:hi], np.frombuffer(shard["terminals"], np.int32), np.frombuffer(shard["rules"], np.int32).reshape(-1, 2))
    return tokens[start - skipped : stop - skipped]


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _shard(number: int, ids: list[int | None], tokens: np.ndarray, at: np.ndarray, rounds: int | None, min_count: int) -> pa.RecordBatch:
    terminals, rules, seq, begins = compress(tokens, at, rounds, min_count)
    width = 2 if len(terminals) + len(rules) <= 1 << 16 else 4
    row = {
        "shard": number, "doc_ids": ids, "doc_tokens": np.diff(at).tolist(), "doc_begins": begins.tobytes(), "terminals": terminals.tobytes(), "rules": rules.astype(np.int32).tobytes(),
        "lengths": expansion_lengths(len(terminals), rules).tobytes(), "width": width, "sequence": seq.astype(np.uint16 if width == 2 else np.uint32).tobytes(), "n_tokens": len(tokens),
    }
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def grammar_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, rounds: int | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """A row for each shard of docs, which follow the table's partitions; the vocabulary file is read on the driver alone."""
    ranks = read_ranks(vocabulary)
    sent, name = docs.sparkSession.sparkContext.broadcast(ranks), hash(frozenset(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, sent.value)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                tokens, at = encoder.encode(some.column(1))
                ids += some.column(0).to_pylist()
                parts.append(tokens)
                sizes.append(np.diff(at))
                held += len(tokens)
                if held >= shard_tokens:
                    yield _shard(number, ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), rounds, min_count)
                    number, ids, parts, sizes, held = number + 1, [], [], [], 0
        if ids:
            yield _shard(number, ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), rounds, min_count)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, SCHEMA)


def decoded(shards: DataFrame) -> DataFrame:
    """(doc_id, tokens) of every document of some shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens = [decode_range(row, k) for k in range(len(row["doc_ids"]))]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array([t.tolist() for t in tokens], pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return shards.mapInArrow(run, "doc_id bigint, tokens array<int>")
