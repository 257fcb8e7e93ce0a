from __future__ import annotations

import numpy as np
import pytest

from inkwell.llm import grammar_ids as G


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=G.PATTERN, mergeable_ranks=G.read_ranks(), special_tokens={})


TEXTS = ["the cat sat on the mat. " * 400, "", None, "  two  spaces \n\n and\ttabs ", " lead", "trail ", "日本語 naïve 🎉 it's we'll", "12345 678", "the cat sat on the mat. " * 400, "a" * 5000, "word " * 60_000]


@pytest.mark.parametrize("shard_tokens", [1 << 20, 500])
def test_every_text_comes_back(spark, bpe, shard_tokens):
    rows = [(k if k != 3 else None, t, 0) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(2)
    shards = G.grammar_shards(df, shard_tokens=shard_tokens).cache()
    got = sorted(((r["doc_id"] is not None, r["doc_id"]), r["tokens"]) for r in G.decoded(shards).collect())
    want = sorted(((i is not None, i), bpe.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert got == want
    for s in shards.collect():
        s = s.asDict()
        assert s["n_tokens"] == sum(s["doc_tokens"])
        assert len(set(s["doc_ids"])) == len(s["doc_ids"])
        rng = np.random.default_rng(1)
        for k, i in enumerate(s["doc_ids"]):
            tokens = dict(got)[(i is not None, i)]
            for _ in range(8):
                a, b = sorted(rng.integers(0, len(tokens) + 2, 2).tolist())
                assert G.decode_range(s, k, a, b).tolist() == tokens[a:b]


def test_grammars_are_grammars():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 50, 5000):
        ids = rng.choice([5, 9, 70_000, 11], size, p=[0.6, 0.2, 0.1, 0.1]).astype(np.int32)
        at = np.sort(np.concatenate([[0, size], rng.integers(0, size + 1, 3)]))
        terminals, rules, seq, begins = G.compress(ids, at)
        assert G.expand(seq, terminals, rules).tolist() == ids.tolist()
        lengths = G.expansion_lengths(len(terminals), rules)
        assert all(lengths[len(terminals) + k] == len(G.expand(np.array([len(terminals) + k]), terminals, rules)) for k in range(len(rules)))
        assert all(max(r) < len(terminals) + k for k, r in enumerate(rules))
        assert [int(lengths[seq[a:b]].sum()) for a, b in zip(begins, begins[1:], strict=False)] == np.diff(at).tolist()
    terminals, rules, seq, _ = G.compress(np.tile(np.arange(64, dtype=np.int32), 512), np.array([0, 64 * 512]))
    assert len(seq) + 2 * len(rules) < 64 * 512 / 20


def test_an_empty_table(spark):
    assert G.grammar_shards(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    words = [rng.integers(0, 3000, rng.integers(2, 40)) for _ in range(4000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.3, 12_000) % 4000]).astype(np.int32)
    at = np.concatenate([np.arange(0, len(ids), 1000), [len(ids)]])
    terminals, rules, seq, begins = G.compress(ids, at)
    assert (G.expand(seq.astype(np.int32), terminals, rules) == ids).all()
    assert max(nonoverlapping(seq.tolist(), begins.tolist()).values()) < 2 == G.MIN_COUNT


def nonoverlapping(seq, begins):
    """How often each pair occurs without overlapping itself, over no document's end."""
    count, last = {}, {}
    for a, b in zip(begins, begins[1:], strict=False):
        for i in range(a, b - 1):
            p = (seq[i], seq[i + 1])
            if last.get(p) != i - 1 or p[0] != p[1]:
                count[p], last[p] = count.get(p, 0) + 1, i
            else:
                last.pop(p)
    return count


def sequential(ids, at):
    """Re-Pair as it is published: one most frequent pair after another."""
    docs, rules = [ids[a:b] for a, b in zip(at, at[1:], strict=False)], 0
    while True:
        flat, begins = [x for d in docs for x in d], np.cumsum([0, *map(len, docs)]).tolist()
        count = nonoverlapping(flat, begins)
        pair = max(count, key=count.get, default=None)
        if pair is None or count[pair] < 2:
            return len(flat) + 2 * rules
        for d in docs:
            i = 0
            while i < len(d) - 1:
                if (d[i], d[i + 1]) == pair:
                    d[i : i + 2] = [-1 - rules]
                i += 1
        rules += 1


@pytest.mark.parametrize("seed", range(4))
def test_grammars_are_about_as_small_as_the_sequential_algorithm_s(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 60, rng.integers(2, 12)) for _ in range(120)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.4, 500) % 120] + [np.zeros(41, int)]).astype(np.int32)
    at = np.array([0, 700, 701, 701, len(ids)])
    terminals, rules, seq, begins = G.compress(ids, at)
    assert (G.expand(seq, terminals, rules) == ids).all()
    assert len(seq) + 2 * len(rules) <= 1.05 * sequential(ids.tolist(), at.tolist())


def test_many_short_documents_stay_apart():
    """Ends of documents are next to many ids, also in the rounds that count exactly."""
    rng = np.random.default_rng(11)
    ids = rng.integers(0, 9, 3000).astype(np.int32)
    at = np.unique(np.concatenate([[0, 3000], rng.integers(0, 3000, 1500)]))
    terminals, rules, seq, begins = G.compress(ids, at)
    assert (G.expand(seq, terminals, rules) == ids).all()
    lengths = G.expansion_lengths(len(terminals), rules)
    assert [int(lengths[seq[a:b]].sum()) for a, b in zip(begins, begins[1:], strict=False)] == np.diff(at).tolist()
    assert max(nonoverlapping(seq.tolist(), begins.tolist()).values()) < 2


@pytest.mark.parametrize("ids", [[7] * n for n in (1, 2, 3, 4, 5, 8, 9, 31)] + [[1, 1, 1, 2, 2, 2, 1, 1, 2], [1, 2] * 9 + [1]])
def test_runs_of_one_id_come_to_an_end(ids):
    ids = np.array(ids, np.int32)
    terminals, rules, seq, begins = G.compress(ids, np.array([0, len(ids)]))
    assert G.expand(seq, terminals, rules).tolist() == ids.tolist()
    assert max(nonoverlapping(seq.tolist(), begins.tolist()).values(), default=0) < 2


def test_all_places_are_counted_only_when_the_bar_falls(monkeypatch):
    """A long passage takes many rounds, which only look at its places."""
    rng = np.random.default_rng(3)
    passage = rng.permutation(5000)[:1500]
    words = [rng.integers(5000, 9000, rng.integers(2, 30)) for _ in range(2000)]
    ids = np.concatenate([x for k in range(60) for x in (passage, *(words[j] for j in rng.zipf(1.3, 60) % 2000))]).astype(np.int32)
    at, passes, bincount = np.array([0, len(ids) // 2, len(ids)]), [], np.bincount

    def counted(x, *args, **how):
        passes.extend([len(x)] if how.get("minlength") == 1 << G.TABLE_BITS else [])
        return bincount(x, *args, **how)

    monkeypatch.setattr(np, "bincount", counted)
    terminals, rules, seq, begins = G.compress(ids, at)
    monkeypatch.undo()
    assert (G.expand(seq, terminals, rules) == ids).all()
    assert max(nonoverlapping(seq.tolist(), begins.tolist()).values()) < 2
    most = max(nonoverlapping(ids.tolist(), at.tolist()).values())
    assert 0 < len(passes) <= np.log2(most) + 2


@pytest.mark.parametrize("symbols", [500, 1 << 30])
def test_pairs_are_numbered_as_they_are(symbols):
    """Also where symbols and places are too many for one integer."""
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 40, (2, 3000)).astype(np.int32) + np.int32(symbols - 40)
    number, first = G._grouped(left, right, symbols)
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    assert len(first) == len(set(pairs)) and [pairs[first[n]] for n in number] == pairs
    none, first = G._grouped(left[:0], right[:0], symbols)
    assert len(none) == len(first) == 0
