"""Results against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from runeflow.llm import common, decontaminate, language, mixing, near, neighbours, quality, shuffle, suffixes, tokens, windows
from runeflow.llm import hashing as H

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def plain():
    return [r for r in data.unique(data.rows())]


def test_windows(spark, plain):
    got = {r["doc_id"]: r for r in windows.remove_repeated_windows(data.docs(spark, plain)).collect()}
    text = {r[0]: WORD.findall(r[1] or "") for r in plain}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in text.values() for i in range(len(w) - 34))
    for d, w in text.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        runs = [(k[0], k[-1] + 1) for g, k in ((g, [i for i, _ in k]) for g, k in itertools.groupby(enumerate(gone), lambda x: x[1])) if g]
        r = got[d]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
        assert [tuple(s) for s in r["spans"]] == runs
    assert sum(r["n_removed"] for r in got.values()) > 1000


def test_suffixes(spark, plain):
    got = {r["doc_id"]: r for r in suffixes.remove_repeated_bytes(data.docs(spark, plain)).collect()}
    seen, total = set(), 0
    for d, text in sorted((r[0], r[1]) for r in plain):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), sum(gone), spans, kept)
        total += sum(gone)
    assert total > 5000


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, plain, k):
    rng = random.Random(5)
    extra = list(plain)
    base = data.words(rng, 100, 3000).split()
    for i in range(1000, 1060):  # a chain in which neighbours are alike and ends are not
        base[(i * 7) % 100] = f"c{i}"
        extra.append((i, " ".join(base).replace("w", "W", 3), "en", "s0", 0, *data.NONE))
    got = {r["doc_id"]: r for r in near.near_duplicates(data.docs(spark, extra), k=k).collect()}
    sets = {}
    for r in extra:
        w = WORD.findall((r[1] or "").lower())
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            of[y] = x
    for d, s in sets.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(s), root(d), root(d) == d)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for shared in (500, 1500, 2700):
        x, y = np.unique(a[:3000]), np.unique(np.r_[a[:shared], rng.integers(0, 2**64, 3000 - shared, dtype=np.uint64)])
        r = near.registers(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]))
        j = near.estimate(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(j - shared / (6000 - shared)) < 0.15
    whole = near.registers(np.unique(np.r_[x, y]), np.array([0, len(np.unique(np.r_[x, y]))]))
    assert (near.merge(r[0], r[1]) == whole[0]).all()


def test_decontamination_of_edited_copies(spark):
    rng = random.Random(2)
    items = [data.words(rng, rng.randrange(12, 60), 3000) for _ in range(40)]
    rows, want = [], set()
    for i in range(120):
        w = items[i % 40].split()
        for _ in range(i % 3 * len(w) // 10):
            w[rng.randrange(len(w))] = f"y{i}"
        rows.append((i, f"{data.words(rng, 100, 3000)} {' '.join(w).upper()}! {data.words(rng, 50, 3000)}"))
        want.add((i, i % 40))
    rows += [(200 + i, data.words(rng, 300, 3000)) for i in range(60)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == want


def test_decontamination_of_a_frequent_edited_copy(spark, monkeypatch):
    """One edited copy in many documents and one unedited leak: what the copy keeps is the frequent minority of the n-grams."""
    rng = random.Random(4)
    items = [f"{data.words(rng, 30, 3000)} and so on and on" for _ in range(12)]
    rows, want = [], set()
    for i, item in enumerate(items):
        w = item.split()
        for k in range(1, 30, 5):
            w[k] = f"y{i}"
            w[k + 2] = f"z{i}"
        copies = [item, *[" ".join(w)] * 20]
        want |= {(100 * i + k, i) for k in range(21)}
        rows += [(100 * i + k, f"{data.words(rng, 60, 3000)} {x} {data.words(rng, 20, 3000)}") for k, x in enumerate(copies)]
    rows += [(2000 + i, f"and so on and on {data.words(rng, 60, 3000)} and so on and on") for i in range(40)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == set(range(2000, 2040))
    it = decontaminate.read_items(list(range(len(items))), items)
    batch = decontaminate._Batch(pa.array([x for _, x in rows]), it)
    found = decontaminate.align(batch, it, decontaminate.seeds_of(it), 0.4)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    assert found == decontaminate.align(batch, it, decontaminate.seeds_of(it), 0.4) and {(rows[f[0]][0], f[1]) for f in found} == want


def test_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(2, 7, rng.integers(1, 14)).astype(np.uint64), rng.integers(2, 7, rng.integers(1, 10)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.smith_waterman(a[None], b[None])[0][0] == h.max()


def test_mixing(spark, plain):
    rows = mixing.mix(data.docs(spark, plain)).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in plain}
    source = {r[0]: r[3] for r in plain}
    total = collections.Counter()
    for d, s in source.items():
        total[s] += size[d]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, target, open_ = 1.5 * sum(total.values()), {}, set(names)
    while True:
        left = goal - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[source[r["doc_id"]]])
        assert math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 40
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(data.docs(spark, plain[::-1])).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_rates_are_exponential_tilts(spark):
    d = spark.createDataFrame([(i, "w " * (5 + i), "a" if i % 2 else "b") for i in range(80)], "doc_id long, text string, source string")
    by = collections.defaultdict(list)
    for r in mixing.mix(d, weights=(1.0, 3.0), share=1.0).collect():
        by[r["source_size"]].append((r["size"], r["rate"], r["target"]))
    for rs in by.values():
        assert math.isclose(sum(s * x for s, x, _ in rs), rs[0][2], rel_tol=1e-6)
        lam = [math.log(x) / s for s, x, _ in rs if x < 2]
        assert max(lam) - min(lam) < 1e-9


def naive_bits(s, a):
    """Code length of each symbol of a sequence under the tree fitted to it, context by context."""
    n = {k: collections.defaultdict(collections.Counter) for k in range(language.ORDER + 1)}
    for i in range(len(s)):
        for k in range(min(i, language.ORDER) + 1):
            n[k][tuple(s[i - k : i])][s[i]] += 1
    states = {c for k in n for c, v in n[k].items() if k == 0 or sum(v.values()) >= language.LEAST}

    def prob(c):
        v = n[len(c)][c]
        low = prob(c[1:]) if c else np.full(a, 1 / a)
        p, total, d = np.zeros(a), sum(v.values()), len(v)
        unseen = [x for x in range(a) if x not in v]
        left = sum(low[x] for x in unseen)
        d = d if left > 0 else 0
        for x in range(a):
            p[x] = v[x] / (total + d) if x in v else low[x] / left * d / (total + d)
        return p

    def cost(t):
        out = 0.0
        for i in range(len(t)):
            k = next(k for k in range(min(i, language.ORDER), -1, -1) if tuple(t[i - k : i]) in states)
            p = prob(tuple(t[i - k : i]))
            assert abs(p.sum() - 1) < 1e-9
            out -= math.log2(p[t[i]])
        return out

    return cost


def test_context_trees():
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "then", "other", "hand", "er", "and"]) for _ in range(150))
    m = language.fit([("x", text)])
    s = m.code[language.folded(np.frombuffer((text + "\n").encode(), np.uint8))].tolist()
    cost = naive_bits(s, m.symbols)
    for t in ("the hand", "other", "qqq the", text, ""):
        data_, off = common.utf8(pa.array([t, "and then", t]))
        want = cost(m.code[language.folded(np.frombuffer(t.encode(), np.uint8))].tolist())
        got = language.code_lengths(m, data_, off)[:, 0]
        assert math.isclose(got[0], want, rel_tol=1e-4, abs_tol=1e-3) and got[0] == got[2]


def test_language_held_out(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "eit"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(20)), k) for i, k in ((i, ("aa", "bb")[i % 2]) for i in range(200))]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] == rows[r["doc_id"]][2] and 0 <= r["score"] <= 1


def test_forward_backward():
    rng = np.random.default_rng(7)
    first = np.array([0, 1, 4, 9])
    e, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs, z = quality.forward_backward(e, first, moves)
    all_pairs = np.zeros((2, 2))
    for t in range(3):
        a, b = first[t], first[t + 1]
        ways = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([math.exp(sum(e[a + i] * y for i, y in enumerate(ys)) + sum(moves[p, q] for p, q in itertools.pairwise(ys))) for ys in ways])
        assert math.isclose(z[t], math.log(w.sum()))
        for i in range(b - a):
            assert math.isclose(good[a + i], sum(x for x, ys in zip(w, ways, strict=True) if ys[i]) / w.sum())
        for x, ys in zip(w / w.sum(), ways, strict=True):
            for p, q in itertools.pairwise(ys):
                all_pairs[p, q] += x
    assert np.allclose(pairs, all_pairs)


def test_quality_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        lines = [" ".join(f"{'Tree' if k == 0 else 'leaf'}{chr(97 + rng.randrange(26))}" for k in range(9)) + "." if good else "!!! ### " * 5 for _ in range(4)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r["predicted"] == labels[r["doc_id"]][1] == (r["score"] >= 0.3) for r in got)


def test_tokens(spark, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    uri = f"{common.shared_dir(spark)}/ids"
    manifest = tokens.write_tokens(data.docs(spark, plain), tokens.default_tokenizer(), uri)
    got, start = {r["doc_id"]: r for r in tokens.read_tokens(manifest, uri).collect()}, 0
    for r in sorted(plain):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        g = got[r[0]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.lookup(manifest, uri, 62).tolist()[:-1] == t.encode(plain[62][1], add_special_tokens=False).ids
    assert tokens.lookup(manifest, uri, 10**9) is None


def test_lookup_reads_as_much_in_any_shard():
    """Every key is found by seeks, others aren't; the bytes read don't grow with the shard."""

    class File:
        def __init__(self, raw):
            self.raw, self.n = raw, 0

        def read_at(self, n, at):
            self.n += n
            return self.raw[at : at + n]

    most = []
    for n in (1, 200, 20_000):
        keys = np.sort(np.random.default_rng(n).choice(10**9, n, False)).astype(np.int64)
        size = np.arange(n) % 5
        starts = np.r_[0, np.cumsum(size)]
        ids = (np.arange(starts[-1]) % 60_000).astype("<u2")
        raw = tokens.shard_bytes(ids, starts, keys, np.ones(n, bool), 2)
        read = []
        for k in range(0, n, max(1, n // 300)):
            f = File(raw)
            assert tokens.lookup_in(f, int(keys[k])).tolist() == ids[starts[k] : starts[k + 1]].tolist()
            read.append(f.n)
        most.append(max(read))
        assert sum(tokens.lookup_in(File(raw), int(k)) is not None for k in range(-300, 0)) == 0
    assert max(most) < 1200 and len(raw) > 500_000


def test_encoder_on_odd_white_space():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    parts = ["a", "B", "é", " ", " ", "\n", "\t", " ", ".", "'s", "1", "<|endoftext|>", " ", "日", "!!", "\x1c", "\x85", "\r", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None]
    t, enc = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    ids, starts = enc.encode(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    mph = tokens.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(5000))


def _replayed(spark, d, shards, bucket_bytes):
    """Scatter and Fisher-Yates, record by record, with a Mersenne twister of its own."""
    names = [c for c in d.columns if c not in ("shard", "slot")]
    n_rows, total = d.count(), sum(len((r["text"] or "").encode()) + shuffle.ROW_BYTES for r in d.collect())
    n = max(shuffle.LEAST, -(-total // bucket_bytes))
    hashed = shuffle._hashed(d, names, "text", shuffle.SEED).selectExpr("*", f"cast(pmod(h1, {n}) as int) as bucket").selectExpr("*", f"pmod(hash(bucket), {n}) as part")
    parts = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in hashed.collect():
        parts[r["part"]][r["bucket"]].append((r["h1"], r["h2"], r["record"]["doc_id"], r["record"]["text"]))
    buckets = {}
    for part, own in parts.items():
        seed = shuffle.SEED + part
        rng = np.random.RandomState(np.array([seed >> 32, seed & 0xFFFFFFFF], np.uint32))

        def below(n, rng=rng):
            while True:
                bits = int(rng.randint(0, 2**32, dtype=np.uint32)) >> 1
                if n & (n - 1) == 0:
                    return (n * bits) >> 31
                if bits - bits % n + n - 1 < 2**31:
                    return bits % n

        for bucket in sorted(own):
            rows = sorted(own[bucket])
            order = list(range(len(rows)))
            for i in range(len(rows)):  # inside out
                j = below(i + 1)
                order[i], order[j] = order[j], order[i]
            buckets[bucket] = [rows[i] for i in order]
    every = [x for b in sorted(buckets) for x in buckets[b]]
    first = [-(-s * n_rows // shards) for s in range(shards + 1)]
    return {(s, p - first[s]): every[p][2:] for s in range(shards) for p in range(first[s], first[s + 1])}


def test_shuffle(spark, plain):
    """Scatter and Fisher-Yates replayed; the same places however the input is laid out."""
    d = data.docs(spark, plain)
    want = _replayed(spark, d, 7, 4000)
    assert len(want) == len(plain)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        for x in (d, d.repartition(5, "doc_id"), d.repartition("doc_id"), d.coalesce(1)):
            got = shuffle.shuffled_shards(x, f"{common.shared_dir(spark)}/shards", shards=7, bucket_bytes=4000).collect()
            assert {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shuffle_of_a_record_that_fills_the_table(spark):
    """A third of the rows, and more, are one and the same record."""
    rows = [(1, "same", "a", "b", 4)] * 3000 + [(None, None, None, None, None)] * 800 + [(i, f"text {i}", "a", "b", 6) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    n = -(-sum(len(r[1] or "") + shuffle.ROW_BYTES for r in rows) // 8000)
    got = [shuffle.shuffled_shards(x, f"{common.shared_dir(spark)}/shards", shards=7, bucket_bytes=8000).collect() for x in (d, d.repartition("lang"))]
    a, b = ({(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in g} for g in got)
    assert a == b and len(got[0]) == len(a) == len(rows)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(a.values(), key=key) == sorted((r[:2] for r in rows), key=key)
    in_shard = collections.Counter(s for s, _ in a)
    assert max(in_shard.values()) - min(in_shard.values()) <= 1 and all((s, k - 1) in a for s, k in in_shard.items())
    hot = collections.Counter(s for (s, _), r in a.items() if r == (1, "same"))
    assert n > 40 and min(hot.values()) > 3000 / 7 * 0.8


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32)) * rng.choice([0.5, 1.0, 3.0], (3000, 1))
    v[2000:] = v[5]  # a third are one vector
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(d, k=10, query="vec_id % 50 = 0").collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = []
    for q in range(0, 3000, 50):
        s = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        hits.append(len(set(want) & set(got[q])) / 10)
        assert len(got[q]) == 10 and all(math.isclose(s[i], x, rel_tol=1e-12, abs_tol=1e-12) for i, x in got[q].items())
    assert np.mean(hits) >= 0.9


def test_window_hashes_are_of_content():
    data_, off = common.utf8(pa.array(["a b c d", "x a b c d", ""]))
    w = H.Words(data_, off)
    h = H.word_hashes(data_, w)
    assert w.count.tolist() == [4, 5, 0] and (h[:4] == h[5:9]).all() and H.windows(h[:4], 4)[0] == H.windows(h[5:9], 4)[0]
    assert hashlib.sha256(h.tobytes()).hexdigest() == hashlib.sha256(H.word_hashes(data_, w).tobytes()).hexdigest()
