"""Token counts, packing, decontamination, SimHash, sharding and the pipeline, against plain Python."""

import collections
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from heddle.llm import jaccard, packing, sharding, simhash, suffix, tokens, wumanber
from tests.llm.conftest import frame, noise

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "bc", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "😀", "'s", "'LL", "<|endoftext|>", "<|", "!", "...", " ", "\x85", "\x1c", "the", " and", "中文"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts_of(seed):
    return [None, "", " ", "a" * 5000, "ab" * 3000, " " * 400, *noise(PIECES, 200, 80, seed)]


def test_token_counts(spark, empty, library):
    texts = texts_of(5)
    rows = {r["doc_id"]: r for r in tokens.token_counts(frame(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(rows[i]) == (i, len((t or "").encode()), n, n > 512)
    assert tokens.token_counts(empty, PATH).collect() == []
    twice = tokens.token_counts(frame(spark, ["ab cd"] * 2, [1, 1]), PATH).collect()
    assert twice[0] == twice[1]


def test_long_pretokens(spark, library):
    """Unspaced texts: the same ids as the library's, in time that grows with the text."""
    rng = random.Random(20)
    texts = ["".join(rng.choices(a, k=n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "ACGT", "中文字语", ".-=", "aé") for n in (191, 192, 193, 500, 4000)]
    rows = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame(spark, texts), PATH).collect()}
    assert [rows[i] for i in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    began = time.time()
    long = tokens.token_counts(frame(spark, ["".join(rng.choices("abcdefgh", k=1_000_000)), "a" * 1_000_000, "x " * 2_500_000]), PATH).collect()
    assert time.time() - began < 60 and all(r["n_tokens"] > 10_000 for r in long)


def test_packing(spark, empty, library):
    texts = [*texts_of(6), *(" ".join(map(str, range(n))) for n in (300, 2000))]
    found = packing.pack(frame(spark, texts).repartition(3), PATH).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0  # no padding anywhere
        short += at < 1024
    assert short <= 3 * 10
    assert packing.pack(empty, PATH).collect() == []
    twice = packing.pack(frame(spark, ["same text"] * 2, [1, 1]), PATH).collect()
    assert sum(r["length"] for r in twice) == sum({r["doc_id"]: 2 * r["doc_tokens"] for r in twice}.values())


def test_harmonic_classes(monkeypatch):
    """Bins hold their class's count of whole documents; few documents are cut, and no sequence is padded."""
    rng = random.Random(16)
    for waiting in (256, 4):
        monkeypatch.setattr(packing, "WAITING", waiting)
        bins, rows, sizes = packing.Bins(1024, 0), [], []
        for doc in range(3000):
            sizes.append(int(rng.paretovariate(0.9) * 20) if doc % 50 else rng.choice([1, 512, 1024, 1025, 5000]))
            rows += bins.add((doc, 0, bytes(4 * sizes[-1]), sizes[-1]))
            assert len(bins.waiting) <= waiting + 1 and all(len(g) < k for k, g in bins.open.items())
        rows += list(bins.close())
        by_doc, by_sequence = collections.Counter(), collections.Counter()
        for doc, _, n, _, _, sequence, _ in rows:
            by_doc[doc] += n
            by_sequence[sequence] += n
        assert all(by_doc[d] == n for d, n in enumerate(sizes))
        assert sum(n < 1024 for n in by_sequence.values()) <= 10 and all(n & (n - 1) == 0 for n in by_sequence.values())
        pieces = collections.Counter(r[0] for r in rows)
        short = [d for d, n in enumerate(sizes) if n <= 1024]
        if waiting == 256:
            assert sum(pieces[d] for d in short) / len(short) < 1.1


WORDS = [*"abcdefgh", "é", "Übung", "X1", "the", "of"]


def item_words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, empty):
    rng = random.Random(7)
    sentence = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for i in range(40)] + [(50, None), (51, ""), (52, "!?"), (None, "a b"), (3, "the of the"), (60, sentence(30))]
    texts = [None, "", "!!", *(sentence(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + sentence(rng.randint(0, 20)) for _ in range(300))]
    owners = collections.defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            owners[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(k) for k in owners}
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block, most in ((32 << 20, 64 << 20), (200, 64 << 20), (300, 1500)):  # one block, several, and several passes
        rows = {r["doc_id"]: r for r in wumanber.decontaminate(frame(spark, texts), benchmark, block_bytes=block, most_bytes=most).collect()}
        for i, t in enumerate(texts):
            w, hit, own = item_words(t), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if found := owners.get(tuple(w[k : k + n])):
                        own |= found
                        hit |= set(range(k, k + n))
            want = (i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
            assert tuple(rows[i]) == want, t
    assert len(list(wumanber.groups(benchmark, 10, "item_id", "text", 1500, 300))) > 2
    for most in (64 << 20, 1500):
        clean = wumanber.uncontaminated(frame(spark, texts), benchmark, block_bytes=300, most_bytes=most)
        assert clean.columns == frame(spark, []).columns
        assert {r["doc_id"] for r in clean.collect()} == {i for i in rows if not rows[i]["contaminated"]}
    assert wumanber.uncontaminated(empty, benchmark).collect() == []
    assert wumanber.decontaminate(empty, benchmark).collect() == []
    assert not any(r["contaminated"] for r in wumanber.decontaminate(frame(spark, texts[:9]), benchmark.limit(0)).collect())
    twice = wumanber.decontaminate(frame(spark, [texts[9]] * 2, [9, 9]), benchmark.unionAll(benchmark)).collect()
    assert twice[0] == twice[1] == rows[9]
    long = wumanber.decontaminate(frame(spark, ["a b " * 700_000 + items[-1][1]]), benchmark).first()
    assert long["n_items"] >= 1 and long["n_words"] == 1_400_030


def test_merged_runs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sets = [np.zeros(40, dtype=bool) for _ in range(2)]
        for s in sets:
            for a, n in zip(rng.integers(0, 38, 3), rng.integers(0, 6, 3), strict=True):
                s[a : a + n] = True
        runs = [np.flatnonzero(np.diff(np.r_[False, s, False])) for s in sets]
        both = wumanber.merged(*runs)
        assert [i for a, b in both.reshape(-1, 2) for i in range(a, b)] == np.flatnonzero(sets[0] | sets[1]).tolist()


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(values))]


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(250)] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        out.append(" ".join(w))
    return out


def test_simhash(spark, empty):
    texts = [None, "", " \n", "one", "One", "two words", *near_copies(8, 150, 4), *noise(["A ", "b ", "c\t", "é\n"], 60, 30, 9)]
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 50
    assert simhash.simhash_groups(empty).collect() == []
    long = " ".join(f"w{k % 90_000}" for k in range(400_000))
    both = simhash.simhash_groups(frame(spark, [long, long + " x", None, ""], [7, 3, 8, 2])).collect()
    assert {r["doc_id"]: r["component_id"] for r in both} == {7: 3, 3: 3, 8: 2, 2: 2}
    twice = simhash.simhash_groups(frame(spark, ["same text here", "same text here"], [4, 4])).collect()
    assert [r["component_id"] for r in twice] == [4, 4]


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_block_keys_lose_no_pair(spark, monkeypatch, blocks):
    """Fingerprints at three bits share a key, and the groups are those of fewer blocks; keys widen with the rows."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, size=500, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    keys = simhash.block_keys(blocks, 3)
    a, b = keys(x[:, None]), keys(y[:, None])
    assert (a == b).any(axis=1).all() and len({*map(int, a.reshape(-1))}) > 450
    assert [simhash.blocks_for(n, 3) for n in (0, 10**5, 10**8, 10**12)] == [4, 4, 5, 6]
    texts = near_copies(8, 120, 4)
    monkeypatch.setattr(simhash, "blocks_for", lambda rows, most: blocks)
    prints = [brute_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def test_gray_index():
    rng = np.random.default_rng(3)
    for _ in range(15):
        n = int(rng.integers(2, 300))
        base = rng.integers(0, 1 << 63, size=(4, 2), dtype=np.uint64)
        prints = base[rng.integers(0, 4, n)].copy()
        for _ in range(4):
            prints[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        bucket = np.sort(rng.integers(0, 3, n))
        a, b = simhash.GrayIndex(bucket, prints).link(3, at_once=29)
        links = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        index = list(range(n))
        want = brute_components(index, lambda x, y: bucket[x] == bucket[y] and int(simhash.apart(prints[x], prints[y])) <= 3)  # noqa: B023
        assert brute_components(index, lambda x, y: frozenset((x, y)) in links) == want  # noqa: B023


def test_near_duplicate_recall(spark):
    """Pairs at a similarity of 0.8 or more are found; unrelated documents stay apart."""
    texts = near_copies(10, 200, 7)
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similar(shingles[a], shingles[b])]
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.95 * len(pairs)
    apart = [(a, b) for a in range(len(texts)) for b in range(a) if not shingles[a] & shingles[b]]
    assert not any(group[a] == group[b] for a, b in apart)
    kept = simhash.one_of_each(frame(spark, [*texts, texts[0]], [*range(len(texts)), 0])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(group.values()))


def test_one_of_each_with_repeated_ids(spark, empty):
    """Distinct texts that share a doc_id stay, wholly equal rows become one, and rows without a doc_id stay."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six", "Seven eight nine ten eleven twelve", "a b c d e f g", "a b c d e f g", None, ""]
    ids = [1, 1, 1, 5, None, None, 9, 8]
    kept = simhash.one_of_each(frame(spark, texts, ids))
    assert kept.columns == empty.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == [(0, texts[4]), (0, texts[5]), (1, texts[0]), (1, texts[1]), (8, "")]
    assert simhash.one_of_each(empty).collect() == []
    long = " ".join(f"w{i}" for i in range(200_000))
    assert len(simhash.one_of_each(frame(spark, [long, long + " x", "short"])).collect()) == 2


def jaccard_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in texts)]
    return brute_components(sets, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))


def found_groups(spark, texts):
    rows = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    return [g for _, g in sorted((r["doc_id"], r["component_id"]) for r in rows)]


def test_near_duplicates_are_verified(spark):
    """A text below 0.8 to all others of its family stays apart, however near its fingerprint is."""
    texts = [None, "", " ", "one", "ONE", *near_copies(16, 250, 14), *near_copies(17, 60, 3)]
    want = jaccard_groups(texts)
    assert 40 < len(set(want)) < 250
    assert found_groups(spark, texts) == want


def test_near_duplicates_lose_no_pair(spark, monkeypatch):
    """Isolated pairs at 0.8 exactly, just above and just below it, each alone with its words."""
    texts = []
    for k, cut in enumerate([20, 20, 19, 15, 21, 25] * 50):
        words = [f"p{k}x{i}" for i in range(104)]  # a hundred shingles
        texts += [" ".join(words), " ".join(words[: 104 - cut])]  # the second has 100 - cut of them
    want = jaccard_groups(texts)
    assert sum(a == b for a, b in zip(want[::2], want[1::2], strict=True)) == 200
    assert found_groups(spark, texts) == want
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def set_print(text):
    """The fingerprint of a set of five-word shingles, bit by bit."""
    w = text.lower().encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("bound", [Fraction(4, 5), Fraction(97, 100)])
def test_near_duplicates_by_fingerprints(spark, monkeypatch, bound):
    """Without the search by rare shingles just the pairs stay linked whose fingerprints are near and that are similar; with it, all that are similar."""
    monkeypatch.setattr(simhash, "BOUND", bound)
    texts = []
    for k in range(120):  # each pair is alone with its words
        words = [f"p{k}x{i}" for i in range(400)]
        texts += [" ".join(words), " ".join(words[: 400 - k % 40])]
    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    near = [(set_print(a) ^ set_print(b)).bit_count() <= 3 for a, b in pairs]
    alike = [Fraction(len(b.split()) - 4, len(a.split()) - 4) >= bound for a, b in pairs]
    assert all(sum(n == x and a == y for n, a in zip(near, alike, strict=True)) > 5 for x, y in ((True, True), (False, True)))

    def linked():
        group = found_groups(spark, texts)
        return [a == b for a, b in zip(group[::2], group[1::2], strict=True)]

    assert linked() == alike
    every = jaccard.prefixes
    monkeypatch.setattr(jaccard, "prefixes", lambda sets, similarity: every(sets, similarity).where("false"))
    assert linked() == [n and a for n, a in zip(near, alike, strict=True)]


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = near_copies(18, 200, 12)
    assert found_groups(spark, texts) == jaccard_groups(texts)


@pytest.mark.parametrize("leaders", [1, 3])
def test_large_parts_make_no_cells(spark, monkeypatch, leaders):
    """Large groups of near copies, connected by their leaders, beside texts that share their rare words and are not similar."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rng = random.Random(19)
    base = [[f"b{k}x{i}" for i in range(120)] for k in range(2)]
    texts = []
    for k in range(2):
        for _ in range(60):
            words = list(base[k])
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        for cut in (40, 60, 90, 95, 100):  # chains to the large part, some by links of their own
            texts += [" ".join(base[k][:cut] + [f"s{k}{cut}{i}" for i in range(120 - cut)]), " ".join(base[k][120 - cut :])]
    texts += [" ".join(base[0][:60] + base[1][:60]), " ".join(base[0][:60] + base[1][:62])]
    want = jaccard_groups(texts)
    assert found_groups(spark, texts) == want
    assert max(collections.Counter(want).values()) >= 60


def test_sharding(spark, empty):
    texts = [None, "", *noise(PIECES, 3000, 60, 11), *["hot group of copies"] * 1500, *["another group"] * 40]
    rows = sharding.shard_documents(frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = collections.defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r["shard"]].append(r)
    assert set(by) == set(range(16))
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    sizes = [sum(r["size"] for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 0.02 * max(sizes)
    homes = collections.defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]] or ""].add(r["shard"])
    assert {t for t, s in homes.items() if len(s) > 1} <= {"hot group of copies"}  # larger than a shard's share
    assert sharding.shard_documents(empty).collect() == []
    twice = sharding.shard_documents(frame(spark, ["same"] * 3 + ["x" * 1_000_000], [1, 1, 1, None])).collect()
    assert len(twice) == 4 and sorted((r["shard"], r["slot"]) for r in twice) == sorted({(r["shard"], r["slot"]) for r in twice})


def test_sharding_by_groups_alone(spark, monkeypatch):
    """Groups stay whole if asked to, a key of many rows is salted, and tasks and their number change nothing."""
    monkeypatch.setattr(sharding, "ROWS_IN_CELL", 40)
    monkeypatch.setattr(sharding, "GROUPS_IN_CELL", 100)
    texts = [*noise(PIECES, 1500, 60, 11), *[""] * 700, *["hot group of copies"] * 900]
    found = {}
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        docs = frame(spark, texts).repartition(parts)
        found[parts] = [sorted(map(tuple, sharding.shard_documents(docs, most_share=m).drop("grown_shard").collect())) for m in (1.0, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[1] == found[5]
    homes = collections.defaultdict(set)
    for doc_id, _, _, _, shard, _ in found[1][1]:
        homes[texts[doc_id]].add(shard)
    assert all(len(s) == 1 for s in homes.values())


def test_best_fit_decreasing():
    rng = random.Random(12)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        bins, room = sharding.best_fit_decreasing(sizes, [], 60)
        used = collections.Counter()
        for b, s in zip(bins, sizes, strict=True):
            used[b] += s
        assert all(used[b] + room[b] == 60 and room[b] >= 0 for b in range(len(room)))
        # the plain rule, by scanning all bins
        left = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, k) for k, r in enumerate(left) if r >= s]
            if fits:
                left[min(fits)[1]] -= s
            else:
                left.append(60 - s)
        assert sorted(left) == sorted(room)


def test_long_texts_are_cut_between_windows(monkeypatch):
    """Cutting a text for memory's sake leaves every window's sample as it was."""
    rng = random.Random(13)
    text = "".join(rng.choices("abc ", k=6000)).encode()

    def windows():
        out = {}
        for docs, at, ends, buffer in suffix.pieces([5], [text], 200):
            found = suffix.stretches(docs, at, ends, buffer, 200)
            for place, least, most in zip(*(found[c].tolist() for c in ("place", "least", "most")), strict=True):
                for d in range(least, most + 1):
                    assert place - d not in out
                    out[place - d] = place
        return out

    whole = windows()
    assert set(whole) == set(range(len(text) - 199))
    monkeypatch.setattr(suffix, "PIECE", 700)
    assert windows() == whole


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(20)
    texts = [prose(rng.randint(40, 200)) for _ in range(30)]
    texts += [texts[0], texts[1].upper(), " ".join(texts[2].split()[:-1] + ["changed"]), "short", None, "spam again and again " * 30, f"{prose(30)} {item} {prose(30)}", f"{prose(40)} mail x.y@example.com now {prose(20)}"]
    frame(spark, texts).select("doc_id", "text", "lang").selectExpr("*", "'s' AS source", "cast(length(text) AS long) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    everything = set(range(len(texts)))
    assert everything - set(kept[0]) == {33, 34, 35}
    assert set(kept[0]) - set(kept[1]) == {30, 31, 32}
    assert set(kept[1]) - set(kept[2]) == {36}
    assert set(kept[3]) == set(kept[2]) and "<EMAIL>" in kept[3][37]
    assert {i: t for i, t in kept[3].items() if i != 37} == {i: t for i, t in kept[2].items() if i != 37}
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(kept[3])
