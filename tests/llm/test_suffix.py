"""Repeated-string removal against a count of all windows."""

import collections
import hashlib
import random

import pytest

from heddle.llm import suffix
from tests.llm.conftest import frame


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(20, 120)) for _ in range(4)]
    base = text(300).split()
    texts = [None, "", "short", "a" * 900, "ab" * 700, "xyz" * 66 + "xy", "xyz" * 70]
    for _ in range(60):
        texts.append(" ".join([text(rng.randint(0, 60)), rng.choice(passages), text(rng.randint(0, 60)), rng.choice(["", rng.choice(passages)])]))
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + texts[10:14]


def rows(found):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 512, 1 << 20), (2, 3, 1 << 20), (3, 512, 700)])
def test_against_all_windows(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(suffix, "HOT", hot)  # few stretches make a key hot: the other path
    monkeypatch.setattr(suffix, "PIECE", piece)
    texts = corpus(seed)
    got = rows(suffix.remove_repeats(frame(spark, texts).repartition(3)))
    want = brute(texts, 200)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_edges(spark, empty):
    assert suffix.remove_repeats(empty).collect() == []
    same = suffix.remove_repeats(frame(spark, ["x y z " * 50] * 2, [1, 1])).collect()
    assert len(same) == 2 and same[0] == same[1] and same[0]["n_removed"] == 300
    texts = ["a" * 250, None, "x" * 199, "é" * 150 + "z", "b" * 250, "a" * 250, "é" * 150, "c" * 50 + "\0" * 260, "\0" * 220]
    assert rows(suffix.remove_repeats(frame(spark, texts))) == dict(enumerate(brute(texts, 200)))
    ids = suffix.remove_repeats(frame(spark, ["q w " * 60, "q w " * 60, "q w " * 70], [None, None, 4])).collect()
    assert sorted(r["n_removed"] for r in ids) == [240, 240, 280]


def test_many_copies_and_a_very_long_text(spark, monkeypatch):
    """A text that most rows hold, and one of millions of bytes that holds it too."""
    rng = random.Random(4)
    hot, long = "".join(rng.choices("abcdef ", k=400)), "".join(rng.choices("abcdefgh ", k=3_000_000))
    texts = [*[hot] * 300, long + hot, *(f"{i} " * 80 + hot[:250] for i in range(40)), long[1_000_000:1_000_300]]
    got = rows(suffix.remove_repeats(frame(spark, texts).repartition(4)))
    assert all(got[i][1] == 400 for i in range(300)) and got[300][:3] == (3_000_400, 700, 2)
    assert got[341][1] == 300 and [got[i][1] for i in range(301, 341)] == [w[1] for w in brute([hot, *texts[301:341]], 200)[1:]]


def test_same_windows():
    """Windows by sorted suffixes and common prefixes against all windows by their bytes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, span = int(rng.integers(2, 40)), 24
        key, most = np.sort(rng.integers(0, 3, n)), rng.integers(0, 9, n)
        least, place = np.array([rng.integers(0, m + 1) for m in most]), rng.integers(50, 1000, n)
        base = rng.integers(0, 2, 40).astype(np.uint8)
        contents = []
        for i in range(n):  # parts of one string around its place 10, with few bytes changed
            data = base[10 - most[i] : 10 - least[i] + span].copy()
            data[rng.integers(0, len(data), rng.integers(0, 2))] ^= 1
            contents.append(data.tobytes())
        seen = collections.defaultdict(set)
        for i in range(n):
            for j in range(least[i], most[i] + 1):
                seen[key[i], j, contents[i][most[i] - j : most[i] - j + span]].add(i)
        want = collections.defaultdict(set)
        for (_, j, _), rows_of in seen.items():
            if len(rows_of) > 1:
                for i in rows_of:
                    want[i] |= set(range(place[i] - j, place[i] - j + span))
        got = collections.defaultdict(set)
        for i, a, b in zip(*suffix.same_windows(key, place, least, most, contents, span), strict=True):
            got[i] |= set(range(a, b))
        assert got == want


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        columns = [rng.integers(0, 4, n) for _ in range(3)]
        order = suffix.multikey_order(columns)
        got = list(zip(*(c[order] for c in columns), strict=True))
        assert got == sorted(zip(*columns, strict=True))
