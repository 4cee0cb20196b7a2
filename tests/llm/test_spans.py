import random

import numpy as np
import pytest

from wakegraph.llm import spans


def brute(texts, length):
    own, shared = {}, set()
    for d, (_, t) in enumerate(texts):
        for i in range(len(t or "") - length + 1):
            if own.setdefault(t[i : i + length], d) != d:
                shared.add(t[i : i + length])
    out = {}
    for d, (i, t) in enumerate(texts):
        if t and len(t) >= length:
            covered = bytearray(len(t))
            for k in range(len(t) - length + 1):
                if t[k : k + length] in shared:
                    covered[k : k + length] = b"\1" * length
            n = sum(1 for a, b in zip(b"\0" + bytes(covered), covered) if b and not a)
            out[i] = (len(t), n, sum(covered))
    return out


def corpus(seed):
    random.seed(seed)
    letters = "abcdefgh é日\U0001f600\n"
    word = lambda n: "".join(random.choice(letters) for _ in range(n))
    block = [word(n) for n in (32, 33, 40, 47, 31, 100, 15)]
    texts = []
    for i in range(60):
        t = word(random.randrange(60))
        for _ in range(random.randrange(3)):
            b = random.choice(block)
            a = random.randrange(0, 12)
            t += b[a if random.random() < 0.4 else 0 :] + word(random.randrange(30))
        texts.append((i, t))
    hot = word(36)
    texts += [(100 + i, word(i % 9) + hot + word(i % 7)) for i in range(40)]
    return texts + [(200, texts[0][1]), (201, "a" * 90), (202, "ab" * 30), (203, "a" * 31), (204, ""), (205, None), (206, "b" * 500), (207, texts[5][1]), (208, "a" * 40 + "c")]


@pytest.mark.parametrize("limit", [spans.FILTER_LIMIT, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, limit):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, cls int, gram string")
    want = brute(texts, 32)
    job = spans.SharedSpans(docs, length=32, gram=16, filter_limit=limit)
    assert {r.doc_id for r in job.found().collect()} == {d for d, (_, n, _) in want.items() if n}
    rows = {r.doc_id: r for r in job.coverage().collect()}
    assert {d: (r.n_chars, r.n_spans, r.shared_chars) for d, r in rows.items()} == want
    assert all(abs(r.shared_part - r.shared_chars / r.n_chars) < 1e-12 for r in rows.values())


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 256)
    random.seed(9)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    shared = word(70)
    texts = [(1, word(240) + shared + word(900)), (2, word(500) + shared), (3, word(2000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # pieces are cut in this process only, so the work of the tasks is called directly
    got = [w for w, _ in spans._windows([t for _, t in texts], 64, 32)]
    assert len(got) > 3
    assert {r.doc_id for r in spans.SharedSpans(docs, 64, 32).found().collect()} == {1, 2}


def test_compact_windows_are_those_of_the_cartesian_tree():
    random.seed(3)
    for width in (1, 4, 9):
        h = np.array([random.randrange(40) << 40 for _ in range(120)], np.uint64)
        want = set()
        todo = [(0, len(h) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= width:
                c = a + int(np.argmin(h[a : b + 1]))
                want.add((max(a, c - width + 1), c, min(b, c + width - 1)))
                todo += [(a, c - 1), (c + 1, b)]
        assert {tuple(map(int, x)) for x in zip(*spans.compact_windows(h, width))} == want


def test_nothing_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spans.SharedSpans(docs).found().count() == 0 and spans.SharedSpans(docs).coverage().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(docs, 20, 64)
