import random

import pytest

from tapeloom.llm import fmindex, spans


def runs_by_hand(texts, least):
    out = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            x, y = texts[a], texts[b]
            for i in range(len(x)):
                for j in range(len(y)):
                    if i and j and x[i - 1] == y[j - 1]:
                        continue
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    if n >= least:
                        out.add((a, i, b, j, n))
    return out


def windows_by_hand(texts, least):
    """(text, start) of every window that another text holds."""
    places = {}
    for t, x in enumerate(texts):
        for i in range(len(x) - least + 1):
            places.setdefault(x[i : i + least], set()).add((t, i))
    return {p for found in places.values() if len({t for t, _ in found}) > 1 for p in found}


def made(seed, n=10, alphabet="abé漢"):
    random.seed(seed)
    passages = ["".join(random.choice(alphabet) for _ in range(40)) for _ in range(3)]
    texts = []
    for _ in range(n):
        s = "".join(random.choice("xyz") for _ in range(random.randint(0, 15)))
        for _ in range(random.randint(0, 3)):
            p, i, j = random.choice(passages), random.randint(0, 10), random.randint(20, 40)
            s += p[i:j] + random.choice("xyz")
        texts.append(s)
    return texts


@pytest.mark.parametrize("stream", [512, 3])
@pytest.mark.parametrize("least", [4, 5, 14, 16, 31])
@pytest.mark.parametrize("seed", range(4))
def test_index_against_brute_force(monkeypatch, seed, least, stream):
    monkeypatch.setattr(fmindex, "STREAM", stream)
    texts = made(seed) + ["", "x"]
    text, at, of, length, hashes = fmindex.classes(texts, least)
    windows = [(t, a + k) for t, a, c in zip(text, at, of) for k in range(length[c] - least + 1)]
    assert len(windows) == len(set(windows)) and set(windows) == windows_by_hand(texts, least)
    content = {}
    for t, a, c in zip(text, at, of):
        content.setdefault(c, set()).add(texts[t][a : a + length[c]])
    assert all(len(x) == 1 for x in content.values()) and len(set(hashes)) == len(hashes) == len(content)


def test_more_signs_than_two_bytes_number():
    rare = "".join(map(chr, range(0x10000, 0x10000 + 66_000)))
    text, at, of, length, _ = fmindex.classes([rare + "abcdefgh", "x" + rare[500:700], "abcdefgh" + rare[:3]], 8)
    assert {(t, a, length[c]) for t, a, c in zip(text.tolist(), at.tolist(), of)} == {(0, 500, 200), (1, 1, 200), (0, 66_000, 8), (2, 0, 8)}


def test_a_popular_notice_costs_a_row_a_text():
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    notice, rows = word(300), []
    for n in (500, 1000, 2000):
        text, *_ = fmindex.classes([word(30) + notice + word(30) for _ in range(n)], 200)
        rows.append(len(text))
    # The notice itself, and the few that have a letter or two beside it in common.
    assert all(n <= r <= 8 * n for n, r in zip((500, 1000, 2000), rows))


@pytest.mark.parametrize("seed", range(4))
def test_every_window_has_a_fingerprint(seed):
    random.seed(seed)
    texts = ["".join(random.choice("ab") for _ in range(n)) for n in (0, 9, 30, 200)]
    text, at, h = spans.winnow(texts, 12)
    for k, t in enumerate(texts):
        mine = at[text == k]
        assert all(any(i <= p <= i + 6 for p in mine) for i in range(len(t) - 11))


@pytest.mark.parametrize("chars", [10**6, 300, 60])
def test_operator_against_brute_force(spark, chars):
    texts = [*made(7, 14), None, "", "q" * 5000, "q" * 5000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[0], "n")], "doc_id long, text string, n_chars string")
    found, classes = spans.shared_spans(df, least=14, shard_chars=chars)
    pairs = {tuple(r) for r in spans.document_pairs(found, classes, 14).collect()}
    whole = [t or "" for t in texts]
    want = {(a, b) for a, i, b, j, n in runs_by_hand(whole[:14], 14)} | {(a, b) for a in range(14) for b in range(a + 1, 14) if whole[a] == whole[b] and len(whole[a]) >= 14}
    assert pairs == want | {(16, 17)}
    for r in found.collect():
        assert spans._piece(whole[r["key"]][r["begin"] : r["begin"] + r["length"]]) == bytes(r["span"])
    length = {r["key"]: r for r in spans.shared_lengths(found, classes, 14).collect()}
    assert length[14]["shared_chars"] == 0 and length[16]["shared_chars"] == 5000 and len(length) == len(texts)
    for a in range(14):
        cover = {p for b in range(14) if b != a for x, i, y, j, n in runs_by_hand([whole[a], whole[b]], 14) for p in range(i, i + n)}
        assert length[a]["shared_chars"] == len(cover)


@pytest.mark.parametrize("chars", [10**6, 300])
def test_notice_in_many_texts(spark, chars):
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    notice, beginning = word(20), word(13)
    texts = [word(20) + notice + word(20) for _ in range(150)] + [beginning + word(12) for _ in range(150)]
    texts[3] = texts[8][10:45] + "x"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, classes = spans.shared_spans(df, least=14, shard_chars=chars)
    got = {tuple(r) for r in spans.document_pairs(found, classes, 14).collect()}
    sets = [{t[i : i + 14] for i in range(len(t) - 13)} for t in texts]
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if sets[a] & sets[b]}
    assert {(r["key"], p) for r in found.collect() for p in range(r["begin"], r["begin"] + r["length"] - 13)} == windows_by_hand(texts, 14)


def test_empty_and_too_short(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found, classes = spans.shared_spans(df)
    assert found.count() == 0 and spans.shared_lengths(found, classes).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, least=7)
