"""Substring and suffix-array dedup."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from logitblend.llm import substring, suffixes, windows


def words_of(found):
    return [(r.doc_id, r.words, r.removed, brute.sha(bytes(r.kept))) for r in found]


def bytes_of(found):
    return [(r.doc_id, r.bytes, r.removed, len(r.spans), brute.sha(bytes(r.kept))) for r in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r)))


def rows_with_repeats():
    rows = brute.corpus(4, 60)
    long = brute.prose(77, 400)
    rows += [
        (200, long + " end", "a"),
        (201, "start " + long, "a"),
        (202, brute.mutated(long, 1, 4), None),
        (203, long[100:1500] + "\n" + long[100:1500], "b"),
        (None, long, "b"),
        (204, "same key, first text " + long[:700], "b"),
        (204, "same key, second text " + long[:700], "b"),
        (205, "ab" * 400, "c"),
        (206, "x" + "ab" * 300 + " " * 150, "c"),
    ]
    return rows + rows[:3]


@pytest.mark.parametrize("block", [windows.BLOCK, 600])
def test_words_equal_plain_search(frame, block):
    rows = rows_with_repeats()
    found = substring.deduplicated(frame(rows), keep=("doc_id",), block=block)
    got = words_of(found.select("row.doc_id", "words", "removed", "kept").collect())
    want = [(d, *w) for (d, _, _), w in zip(rows, brute.words_removed([r[:2] for r in rows]), strict=True)]
    assert order(got) == order(want)


@pytest.mark.parametrize("block", [windows.BLOCK, 3000])
def test_bytes_equal_plain_search(frame, block):
    rows = rows_with_repeats()
    rows = [r for r in rows if len(r[1] or "") < 20_000] + [(300, brute.prose(8, 9000)[:9000], "z")]
    found = suffixes.deduplicated(frame(rows), keep=("doc_id",), block=block)
    got = bytes_of(found.select("row.doc_id", "bytes", "removed", "spans", "kept").collect())
    want = [(d, *w) for (d, _, _), w in zip(rows, brute.bytes_removed([r[:2] for r in rows]), strict=True)]
    assert order(got) == order(want)


def test_no_documents(frame):
    assert substring.deduplicated(frame([])).count() == 0
    assert suffixes.deduplicated(frame([(1, None, None)])).collect()[0].removed == 0


def test_very_long_text_is_hashed_in_stretches(monkeypatch):
    r = np.random.default_rng(1)
    h = windows.mixed(r.integers(0, 50, 5000).astype(np.uint64))
    cut = windows.Segments(20, 5)
    whole = list(cut.of(h))
    monkeypatch.setattr(windows, "STRETCH", 700)
    parts = list(windows.Segments(20, 5).of(h))
    assert len(whole) == 1 and len(parts) == 8
    for found in (whole, parts):
        covered = np.concatenate([s + np.arange(w) for p in found for s, w in zip(p[3], p[4], strict=True)])
        assert covered.tolist() == list(range(5000 - 19))


def test_equal_windows_have_equal_anchors():
    r = random.Random(2)
    text = bytes(r.choice(b"abc") for _ in range(3000))
    symbols, cut = windows.Bytes(), windows.Segments(40, 8)
    anchor_of = {}
    for anchor, _, _, start, count, folded in cut.of(symbols.hashes(text + text[500:900])):
        data = text + text[500:900]
        for a, s, n, f in zip(anchor, start, count, folded, strict=True):
            seen = [data[i : i + 40] for i in range(s, s + n)]
            assert f or len(set(seen)) == len(seen)
            for window in seen:
                assert anchor_of.setdefault(window, a) == a


def test_wavelet_matrix_and_backward_search():
    r = np.random.default_rng(3)
    sequence = r.integers(0, 37, 1000)
    matrix = substring.WaveletMatrix(sequence, 37)
    for at in (0, 1, 63, 64, 65, 500, 1000):
        got = matrix.rank(np.full(37, at), np.arange(37))
        assert got.tolist() == np.bincount(sequence[:at], minlength=37).tolist()
    texts = [r.integers(0, 3, 60) for _ in range(5)]
    whole, begins = windows.joined(texts, 3)
    docs = np.repeat([40, 10, 30, 10, 20], 61)
    index = substring.FMIndex(whole, docs, 61, 4)
    low, high = np.array([0]), np.array([len(whole)])
    for symbol in (2, 1, 2):
        low, high = index.extend(low, high, np.array([symbol + 5]))
    flat = " ".join(map(str, whole.tolist()))
    count = sum(whole[i : i + 3].tolist() == [7, 6, 7] for i in range(len(whole)))
    assert high[0] - low[0] == count, flat


def test_statistics_of_streamed_texts():
    """The smallest doc of every window, read off the index alone."""
    r = np.random.default_rng(8)
    texts = sorted((r.integers(0, 2, n) for n in (50, 33, 33, 21, 6, 5)), key=len, reverse=True)
    lengths = np.array([len(t) for t in texts])
    whole, begins = windows.joined(texts, 2)
    own = np.array([9, 3, 7, 3, 1, 5])
    index = substring.FMIndex(whole, np.repeat(own, lengths + 1), 51, 5)
    # What it was built from isn't kept.
    assert not any(getattr(v, "dtype", None) == np.int64 and np.size(v) >= len(whole) for v in vars(index).values())
    seen = set()
    for step, k, least in index.statistics(whole, begins + lengths, lengths, 5):
        for i in range(k):
            place = lengths[i] - step
            window = texts[i][place : place + 5].tolist()
            where = [own[j] for j, t in enumerate(texts) for p in range(len(t) - 4) if t[p : p + 5].tolist() == window]
            assert least[i] == min(where)
            seen.add((i, int(place)))
    assert seen == {(i, p) for i, n in enumerate(lengths) for p in range(n - 4)}


@pytest.mark.parametrize("kind, length, gram, in_text", [(windows.Words, 50, 10, False), (windows.Bytes, 100, 24, True)])
def test_nothing_is_removed_without_an_index(frame, kind, length, gram, in_text):
    """All that is removed was found by an index: with none, whole copies stay, too."""
    def compute(texts, spans):
        return [pa.array([len(s) for s in spans], pa.int32())]

    def spans(find):
        docs = frame(rows_with_repeats())
        found = windows.without_repeats(docs, "doc_id", "text", ("doc_id",), kind, length, gram, in_text, find, "n int", compute)
        return sum(r.n > 0 for r in found.collect())

    def finds(data, ids, starts, copied):
        if kind is windows.Words:
            return substring.earlier_windows(data, ids, starts, copied)
        return suffixes.repeated_bytes(data, ids, starts, copied)

    assert spans(finds) > 30
    assert spans(lambda *_: iter(())) == 0


def test_a_long_text_of_one_passage_is_one_segment(frame):
    """A text that repeats a passage is indexed once for each different segment."""
    passage = brute.prose(5, 80)
    rows = [(5, " ".join([passage] * 400), "s"), (6, passage, "s"), (4, " ".join([passage] * 3), "s"), (7, "be " * 30_000, "s")]
    seen = frame(rows).sparkSession.sparkContext.accumulator(0)

    def finds(data, ids, starts, copied):
        seen.add(sum(len(d.split()) for d in data))
        return substring.earlier_windows(data, ids, starts, copied)

    def compute(texts, spans):
        return [pa.array([sum(b - a for a, b in s) for s in spans], pa.int32())]

    found = windows.without_repeats(
        frame(rows), "doc_id", "text", ("doc_id",), windows.Words, 50, 10, False, finds, "n int", compute
    )
    got = {r.row.doc_id: r.n for r in found.collect()}
    want = brute.words_removed([r[:2] for r in rows])
    assert got == {r[0]: w[1] for r, w in zip(rows, want, strict=True)}
    assert seen.value < 4000


def test_united_segments():
    def segment(anchor, content, doc, start, twin=0, folded=False):
        return dict(anchor=anchor, content=content, twin=twin, doc=doc, start=start, version=1, windows=5, folded=folded, copied=False, is_copy=False)

    r = random.Random(3)
    rows = [segment(r.randrange(12), r.randrange(3), r.randrange(4), r.randrange(3)) for _ in range(60)]
    rows += [segment(100 + k, 1, 1, 1) for k in range(5)] + [segment(200, 1, 1, 1, folded=True), segment(300, 1, 1, 1, 7), segment(300, 1, 2, 1, 8)]
    rows += rows[:5]
    names = [n for n, _ in windows._SEGMENT]
    key = lambda x: tuple(x[n] for n in names[:6])

    def united(parts, size, in_text):
        out = []
        for part in parts:
            columns = [np.array([x[n] for x in part], t.to_pandas_dtype()) for n, t in windows._SEGMENT]
            out += windows._ordered(columns).to_pylist()
        out.sort(key=lambda x: (not x["is_copy"], *key(x)))
        batches = [pa.RecordBatch.from_pylist(out[i : i + size], pa.schema(windows._SEGMENT)) for i in range(0, len(out), size)]
        return [x for b in windows._sifted(iter(batches), in_text) for x in b.to_pylist()]

    distinct = {key(x): x for x in rows}
    for in_text in (False, True):
        for size in (1, 3, 1000):
            got = united([rows[::2], rows[1::2]], size, in_text)
            firsts = {x["anchor"]: [] for x in got}
            for x in got:
                if not x["is_copy"]:
                    firsts[x["anchor"]].append(x)
            for (anchor, content, twin), own in {k[:3]: [y for y in distinct if y[:3] == k[:3]] for k in distinct}.items():
                first = min(own)
                alone = len({k[:3] for k in distinct if k[0] == anchor}) == 1
                mine = [x for x in firsts.get(anchor, []) if (x["content"], x["twin"]) == (content, twin)]
                folded = distinct[first]["folded"] and in_text
                if alone and len(own) == 1 and not folded:
                    assert not mine
                else:
                    assert [key(x) for x in mine] == [first]
                    assert mine[0]["copied"] == (len(own) > 1)
                copies = {key(x) for x in got if x["is_copy"] and key(x)[:3] == (anchor, content, twin)}
                assert copies == set(own) - {first}


def test_shared_prefixes():
    r = np.random.default_rng(4)
    texts = [r.integers(0, 2, n) for n in (40, 1, 25, 60)]
    whole, _ = windows.joined(texts, 2)
    order_, ranks = windows.suffix_array(whole, 61)
    got = windows.common_prefixes(order_, ranks)
    for i in range(1, len(whole)):
        a, b = whole[order_[i - 1] :], whole[order_[i] :]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[i] == n


def test_maximal_repeats_have_all_occurrences():
    text = b"xabcdey abcdez abcde abcdeq"
    whole, _ = windows.joined([np.frombuffer(text, np.uint8)], 256)
    order_, ranks = windows.suffix_array(whole, len(text) + 1)
    shared = windows.common_prefixes(order_, ranks).tolist()
    left = whole[order_ - 1].tolist()
    found = list(suffixes.maximal_repeats(shared, left, order_.tolist(), 3))
    got = {text[order_[x.low] : order_[x.low] + x.length]: x.high - x.low + 1 for x in found}
    assert got == {b"abcde": 4, b" abcde": 3}


def test_groups_list_all_occurrences():
    r = random.Random(6)
    passages = [bytes(r.choice(b"abcdefgh") for _ in range(n)) for n in (60, 45)]
    noise = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    data = [noise(20) + passages[0] + noise(9), passages[0], noise(3) + passages[0][5:] + passages[1], passages[1] + noise(30), noise(80)]
    for group in suffixes.groups(data, np.arange(5) << 32, 30):
        found = {data[k][p : p + group.length] for k, p in zip(group.segments, group.places, strict=True)}
        assert len(found) == 1
        (text,) = found
        places = {(k, p) for k, d in enumerate(data) for p in range(len(d)) if d.startswith(text, p)}
        assert set(zip(group.segments.tolist(), group.places.tolist(), strict=True)) == places and len(places) > 1
    lengths = sorted(g.length for g in suffixes.groups(data, np.arange(5) << 32, 30))
    assert 60 in lengths and 55 in lengths and 45 in lengths


def test_merged_spans():
    r = random.Random(7)
    spans = [(r.randrange(5), a, a + 1 + r.randrange(9)) for a in (r.randrange(60) for _ in range(40))]
    got = list(zip(*(x.tolist() for x in windows.merged(*(np.array(c) for c in zip(*spans, strict=True)))), strict=True))
    covered = {(o, p) for o, a, b in spans for p in range(a, b)}
    assert {(o, p) for o, a, b in got for p in range(a, b)} == covered
    assert got == sorted(got) and all(o != q or b < c for (o, _, b), (q, c, _) in zip(got, got[1:], strict=False))
    lists = pa.array([[{"start": 3, "stop": 9}, {"start": 1, "stop": 4}], None, [], [{"start": 0, "stop": 2}]], windows.SPANS_TYPE)
    assert windows._merged_lists(lists.slice(1)) == [[], [], [(0, 2)]]
    assert windows._merged_lists(lists) == [[(1, 9)], [], [], [(0, 2)]]


def test_copied_segments_occur_twice():
    r = random.Random(8)
    noise = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    shared = noise(50)
    data = [noise(40), noise(10) + shared, shared + noise(20), noise(60)]
    found = set(suffixes.repeated_bytes(data, np.array([1, 2, 3, 4]), np.zeros(4, int), np.array([True, False, True, False]), 30))
    assert (0, True, 0, 40) in found and (2, True, 0, 70) in found and (2, False, 0, 50) in found
    assert not any(k in (1, 3) or (k == 0 and not copies) for k, copies, _, _ in found)
