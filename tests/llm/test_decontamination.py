import brute
import pytest

from logitblend.llm import decontam

ITEMS = [
    (1, brute.prose(1001, 70)),
    (2, "Only six words: in this ITEM, ok"),
    (3, "word"),
    (4, None),
    (5, " .,; "),
    (6, brute.prose(2001, 160)[200:500]),
    (10, "É ünï code"),
    (2, "Only six words: in this ITEM, ok"),
    (None, "an item with no number at all has ten words here"),
]


def documents():
    rows = brute.corpus(1, 60)
    rows.append((100, "so: only six WORDS in-this item ok, and WORD.", "s"))
    rows.append((101, "an item with no number at all has ten words here", "s"))
    rows.append((102, "aword words wordé É ÜNÏ code", "s"))
    rows.append((102, "a word", "s"))
    return rows


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 400])
def test_hits_equal_plain_search(spark, frame, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.hits(frame(documents()), items, keep=("doc_id",), block_bytes=block_bytes)
    got = found.select("row.doc_id", *decontam.contamination(found)).collect()
    want = [(d, *brute.contaminated(t, ITEMS)) for d, t, _ in documents()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_ten_blocks_take_one_scan(spark, frame, capsys):
    items = ITEMS + [(100 + k, brute.prose(5000 + k, 20)) for k in range(20)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(documents())
    found = decontam.hits(docs, table, keep=("doc_id",), block_bytes=500)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "HashAggregate" not in plan
    got = found.select("row.doc_id", *decontam.contamination(found)).collect()
    assert sorted(map(tuple, got)) == sorted((d, *brute.contaminated(t, items)) for d, t, _ in documents())


def test_more_items_than_one_scan_takes(spark, frame, monkeypatch):
    monkeypatch.setattr(decontam, "SCAN_BYTES", 900)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.hits(frame(documents()), items, keep=("doc_id",), block_bytes=400)
    got = found.select("row.doc_id", *decontam.contamination(found)).collect()
    assert sorted(map(tuple, got)) == sorted((d, *brute.contaminated(t, ITEMS)) for d, t, _ in documents())


def test_no_items_and_no_documents(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontam.hits(frame(documents()), none)
    assert found.filter("size(spans) > 0 or size(items) > 0").count() == 0
    assert decontam.hits(frame([]), none).count() == 0


def test_clean_documents_stay_as_they_are(spark, frame):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(documents())
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if not brute.contaminated(r.text, ITEMS)[-1]]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))


def test_windows_slide():
    tables = decontam.compiled([(0, brute.prose(5, 30, 10_000))])
    (table,) = tables
    assert table.most == 9 and min(table.shift.values()) == 0
    assert len(table.buckets) == 21
