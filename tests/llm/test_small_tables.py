"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat, decontaminate, exact_dedup, html_text, langid, near_dedup, packing, pii, quality, warc
from tidelog.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, kept string, _id int, _own string, quality_score int"
EXTRA = (1, "k", "x", 2, "y", 3)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), *EXTRA) for i, t in rows], DOCS)


LONG = "word " * 60_000
CASES = [(5, None), (4, ""), (3, "a  b\tc"), (2, "a b c"), (1, "a b\nc d"), (1, "a b\nc d"), (None, "a b c"), (9, LONG), (8, LONG), (7, " "), (6, "a b c ")]


def test_exact_dedup(spark):
    rows = exact_dedup.exact_dedup(docs(spark, CASES)).collect()
    assert len(rows) == len(CASES)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = Counter(norm(t) for _, t in CASES)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in rows:
        text = sha[r.text_sha256]
        assert r.group_size == groups[text]
        assert r.keep_id == min(i for i, t in CASES if norm(t) == text and i is not None)
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, []).limit(0)).count() == 0


def test_exact_dedup_with_few_counters_is_the_same(spark):
    rows = [(i, f"t{i % 3 if i % 2 else i}") for i in range(400)]
    one, other = (sorted(exact_dedup.exact_dedup(docs(spark, rows), counters=c).collect()) for c in (1, 4))
    assert one == other


def test_misra_gries_finds_every_heavy_key(spark):
    keys = [k for k, n in (("a", 300), ("b", 150), ("c", 120)) for _ in range(n)] + [f"x{i}" for i in range(430)]
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    found = {r.key: r.n for r in exact_dedup.misra_gries(df, "key", 9).collect()}
    assert len(found) <= 9
    counts = Counter(keys)
    assert {k for k, n in counts.items() if n > len(keys) / 10} <= found.keys()
    assert all(n <= counts[k] for k, n in found.items())


def test_drop_exact_copies_keeps_columns(spark):
    df = docs(spark, CASES)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(4, ""), (2, "a b c"), (1, "a b\nc d"), (8, LONG), (7, " "), (6, "a b c ")])


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [*CASES, (20, base), (21, base + " x"), (22, "y " + base + " x"), (23, base.upper()), (24, "other " * 3), (25, "one two"), (26, "ONE two"), (27, "one")]
    found = {}
    for r in near_dedup.near_duplicates(docs(spark, rows), words=3, percent=85).collect():
        found.setdefault(r.doc_id, r)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    for i in ids:
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), up[i], up[i] == i), i
    assert found[None].component_id is None and found[None].kept
    assert near_dedup.near_duplicates(docs(spark, []).limit(0)).count() == 0
    assert near_dedup.drop_near_copies(docs(spark, rows), 3, 85).columns == docs(spark, rows).columns


def test_decontaminate(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it all"
    df = docs(spark, [*CASES, (30, "xx " + item.upper() + " yy"), (31, "xx " + item.replace("fox", "cat") + " zz"), (32, item[:30])])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(df, bench).collect()}
    assert found.keys() == {(30, 1), (31, 1)} and found[30, 1] == 0 and 0 < found[31, 1] <= 3
    assert decontaminate.find_items(docs(spark, []).limit(0), bench).count() == 0
    assert decontaminate.find_items(df, bench.limit(0)).count() == 0
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - 2


def test_language_id(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(1, 20)] + [(i, "der hund und die katze von dem haus " * 3, "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "123 ...", "de"), (52, "der hund und das haus", None), (None, "the house of the dog", None), (53, LONG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    assert found[50].lang_pred == found[51].lang_pred == "und"
    assert found[52].lang_pred == "de" and found[None].lang_pred == "en" and found[None].held_out
    alone = langid.identify(df.filter("doc_id = 53"), langid.sample_texts(df)).collect()  # a text of many segments
    assert (alone[0].lang_pred, alone[0].score) == (found[53].lang_pred, found[53].score) and found[53].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_quality_edges(spark):
    df = docs(spark, CASES)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(df, labels).collect()} == {0.5}
    assert quality.classify(df, labels.limit(0)).filter("kept").count() == len(CASES)
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.drop_rejected(df, labels.limit(0)).columns == df.columns


def test_quality_of_a_fitted_model_on_edges(spark):
    good, bad = "The house of the man was in the middle of the town, and it was large.", "BUY!!! $$$ @@@ >>> NOW ### 99"
    many = [(100 + i, f"{good} Number {i}." if i % 2 else f"{bad} {i}") for i in range(120)]
    df = docs(spark, [*CASES, *many, (100, bad + " 0"), (300, None), (301, good), (302, "漢字" * 50_000)])
    df = df.withColumn("source", F.when(F.col("doc_id") == 300, None).otherwise(F.col("source"))).withColumn("n_chars", F.when(F.col("doc_id") == 301, None).otherwise(F.col("n_chars")))
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(100)] + [(100, 0), (None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    assert model.constant is None
    rows = quality.classify(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= quality.THRESHOLD) for r in rows)
    assert sum(r.kept == bool(r.doc_id % 2) for r in rows if r.doc_id and 200 <= r.doc_id < 220) >= 19
    assert len({r.score for r in rows if r.doc_id == 100}) == 1
    half = quality.classify(df, labels, threshold=next(r.score for r in rows if r.doc_id == 101))
    assert half.filter("doc_id = 101 AND kept").count() == 1  # a tie with the threshold
    kept = quality.drop_rejected(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.classify(df.limit(0), labels).count() == 0


def test_the_pool_holds_no_labelled_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "CoTrained", lambda *parts: seen.append(parts))
    df = docs(spark, [(i, f"text {i}") for i in range(200)])
    quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(0, 200, 2)], "doc_id long, quality int"))
    text, _, y, pool, _ = seen[0]
    assert len(y) == len(text) == 100 and len(pool) == 100
    assert not {r.tobytes() for r in text} & {r.tobytes() for r in pool}


def test_packing_edges(spark):
    packed = packing.pack(docs(spark, CASES), tokenizer(), with_ids=True).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    for r in packed:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 and len(r.ids) == r.length and 1 << r.bucket == r.length
    assert [(r.start, r.length, r.doc_tokens, r.ids) for r in packed if r.doc_id in (4, 5)] == [(0, 1, 1, [0])] * 2
    assert sum(r.length for r in packed if r.doc_id == 9) == next(r.doc_tokens for r in packed if r.doc_id == 9)
    assert packing.pack(docs(spark, []).limit(0), tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, CASES), tokenizer(), 1000)


def test_pii_edges(spark):
    found = {r.doc_id: r for r in pii.report(docs(spark, [*CASES, (40, "x@y.zz 10.0.0.1 +49 30 123456"), (41, "call (523) 555-1055, Mr. Smith"), (42, "1" * 30_000), (43, "1 " * 30_000)])).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[5].base_sha256 == found[42].base_sha256 == found[43].base_sha256 == empty
    assert (found[40].n_email, found[40].n_ip, found[40].n_phone, found[40].n_card) == (1, 1, 1, 0)
    assert found[40].spans == "email:0:6,ip:7:15,phone:16:29"
    assert pii.report(docs(spark, []).limit(0)).count() == 0


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 7), (2, None, "", 7), (None, "u", "<p>x", 7), (3, "u", "<article><p>" + LONG + "</p></article>", 7), (3, "u", "<script>a</script>", 7)], "page_id long, url string, html string, text int")
    found = [(r.page_id, r.n_chars, r.text) for r in html_text.extract(pages).collect()]
    assert found[0] == (1, 0, "") and found[1] == (2, 0, "") and found[3] == (3, len(LONG) - 1, LONG.strip()) and found[4] == (3, 0, "")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc_edges(spark):
    rows = [(3, "u", "x"), (2, "a b\nc", "x"), (1, None, None), (4, "u", ""), (None, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "a\r\n\r\nWARC/1.1\r\n"), (2, "u", "x")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    found = sorted(warc.archive_pages(pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found] == [(1, 0, "response", None), (2, 1, "response", None), (2, 1, "response", None), (3, 1, "revisit", 2), (4, 0, "revisit", 1), (7, 100, "response", None), (8, 15, "response", None), (None, 100, "revisit", 7)]
    assert warc.archive_pages(pages, least_bytes=2).filter("record_type = 'revisit'").count() == 1
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 3}é") for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archives(warc.resolve_revisits(pages), path, per_file=3)
    read = warc.read_archives(spark, path).collect()
    responses = {r.record_id: bytes(r.payload).decode() for r in read if r.record_type == "response"}
    assert sorted(responses.values()) == ["<p>0é", "<p>1é", "<p>2é"] and len(read) == 20
    assert all(r.refers_id in responses and r.payload is None for r in read if r.record_type == "revisit")


def test_chat(spark):
    rows = [
        (1, 1, "user", "hi"), (2, 1, "user", "hi"), (2, 2, "assistant", "yo"), (3, 1, "user", "hi"), (3, 2, "assistant", "yo"),
        (4, 1, "user", "hi"), (4, 2, "assistant", "yo!"), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (6, None, None, None), (None, 1, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    found = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert found.keys() == {2, 4, 6}
    assert found[2].n_copies == 2 and found[2].n_turns == 2
    assert found[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert found[6].rendered == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0
