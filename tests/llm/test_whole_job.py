"""Cases in which the operators once did less than the whole job."""

import random

from pyspark.sql import functions as F

from tidelog.llm import decontaminate, html_text, quality

PROSE = "The house of the man was in the middle of the town and it was the largest of all the houses that they had."


def test_a_head_without_an_end_tag_ends_where_its_content_ends():
    for page in (f"<html><head><title>t</title><meta x><body><article><p>{PROSE}</article>", f"<head><style>p</style><header>h</header><article><p>{PROSE}</article>"):
        assert html_text.main_text(page) == PROSE


def test_elements_without_text_end_at_their_own_end_tag():
    article = f"<article><p>{PROSE}</article>"
    assert html_text.main_text("<p>" + "İ" * 40 + "</p><SCRIPT>a</Script>" + article) == PROSE
    assert html_text.main_text("<script>a </scripts> b</script >" + article) == PROSE
    assert html_text.main_text("<button><svg>" + article) == PROSE
    assert html_text.main_text("<style>" + article) == ""


def test_layout_classes_around_an_article_do_not_hide_it():
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "nav-open", "content-sidebar-wrap", "social"):
        for tag in ("main", "article"):
            assert html_text.main_text(f"<body><div class='{name}'><{tag}><p>{PROSE}</p></{tag}></div>") == PROSE, (name, tag)
    for name in ("sidebar", "site-comments", "nav has-sidebar"):
        assert html_text.main_text(f"<body><div class='{name}'><p>{PROSE}</p></div>") == ""
    related = f"<div class='related'><article><p>{PROSE} Also.</p></article></div>"
    assert html_text.main_text(f"<article><p>{PROSE}</p></article>" + related) == PROSE
    assert html_text.main_text(f"<main><p>{PROSE}</p><div class='comments'><article class='comment'><p>{PROSE} I say.</p></article></div></main>") == PROSE
    assert html_text.main_text(f"<div hidden><main><p>{PROSE}</p></main></div>") == ""


POLISH = "Dom tego człowieka stał pośrodku miasteczka i był największy ze wszystkich domów, jakie kiedykolwiek tam zbudowano, więc każdy go znał."
RUSSIAN = "Дом этого человека стоял посреди города и был самым большим из всех домов, которые там когда-либо построили, поэтому его знали все."
CHINESE = "这个人的房子坐落在镇子的中央,是镇上所有房子中最大的一座,因此每个人都知道它,外地来的客人也常常向人打听这座房子的来历。"


def test_pages_in_languages_without_listed_stop_words():
    for text in (POLISH, RUSSIAN, CHINESE):
        page = f"<body><div><a href=x>{text}</a></div><div><p>{text}<p>{text}</div><div class=comments><p>{text}</p></div><footer>{text}</footer>"
        assert html_text.main_text(page) == text + "\n" + text
    words = "Lorem dolor amet " * 10
    assert html_text.main_text(f"<div><p>{PROSE} {PROSE}</p><div>{words}</div>") == f"{PROSE} {PROSE}"


def quality_rows(spark, n):
    """n documents, every third of them bad and labelled so; the first is one word of 400,000 letters, the second one run of signs."""
    good = lambda i: f"{PROSE} It was number {i} of the street."
    texts = ["x" * 400_000, "=" * 10_000] + [f"CLICK!!! $$$ {i} @@@ BUY>>> ### {i}" if i % 3 == 0 else good(i) for i in range(2, n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")
    return docs, labels


def test_one_very_long_word_leaves_scores_numbers(spark):
    docs, labels = quality_rows(spark, 90)
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(0 <= s <= 1 for r in rows.values() for s in (r.score, r.text_score, r.meta_score))
    assert all(rows[i].kept == (i % 3 > 0) for i in range(2, 90))
    assert {r.doc_id for r in quality.drop_rejected(docs, labels).collect()} == {i for i, r in rows.items() if r.kept}


def test_without_a_classifier_nothing_is_rejected(spark):
    docs, labels = quality_rows(spark, 30)
    for few in (labels.filter("doc_id < 10 AND (quality = 0 OR doc_id = 1)"), labels.filter("quality = 0"), labels.filter("doc_id < 3").withColumn("quality", F.lit(0))):
        assert quality.drop_rejected(docs, few).count() == 30
        assert quality.classify(docs, few).filter("kept AND score < 0.5").count() == 30


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeionrstlmdk") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_short_items_are_found_at_the_bounds_of_words():
    index = decontaminate.Index([(1, "What is the capital of Australia?"), (2, "the cap"), (3, "北京是中国的首都吗?"), (4, ""), (2, "The  cap")])
    assert sorted(index.search(["So: what is  the capital of australia?", "他问北京是中国的首都吗?是的", "", "the cap."])) == [(0, 1, 0, 4, 37), (1, 3, 0, 2, 12), (3, 2, 0, 0, 7), (3, 2, 0, 0, 7)]


def test_half_an_item_is_found():
    for n in (20, 70, 300):
        item = words_of(n, n)
        index = decontaminate.Index([(7, item)])
        for at in (0, len(item) // 4, len(item) // 2):
            half = item[at : at + len(item) // 2].strip()
            rows = list(index.search([words_of(1, 50) + " " + half + " " + words_of(2, 50)], parts=True))
            assert [r[:3] for r in rows] == [(0, 7, 0)], (n, at)
        assert [r[2:] for r in index.search([item], parts=True)] == [(0, 0, len(item))]
        assert not list(index.search([words_of(3, 500)], parts=True))


def test_alignment_in_bands_wider_than_4096():
    item = words_of(5, 2600)
    assert len(item) > 12_800
    text = "ab " * 40 + item[:5000] + "#" * 30 + item[5000:9000] + item[9010:]
    ((_, _, edits, start, end),) = decontaminate.Index([(1, item)]).search([text])
    assert (edits, start, end) == (40, 120, 120 + len(item) + 20)


def test_documents_with_half_an_item_are_dropped(spark):
    item = words_of(6, 70)
    docs = spark.createDataFrame([(1, item), (2, "x " + item[: len(item) // 2]), (3, words_of(7, 90))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]
    assert [r.doc_id for r in decontaminate.find_items(docs, bench).collect()] == [1]


def test_alignment_on_diagonals_over_4096():
    item, found = "abcdefghij" * 6, decontaminate.semi_global
    region = "z" * 5000 + item[:30] + "##" + item[30:]
    assert found(decontaminate.codes(item), decontaminate.codes(region), 0, 6000, 4) == (2, 5000, 5062)


def distances(item, text):
    """For each end in text the least edits of a passage that ends there: the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[j - 1] + 1))
    return row


def test_edits_and_places_against_the_plain_table():
    rng = random.Random(13)
    items = [(i, words_of(20 + i, 5 + 3 * i)) for i in range(12)]
    index = decontaminate.Index(items)
    seen = 0
    for _ in range(60):
        i, item = rng.choice(index.items)
        own = list(item)
        for _ in range(rng.randint(0, decontaminate.edit_budget(len(item)) + 2)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["q"], [own[k], "z"]])
        text = decontaminate.normalise(words_of(rng.random(), 20) + " " + "".join(own) + " " + words_of(rng.random(), 20))
        table = distances(item, text)
        found = {x[1]: x[2:] for x in index.search([text])}
        if min(table) <= decontaminate.edit_budget(len(item)):
            edits, start, end = found[i]
            assert edits == min(table) == table[end] == distances(item, text[start:end])[-1] == distances(text[start:end], item)[-1]
            seen += 1
        else:
            assert i not in found
    assert seen > 30


def test_common_grams_are_met_in_parts(monkeypatch):
    """Items and texts full of the same q-grams: the same result however few meetings are held at a time."""
    items = [(i, "the same words again and again " * 3 + f"item {i} " + words_of(i, 8)) for i in range(20)]
    texts = [words_of(50, 30), items[3][1] + " x", "the same words again and again " * 40, items[7][1] + " " + items[8][1], ""]
    whole = sorted(decontaminate.Index(items).search(texts, parts=True))
    assert {(t, i) for t, i, e, *_ in whole if e == 0} >= {(1, 3), (3, 7), (3, 8)}
    monkeypatch.setattr(decontaminate, "MEETINGS", 50)
    assert sorted(decontaminate.Index(items).search(texts, parts=True)) == whole


def test_benchmarks_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    items = [(i, words_of(i, 30)) for i in range(8)]
    docs = spark.createDataFrame([(i, f"{words_of(90 + i, 20)} {items[i][1] if i < 8 else ''}", i) for i in range(12)], "doc_id long, text string, _text int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.item_blocks(bench))) > 2
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [8, 9, 10, 11]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()} == {(i, i) for i in range(8)}
