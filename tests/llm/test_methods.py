"""The methods themselves against brute force, and the learned ones on held-out rows."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, graph, html_text, langid, near_dedup, packing, pii, quality
from tidelog.llm.common import Workspace
from tidelog.llm.queries import table, tokenizer

DIR = "/root/testdata/sf0.01"


def plain_phrases(train, text):
    """Ends of phrases in a parse of the whole text by substring search."""
    count, phrase = 0, ""
    for c in text:
        if phrase + c in train:
            phrase += c
        else:
            count, phrase = count + 1, c if c in train else ""
    return count


def phrases(train, text):
    """The same by the automaton, in segments."""
    a, size = langid.SuffixAutomaton(train), langid.SEGMENT
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    codes = np.zeros((max(map(len, parts)), len(parts)), np.int32)
    for j, part in enumerate(parts):
        codes[: len(part), j] = [a.classes.get(c, 0) for c in part]
    return a.phrases(codes, np.array([len(p) for p in parts]), np.arange(len(parts)) - 1).sum()


def test_suffix_automaton_parses_as_substring_search(monkeypatch):
    rng = random.Random(1)
    for size in (256, 7):
        monkeypatch.setattr(langid, "SEGMENT", size)
        for _ in range(200):
            letters = rng.choice(["abc ", "ab", "abcdefgh"])
            train = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
            text = "".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 90)))
            assert phrases(train, text) == plain_phrases(train, text)
            assert phrases(train, train * 3) == plain_phrases(train, train * 3)


def test_long_texts_and_large_alphabets_parse_as_a_whole():
    rng = random.Random(2)
    han = [chr(0x4E00 + i) for i in range(3000)]
    words = ["".join(rng.choice(han) for _ in range(rng.randint(1, 3))) for _ in range(1500)]
    train = "".join(rng.choice(words) for _ in range(4000))
    text = "".join(rng.choice(words) for _ in range(50_000))
    assert len(text) > 90_000 and len(set(train)) > 1500
    assert phrases(train, text) == plain_phrases(train, text)


def test_languages_with_thousands_of_characters():
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(4000)]
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    one, two = ([make(letters, 2) for _ in range(900)] for letters in (han[:2500], han[1500:]))
    text = lambda words, n: "".join(rng.choice(words) for _ in range(n))
    model = langid.Model({"xx": [text(one, 6000)], "yy": [text(two, 6000)], "en": ["the cat and the dog " * 50]})
    found = model.predict([text(one, 40), text(two, 40), text(one, 4000), "the dog", "", "12"])
    assert [lang for lang, _ in found] == ["xx", "yy", "xx", "en", "und", "und"]


def test_language_on_held_out_rows(spark):
    docs = table(spark, DIR, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    learn, rest = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    model = quality.fit(docs, learn, 2000, 2000)
    assert model.constant is None
    rows = rest.join(quality.classify(docs, learn), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_words_give_the_ids_of_whole_texts():
    encoder, rng = packing.Encoder(tokenizer()), random.Random(3)
    parts = ["a", "b", "'s", "'", "é", "1", " ", " ", " ", "\n", "\t", "!", "\x85", "\x1c", "ll", " the", "日本", "²", "Ⅷ", ".", ",", "<|endoftext|>", " "]
    texts = ["", " ", "a b", "  a  b ", "x\n y\n\n z ", "I'm here's  it\t\tq", "a.\nB c, d.", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500))]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert array("I", ids).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_query_against_plain_encoding(spark):
    """Every piece of the whole query: place, length, checksum and token count from encoding each text as it is."""
    encoder = packing.Encoder(tokenizer()).tokenizer
    pieces, sequences = {}, set()
    for r in packing.pack(table(spark, "/root/testdata/sf0.001", "documents"), tokenizer()).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.sequence_id not in sequences and r.offset == 0
        sequences.add(r.sequence_id)
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert pieces.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids = [*encoder.encode(d.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids[at : at + r.length]).tobytes()))
            at += r.length
        assert at == len(ids)


def test_buckets_hold_sequences_of_one_length(spark, tmp_path):
    packed = packing.pack(table(spark, "/root/testdata/sf0.001", "documents"), tokenizer(), with_ids=True)
    packing.write_buckets(packed, f"file://{tmp_path}/buckets")
    read = spark.read.parquet(f"file://{tmp_path}/buckets")
    lengths = {r.bucket: r.lengths for r in read.groupBy("bucket").agg(F.collect_set(F.size("ids")).alias("lengths")).collect()}
    assert lengths and all(found == [1 << k] for k, found in lengths.items())
    assert read.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_piece_lengths():
    for n in range(1, 4000):
        own = packing.piece_lengths(n)
        assert sum(own) == n and all(x & (x - 1) == 0 and x <= 1024 for x in own) and own == sorted(own, reverse=True)
        assert sum(x < 1024 for x in own) == bin(n % 1024).count("1")


def test_edited_passages_are_found():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))) for i in range(40)]
    index = decontaminate.Index(items)
    for _ in range(150):
        i, text = rng.choice(index.items)
        own, edits = list(text), rng.randint(0, decontaminate.edit_budget(len(text)))
        for _ in range(edits):
            k, what = rng.randrange(len(own)), rng.random()
            if what < 0.34:
                own[k] = "#"
            elif what < 0.67:
                own.insert(k, "#")
            else:
                del own[k]
        before = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        found = {x[1]: x for x in index.search([before + " " + "".join(own) + " tail"])}
        assert found[i][2] <= edits
    assert not list(index.search([" ".join(rng.choice(words) for _ in range(300))]))


def test_near_duplicates_of_edited_copies(spark):
    """Chains and groups of copies, against all pairs."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows, base = [], [rng.choice(words) for _ in range(80)]
    for i in range(120):
        own = list(base if i % 3 else [rng.choice(words) for _ in range(80)])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in rows}
    up = dict.fromkeys(sets)
    up = {i: i for i in up}
    for _ in range(120):
        before = dict(up)
        for a in sets:
            for b in sets:
                if up[a] != up[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
        if before == up:
            break
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == up


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i:]])) for i in range(40)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def brute_components(sets, percent):
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and up[a] != up[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {i: new if c == old else c for i, c in up.items()}
    return up


def test_families_in_one_cluster_are_told_apart(spark, monkeypatch):
    """Families whose members are just under or over the similarity, in blocks much smaller than the cluster."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 6)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 5)
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(120)]
    for i in range(150):
        own = list(base)
        for k in range(i % 5):  # a family has these changes in common
            own[10 + 9 * k] = f"f{i % 5}"
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    expected = brute_components(sets, 80)
    assert len(set(expected.values())) >= 3
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_meeting_in_blocks_connects_what_all_pairs_connect(spark):
    """Rows are linked where their numbers differ by 1: chains in groups, blocks of three rows."""
    rng = random.Random(9)
    numbers = rng.sample(range(300), 200)
    rows = [(n % 2, i, 1, n // 2) for i, n in enumerate(numbers)]

    def test(columns):
        v = columns["v"].to_numpy()
        return lambda x, others: others[abs(v[others] - v[x]) == 1]

    ws = Workspace(spark, "test")
    df = spark.createDataFrame(rows, "g long, id long, bytes long, v long")
    links = graph.meet(df, "g", test, ws, 3)
    up = {i: i for _, i, *_ in rows}
    for g, i, _, v in rows:
        for h, j, _, w in rows:
            if g == h and abs(v - w) == 1 and up[i] != up[j]:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = {k: new if c == old else c for k, c in up.items()}
    for hub in (graph.HUB, 2):
        found = {r.id: r.comp for r in graph.components(links, ws, hub).collect()}
        assert {i: found.get(i, i) for i in up} == up


def test_texts_under_one_id_lose_no_link(spark):
    """Rows that share a doc_id are one document, and each of its texts may link it."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " z"), (3, c), (3, c), (4, c + " z"), (5, "other words only here"), (6, b)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (3, 1), (4, 1), (5, 5), (6, 1)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]
            if good():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_base_spans_follow_the_rules(spark):
    rng = random.Random(6)

    def card():
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 19)))
        return next(d + c for c in "0123456789" if luhn(d + c))

    fixed = ["", "1", "22", "333", " ", "-", ".", "(", ")", "@", "a", "b.c", "_", "x@y.zz", "\n", "é", "😀", "10.0.0.1", "192.168.1.300", " +49 30 123456", "%", "+"]
    texts = ["a@b.co_x@d.com", "a@b.com@c.com", "1.2.3.4.5.6.7.8", "0300.1.2.3", "4111 1111-1111 1111", "4" * 30, "++49 30 1234567-", "a" * 5000 + "@b.c", "1." * 500]
    texts += ["".join(rng.choice([card(), *fixed]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(rows).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


def test_votes_are_weighed_by_agreement():
    """A labeler that disagrees with the others is trusted less; each kind has its own share of true spans."""
    patterns = [(3, (1, 1, 1, -1, -1, -1), 40.0), (3, (1, 0, 1, -1, -1, -1), 20.0), (3, (0, 1, -1, 0, 0, -1), 25.0), (3, (0, 0, -1, 0, 0, -1), 40.0), (6, (1, -1, 1, -1, 1, 1), 50.0)]
    share, known, beliefs = pii.expectation_maximisation(patterns)
    assert 0.3 < share[3] < 0.7 and share[6] > 0.9
    assert beliefs[0] > 0.9 and beliefs[1] > 0.9 and beliefs[2] < 0.1 and beliefs[3] < 0.1
    assert known[0].true[0] > 0.9 > known[1].true[0]


def test_expectation_maximisation_finds_known_reliabilities():
    """Votes drawn from labelers of known reliability: what EM finds is near it, and near the likelihood's own optimum."""
    rng, hit = random.Random(11), [0.95, 0.9, 0.85, 0.8, 0.75, 0.7]
    counts, truth = {}, {}
    for _ in range(6000):
        true = rng.random() < 0.4
        votes = tuple(-1 if rng.random() < 0.2 else int((rng.random() < h) == true) for h in hit)
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + true
    share, known, beliefs = pii.expectation_maximisation([(0, v, float(n)) for v, n in sorted(counts.items())], 200)
    assert abs(share[0] - 0.4) < 0.03
    for r, h in zip(known, hit, strict=True):
        assert abs(r.true[0] / (r.true[0] + r.true[1]) - h) < 0.06 and abs(r.false[1] / (r.false[0] + r.false[1]) - h) < 0.06
    right = sum(truth[v] if b > 0.5 else counts[v] - truth[v] for (v, _), b in zip(sorted(counts.items()), beliefs, strict=True))
    assert right > 0.95 * 6000


def test_classifier_fits_as_gradient_descent_in_numpy():
    rng = random.Random(12)
    rows = [([(f, rng.randint(0, 2)) for f in ("a", "b", "c")], rng.random(), float(rng.randint(1, 9))) for _ in range(40)]
    names = sorted({f for x, _, _ in rows for f in x})
    x = np.array([[1.0] + [float(f in own) for f in names] for own, _, _ in rows])
    y, n, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(len(names) + 1)
    decay = np.array([0.001] * len(w))
    for _ in range(pii.TRAIN_STEPS):
        w += 2 * (x.T @ (n / n.sum() * (y - 1 / (1 + np.exp(-x @ w)))) - decay * w)
    found = pii.train(rows)
    assert np.allclose([found[None], *[found[f] for f in names]], w, atol=1e-6)


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_candidates_are_added_to_base_spans(spark):
    texts = [
        "Please call me at (523) 555-1055 today", "invoice number 523-555-1055 x", "contact Mr. Smith or Anna Berg", "phone: 523-555-1234 and mail joe [at] mail [dot] com",
        f'so token = "{HEX}" it', f"TOKEN = \"{HEX.upper()}\"!! x", f"the commit {HEX} of", "see https://example.com/a/b/2024-report-for-the-year.html now", "api_key: ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6q7R8",
    ] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(rows).collect()}
    assert found[0].spans == "phone:18:32" and found[0].n_phone == 0 and found[0].n_spans == 1
    assert found[2].spans == "name:8:17,name:21:30"
    assert "email:29:52" in found[3].spans
    assert found[4].spans == "secret:12:52" and found[5].spans == "secret:9:49" and found[8].spans == "secret:9:49"
    assert found[6].spans == found[7].spans == ""


def test_spelled_out_addresses_may_have_any_length(spark):
    long = "a" * 90 + " [at] " + " [dot] ".join(["b" * 70] * 10 + ["com"])
    rows = spark.createDataFrame([(i, f"write to {long} soon") for i in range(20)], "doc_id long, text string")
    assert {r.spans for r in pii.report(rows).collect()} == {f"email:9:{9 + len(long)}"}


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><ul class="menu"><li><a href=x>Home</a></ul></header>
<div id="cookie-notice"><p>We use cookies on this site and that is the long text of the notice for all of the people.</p></div>
<div class=content><h2>A headline</h2><p>The house of the man was in the middle of the town and it was the largest of all the houses that they had.</p>
<p>Short&nbsp;&amp; one.</p><p>Then the man went to the town and was in the house of the people that he had seen on the day of the fair.</p></div>
<div class="comments"><p>I think that this is the best of the articles that I have read on this site in the last year.</p></div>
<form><p>Subscribe to the letter</p></form><script>if (a < b) { "</p>" }</script><footer>&copy; x</footer></body></html>"""


def test_pages_without_article_elements():
    lines = html_text.main_text(PAGE).split("\n")
    assert lines[0] == "A headline" and len(lines) == 4 and lines[-3].startswith("The house") and lines[-2] == "Short & one." and lines[-1].startswith("Then the man")
    assert not re.search("cookies|Home|best of|Subscribe|if|©", "\n".join(lines))


def test_block_rules_find_the_articles_of_pages_without_the_element(spark):
    """The test pages with their article elements made plain ones: the rules alone tell their lines."""
    kept = lost = extra = 0
    for r in table(spark, DIR, "pages").collect():
        known = html_text.main_text(r.html).split("\n")
        found = html_text.main_text(r.html.replace("article>", "div>")).split("\n")
        kept, lost, extra = kept + len(set(known) & set(found)), lost + len(set(known) - set(found)), extra + len(set(found) - set(known))
    assert kept > 0.85 * (kept + lost) and extra < 0.02 * kept


def two_passes(kinds):
    """The two passes over (characters, share of stop words, share of links) of blocks outside any article, written out."""
    labels = []
    for n, stop, linked in kinds:
        if linked > 1 / 3:
            labels.append("bad")
        elif n < 70:
            labels.append("open")
        elif stop >= 0.25 and n >= 120:
            labels.append("good")
        else:
            labels.append("near" if stop >= 0.15 else "bad")
    for kind in ("near", "open"):
        before = list(labels)
        for i, label in enumerate(before):
            if label == kind:
                left = next((x for x in reversed(before[:i]) if x in ("good", "bad")), None)
                right = next((x for x in before[i + 1 :] if x in ("good", "bad")), None)
                if kind == "near":
                    labels[i] = "bad" if {left, right} - {None} == {"bad"} else "good"
                else:
                    labels[i] = "good" if left == right == "good" else "bad"
    return [x == "good" for x in labels]


def test_two_passes_against_the_rules_written_out():
    rng = random.Random(10)
    for _ in range(300):
        blocks, kinds = [], []
        for _ in range(rng.randint(1, 12)):
            words = ["the" if rng.random() < rng.choice([0.05, 0.2, 0.4]) else "xyzzyx" for _ in range(rng.randint(3, 40))]
            text = " ".join(words)
            linked = len(text) if rng.random() < 0.25 else 0
            blocks.append(html_text.Block(text, linked, False, False))
            kinds.append((len(text), words.count("the") / len(words), linked / len(text)))
        assert html_text.second_pass(blocks, [html_text.first_pass(b) for b in blocks]) == two_passes(kinds)


def test_link_rich_paragraphs_of_an_article_stay():
    text = "It was <a href=x>the largest of the houses</a> and <a href=y>the one in the middle of town</a> that they all had known since then, and it is there now."
    shares = "<ul><li><a href=a>Share</a></li><li><a href=b>Print this page</a></li></ul>"
    assert html_text.main_text(f"<article><p>{text}</p>{shares}</article>") == re.sub("<[^>]*>", "", text)


@pytest.mark.parametrize("broken", ["<p>a<", "<<<", "<p", "<!-- x", "<script>", "<a href='", "</p></p>", "&#xfffffff; &bogus;", "<p>x</article></main>"])
def test_broken_pages_do_not_fail(broken):
    assert isinstance(html_text.main_text(broken), str)


def test_chunk_keys_meet_under_the_distance(spark):
    """Signatures that differ in `distance` symbols share a key wherever the differences are."""
    rng, distance = np.random.default_rng(7), near_dedup.distance_bound(85, near_dedup.KEYED)
    base = rng.integers(0, 2**16, near_dedup.KEYED).astype(">u2")
    rows = [(0, bytearray(base.tobytes()))]
    for i in range(1, 60):
        own = base.copy()
        own[rng.choice(near_dedup.KEYED, distance, replace=False)] += 1
        rows.append((i, bytearray(own.tobytes())))
    keys = {r.id: set(r.keys) for r in spark.createDataFrame(rows, "id long, sig binary").select("id", near_dedup.chunk_keys(distance).alias("keys")).collect()}
    assert all(keys[0] & keys[i] for i in range(1, 60))
    assert len(keys[0]) == near_dedup.KEYED


def test_encoder_looks_up_distinct_words_only():
    """A slice's words are numbered before they are looked up; white space of all kinds, in slices of many texts, as encoded one by one."""
    encoder = packing.Encoder(tokenizer())

    class Counting(dict):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

    encoder.spaced, encoder.bare = Counting(), Counting()
    texts = ["the same words, the same words\nand a line " + "again and again " * 500 + "end."] * 20
    odd = ["", " ", "\n", "a ", " a", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\xa0b", "\na", "a\n", "a b c", "a\x1cb", "é 한\n文", "x" * 60 + " " + "y" * 60]
    want = [array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts + odd]
    assert list(encoder.encode(texts + odd)) == want and Counting.asked < 100
    assert list(packing.slices([])) == [] and list(packing.slices([1, packing.SLICE_BYTES + 1, 1, 1])) == [(0, 1), (1, 2), (2, 4)]


def test_workers_forget_the_encoder_and_bound_all_its_words():
    from tidelog.llm import common
    from tidelog.llm.queries import tokenizer

    path = tokenizer()
    common.works_on("packing")
    encoder = packing._encoders.setdefault(path, packing.Encoder(path))
    # words that begin lines count too
    encoder.bare.update((f"w{i}", b"") for i in range(packing.CACHE_WORDS + 1))
    assert list(encoder.encode(["a b\nc"])) == encoder._ids(["a b\nc"])
    assert len(encoder.bare) < 10
    common.works_on("packing")
    assert path in packing._encoders
    common.works_on("quality")
    assert not packing._encoders
