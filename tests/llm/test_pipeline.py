"""The stages of the corpus pipeline, each against brute force on its own input."""

import re

import corpus_pipeline
from tidelog.llm.common import materialize
from tidelog.llm.decontaminate import normalise
from tidelog.llm.queries import table

DIR = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def components(sets):
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if up[a] != up[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    return up


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), name)
        seen.append(docs)
    source, good, exact, near, clean, packed = [{r.doc_id: r for r in d.collect()} if "text" in d.columns else d.collect() for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    assert 0 < len(good) < len(source) and all(good[i] == source[i] for i in good)

    first = {}
    for i in sorted(good):
        first.setdefault(norm(good[i].text), i)
    assert exact.keys() == set(first.values())

    sets = {}
    for i, r in exact.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    assert near.keys() == {i for i, c in components(sets).items() if i == c}

    items = [normalise(r.text) for r in table(spark, DIR, "benchmark").collect()]
    assert clean.keys() == {i for i, r in near.items() if not any(x in normalise(r.text) for x in items)}

    total = {}
    for r in packed:
        total.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    assert total.keys() == clean.keys() and all(a == b for a, b in total.values())


def test_run_is_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, DIR).columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


PROSE = "The house of the man was in the middle of the town and it was the largest of all the houses that they had in number"


def folder(spark, path, rows, labels, items):
    """A folder of tables as run() reads them, documents with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, kept string, _text int, component_id int, h1 string"
    spark.createDataFrame([(i, t, "en" if i else None, None if i == 3 else "src", len(t or ""), 1, "k", 2, 3, "h") for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_edges_through_run(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and tables without rows: without labels all is judged good."""
    item = "what is the name of the largest house in the middle of the town of the man"
    long = "word " * 60_000
    rows = [(1, f"{PROSE} 1 {item}"), (2, None), (3, ""), (4, f"{PROSE} 4."), (4, f"{PROSE} 4."), (5, f"{PROSE}  4."), (None, f"{PROSE} 4."), (6, long), (7, long + "x"), (8, "one two"), (None, "other words")]
    path = folder(spark, f"file://{tmp_path}/a", rows, [], [(1, item), (2, None), (3, "")])
    packed = corpus_pipeline.run(spark, path).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    # 3 and 5 are copies of 2 and 4, 1 holds an item; 6 and 7 have one and two distinct shingles
    assert sorted(total, key=lambda i: (i is None, i)) == [2, 4, 6, 7, 8, None]
    assert total[2] == 1 and all(r.doc_tokens == total[r.doc_id] for r in packed)

    empty = folder(spark, f"file://{tmp_path}/b", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_fitted_classifier_decides_in_run(spark, tmp_path):
    rows = [(i, f"{PROSE} {i} " + " ".join(f"x{i}y{k}" for k in range(60)) if i % 2 else f"BUY!!! $$$ {i} @@@ >>> ### {i} " + " ".join(f"Z{i}Q{k}!!" for k in range(60))) for i in range(1, 121)]
    path = folder(spark, f"file://{tmp_path}/c", rows, [(i, i % 2, 0) for i in range(1, 101)], [(1, "nothing of this is there at all, not one word of it is")])
    kept = {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()}
    assert {i for i in range(101, 121) if i % 2} <= kept and not {i for i in range(101, 121) if i % 2 == 0} & kept
