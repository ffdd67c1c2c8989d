"""The stages of the corpus pipeline, one after the other, against what was planted."""

import random

import os
import sys

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_lines, brute_overlaps, distance, naive_model  # noqa: E402


def test_stages_remove_what_was_planted(spark, tmp_path):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(5)) for _ in range(800)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = {i: f"{prose(60)}\n{prose(70)}" for i in range(80)}
    toxic = {i: " ".join(x for w in prose(40).split() for x in (w, *(["moron"] if r.random() < 0.2 else []))) + " moron scum idiot" for i in range(100, 140)}
    passage, item = prose(60), prose(25)
    rows = dict(clean) | toxic
    rows[200] = f"{prose(40)}\n{passage}"
    rows[201] = f"{prose(40)}\n{passage}"
    near = prose(150).split()
    rows[300] = " ".join(near)
    rows[301] = " ".join("changed" if k % 40 == 5 else w for k, w in enumerate(near))
    rows[400] = f"{prose(30)} {item} {prose(30)}"
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{d}/{name}"
        stage(spark, docs, d).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs
    ids = {name: {x.doc_id for x in s.select("doc_id").collect()} for name, s in seen.items()}
    assert not ids["toxicity"] & set(toxic) and set(clean) <= ids["sentencepiece"]
    texts = {x.doc_id: x.text for x in seen["line_dedup"].collect()}
    assert passage in texts[200] and passage not in texts[201]
    assert 300 in ids["near_dedup"] and 301 not in ids["near_dedup"]
    assert 400 in ids["near_dedup"] and 400 not in ids["decontaminate"]
    assert all(x.round_trip and x.n_tokens == len(x.ids) for x in docs.collect())
    for name in ("toxicity", "line_dedup", "near_dedup", "decontaminate"):
        assert seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def write(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def staged(spark, folder):
    """The rows after each stage, as (doc_id, text)."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = sorted((tuple(x) for x in (docs.select("doc_id", "text") if "text" in docs.columns else docs.select("doc_id", "ids")).collect()), key=repr)
    return out


def test_stages_are_those_of_brute_force(spark, tmp_path):
    import sentencepiece

    from jobscope.llm.queries import tokenizer_path

    r = random.Random(61)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, items = [f"{prose(12)}." for _ in range(6)], [(k, prose(n)) for k, n in enumerate((20, 15, 8, 40))]
    rows = []
    for i in range(150):
        text = [prose(r.randrange(8, 40)) for _ in range(r.randrange(1, 4))]
        if i % 7 == 0:
            text.insert(r.randrange(len(text) + 1), r.choice(shared))
        if i % 11 == 0:
            text.append(f"{prose(9)} {r.choice(items)[1]} {prose(4)}")
        if i % 5 == 0:
            text.append("moron " * r.randrange(2, 5) + prose(4))
        rows.append((i, "\n".join(text)))
    for i in range(150, 190):
        near = rows[r.randrange(150)][1].split(" ")
        for _ in range(max(1, len(near) // 15)):
            near[r.randrange(len(near))] = r.choice(words)
        rows.append((i, " ".join(near)))
    rows += [(None, "no id here"), (None, "no id here"), (7, rows[7][1]), (8, "another text of the same id, short"), (200, None), (201, ""), (202, "\n\n"), (203, "yes")]
    labels = [(i, 1, int("moron" in t)) for i, t in rows[:150]] + [(7, None, None), (None, 1, 1)]
    write(spark, str(tmp_path), rows, labels, items)
    found = staged(spark, str(tmp_path))

    import zlib

    known = {i: y for i, _, y in labels if i is not None and y is not None}
    learned = [(t or "", known[i]) for i, t in rows if i in known and zlib.crc32(str(i).encode()) % 4 != 2]
    score = naive_model([t for t, _ in learned], [y for _, y in learned], 2048)
    want = [(i, t) for i, t in rows if score(t or "") < 0.3]
    assert found["toxicity"] == sorted(want, key=repr)

    drops = brute_lines(want)
    want = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drops[i, t or ""]) if (i, t or "") in drops else t) for i, t in want]
    assert found["line_dedup"] == sorted(want, key=repr)

    rank = lambda row: (row[0] is None, row[0] or 0)
    split, parent = [(t or "").lower().split() for _, t in want], list(range(len(want)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(want)):
        for b in range(a):
            if distance(split[a], split[b]) <= 0.2 * max(len(split[a]), len(split[b])) + 1e-9:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, row in enumerate(want):
        groups.setdefault(root(k), []).append(row)
    assert len(found["near_dedup"]) == len(groups)
    firsts = {k: min(rank(x) for x in g) for k, g in groups.items()}
    assert sorted(map(rank, found["near_dedup"])) == sorted(firsts.values())

    want = [x for x in found["near_dedup"] if not brute_overlaps([(0, x[1])], items)]
    assert found["decontaminate"] == want

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert found["sentencepiece"] == sorted(((i, [1, *library.encode(t or ""), 2]) for i, t in want), key=repr)


def test_stages_take_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert all(not rows for rows in staged(spark, str(tmp_path)).values()) and corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_clashing_columns_on(spark, tmp_path):
    from pyspark.sql import functions as F

    write(spark, str(tmp_path), [(1, "some text to keep"), (None, None), (2, "the words of the item stand here"), *((k, f"plain{k} text{k} of its own{k}") for k in range(10, 30))], [(k, 1, 0) for k in range(10, 30)], [(0, "words of the item stand")])
    clashing = ["key", "node", "bucket", "weight", "label", "text_key", "found_key", "dropped_lines", "h1", "held", "score", "lead", "content", "winner"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit(7) for c in clashing})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    rows = docs.collect()
    assert {x.doc_id for x in rows} == {1, None, *range(10, 30)} and all(x[c] == 7 for x in rows for c in clashing)
