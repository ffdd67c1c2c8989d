"""Sharding, vector codes and spelling variants against brute force and awkward rows."""

import random
import zlib
from collections import Counter, defaultdict
from math import inf, nan

import duckdb
import numpy as np
import pytest

from jobscope.llm import sharding, spelling, vector_codes
from jobscope.store import new_path
from test_operators import awkward, docs


def as_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return Counter(con.execute(sql).fetchall())


# ---- 11 shards ----
def best_fit(sizes, capacity):
    """Shards of groups of falling size, one at a time."""
    rooms, found = [], []
    for size in sizes:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, size))
        rooms[k] -= size
        found.append(k)
    return found


def spelled_out(runs):
    return [shard for n, shard in runs for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_one_by_one(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([r.randrange(1, 9), r.randrange(1, 300)]) for _ in range(r.randrange(1, 900))), reverse=True)
    classes = sorted(Counter(sizes).items(), reverse=True)
    a, n = (np.array(x, np.int64) for x in zip(*classes, strict=True))
    for capacity in (1, 40, 300, 1000, sum(sizes)):
        assert spelled_out(sharding.pack(a, n, capacity)) == best_fit(sizes, capacity)
    for shards in (1, 3, 16):
        found = spelled_out(sharding.pack_evenly(a, n, shards))
        loads = Counter()
        for size, shard in zip(sizes, found, strict=True):
            loads[shard] += size
        assert max(loads) < shards and max(loads.values()) <= max(sizes[0], -(-sum(sizes) // shards) + sizes[0])


def test_a_group_above_an_equal_share_has_a_shard_alone():
    runs = sharding.pack_evenly(np.array([900, 500, 10]), np.array([1, 1, 60]), 4)
    loads = Counter()
    for size, shard in zip([900, 500, *[10] * 60], spelled_out(runs), strict=True):
        loads[shard] += size
    assert loads == {0: 900, 1: 500, 2: 300, 3: 300}


def test_the_tree_gives_the_tightest_room():
    r, tree, held = random.Random(3), sharding.RoomTree(), set()
    for k in range(6000):
        if r.random() < 0.6:
            held.add(entry := (r.randrange(500), k))
            tree.add(entry)
        else:
            size = r.randrange(520)
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take(size) == want
            held.discard(want)


def _check_shards(rows, found, shards=None):
    of, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for x in found:
        of[x.text_md5 if "text_md5" in x else (x.text_crc32, x.size)].add(x.shard)
        slots[x.shard].append(x.slot)
        loads[x.shard] += x.size
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in found) == want
    return loads


def test_shards_hold_whole_groups_of_near_equal_size(spark):
    r = random.Random(5)
    rows = [(k, "é" * r.randrange(200) + str(r.randrange(400))) for k in range(1500)] + [(7, None), (7, None), (None, ""), (None, "x y"), (None, "x y")]
    found = sharding.shard_rows(docs(spark, rows), 16).collect()
    loads = _check_shards(rows, found)
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= max(groups.values())
    table = sharding.shard_table(docs(spark, rows)).collect()
    assert Counter(tuple(x) for x in table) == as_sql(rows, sharding.ORACLE)
    assert {(x.law, x.grown_shard) for x in table} == {("bytes", None)} and Counter((x.doc_id, x.shard, x.slot) for x in table) == Counter((x.doc_id, x.shard, x.slot) for x in found)


def test_copies_of_a_third_of_all_rows_are_one_group(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k} " + "w " * (k % 50)) for k in range(1200)]
    loads = _check_shards(rows, found := sharding.shard_rows(docs(spark, rows), 4).collect())
    assert Counter(tuple(x) for x in sharding.shard_table(docs(spark, rows), 4).collect()) == as_sql(rows, sharding.oracle_sql(shards=4))
    assert len(loads) == 4 and len({x.shard for x in found if x.doc_id % 3 == 0}) == 1 and max(loads.values()) < 1.1 * min(loads.values())


def test_a_capacity_gives_the_shards_of_best_fit(spark):
    r = random.Random(6)
    rows = [(k, "a" * r.randrange(90) + str(k % 150)) for k in range(400)] + [(500, "b" * 5000)]
    found = sharding.shard_rows(docs(spark, rows), capacity=700).collect()
    loads, groups = _check_shards(rows, found), Counter()
    for _, t in rows:
        groups[t] += len(t) + 1
    assert len(loads) == len(set(best_fit(sorted(groups.values(), reverse=True), 700))) and sorted(loads.values())[-2] <= 700 < max(loads.values()) == 5001


def test_shards_are_written_with_all_columns(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k % 40}") for k in range(200)]
    table = docs(spark, rows).withColumn("shard", F.lit("own")).withColumn("place", F.col("doc_id"))
    path = new_path(spark, "shards")
    sharding.write_shards(table, path, shards=5)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(table.columns) and {x.shard for x in back.select("shard").collect()} == set(range(5))
    assert back.drop("shard").exceptAll(table.drop("shard").select(*back.drop("shard").columns)).isEmpty() and back.count() == 200
    assert back.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()


def test_shards_of_nothing_and_of_awkward_rows(spark):
    assert sharding.shard_table(docs(spark, [])).count() == 0
    assert len(sharding.shard_table(awkward(spark)).collect()) == awkward(spark).count()
    with pytest.raises(ValueError):
        sharding.shard_rows(docs(spark, []))


# ---- 12 vector codes ----
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [x for x in rows if x[1] is not None and len(x[1]) and all(v is not None and abs(v) < inf for v in x[1])]
    kept.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    if not kept:
        return []
    whole = [[int(np.floor(256 * float(np.float32(v)))) for v in x[1]] for x in kept]
    cuts = [k * len(whole[0]) // parts for k in range(parts + 1)]
    cut = [[tuple(v[a:b]) for a, b in zip(cuts, cuts[1:])] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for v in cut:
                of[nearest(v[p], books[p])[1]].append(v[p])
            for i, xs in of.items():
                books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs))
    found, labels = [], Counter()
    for x, v in zip(kept, cut):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        found.append((x[0], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), x[2]))
        labels[x[2]] += found[-1][2]
    import hashlib

    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, labels[label], sha) for i, code, error, label in found]


def test_the_annulus_holds_the_nearest_entry():
    r = np.random.default_rng(1)
    for width, scale in ((4, 3), (4, 300), (1, 5), (7, 1 << 25), (0, 1)):
        entries, x = r.integers(-scale, scale + 1, (64, width)), r.integers(-scale, scale + 1, (500, width))
        entries[10:20] = entries[:10]
        distance = ((x[:, None] - entries[None]) ** 2).sum(2)
        found, least = vector_codes.nearest(x, entries)
        assert (found == distance.argmin(1)).all() and (least == distance.min(1)).all()


@pytest.mark.parametrize("dimension, n", [(64, 300), (16, 70), (19, 40), (5, 30)])
def test_codes_are_those_of_brute_force(spark, dimension, n):
    r = np.random.default_rng(dimension)
    rows = [(int(k * 7 % n), [float(v) for v in r.normal(0, 0.3, dimension).astype(np.float32)], [None, 1, 2][k % 3]) for k in range(n)]
    rows += [(1, rows[0][1], 5), (None, rows[3][1], None)]
    odd = [(0, None, 1), (2, [], 1), (3, [nan] * dimension, 1), (4, [inf] + [0.0] * (dimension - 1), 1), (5, [None] + [0.0] * (dimension - 1), None), (6, [0.5] * (dimension + 1), 1)]
    found = [tuple(x) for x in vector_codes.code_table(spark.createDataFrame(rows + odd, EMBEDDINGS)).collect()]
    assert Counter(found) == Counter(brute_codes(rows))


def test_codes_are_those_of_sql_and_decode(spark):
    r = np.random.default_rng(9)
    rows = [(k, [float(v) for v in r.normal(0, 0.3, 32).astype(np.float32)], k % 4 or None) for k in range(200)] + [(k, [0.25] * 32, 9) for k in range(200, 300)]
    table = spark.createDataFrame(rows, EMBEDDINGS)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(tuple(x) for x in vector_codes.code_table(table).collect()) == sorted(con.execute(vector_codes.ORACLE).fetchall())
    kept = vector_codes.kept_vectors(table)
    books = vector_codes.train(kept)
    back = {x.vec_id: x for x in vector_codes.decode(vector_codes.encode(kept, books), books).collect()}
    for i, v, _ in rows:
        assert sum((int(np.floor(a * 256)) - int(round(b * 256))) ** 2 for a, b in zip(v, back[i].vector, strict=True)) == back[i].error


def test_codes_of_nothing(spark):
    assert vector_codes.code_table(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert vector_codes.code_table(spark.createDataFrame([(1, None, 1), (2, [nan], 1)], EMBEDDINGS)).count() == 0
    clash = spark.createDataFrame([(1, [0.5] * 16, 2, "x", 3)], "vec_id long, embedding array<double>, label int, vector string, error int")
    assert vector_codes.code_table(clash).collect()[0][:3] == (1, "00" * 16, 0)


# ---- 13 spelling ----
def brute_variants(rows, min_chars=7, min_count=2, times=10, every=31):
    import re

    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in counts if abs(len(x) - len(w)) <= 1 and one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def edited(r, word):
    k, c = r.randrange(len(word)), r.choice("abcéÿ×")
    return r.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def spelled(n, seed=2):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé") for _ in range(r.randrange(5, 13))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "Aaaaaaaaa", "ababababab"]
    pool = base * 12 + [edited(r, w) for w in base * 4]
    pool += [edited(r, edited(r, w)) for w in base]
    chain = [(k, "lighthouse " * 9 + "lighthousé " * (k % 3 == 0) + "lighthhousé" * (k in (3, 60))) for k in range(90)]
    return chain + [(None if k % 97 == 0 else k % 50, " ".join(r.choice([str.upper, str])(r.choice(pool)) for _ in range(25)) + r.choice([".", "\n", "1x", ""])) for k in range(n)]


@pytest.mark.parametrize("indexed, asking", [(512, 1024), (3, 5)])
def test_variants_are_those_of_brute_force(spark, monkeypatch, indexed, asking):
    monkeypatch.setattr(spelling, "INDEXED", indexed)
    monkeypatch.setattr(spelling, "ASKING", asking)
    rows = spelled(260) + [(1, None), (2, ""), (3, "y" * 30_000 + " " + "y" * 30_001), (4, "y" * 30_000 + " " + "y" * 30_001)]
    found = [tuple(x) for x in spelling.variant_table(docs(spark, rows)).collect()]
    want = brute_variants(rows)
    assert len(found) == len(set(found)) and set(found) == want
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    assert {x for x in want if len(x[0]) < 99} == {x for x in as_sql(rows[:-2], spelling.ORACLE) if len(x[0]) < 99}


def test_short_words_have_shorter_grams(spark):
    rows = spelled(60, 4)
    for least in (2, 3, 5):
        found = {tuple(x) for x in spelling.variant_table(docs(spark, rows), min_chars=least).collect()}
        assert found == brute_variants(rows, min_chars=least)


def test_a_letter_is_lost_by_the_sum_of_id_and_run():
    lost = [k for k in range(2000) if spelling.observed(k, "étendue", 31) != "étendue"]
    assert 40 < len(lost) < 90
    for k in lost:
        h = zlib.crc32(f"{k}:étendue".encode())
        assert spelling.observed(k, "étendue", 31) == "étendue"[: h % 7] + "étendue"[h % 7 + 1 :]


def test_variants_of_nothing_and_of_awkward_rows(spark):
    assert spelling.variant_table(docs(spark, [])).count() == 0
    assert {tuple(x) for x in spelling.variant_table(awkward(spark)).collect()} == brute_variants([tuple(x)[:2] for x in awkward(spark).collect()])
