import hashlib
import random
import re

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipika.llm import components, exact_dedup, line_dedup, ngram_join, shingles, suffix_dedup, suffix_sort


@pytest.mark.parametrize("at_once", [0, 40, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "TASK_EDGES", at_once)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, None)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges += edges[:5]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a LONG, b LONG"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == brute.components({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a LONG, b LONG"), "a", "b").count() == 0


def same_as_groups(got, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(brute.lower((t or "").encode()), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        key = next(k for k, ids in groups.items() if r["doc_id"] in ids)
        assert (r["keep_id"], r["group_size"]) == (max(groups[key]), len(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key).hexdigest()
    for ids in groups.values():
        assert sum(r["kept"] for r in got if r["doc_id"] in ids) == 1


def test_exact(spark, docs, rows, nothing, tmp_path):
    p = f"{tmp_path}/d.parquet"
    docs.repartition(3).write.parquet(p)
    same_as_groups(exact_dedup.exact_dedup(spark, p).collect(), rows)
    # a digest of two values only: bytes decide
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    same_as_groups(exact_dedup.exact_dedup(spark, p, digest=weak).collect(), rows)
    nothing.write.parquet(f"{tmp_path}/e.parquet")
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/e.parquet").count() == 0


def test_exact_goes_on_from_its_state(spark, docs, rows, tmp_path):
    p, state = f"{tmp_path}/d.parquet", f"file://{tmp_path}/state"
    docs.filter("doc_id % 2 = 0").write.parquet(p)
    exact_dedup.exact_dedup(spark, p, state_dir=state).count()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(p)
    same_as_groups(exact_dedup.exact_dedup(spark, p, state_dir=state).collect(), rows)
    spark.createDataFrame([(None, "a"), (1, "A"), (None, "a")], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/n.parquet")
    got = exact_dedup.exact_dedup(spark, f"{tmp_path}/n.parquet").collect()
    assert [r["keep_id"] for r in got] == [1, 1, 1] and sum(r["kept"] for r in got) == 1


def test_exact_compares_bytes_across_runs(spark, tmp_path):
    """One digest for all: rows of a second folder meet those of the first, whose bytes come from their own files."""
    state, one = f"file://{tmp_path}/state", lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 0)
    for name, rows in (("a b", [(1, "aaa"), (5, "ccc")]), ("c", [(2, "bbb"), (3, "AAA"), (4, "bbb")])):
        df = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("_metadata", F.lit(0))
        df.write.parquet(f"{tmp_path}/{name}")
        got = exact_dedup.exact_dedup(spark, f"{tmp_path}/{name}", digest=one, state_dir=state).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {1: (3, 2, False), 2: (4, 2, False), 3: (3, 2, True), 4: (4, 2, True), 5: (5, 1, True)}


def test_ngram(docs, unique_rows, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute.ngram([r[:2] for r in unique_rows])
    assert ngram_join.ngram_components(nothing).count() == 0


def chains_of_edits(seed=5, sizes=(3, 5, 6, 8, 12, 17, 30, 60, 140), each=25):
    """Groups of near copies whose links are just above and below the threshold."""
    rng, rows = random.Random(seed), []
    for n in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
            if rng.random() < 0.3:
                w = w[: -rng.randint(1, max(1, n // 5))]
            rows.append((len(rows), " ".join(w)))
    return rows


def ngram_of(spark, rows, **kw):
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id LONG, text STRING"), **kw)
    return {r[0]: (r[1], r[2]) for r in got.select("doc_id", "n_shingles", "component_id").collect()}


@pytest.mark.parametrize("small,percent", [(48, 75), (2, 75), (2, 50), (2, 90)])
def test_ngram_on_chains_of_edits(spark, monkeypatch, small, percent):
    """Also with every entry treated as large, in blocks of a few nodes, and at other similarities."""
    for name, value in (("SMALL", small), ("HUBS", 1), ("PART", 4), ("OTHERS", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = chains_of_edits()
    assert ngram_of(spark, rows, percent=percent) == brute.ngram(rows, percent)


def test_ngram_names_that_clash(spark, monkeypatch):
    """Sets whose names share the number that stands for them: here it has five bits."""
    monkeypatch.setattr(ngram_join, "number", lambda name: name[0] & 31)
    rows = chains_of_edits(6, (6, 9, 30, 60), 12)
    assert ngram_of(spark, rows) == brute.ngram(rows)


def all_by_deletions(plain):
    """Every band with one-deletion neighbourhoods, whatever the counts."""
    return lambda *a: [(low, high, m, int(ngram_join.most_different(np.array([high]), np.array([high]), a[1])[0]) // 2 + 1) for low, high, m, _ in plain(*a)]


def test_ngram_by_deletions(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "bands", all_by_deletions(ngram_join.bands))
    rows = chains_of_edits(7)
    assert ngram_of(spark, rows) == brute.ngram(rows)


def test_allocation_follows_the_counts():
    """Without frequent shingles segments are cheapest; with them the smallest sets, short of rare segments, get neighbourhoods."""
    by_deletions = lambda share, load: [d for *_, d in ngram_join.bands(1000, 75, share, load)]
    assert not any(by_deletions(0.0, 0.0)) and by_deletions(0.05, 1e3)[0] == 1 and not any(by_deletions(0.05, 1e3)[1:])


def test_ngram_with_null_ids(spark):
    text = "a b c d e f g h i j k l"
    rows = [(None, text), (7, text + " m"), (9, "other words that are linked with nothing at all here"), (None, "only null ids have this one text"), (None, "only null ids have this one text"), (None, None)]
    got = sorted(tuple(r) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id LONG, text STRING")).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1))).collect())
    assert got == [(-1, 0, -1), (-1, 3, -1), (-1, 3, -1), (-1, 8, 7), (7, 9, 7), (9, 6, 9)]


def test_ngram_of_short_texts_across_tasks(spark):
    """Two extensions of a text meet in one task, the text that links them is in another."""
    several, alone = [], []
    for salt in range(24):
        base = [f"s{salt}w{i}" for i in range(8)]
        several += [(3 * salt, " ".join([*base, "x"])), (3 * salt + 1, " ".join([*base, "y"]))]
        alone.append((3 * salt + 2, " ".join(base)))
    rows = spark.sparkContext.parallelize([several, alone], 2).flatMap(lambda part: part)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == brute.ngram([*several, *alone])


@pytest.mark.parametrize("deletions", [False, True])
def test_every_similar_pair_meets(monkeypatch, deletions):
    """Index entries alone: each pair above the threshold shares one, by segments and by one-deletion neighbourhoods."""
    if deletions:
        monkeypatch.setattr(ngram_join, "bands", all_by_deletions(ngram_join.bands))
    rng = np.random.default_rng(0)
    signer = ngram_join.Signer(np.zeros(ngram_join.CELLS, bool))
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        if len(b) and ngram_join.links(a, b) and not np.array_equal(a, b):
            x, y = signer.entries([a, b])
            assert np.intersect1d(x, y).size


def test_one_of_each(docs, unique_rows):
    want = sorted(i for i, (_, c) in brute.ngram([r[:2] for r in unique_rows]).items() if i == c)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted({r["doc_id"] for r in out.select("doc_id").collect()}) == want


@pytest.mark.parametrize("dense,most", [(8, 10**7), (0, 10**7), (8, 0)])
def test_lines(docs, rows, unique_rows, nothing, monkeypatch, dense, most):
    """Also with every word treated as dense, and with blocks of a few lines."""
    for name, value in (("DENSE", dense), ("MOST", most), ("PAIRS", 7), ("LATER", 3), ("EARLIER", 4)):
        monkeypatch.setattr(line_dedup, name, value)
    want = brute.lines([r[:2] for r in unique_rows])
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["doc_id"]] for r in got)
    assert line_dedup.without_repeated_lines(nothing).count() == 0


def near_lines(seed=4, families=12, each=9):
    """Lines of 1 to 20 words in families under common words: chains of changes just above and below the threshold."""
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = ["the", "of", *(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 18)))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["new", "old", f"v{rng.randrange(9)}"])
            rows.append(" ".join(w[: rng.randint(1, len(w))]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("dense", [8, 0])
def test_near_lines(spark, monkeypatch, dense):
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    monkeypatch.setattr(line_dedup, "EARLIER", 16)
    lines = near_lines()
    rows = [(2**62 + i if i % 2 else -(2**62) - i, "\n".join(lines[6 * i : 6 * i + 6])) for i in range(len(lines) // 6)]
    got = {r[0]: r[1] for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)).collect()}
    assert got == brute.lines(rows)


def test_a_line_with_a_changing_number_costs_its_count():
    """No word's pairs are made in full: of 20,000 lines that are all alike each meets a few."""
    import pyarrow as pa

    lines = pa.array([f"page {i} of the report about the weather in the north of the town by night" for i in range(20_000)])
    counts = np.bincount((line_dedup.word_hashes(lines)[0] & np.uint64(line_dedup.CELLS - 1)).astype(np.int64), minlength=line_dedup.CELLS)
    entries, _ = line_dedup.entries_of(lines, np.arange(20_000), np.zeros(20_000, np.int64), line_dedup.classes(counts))
    out = line_dedup.candidates(pa.table({"bucket": pa.array([0], pa.int32()), "payload": pa.array([entries.tobytes()], pa.binary())}))
    pairs = out.filter(pa.compute.is_valid(out["eid"]))
    assert len(set(pairs["id"].to_pylist())) == 19_999 and len(pairs) <= 3 * line_dedup.FIRST * 20_000


def test_a_very_long_text_of_lines(spark):
    """Very many lines in one text: one pass, no cost of lines times removed lines."""
    text = "\n".join(f"line {i % 1000} x" for i in range(300_000))
    got = line_dedup.without_repeated_lines(spark.createDataFrame([(1, text)], "doc_id LONG, text STRING"), digest=True).first()
    assert got[1:3] == (300_000, 299_000) and got[3] == hashlib.sha256("\n".join(f"line {i} x" for i in range(1000)).encode()).hexdigest()


def test_lines_with_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (1, "A b c d e f"), (3, "x\nx"), (4, "x y"), (5, "p q r"), (6, "q p r s")], "doc_id LONG, text STRING")
    got = {r[0]: r[1] for r in line_dedup.without_repeated_lines(df).collect()}
    assert got == {None: "a b c d e", 1: "A b c d e f", 2: "", 3: "x", 4: "x y", 5: "p q r", 6: ""}


def test_line_sql(spark, sf, unique_rows, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(line_dedup.SQL).fetchall()}
    assert {r[0]: tuple(r)[1:] for r in line_dedup.op5_line_dedup(spark, sf).collect()} == want


def test_suffix(docs, rows, unique_rows, nothing):
    want = brute.repeats([r[:2] for r in unique_rows])
    got = suffix_dedup.without_repeats(docs, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_suffix_on_low_variety(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(90, 400))) if i % 3 else "ab" * rng.randint(40, 200)) for i in range(12)]
    rows += [(i, rows[i % 12][1][rng.randint(0, 30) :] + "c" * rng.randint(0, 150)) for i in range(12, 30)] + [(30, None), (31, "é" * 120)]
    want = brute.repeats(rows)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == want


@pytest.mark.parametrize("steps,piece", [(((0, 69), (1 << 62, 8)), 1 << 22), (((3, 69), (6, 8), (1 << 62, 1)), 150), (((1 << 62, 69),), 64)])
def test_suffix_in_ranges_and_pieces(spark, monkeypatch, steps, piece):
    """Frequent grams cut into ranges of windows, texts into pieces, runs of few anchors; any ids."""
    for name, value in (("STEPS", steps), ("PIECE", piece), ("BLOCK", 300), ("RUN", 20), ("STRIP", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abdeionrst", k=rng.randint(2, 7)))
    phrase, passage = "a phrase of sixty bytes that stands before text that varies. ", " ".join(word() for _ in range(40))
    rows = []
    for i in range(40):
        t = " ".join(word() for _ in range(rng.randint(5, 60)))
        t += (phrase, passage, phrase + passage, passage[rng.randint(0, 60) :], "x" * rng.randint(80, 260), "\0" * 120)[i % 6]
        rows.append(((-1) ** i * (2**62 + i), t + " ".join(word() for _ in range(rng.randint(0, 30)))))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)).collect()}
    assert got == brute.repeats(rows)


def test_suffix_equality_is_the_sorts(monkeypatch):
    """With prefixes that say nothing agrees, nothing is covered, however equal the hashes are."""
    import pyarrow as pa

    data = np.frombuffer(bytes(random.Random(1).choices(range(97, 123), k=400)) * 2, np.uint8)
    e, _ = suffix_dedup.anchors(data, np.array([0, 400, 800]), np.array([1, 2]))
    edges = np.zeros(len(e), suffix_dedup.EDGE)
    edges["key"] = e["gram"]
    for c in ("id", "start", "off", "run"):
        edges[c] = e[c]
    for k, a in enumerate(e):
        edges["bytes"][k, : a["run"] + 100] = data[(a["id"] - 1) * 400 + a["start"] :][: a["run"] + 100]
    part = pa.table({"payload": pa.array([edges.tobytes()], pa.binary())})
    assert sum(suffix_dedup.covered_edges(part)["length"].to_pylist()) == 400
    sort = suffix_dedup.deep_shallow
    monkeypatch.setattr(suffix_dedup, "deep_shallow", lambda *a: (sort(*a)[0], np.minimum(sort(*a)[1], 0)))
    assert not len(suffix_dedup.covered_edges(part))


def test_suffix_sql_tables(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.op10_suffix_dedup(spark, sf).collect()} == brute.repeats(docs)


def test_deep_shallow():
    for seed in range(60):
        r = random.Random(seed)
        strings = []
        for _ in range(r.randint(1, 60)):
            if strings and r.random() < 0.7:
                b = bytearray(r.choice(strings))
                if r.random() < 0.7 and b:
                    b[r.randrange(len(b))] = r.randrange(1, 256)
                strings.append(bytes(b[: r.randint(max(0, len(b) - 3), len(b))]))
            else:
                strings.append(bytes(r.randrange(1, 4) if r.random() < 0.8 else r.randrange(1, 256) for _ in range(r.randint(0, 100))))
        rows = np.zeros((len(strings), 100), np.uint8)
        for i, s in enumerate(strings):
            rows[i, : len(s)] = list(s)
        group = np.array([r.randrange(3) for _ in strings])
        order, lcp = suffix_sort.deep_shallow(rows, np.array([len(s) for s in strings]), group)
        assert sorted(order) == list(range(len(strings)))
        key = [(group[i], strings[i]) for i in order]
        assert key == sorted(key)
        for k in range(1, len(order)):
            a, b = key[k - 1], key[k]
            common = next((j for j, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
            assert lcp[k] == (common if a[0] == b[0] else -1)


def test_strangers_in_a_common_entry_make_no_pairs():
    """Pairs of one entry are sifted by their profiles before they are rows; entries may be cut anywhere into batches."""
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 1 << 63, 60, np.int64).view(np.uint64) for _ in range(140)]
    some[3] = np.append(some[2][:58], some[3][:2])  # a near copy of its neighbour
    rows = [(e, i, i, 60, ngram_join.profile(some[i])) for e, members in ((1, range(40)), (2, range(2, 4)), (3, range(140)), (4, [5])) for i in members]
    whole = pa.table(dict(zip(("entry", "node", "comp", "n", "profile"), map(list, zip(*rows, strict=True)), strict=True)))
    for size in (7, 40, 1000):
        made = [tuple(r.values()) for b in ngram_join.cross_pairs(75)(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert set(made) == {(2, 3)} and len(made) <= 3
    alike = pa.table({"entry": [1] * 60, "node": range(60), "comp": range(60), "n": [60] * 60, "profile": [ngram_join.profile(some[0])] * 60})
    made = {tuple(r.values()) for b in ngram_join.cross_pairs(75)(iter(alike.to_batches())) for r in b.to_pylist()}
    assert len({x for p in made for x in p}) == 60


@pytest.mark.parametrize("piece", [1, 40, 1 << 17])
def test_word_hashes_by_hand(monkeypatch, piece):
    """The hash of a word does not depend on its place, its text or the piece it is hashed in."""
    monkeypatch.setattr(shingles, "PIECE", piece)
    monkeypatch.setattr(shingles, "_POWERS", [])
    rng = random.Random(piece)
    texts = ["", None, " ", "a", *("".join(rng.choices("abAZz é ß語\t\n\v\f\r\x1c\x00", k=rng.randint(0, 30))) for _ in range(300)), "", "B" * 500 + " b"]
    h, owner = shingles.word_hashes(pa.array(texts)[1:])
    want = [(i, w) for i, t in enumerate(texts[1:]) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert owner.tolist() == [i for i, _ in want]
    for got, (_, w) in zip(h.tolist(), want, strict=True):
        total = sum(int(shingles._BYTE[b]) * pow(int(shingles._BASE), k, 1 << 64) for k, b in enumerate(w.lower())) + len(w)
        assert got == int(shingles.mix(np.array([total % (1 << 64)], np.uint64))[0])


def test_only_rows_with_equals_are_sorted_in_full(monkeypatch):
    """Of 1,000 sets of which ten have a copy, 20 rows go to the sort by all keys (before: all rows)."""
    sorts, plain = [], np.lexsort
    monkeypatch.setattr(line_dedup.np, "lexsort", lambda keys: sorts.append(len(keys[0])) or plain(keys))
    rows = np.zeros(1010, line_dedup.LINE)
    rows["id"], rows["a"] = np.arange(1010), np.append(np.arange(1000), np.arange(10)) * 7
    rows["b"] = rows["a"] + np.uint64(1)
    first, later = line_dedup.of_equal(rows, [rows["b"], rows["a"]])
    assert first.tolist() == list(range(1000)) and sorted(later.tolist()) == list(range(1000, 1010)) and sorts == [20]
    none = line_dedup.of_equal(rows[:0], [rows["b"][:0], rows["a"][:0]])
    assert [len(x) for x in none] == [0, 0]


def test_places_in_order_for_near_and_far_ids():
    for ids in ([5, 3, 3, 5, -2], [2**62, -(2**62), 3, 3, -(2**62)], []):
        rows = np.zeros(len(ids), line_dedup.LINE)
        rows["id"], rows["line"] = ids, [1, 4, 4, 0, 7][: len(ids)]
        places, at = line_dedup.ranks(rows)
        want = sorted({(int(r["id"]), int(r["line"])) for r in rows})
        assert [(int(p["id"]), int(p["line"])) for p in places] == want
        assert [want[i] for i in at] == [(int(r["id"]), int(r["line"])) for r in rows]
