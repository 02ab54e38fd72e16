import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest

from lipika.llm import mixing, packing


def targets(sizes):
    """Water filling by repeated capping."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] / share > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / share for s in sizes}
        capped |= over


def test_mix(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size[r[0]]
    want, source = targets(per), {r[0]: r[3] for r in rows}
    taken, largest = Counter(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_mixed_documents(docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["taken"]}
    repeats = Counter(r[0] for r in docs.select("doc_id").collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r[0] for r in out.select("doc_id").collect()) == {i: k * repeats[i] for i, k in taken.items()}


def test_mix_odds_differ_by_size(spark):
    """In one source, by word counts of 4 and 400: both are sampled, and the longer ones more often."""
    rows = [(i, "w " * (400 if i % 2 else 4), "b") for i in range(2000)] + [(-1, "w " * 250_000, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")).filter("doc_id >= 0").collect()
    target = got[0]["target"]
    assert abs(sum(r["taken"] for r in got) - target) <= 400 and target % got[0]["source_size"]
    share = {n: np.mean([r["taken"] % (3 * n) > 0 for r in got if r["size"] == n]) for n in (4, 400)}
    assert 0.02 < share[4] < share[400] < 0.98


def test_mix_sql_and_zero_sizes(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4), r["taken"]) for r in mixing.op9_mix_sources(spark, sf).collect())
    q = con.sql(mixing.SQL)
    assert got == sorted((a, b, c, round(d, 4), e) for a, b, c, d, e in q.select("doc_id, size, source_size, target, taken").fetchall())
    zero = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id LONG, text STRING, source STRING")
    assert [r["taken"] for r in mixing.mix(zero).collect()] == [0, 0]


def sequences_are_sound(got, size=1024):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= size
    return len(by)


def test_pack(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs, with_ids=True).collect()
    n = sequences_are_sound(got)
    total = sum(r["length"] for r in got)
    assert n <= -(-total // 1024) + 2
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    copies = Counter(r[0] for r in rows)
    for i, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want = []
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            want.append((k, s, len(part), zlib.crc32(part.tobytes()), part.tobytes()))
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in by[i])
        assert mine == sorted(want * copies[i])
    assert packing.pack_documents(nothing).count() == 0


def test_encoder_takes_any_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.Encoder(packing.tokenizer_path())
    for text in ("", "<|endoftext|> a", " " * 3000 + "x", " ‍é😀\n\n  it's 12  ", "a" * 30000, "\r\n\t" * 50):
        assert encode(text) == np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    for n in (1, 40, 3000, 60000):
        h = Counter(np.minimum(rng.geometric(1 / 300, n), 1024).tolist())
        plan, over = packing.plan(h)
        used = Counter()
        for c, k in plan:
            assert sum(l * a for l, a in c.items()) <= 1024 and k > 0
            for l, a in c.items():
                used[l] += a * k
        assert used == h and over <= max(8, n / 20)
        assert sum(k for _, k in plan) <= -(-sum(l * m for l, m in h.items()) // 1024) * 1.001 + 1
    assert packing.plan({}) == ([], 0)
    assert sum(k for _, k in packing.plan({600: 10})[0]) == 10


def test_the_program_packs():
    """Where lengths are hard to combine, the rounded program places the pieces, and without it more sequences are needed."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(270, 420, 3000), rng.integers(270, 420, 3000)
    for lengths in (np.concatenate([a, b, 1024 - a - b]), rng.integers(260, 500, 60000)):
        h = Counter(lengths.tolist())
        (made, over), (plain, _) = packing.plan(h), packing.plan(h, rounds=0)
        assert over <= 0.05 * len(lengths)
        assert sum(k for _, k in made) < 0.99 * sum(k for _, k in plain)


def test_knapsack_is_the_best_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size = 24
        count, price = np.append(0, rng.integers(0, 3, size)), rng.random(size + 1)
        best = {0: 0.0}
        for l in range(1, size + 1):
            for _ in range(int(count[l])):
                for c, v in list(best.items()):
                    if c + l <= size:
                        best[c + l] = max(best.get(c + l, 0.0), v + price[l])
        k = packing.Knapsack(price, count, size)
        c = k.configurations(np.array([size]))[0]
        assert all(a <= count[l] for l, a in c.items()) and sum(l * a for l, a in c.items()) <= size
        assert sum(price[l] * a for l, a in c.items()) == pytest.approx(max(best.values())) == pytest.approx(k.best[size])


def test_added_tokens_are_the_files_own(spark):
    """The contract's ids: what spells an added token is that token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext", *(f"x {k.content} y" for k in t.get_added_tokens_decoder().values())]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING"), with_ids=True).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
