"""The training-data operators against brute force and on edge cases."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from repspark.llm import queries
from repspark.llm.bpe import encode_texts, encoder
from repspark.llm.leaks import WuManber, find_leaks, words
from repspark.llm.quantiles import Sketch, daily_sketches, group_percentiles, total_percentiles
from repspark.llm.sentences import find_sentences
from repspark.llm.term_counts import TermCountStore, changes_between, marked
from repspark.llm.top_n import latest_per_item, top_n

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, small, name):
    got, want = same(queries.QUERIES[name](spark, small), queries.ORACLE[name], connect(small))
    assert got == want


# --- 1: percentiles ---


@pytest.mark.parametrize("order", ["up", "down", "random", "ties"])
def test_sketch_keeps_its_bound(order):
    random.seed(2)
    n = 50_000
    data = {"up": list(range(n)), "down": list(range(n, 0, -1)), "random": [random.random() for _ in range(n)], "ties": [i % 7 for i in range(n)]}[order]
    import numpy as np

    parts = [Sketch(64) for _ in range(9)]
    for i in range(0, n, 500):
        parts[i // 500 % 9].add(0, np.sort(np.array(data[i : i + 500], dtype=float)))
    whole = Sketch(64)
    for p in parts:
        for level, error, v in p.buffers():
            whole.add(level, v, error)
    got_n, ps = whole.percentiles([50, 250, 500, 750, 950])
    assert got_n == n and whole.error <= n * 12 / (2 * 64)
    for q, x in zip([50, 250, 500, 750, 950], ps):
        want = -(-q * n // 1000)
        assert sum(d < x for d in data) < want + whole.error and sum(d <= x for d in data) >= want - whole.error


def test_percentiles_by_day_combine(spark):
    random.seed(4)
    rows = [("hot", random.gauss(90, 3), T0 + timedelta(days=i % 3)) for i in range(6000)] + [("a", 95.0, T0), ("a", 80.0, None), (None, 99.0, T0), ("b", None, T0), ("b", float("nan"), T0), ("b", -1.0, T0), ("b", float("inf"), T0)]
    df = spark.createDataFrame(rows, "g string, v double, at timestamp_ntz").withColumn("level", F.lit("clash")).withColumn("strand", F.lit(1))
    days = daily_sketches(df.where("at < '2025-01-02' or at is null"), "v", "g", "at", 0.0, 100.0, 128).unionByName(daily_sketches(df.where("at >= '2025-01-02'"), "v", "g", "at", 0.0, 100.0, 128))
    got = {r["grp"]: r for r in group_percentiles(days, [500], 128).collect()}
    assert set(got) == {"hot", "a"} and got["a"]["q500"] == 80.0 and got["a"]["rank_error"] == 0
    hot = sorted(v for g, v, _ in rows if g == "hot" and 0 <= v <= 100)
    below = sum(v < got["hot"]["q500"] for v in hot)
    assert got["hot"]["n_values"] == len(hot) and abs(below - len(hot) / 2) <= got["hot"]["rank_error"] + 1
    assert total_percentiles(days, [500], 128).first()["n_values"] == len(hot) + 3
    empty = daily_sketches(df.limit(0), "v", "g", "at", 0.0, 100.0)
    assert group_percentiles(empty, [500]).count() == 0 and total_percentiles(empty, [500]).count() == 0


# --- 2: term counts ---


def test_deltas_lead_to_the_same_counts_as_a_recount(spark, tmp_path):
    fields = {"v": ",", "j": None}
    old = [("A*1, b*1 ,A*1", "CC"), ("A*1", None), ("", "cc "), ("NA", "NA"), (None, "DD"), ("A*1", "CC"), ("A*1", "CC")]
    new = [("A*1, b*1 ,A*1", "CC"), ("A*1", "EE"), ("c", "DD"), (None, "DD"), ("A*1", "CC")]
    schema = "v string, j string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    store = TermCountStore(spark, f"file://{tmp_path}/state", fields, max_segments=2)
    assert store.counts().count() == 0 and store.totals() == {}
    store.apply(a.withColumn("sign", F.lit(1)).withColumn("term", F.lit("clash")))
    store.apply(changes_between(a, b, ["v", "j"]))
    fresh = TermCountStore(spark, f"file://{tmp_path}/fresh", fields)
    fresh.apply(b.withColumn("sign", F.lit(1)))
    want = sorted(map(tuple, fresh.counts().collect()), key=repr)
    assert sorted(map(tuple, store.counts().collect()), key=repr) == want
    assert ("v", "A*1", 4, 3) in want and ("j", None, 0, 5) in want and store.totals() == {"v": 4, "j": 5}
    store.apply(spark.createDataFrame([], schema + ", sign int"))
    assert len(store._manifest()["segments"]) == 1, "three segments were folded into one"
    assert sorted(map(tuple, store.counts().collect()), key=repr) == want
    assert {r["term"]: r["mark"] for r in marked(store, 2, 0.6).where("field_name = 'v'").collect()} == {"A*1": "common", "B*1": "rare", "C": "rare"}


def test_a_store_reads_as_before_when_a_commit_breaks_off(spark, tmp_path, monkeypatch):
    path, fields = f"file://{tmp_path}/s", {"v": ","}
    rows = lambda *v: spark.createDataFrame([(x, 1) for x in v], "v string, sign int")
    store = TermCountStore(spark, path, fields, buckets=4)
    store.apply(rows("A", "B,A"), note="monday")
    want = sorted(map(tuple, store.counts().collect()), key=repr)

    def broken(*_):
        raise OSError("lost")

    for step in ("_rename", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(TermCountStore, step, staticmethod(broken))
            with pytest.raises(OSError):
                store.apply(rows("C"), note="tuesday")
            with pytest.raises(OSError):
                store.compact()
        again = TermCountStore(spark, path, fields)
        assert sorted(map(tuple, again.counts().collect()), key=repr) == want and again.note() == "monday"
    with monkeypatch.context() as m:
        m.setattr(TermCountStore, "_rename", staticmethod(lambda *_: False))
        with pytest.raises(RuntimeError):
            store.apply(rows("C"))
    again = TermCountStore(spark, path, fields)
    again.apply(rows("C"), note="tuesday")
    again.compact()
    again.compact()
    assert ("v", "C", 1, 1) in map(tuple, TermCountStore(spark, path, fields).counts().collect()) and again.note() == "tuesday" and again.totals() == {"v": 3}


def test_the_base_is_merged_without_a_shuffle(spark, tmp_path):
    store = TermCountStore(spark, f"file://{tmp_path}/s", {"v": None}, buckets=4)
    for k in range(3):
        store.apply(spark.range(50 * k, 1000).selectExpr("cast(id as string) v", "1 sign"))
    plan = store.counts()._jdf.queryExecution().executedPlan().toString()
    base = plan.split("FullOuter")[1].split("FileScan")[0]
    assert "Exchange" not in base and store.counts().count() == 1001
    store.compact()
    assert len(store._manifest()["segments"]) == 1 and store.counts().where("term = '120'").first()["records"] == 3


def test_a_kept_store_reads_only_what_came_since(spark, tmp_path, small):
    import shutil

    from repspark.llm import queries

    folder = tmp_path / "in"
    folder.mkdir()
    whole = spark.read.parquet(f"{small}/tidy_contigs.parquet")
    cut = whole.selectExpr("max(loaded_at) - interval 5 days m").first()["m"]
    spark.conf.set("repspark.term_store", f"file://{tmp_path}/kept")
    try:
        whole.where(F.col("loaded_at") <= F.lit(cut)).write.parquet(str(folder / "tidy_contigs.parquet"))
        queries.counted_rows(spark, str(folder))
        shutil.rmtree(folder / "tidy_contigs.parquet")
        whole.write.parquet(str(folder / "tidy_contigs.parquet"))
        store = queries.counted_rows(spark, str(folder))
        fresh = TermCountStore(spark, f"file://{tmp_path}/fresh", queries.TERM_FIELDS)
        fresh.apply(whole.withColumn("sign", F.lit(1)))
        assert len(store._manifest()["segments"]) == 3
        assert sorted(map(tuple, store.counts().collect()), key=repr) == sorted(map(tuple, fresh.counts().collect()), key=repr)
        queries.counted_rows(spark, str(folder))
        assert len(store._manifest()["segments"]) == 3
    finally:
        spark.conf.unset("repspark.term_store")


# --- 5: top n ---


def test_top_n_with_ties_copies_and_missing_scores(spark):
    nan = float("nan")
    rows = [("s", f"i{k:03d}", 5.0, T0) for k in range(200)] + [("s", "best", 9.0, T0), ("s", "best", 1.0, T0 - timedelta(1)), ("s", "gone", 99.0, T0), ("s", "gone", None, T0 + timedelta(1)), ("s", "bad", nan, T0)]
    rows += [("t", "a", 0.0, T0), ("t", "b", -0.0, T0), ("t", "b", -0.0, T0), (None, "x", 1.0, T0), ("t", None, 1.0, T0), ("u", "only", None, T0), ("t", "Z", -2.0, None)]
    df = spark.createDataFrame(rows, "g string, i string, score double, at timestamp_ntz").withColumn("neg", F.lit("clash"))
    got = top_n(latest_per_item(df, "g", "i", "score", "at"), "g", "i", "score", 3)
    assert sorted((r["g"], r["place"], r["i"]) for r in got.collect()) == [("s", 1, "best"), ("s", 2, "i000"), ("s", 3, "i001"), ("t", 1, "a"), ("t", 2, "b"), ("t", 3, "Z")]
    assert top_n(latest_per_item(df.limit(0), "g", "i", "score", "at"), "g", "i", "score", 3).count() == 0


# --- 6: tokens ---

TEXTS = [None, "", " ", "  \n\t x", "Don't stop—it's 3.14!", "<|endoftext|> plain", "ห้ามละลายหลอดนี้ " * 3, "第二批细胞变弱……但仍可检出。" * 40, "👩‍🔬🧬" * 5, "a" * 5000, "é́​﻿", "नमूना " * 4, "x\r\n\r\ny", "\x00\x01"]


def test_tokens_equal_the_reference_library(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df, queries.vocabulary_path()).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}


def test_tokens_of_random_pieces():
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = encoder(open(queries.vocabulary_path(), "rb").read())
    random.seed(7)
    for _ in range(800):
        w = "".join(random.choice("abcdeT กขคअआ漢字é👩‍\n\t .,1'") for _ in range(random.randrange(1, 60)))
        assert e.encode(w) == t.encode(w, add_special_tokens=False).ids
        assert b"".join({v: k for k, v in e.ranks.items()}[i] for i in e.encode(w)[:3]).decode("utf-8", "ignore")[:1] in (w[:1], "")


# --- 7: leaks ---


def _brute(docs, items, run=12):
    pats = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - run + 1):
            pats.setdefault(tuple(ws[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for ws in [words(t)] for k in range(len(ws) - run + 1) for i in pats.get(tuple(ws[k : k + run]), ())}


def test_leaks_against_brute_force(spark):
    random.seed(11)
    vocab = [f"w{i}" for i in range(30)] + ["Straße", "ﬁne", "ÉTÉ"]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.randrange(5, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, items_dup := "same words " * 10), (93, items_dup)]
    docs = []
    for d in range(120):
        ws = [random.choice(vocab) for _ in range(random.randrange(0, 900))]
        src = words(random.choice(items[:25])[1])
        n = random.choice([0, 11, 12, 13, 40])
        a = random.randrange(0, max(1, len(src) - n))
        at = random.randrange(0, len(ws) + 1)
        docs.append((d, "  ,​ ".join(ws[:at] + [w.upper() for w in src[a : a + n]] + ws[at:])))
    docs += [(500, None), (501, ""), (502, "SAME­words " * 9), (503, docs[3][1]), (504, "ＳＡＭＥ words; " * 8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    got = {tuple(r) for r in find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = _brute(docs, items)
    assert got == want and len(want) > 20 and (504, 92) in want and (504, 93) in want
    assert find_leaks(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert find_leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_heaps_hold_n_rows_a_group(monkeypatch):
    import pyarrow as pa

    from repspark.llm import top_n as module

    monkeypatch.setattr(module, "HELD", 50)
    random.seed(2)
    rows = [(random.choice("ab"), f"i{k:04d}", random.choice([1.0, 2.0, 3.5])) for k in range(3000)]
    batches = [pa.RecordBatch.from_pylist([{"g": g, "i": i, "s": s} for g, i, s in rows[a : a + 100]]) for a in range(0, 3000, 100)]
    part = [list(module._before(4)(iter(batches[k::3]))) for k in range(3)]
    assert all(sum(b.num_rows for b in p) <= 2 * 4 for p in part)
    merged = pa.Table.from_batches([b for p in part for b in p]).sort_by("g").to_batches(max_chunksize=3)
    got = [tuple(r.values()) for b in module._after(4)(iter(merged)) for r in b.to_pylist()]
    want = [(g, i, s, k) for x in "ab" for k, (g, i, s) in enumerate(sorted((r for r in rows if r[0] == x), key=lambda r: (-r[2], r[1]))[:4], 1)]
    assert got == want


def test_an_evaluation_set_of_over_two_million_words(spark):
    import resource

    vocab = [f"w{i}" for i in range(50_000)]
    random.seed(4)
    items = [(i, " ".join(random.choices(vocab, k=30_000))) for i in range(75)]
    docs = [(d, " ".join(random.choices(vocab, k=200) + items[d][1].split()[500 : 500 + n])) for d, n in ((3, 12), (70, 40), (74, 11))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, 3), (70, 70)]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1000


def test_items_in_several_passes(spark, monkeypatch):
    from repspark.llm import leaks

    monkeypatch.setattr(leaks, "PASS_WORDS", 20)
    item = " ".join(f"x{i}" for i in range(70))
    docs = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(25, 40))), (2, "nothing")], "doc_id bigint, text string")
    got = find_leaks(docs, spark.createDataFrame([(7, item), (8, item[:60])], "item_id bigint, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7)]
    assert WuManber([]).search([["a"] * 20]) == []


# --- 8: sentences ---


def _sentences(spark, small, extra):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id bigint, text string")).withColumn("seg", F.lit("clash"))
    out = {}
    for r in find_sentences(df).where("doc_id < 0").orderBy("sent_start").collect():
        t = extra[-1 - r["doc_id"]]
        out.setdefault(-1 - r["doc_id"], []).append(t[r["sent_start"] : r["sent_end"]])
    return out


def test_sentences_of_hand_made_texts(spark, small):
    cases = {
        "Mr. Zubrik thinks the read floor stayed flat; Prof. Dunleth does not. We stopped at 9:54 p.m. since two tubes shared a label. It failed.": ["Mr. Zubrik thinks the read floor stayed flat; Prof. Dunleth does not.", "We stopped at 9:54 p.m. since two tubes shared a label.", "It failed."],
        "Summary\n\nThe capture was\nlow. He said \"no.\" and left.": ["Summary", "The capture was\nlow.", 'He said "no." and left.'],
        "- first. And more\n- second\r\n* third": ["- first. And more", "- second", "* third"],
        ">read1_n=2\nACGT\n \n[03-05-2025] - x. Y.": [">read1_n=2", "ACGT", "[03-05-2025] - x. Y."],
        "真的吗？！文库升高，重链下降；原因不明。文件out/lane62.tsv是空的。": ["真的吗？！", "文库升高，重链下降；原因不明。", "文件out/lane62.tsv是空的。"],
        "ห้ามละลายหลอดนี้ พบ IGKV5-77 จำนวน 12157 ครั้งในโคลนหลัก": ["ห้ามละลายหลอดนี้", "พบ IGKV5-77 จำนวน 12157 ครั้งในโคลนหลัก"],
        "Im 3. Versuch (s. S. 22) war das Kontrollgemisch wieder sichtbar. So nicht!": ["Im 3. Versuch (s. S. 22) war das Kontrollgemisch wieder sichtbar.", "So nicht!"],
    }
    texts = [*cases, None, "", " \n\t ", "x" * 100_000, "Nothing was low. " * 3000]
    got = _sentences(spark, small, texts)
    for i, want in enumerate(cases.values()):
        assert got[i] == want
    n = len(cases)
    assert not any(i in got for i in (n, n + 1, n + 2)) and got[n + 3] == ["x" * 100_000] and len(got[n + 4]) == 3000


def test_places_depend_on_whole_words_however_long():
    from repspark.llm.sentence_places import HIDDEN, L1, parse

    for n in (3, 29, 30, 31, 500):
        _, _, _, _, cols = parse([f"a1{'b' * n}.Next one"])
        assert (cols["kind"] == HIDDEN).sum() == 1
    for wide in (10, 24, 60, 3000):
        one, two = (parse([f"{c}{'x' * wide}. Next {'y' * wide}{c} end."])[4] for c in "pq")
        hidden = one["kind"] == HIDDEN
        assert one["l2"][hidden] != two["l2"][hidden] and one["r3"][hidden] != two["r3"][hidden] and one["l1"][hidden] == two["l1"][hidden]
    assert L1 == 2


def test_a_batch_is_parsed_as_its_texts_are_alone():
    import numpy as np

    from repspark.llm.sentence_places import COLS, parse

    random.seed(6)
    signs = list("aB1 .!?…。」「()\"'“”\n\r-*>[์กข漢é،؟।:;,_\u200b\U0001f600\u0301") + ["\n\n", " \n", ". ", "1. ", "- "]
    texts = ["".join(random.choices(signs, k=random.randrange(0, 60))) for _ in range(300)] + [None, "", "\n\n", "(", '"', ".", "。", "ก", "ก ข"]
    seg_doc, lo, hi, doc, cols = parse(texts)
    for d, t in enumerate(texts):
        one = parse([t])
        mine, first = seg_doc == d, int(np.searchsorted(seg_doc, d))
        assert one[1].tolist() == lo[mine].tolist() and one[2].tolist() == hi[mine].tolist()
        for c in COLS:
            assert (one[4][c] + (first if c == "seg" else 0)).tolist() == cols[c][doc == d].tolist(), (c, t)
        covered = {i for a, b in zip(one[1], one[2]) for i in range(a, b)}
        assert all(i in covered or x.isspace() for i, x in enumerate(t or ""))
        assert all((t[s:n].isspace() or s == n) for s, n, k in zip(one[4]["stop"].tolist(), one[4]["next"].tolist(), one[4]["kind"].tolist()) if k == 0)


def test_posteriors_are_those_of_all_ways_to_set_boundaries():
    from itertools import product

    import numpy as np

    from repspark.llm.sentence_places import CELLS, HIDDEN, KINDS
    from repspark.llm.sentences import Model

    rng = np.random.default_rng(3)
    counts = np.zeros((KINDS * CELLS, 2))
    at = rng.integers(0, CELLS, (KINDS, 40))
    for k in range(KINDS):
        n = rng.integers(1, 30, 40)
        counts[k * CELLS + at[k], 1] = n
        counts[k * CELLS + at[k], 0] = rng.random(40) * n
    m = Model(counts)

    class P:
        pass

    p, sizes = P(), [1, 4, 2, 6]
    n = sum(sizes)
    p.doc, p.seg, p.kind = np.repeat(np.arange(4), sizes), np.zeros(n, int), np.full(n, HIDDEN)
    for c, k in (("l3", 0), ("l2", 1), ("l1", 2), ("r3", 3), ("r2", 4), ("r1", 5)):
        setattr(p, c, k * CELLS + rng.choice(at[k], n))
    p.l3b = np.where((rng.random(n) < 0.7) & np.concatenate([[False], p.doc[1:] == p.doc[:-1]]), rng.choice(at[0], n), -1)
    q = m.posterior(p)
    e0, e1 = m.event(p.l3, p.l2, p.l1), m.event(np.where(p.l3b >= 0, p.l3b, p.l3), p.l2, p.l1)
    wb, wn = m.word(p)
    for d in range(4):
        i = np.flatnonzero(p.doc == d)
        want, total = np.zeros(len(i)), 0.0
        for way in product((0, 1), repeat=len(i)):
            x, last = 1.0, 0
            for j, b in zip(i, way):
                e = e1[j] if last else e0[j]
                x *= e * wb[j] if b else (1 - e) * wn[j]
                last = b
            total += x
            want += x * np.array(way)
        assert np.allclose(q[i], want / total)


def test_each_character_lies_in_one_sentence(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    covered = Counter()
    got = queries.QUERIES["p8_found"](spark, small).collect()
    for r in got:
        s = docs[r["doc_id"]][r["sent_start"] : r["sent_end"]]
        assert s and s == s.strip()
        covered.update((r["doc_id"], i) for i in range(r["sent_start"], r["sent_end"]))
    assert max(covered.values()) == 1
    assert all((d, i) in covered for d, t in docs.items() for i, c in enumerate(t or "") if not c.isspace())
