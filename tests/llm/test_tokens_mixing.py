import numpy as np
import pytest

from ontoloom.llm import mixing, tokens

TEXTS = ["Hello world", "", None, "客户下单后，系统会自动更新库存 😀👩‍💻", " \n\t ", "<|endoftext|>", "á é ñ — “quote”", "x" * 5000 + "客" * 3000]


def test_round_trip_and_offsets(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    e = tokens.encode(df, with_offsets=True).orderBy("doc_id").collect()
    assert e[1].ids == [] and e[2].ids == []
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    t = tokens.load(f"{tokens.TOKENIZERS}/{tokens.DEFAULT}")
    for r, text in zip(e, TEXTS):
        x = t.encode(text or "", add_special_tokens=False)
        assert r.ids == x.ids
        for (a, b), tok in zip(zip(r.char_start, r.char_end), r.ids):
            assert 0 <= a <= b <= len(text or "")
        if text and text.isascii():
            assert "".join(text[a:b] for a, b in zip(r.char_start, r.char_end)) == text
    assert tokens.encode(df.limit(0)).count() == 0
    assert tokens.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().text is None
    n = {r.doc_id: r.n_tokens for r in tokens.count(df, ["doc_id"]).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in e)


def test_other_key(spark):
    df = spark.createDataFrame([("a", "hi")], "key string, text string")
    assert tokens.encode(df, key="key").first().key == "a"


def test_cut_poisson():
    for mu in (0.1, 1.0, 7.0):
        c = mixing.cut_poisson(mu, 3)
        assert c == sorted(c) and c[-1] == 1 and len(c) == 4
    assert mixing.times(mixing.cut_poisson(float("inf"), 2), np.array([0.0, 0.5, 0.99])).tolist() == [2, 2, 2]


def docs(spark, n=3000):
    rows = []
    for i in range(n):
        s = "big" if i % 3 else ["small-one", " Small_One ", "rare", None, " ", "other"][i // 3 % 6]
        rows.append((i, s, "word " * (i % 7 + 1)))
    return spark.createDataFrame([*rows, (n, "big", None), (n + 1, "big", "")], "doc_id bigint, source string, text string")


def test_shares(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.3, 3), ("rare", 0.2, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs(spark))
    plan = mixing.plan(sizes, t)
    got = {r.source: r for r in mixing.shares(sizes, plan).collect()}
    assert set(got) == {"big", "small_one", "rare"}
    for r in got.values():
        assert abs(r.actual_share - r.target_share) < 0.01 and r.most_repeats <= r.max_repeats
    m = mixing.mix(sizes, plan).collect()
    assert [r.shuffle_key for r in m] == sorted(r.shuffle_key for r in m) and len({(r.doc_id, r.copy_no) for r in m}) == len(m)
    assert len(m) == sum(r.docs_out for r in got.values())


def test_mixing_edges(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("gone", 0.5, 2)], "source string, target_share double, max_repeats int")
    for d in (docs(spark, 30), docs(spark, 30).limit(0)):
        sizes = mixing.sized(d)
        r = {x.source: x for x in mixing.shares(sizes, mixing.plan(sizes, t)).collect()}
        assert r["gone"].tokens_out == 0 and r["gone"].actual_share == 0
    assert mixing.shares(sizes, mixing.plan(sizes, t.limit(0))).count() == 0


@pytest.mark.parametrize("raw, want", [(" Product-Doc ", "product_doc"), ("FAQ", "faq"), (" ", None), (None, None)])
def test_source_names(spark, raw, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "s string").select(mixing.norm_source(F.col("s"))).first()[0] == want
