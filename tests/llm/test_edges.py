"""Every operator on odd rows and on empty tables: no crash, and the results that the docstrings define."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import chroma, jaccard, language, lines, mixing, packing, pieces, quality, secrets, urls
from sieveline.llm.queries import QUERIES, piece_model


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_of_odd_rows(odd_docs):
    model = language.learn(odd_docs, F.lit(True))
    got = by_id(language.predict(odd_docs, model))
    assert odd_docs.count() == language.predict(odd_docs, model).count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert got[5]["lang_pred"] == "en" and 0 <= got[5]["score"] <= 1
    assert language.learn(odd_docs, F.lit(False)) is None
    assert by_id(language.predict(odd_docs, None))[5]["lang_pred"] == "und"


def test_quality_of_odd_rows(spark, odd_docs):
    trusted = spark.createDataFrame([(5,), (7,)], "doc_id bigint")
    model = quality.learn(odd_docs, trusted, F.lit(True), 0.5)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.learn(odd_docs, trusted.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.score(odd_docs, None).collect()} == {0.0}
    assert quality.keep(odd_docs, model).columns == odd_docs.columns


def test_jaccard_of_odd_rows(spark, odd_docs):
    rows = jaccard.link(spark, odd_docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert all(got[i]["n_shingles"] == 0 and got[i]["component_id"] == i for i in (1, 2, 3))
    assert got[4]["n_shingles"] == 1
    assert [r["component_id"] for r in rows if r["doc_id"] in (5, 6)] == [5, 5, 5]
    assert got[None]["component_id"] is None
    kept = jaccard.one_of_each(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None, 9, 10]))


def test_secrets_of_odd_rows(spark, odd_docs):
    found, ledger = secrets.scan_all(spark, odd_docs)
    rows = secrets.digest(found).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[8]["n_assign"], got[8]["n_access"], got[8]["n_hex"]) == (1, 1, 1)
    masked = secrets.redact(odd_docs, ledger)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    assert by_id(masked)[8]["text"] == 'x [secret]" é🎉 [secret]'
    assert by_id(masked)[1]["text"] is None


def test_lines_of_odd_rows(odd_docs):
    rows = lines.apply(odd_docs, lines.learn(odd_docs)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    for i in (1, 2, 3):
        assert got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"]
    assert got[7]["n_words"] == 30_000


def test_packing_of_odd_rows(spark, odd_docs):
    rows = packing.pack(odd_docs, ranks(), 50256, capacity=128).collect()
    keys = [k for r in rows for k, a in zip(r["keys"], r["piece_starts"]) if a == 0]
    assert len(keys) == odd_docs.count()
    assert all(r["cu_seqlens"][-1] <= 128 and len(r["ids"]) == 256 for r in rows)


def test_pieces_of_odd_rows(odd_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = pieces.encode_decode(odd_docs, piece_model(), with_ids=True, check="texts").join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
    assert {r["doc_id"]: r["ids"] for r in rows}[1] == [1, 2]


def test_mixing_of_odd_rows(spark, odd_docs):
    draws, weights = mixing.mix(spark, odd_docs, None, 0.9, 3.0)
    assert {r["doc_id"] for r in draws.collect()} == {r["doc_id"] for r in odd_docs.collect()}
    assert {r["source"] for r in weights.collect()} >= {None, "a", "b", "c"}
    assert mixing.drawn_rows(spark, odd_docs, draws).columns == odd_docs.columns


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://Www.EXAMPLE.org/es/x?y#z"), (4, "http://Www.EXAMPLE.org/es/x?y#z"), (5, "https://a.com#x"), (6, "ftp://b.com/fr/"), (7, "x://é.net/" + "a" * 50_000), (None, "http://a.org")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("x"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None)
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert (got[5]["host"], got[5]["path"]) == ("a.com", "") and got[6]["verdict"] == "allow"
    assert got[None]["rule"] is None  # its path is empty


def test_recordings_of_odd_rows(spark):
    rows = [(1, None), (2, bytearray()), (3, bytearray(b"abc")), (4, bytearray(50_000)), (4, bytearray(50_000)), (5, bytearray(b"\x01\x02" * 30_000))]
    df = spark.createDataFrame(rows, "vec_id bigint, audio binary").withColumn("codes", F.lit("x"))
    got = chroma.search(spark, df, "vec_id", "audio", F.col("vec_id") % 2 == 0).collect()
    members = {r["vec_id"]: r["class_id"] for r in got if r["kind"] == "member"}
    assert members == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


# Rows that share a key, or have none


def long_text(seed, n=30):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def shared_keys(make_docs):
    """One key on different texts, copies under other keys, equal rows, null keys in several sources, and clashing columns."""
    a, b, c, d, e = map(long_text, range(5))
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (3, c, "en", "s"), (3, d, "en", "t"), (4, e, "en", "t"), (4, e, "en", "t"), (4, e, "fr", "t")]
    rows += [(None, long_text(9), "en", "s"), (None, long_text(9), "en", "s"), (None, a, "en", "t"), (None, long_text(10), "en", "t"), (None, "", "en", "t"), (None, "", "en", "t"), (7, None, "en", None)]
    return make_docs(rows, clash=True)


def plain_rows(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=repr)


def test_one_row_of_each_component(spark, shared_keys):
    every = plain_rows(shared_keys)
    kept = plain_rows(jaccard.one_of_each(spark, shared_keys))
    # no two texts are near: a component is a text
    expected = []
    for text in {t for _, t, _, _ in every if t}:
        own = [r for r in every if r[1] == text]
        least = min(own, key=lambda r: (r[0] is None, r[0] or 0))
        expected.append((least[0], text))
    assert sorted(((k, t) for k, t, _, _ in kept if t), key=repr) == sorted(expected, key=repr)
    assert [r for r in kept if not r[1]] == [r for r in every if not r[1]]
    assert kept == plain_rows(jaccard.one_of_each(spark, shared_keys.repartition(5)))


@pytest.mark.parametrize("budget", [None, 0.5, 1.7])
def test_rows_come_as_often_as_they_were_drawn(spark, shared_keys, budget):
    import collections

    draws, _ = mixing.mix(spark, shared_keys, budget, 0.97, 4.0)
    drawn = draws.collect()
    got = mixing.drawn_rows(spark, shared_keys, draws)
    assert got.columns == shared_keys.columns
    rows = plain_rows(got)
    assert len(rows) == len(drawn)
    of_source = lambda s, n: (s, n)
    count = lambda pairs: collections.Counter(pairs)
    assert count(of_source(s, len((t or "").split())) for _, t, _, s in rows) == count(of_source(r["source"], r["tokens"]) for r in drawn)
    if budget is None:
        assert set(rows) == set(plain_rows(shared_keys))
        times = collections.Counter(rows)
        copies = collections.Counter(plain_rows(shared_keys))
        assert all(times[r] >= n for r, n in copies.items())


def test_masks_leave_other_columns_alone(spark, make_docs):
    docs = make_docs([(1, "a token = abcdef123456 b", "en", "s"), (1, "nothing", "en", "s"), (None, None, "en", "s")], clash=True)
    _, ledger = secrets.scan_all(spark, docs)
    got = secrets.redact(docs, ledger).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", "a [secret] b"), ("1", "nothing"), ("None", None)]
    assert all(r[c] == "x" for r in got for c in ("_value", "_key", "_blob", "_spans"))


def test_pipeline_of_shared_keys(spark, shared_keys, tmp_path):
    import corpus_pipeline as p

    shared_keys.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    once = jaccard.one_of_each(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"))
    draws, _ = mixing.mix(spark, once, None, p.ENTROPY_SHARE, p.MOST_REPEATS)
    assert len(got) == draws.count() and {r["doc_id"] for r in got} == {r["doc_id"] for r in once.collect()}


def test_models_do_not_depend_on_the_order_of_rows(spark, make_docs):
    import numpy as np

    rows = [(1, long_text(i, 60) if i % 2 else "de la " * 20 + long_text(i, 20), "en" if i % 2 else "fr", "s") for i in range(10_000)]
    docs = make_docs(rows)
    orders = [docs, docs.orderBy("lang").coalesce(1), docs.repartition(7)]
    by_language = [language.learn(d, F.lit(True), most=20) for d in orders]
    assert all(m.labels == ["en", "fr"] for m in by_language) and all((m.grams == by_language[0].grams).all() for m in by_language)
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    by_quality = [quality.learn(d, trusted, F.lit(True), 0.5, most_positives=50, most_unlabelled=100) for d in orders]
    assert all(np.array_equal(m.params[k], by_quality[0].params[k]) for m in by_quality for k in m.params)
    by_lines = [lines.learn(d, most=50) for d in orders]
    assert all((m.weights == by_lines[0].weights).all() for m in by_lines)


def test_numbers_do_not_depend_on_the_order_of_arrival(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 2000)
    rows = [(i % 40, long_text(i % 90), "en", "s") for i in range(120)] + [(1, None, "en", "s"), (None, "", "en", "s")]
    arrivals = [make_docs(r).repartition(1) for r in (rows, rows[::-1], rows[50:] + rows[:50])]
    sent = [sorted(map(repr, jaccard.ask(d, 3, ["doc_id"], "text").collect())) for d in arrivals]
    assert sent[0] == sent[1] == sent[2] and len(sent[0]) > 30
    placed = [sorted(map(repr, packing.encode(d, ranks(), 50256, "doc_id", "text").collect())) for d in arrivals]
    assert placed[0] == placed[1] == placed[2]


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from sieveline.llm import shared

    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://h:1", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        shared.checkpoint_dir(elsewhere)
    assert shared.checkpoint_dir(spark)
