"""Encoding, counts, language, licenses and packing: against libraries, loops and held-out labels, and on untidy tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm import bpe, langid, licenses, packing, token_counts
from careflow.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "one", "It's a cat, isn't it? <|endoftext|> ÀÉ", "x" * 5000, "mit license " * 3, "Released under the MIT License.", "one", "ab cd " * 4000]


@pytest.fixture(scope="module")
def untidy(spark):
    """Null, empty, long, repeated and equal texts; null and repeated ids; columns named like results."""
    rows = [(None if i == 3 else i, t, None if i % 4 == 0 else "en", "s", i, 1, 2.0, "x", True) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (4, "another text", "de", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, ids long, score double, lang_pred string, kept boolean")


def test_short_and_long_merges_agree():
    ranks = bpe.rank_table(bpe.read_vocabulary(VOCABULARY)["pairs"])
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aeinstrhl!?é") for _ in range(rng.randint(1, 90))) + "</w>"
        assert bpe.merge_word(word, 4, ranks) == bpe.merge_long_word(word, 4, ranks)


def test_encoding_is_the_librarys(spark, untidy):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(7)
    strange = "aA bB'sTtdDİΣσ\x1c\x85\xa0\u2003\u200b é漢字1²½٣<|endoftext|>🙂\n\t!?.—ßŒ"
    more = spark.createDataFrame([(100 + i, "".join(rng.choice(strange) for _ in range(rng.randint(0, 200)))) for i in range(300)], "doc_id long, text string")
    docs = untidy.select("doc_id", "text").union(more)
    got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    texts = [r["text"] or "" for r in docs.collect()]
    assert len(got) == len(texts)
    expected = []
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        expected.append((ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r["ids"], r["decoded"]) for r in got) == sorted(expected)
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_query_2_digests(spark):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, SF).collect():
        ids = library.encode(texts.pop(r["doc_id"]) or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not texts


def test_tree_counts_as_if_from_scratch():
    encoder = bpe.Encoder(bpe.read_vocabulary(VOCABULARY))
    rng = random.Random(3)

    def some(n):
        return "".join(rng.choice("ab c.\n<|endoftext|>é d'll 1 ") for _ in range(n))

    for _ in range(60):
        text = some(rng.choice([0, 5, 700, 6000]))
        tree = token_counts.CountedText(text, encoder)
        for _ in range(10):
            start = rng.randint(-2, len(text) + 3)
            stop, new = start + rng.choice([0, 0, 3, 40, 900]), some(rng.choice([0, 1, 7, 600, 12000]))
            tree.edit(start, stop, new)
            start = min(max(start, 0), len(text))
            text = text[:start] + new + text[min(max(stop, start), len(text)) :]
            assert tree.n_chars == len(text) and tree.n_tokens == len(encoder.encode(text)) // 4


def test_an_edit_encodes_only_its_surroundings():
    encoder = bpe.Encoder(bpe.read_vocabulary(VOCABULARY))
    tree = token_counts.CountedText("some words here " * 20_000, encoder)
    before = tree.encoded
    tree.edit(100_000, 100_003, "more")
    assert tree.encoded - before < 4 * token_counts.LEAF


def test_query_3_counts(spark):
    encoder = bpe.Encoder(bpe.read_vocabulary(VOCABULARY))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(t)
        new = t[: n // 3] + t[n // 3 + 20 :]
        new = new[: 2 * n // 3] + t[:30] + new[2 * n // 3 :] + t[:10]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (len(encoder.encode(t)) // 4, len(encoder.encode(new)) // 4, len(new))


def test_counts_of_untidy_tables(spark, untidy):
    edits = spark.createDataFrame([(1, 1, None, None, "a b c"), (9, 2, 0, 3, None), (9, 1, 5, 1, "zz"), (None, 1, 0, 1, "q"), (777, 1, 0, 1, "q")],
                                  "doc_id long, edit int, start long, stop long, new string")
    got = token_counts.count_edits(untidy, edits, VOCABULARY).collect()
    assert len(got) == untidy.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 4}
    assert (by_id[1]["n_tokens"], by_id[1]["edited_tokens"]) == (0, 3)
    assert by_id[9]["edited_chars"] == 24_000 + 2 - 3
    assert by_id[0]["edited_tokens"] == 0 and by_id[None]["n_tokens"] == 1
    assert token_counts.count_edits(untidy.limit(0), edits, VOCABULARY).count() == 0


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 250
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_backoff_uses_the_longest_known_grams():
    model = langid.Model(["de", "en"], np.log([0.5, 0.5]), {"und": (-1.0, -9.0)}, {" ab": (-2.0, -4.0), "abc": (-4.0, -2.0), "a": (-7.0, -1.0)}, 3)
    scorer = langid.Scorer(model)
    assert scorer.word("und") == (-1.0, -9.0)
    assert scorer.word("abc") == (-3.0, -3.0)
    assert scorer.word("za") == (-7.0, -1.0)
    assert scorer.word("qq") == (0.0, 0.0)
    assert scorer.predict("und a")[0] == "de"
    assert scorer.predict("12 !?") == ("und", 0.0)


def test_language_model_knows_every_word_of_its_sample(spark):
    made = ["".join(x) for x in itertools.product("abcdefghijklmnop", repeat=4)]
    rows = [(i, " ".join(made[i * 1024 : (i + 1) * 1024] * 2), "en") for i in range(64)] + [(64, "zürich zwölf", "small"), (65, "กขคงจฉ", "th")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.words) == {*made, "zürich", "zwölf", "กขคงจฉ"}
    counts = {}
    for _, text, lang in rows:
        for word in text.split():
            for k in range(1, 6):
                for i in range(len(word) + 3 - k):
                    gram = f" {word} "[i : i + k]
                    counts.setdefault(gram, dict.fromkeys(("en", "small", "th"), 0))[lang] += 1
    assert set(model.grams) == {g for g, n in counts.items() if len(g) == 1 or sum(n.values()) >= 3}
    for k in range(1, 6):
        sized = {g: n for g, n in counts.items() if len(g) == k}
        total = [sum(n[x] for n in sized.values()) for x in model.languages]
        for g in sized.keys() & model.grams.keys():
            assert model.grams[g] == pytest.approx([np.log((sized[g][x] + 0.5) / (t + 0.5 * len(sized))) for x, t in zip(model.languages, total)])


def test_language_sample_is_drawn_per_language(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id < 3997, 'one text many times', concat('rare', char(97 + id % 3))) as text", "if(id < 3997, 'en', 'small') as lang")
    model = langid.fit(docs, fit_rows=100)
    assert {"many", "rarea", "rareb", "rarec"} <= set(model.words)
    assert np.exp(model.prior).tolist() == pytest.approx([3997 / 4000, 3 / 4000])


def test_language_of_untidy_tables(spark, untidy):
    model = langid.fit(untidy)
    got = langid.predict(untidy, model).collect()
    assert len(got) == untidy.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    nothing = langid.fit(untidy.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(untidy, nothing).collect()} == {"und"}
    assert langid.predict(untidy.limit(0), model).count() == 0
    assert langid.annotate(untidy.drop("lang_pred", "score"), model).columns[-2:] == ["lang_pred", "score"]


def test_licenses_of_untidy_tables(spark, untidy):
    got = {r["doc_id"]: r for r in licenses.scan(untidy).collect()}
    assert (got[6]["n_words"], got[6]["n_base"], got[6]["first_word"], got[6]["last_word"], got[6]["score"]) == (6, 3, 0, 4, 0.5)
    assert (got[7]["labels"], got[7]["score"], got[7]["spans"][0]["last"]) == ("mit", 1.0, 4)
    assert (got[0]["n_words"], got[0]["first_word"], got[0]["labels"]) == (0, None, "")
    assert licenses.scan(untidy.limit(0)).count() == 0


def test_templates_want_all_mandatory_words():
    a = licenses.compile_template("x", "a <<opt>>b <<var;0-1>><</opt>> c <<var;1-2;d|e>> f")
    for text, end in (("a c d f", 4), ("a b c e d f", 6), ("a b q c d f", 6), ("a c f", -1), ("a c q f", -1), ("a b c d d d f", -1), ("a c d f f", 4)):
        assert a.match([w.encode() for w in text.split()], 0) == end
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<opt>>a<</opt>>")


def test_bucket_edges_are_the_best():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(60, n, replace=False) + 1), rng.integers(1, 9, n)

        def padding(edges, lengths=lengths, counts=counts):
            return sum(c * (min(e for e in edges if e >= x) - x) for x, c in zip(lengths, counts))

        edges = packing.best_edges(lengths, counts, k)
        assert len(edges) <= k
        assert padding(edges) == min(padding([*some, lengths[-1]]) for r in range(min(k, n)) for some in itertools.combinations(lengths[:-1], r))


def check_packing(rows, budget):
    batches = {}
    for r in rows:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["bucket_len"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        else:
            assert r["bucket"] is None and r["batch"] is None
    full = {}
    for (bucket, _), held in batches.items():
        size = held[0]["bucket_len"]
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert len(held) * size <= budget or len(held) == 1
        full.setdefault(bucket, []).append(len(held) == max(1, budget // size))
    assert all(f.count(False) <= 1 for f in full.values())


def test_query_7_batches(spark):
    rows = QUERIES["op7_packing"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == docs
    check_packing(rows, 65_536)
    steps = sorted({n for n in docs.values() if n})
    exact = all(n <= packing.FINE for n in steps)
    edges = sorted({r["bucket_len"] for r in rows if r["n_tokens"]})
    if exact:
        counts = [sum(n == s for n in docs.values()) for s in steps]
        assert edges == packing.best_edges(np.array(steps), np.array(counts), 16)


def test_packing_of_untidy_tables(spark, untidy):
    rows = packing.pack(untidy, buckets=3, budget=64).collect()
    assert len(rows) == untidy.count()
    check_packing(rows, 64)
    alike = spark.range(2000).select(F.when(F.col("id") > 900, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.pack(alike, budget=30, parts=7).collect()
    assert len(rows) == 2000
    check_packing(rows, 30)
    assert packing.pack(untidy.limit(0)).count() == 0


def test_packing_is_exact_for_long_documents(spark):
    lengths = [1100 + 37 * i for i in range(60)] + [20_021] * 3 + [5, 900]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=6).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(lengths))
    check_packing(rows, 65_536)
    distinct, counts = np.unique(lengths, return_counts=True)
    edges = packing.best_edges(distinct, counts, 6)
    assert sorted({r["bucket_len"] for r in rows}) == edges and set(edges) <= set(lengths)
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows) == sum(min(e for e in edges if e >= n) - n for n in lengths)
