"""Near copies, passages, fingerprints, search, url filter and the pipeline: against SQL and loops, and on untidy tables."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from careflow.llm import url_graph
from careflow.llm.components import components
from careflow.llm.fingerprints import fingerprint_edits
from careflow.llm.near_dedup import near_duplicates
from careflow.llm.queries import QUERIES, SQL
from careflow.llm.search import build_index, search
from careflow.llm.substring import repeated_passages

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF) is None


def family(seed=1):
    """A text with many near copies, chains of copies, repeated rows, null and empty texts, and columns named like results."""
    rng = random.Random(seed)
    base = rng.choices(WORDS, k=80)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append((i, " ".join(copy)))
    chain = rng.choices(WORDS, k=60)
    for i in range(60, 75):
        rows.append((i, " ".join(chain)))
        chain[(i * 7) % 60] = f"new{i}"
    rows += [(80, None), (81, ""), (82, " \n"), (83, "one"), (84, "ONE"), (85, "one two"), (None, " ".join(base)), (90, rows[0][1].upper()), (90, rows[0][1].upper())]
    rows += [(91, " ".join(rng.choices(WORDS, k=3000)))]
    return [(i, t, "x", 1, True, 0) for i, t in rows]


SCHEMA = "doc_id long, text string, id string, n_words long, kept boolean, component_id long"


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def linked_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(sets_of(t, size))
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies_against_all_pairs(spark, size, percent):
    rows = family()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent).collect()
    expected = linked_components([r[:2] for r in rows], size, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len(set(expected.values())) < len(expected) - 20


def test_near_copies_of_an_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges += [edges[0], (7, 7), (None, 3)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            x, y = sorted((top(u), top(v)))
            root[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: top(i) for i in root}


def cut_by_loop(rows, window):
    """Rows (id, text), distinct; texts of one id are ordered by their hash, so ids here have one text each."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_passages_against_a_loop(spark, shards):
    rng = random.Random(2)
    shared = [rng.choices(WORDS, k=k) for k in (19, 20, 21, 60)]
    rows = []
    for i in range(60):
        words = rng.choices(WORDS, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((i, " ".join(words)))
    rows += [(100, "a " * 70), (101, "a b " * 30), (102, rows[5][1]), (103, None), (104, ""), (None, rows[7][1]), (105, " ".join(rng.choices(WORDS, k=30_000)))]
    docs = spark.createDataFrame([(i, t, "x", 1, True, 0) for i, t in [*rows, rows[3]]], SCHEMA)
    got = repeated_passages(docs, window=20, shards=shards, keep=["id", "kept"])
    assert got.columns[-2:] == ["id", "kept"]
    got = got.collect()
    expected = cut_by_loop(rows, 20)
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    for r in got:
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        elif r["doc_id"] is not None:
            assert r["kept_text"] == (dict(rows)[r["doc_id"]] or "")
    assert repeated_passages(docs.limit(0)).count() == 0


def test_fingerprints_of_untidy_tables(spark):
    rows = family()
    got = fingerprint_edits(spark.createDataFrame(rows, SCHEMA), low=0.0, high=1.0).collect()
    assert len(got) == len(rows)
    by_text = {}
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t or "")
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    one = fingerprint_edits(spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and one["near_next"] == 1.0
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_of_a_lexicon_over_the_plan_constant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    assert sorted(map(tuple, fingerprint_edits(docs, most_terms=50).collect())) == sorted(map(tuple, fingerprint_edits(docs).collect()))


def test_fingerprints_hash_a_whole_text_once(spark):
    """One split of the whole texts in the plan that ran: next documents take the part hashes that texts have brought along."""
    found = fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet"))
    assert found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in ran and ran.count("split(lower(text") == 1 and ran.count("split(lower(edited") == 1


def test_fingerprints_tell_near_from_far(spark):
    rows = QUERIES["op5_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    near, far = sum(r["near_edited"] for r in rows) / len(rows), sum(r["near_next"] for r in rows) / len(rows)
    assert near > 0.15 > 10 * far


def bm25(rows, query, k, k1=1.2, b=0.75):
    """Best k (id, score) over all rows with words and an id, by the formula."""
    docs = [(i, (t or "").encode().lower().split()) for i, t in rows if i is not None]
    docs = [(i, w) for i, w in docs if w]
    mean = sum(len(w) for _, w in docs) / len(docs)
    counts = [(i, len(w), collections.Counter(w)) for i, w in docs]
    scored = []
    idf = {}
    for term in set(query.encode().lower().split()):
        df = sum(term in c for _, _, c in counts)
        idf[term] = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    for i, n, c in counts:
        score = sum(w * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * n / mean)) for t, w in sorted(idf.items()) if t in c)
        if score:
            scored.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_search_of_untidy_tables(spark):
    rows = [r[:2] for r in family()]
    docs = spark.createDataFrame(family(), SCHEMA)
    index = build_index(docs)
    got = search(index, docs.where("doc_id in (0, 61, 80, 81, 83, 90, 91) or doc_id is null"), k=6).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9)))
    assert set(by) == {0, 61, 83, 90, 91}
    for q, found in by.items():
        assert found == [(i, pytest.approx(s)) for i, s in bm25(rows, dict(rows)[q], 6)]
    assert search(build_index(docs.limit(0)), docs).count() == 0
    assert search(index, docs.limit(0)).count() == 0


def test_search_for_common_words_only(spark):
    rows = [(i, "a b " * (1 + i % 7) + "c " * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = search(build_index(docs), spark.createDataFrame([(1, "a c"), (2, "b zz")], "doc_id long, text string"), k=5).collect()
    for q, text in ((1, "a c"), (2, "b zz")):
        found = [(r["doc_id"], pytest.approx(r["score"])) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert bm25(rows, text, 5) == found


def test_search_in_many_query_blocks(spark, monkeypatch):
    from careflow.llm import search as module

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, search(build_index(docs), docs.where("doc_id % 20 = 0")).collect()))
    monkeypatch.setattr(module, "QUERIES", 3)
    parts = sorted(map(tuple, search(build_index(docs.repartition(5)), docs.where("doc_id % 20 = 0")).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in whole]
    assert [r[3] for r in parts] == pytest.approx([r[3] for r in whole])


def test_search_scores_few_documents(monkeypatch):
    """Texts of common words: whatever share of the floor is bounded, the answers are the same; as it is set, few documents are scored beside them."""
    from careflow.llm import search as module

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=150)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    (row,) = [r for part in module._build(iter([batch])) for r in part.to_pylist()]
    shard = module.Shard(row, row["n_words"] / row["n_docs"], 1.2, 0.75)
    df = shard.sizes
    weight = np.log(1 + (3000 - df + 0.5) / (df + 0.5))
    hashes, asked = module.WordHash(), []
    for text in texts[::100]:
        terms = np.unique(hashes.of(text.encode().split()))
        asked.append((terms, weight[np.searchsorted(shard.terms, terms)]))

    floors = [shard.top(t, w, 10, 0.0)[1][-1] for t, w in asked]

    def scored():
        """Answers, and the documents whose own terms were gone through."""
        looked, plain = [0], module._ranges

        def ranges(starts, lengths):
            looked[0] += len(starts) if ranges.own(starts) else 0
            return plain(starts, lengths)

        ranges.own = lambda starts: len(starts) > 0 and bool(np.isin(starts, shard.own_starts).all())
        monkeypatch.setattr(module, "_ranges", ranges)
        out = [shard.top(t, w, 10, f) for (t, w), f in zip(asked, floors)]
        monkeypatch.setattr(module, "_ranges", plain)
        return [(d.tolist(), s.tolist()) for d, s in out], looked[0] / len(asked)

    found, few = scored()
    monkeypatch.setattr(module, "BOUNDED", 0.5, raising=False)
    assert scored()[0] == found and few < 100


def test_search_sums_common_lists_for_many_queries_at_once(monkeypatch):
    """Common and rare words, equal texts and nearly equal scores: the best are those of exact sums, and few postings are read by one query alone."""
    from careflow.llm import search as module

    monkeypatch.setattr(module, "TOGETHER", 7)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(3000)], k=rng.choice([3, 40, 120]))) for _ in range(1500)]
    texts += [texts[0]] * 30 + [texts[1] + " w0"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    (row,) = [r for part in module._build(iter([batch])) for r in part.to_pylist()]
    shard = module.Shard(row, row["n_words"] / row["n_docs"], 1.2, 0.75)
    df = shard.sizes
    weight = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    shard.weigh(np.arange(len(df)), weight)
    asked = [np.flatnonzero(np.isin(shard.terms, module.hash_words([t.encode()], module.WordHash())[0])) for t in texts[::40]]

    alone, plain = [0], module._ranges

    def ranges(starts, lengths):
        alone[0] += 0 if len(starts) and np.isin(starts, shard.own_starts).all() else lengths.sum()
        return plain(starts, lengths)

    monkeypatch.setattr(module, "_ranges", ranges)
    found = list(shard.tops(((at, 0.0) for at in asked), 10))
    assert alone[0] < sum(df[at].sum() for at in asked) / 3
    member, term = shard.member, np.repeat(np.arange(len(df)), df)
    for at, (ids, scores) in zip(asked, found):
        mine = np.isin(term, at)
        whole = np.bincount(member[mine], shard.value[mine], len(texts))
        best = np.lexsort((np.arange(len(texts)), -whole))[:10]
        best = best[whole[best] > 0]
        assert ids.tolist() == best.tolist() and np.allclose(scores, whole[best], rtol=1e-12)
    floors = [scores[-1] for _, scores in found]
    assert [(d.tolist(), s.tolist()) for d, s in shard.tops(zip(asked, floors), 10)] == [(d.tolist(), s.tolist()) for d, s in found]


def test_word_hashes_of_many_texts():
    from careflow.llm.text import WordHash, hash_words

    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "B", "b", "\0", "\x0b", "\x1c", " ", "é", " ", "x" * 9, "y" * 1100, "\n", "\t"], k=rng.randrange(40))).encode() for _ in range(2000)]
    words = [w for t in texts for w in t.lower().split()]
    words += [("z" * n).encode() for n in range(1, 70)]
    texts += words[-69:]
    hashes, n = hash_words(texts, WordHash())
    assert n.tolist() == [len(t.split()) for t in texts] and hashes.tolist() == WordHash().of(words).tolist()
    assert [x.tolist() for x in hash_words([b"", b" "], WordHash())] == [[], [0, 0]] and len(hash_words([], WordHash())[0]) == 0


def test_index_of_terms_that_agree_in_most_bits(monkeypatch):
    from careflow.llm import search as module

    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=30))) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["id", "text"])

    def lists():
        (row,) = [r for part in module._build(iter([batch])) for r in part.to_pylist()]
        terms, starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], np.int32)
        assert (terms[1:] > terms[:-1]).all()
        members, counts = np.frombuffer(row["members"], np.uint16), np.frombuffer(row["counts"], np.uint8)
        return sorted((members[a:b].tolist(), counts[a:b].tolist()) for a, b in zip(starts, starts[1:]))

    want, plain = lists(), module.hash_words

    def near(texts, hashes):
        words = [w for t in texts for w in t.split()]
        return np.array([int(w[1:]) + (1 << 60) for w in words], np.uint64), plain(texts, hashes)[1]

    monkeypatch.setattr(module, "hash_words", near)
    assert lists() == want


def pages_by_loop(pages, rounds=12, damping=0.85):
    import re

    def host(u):
        u = u or ""
        return re.split(r"[/?#]", u.split("://", 1)[1])[0].lower() if "://" in u else ""

    def path(u):
        if "://" not in (u or ""):
            return ""
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0]
        return rest[rest.index("/") :] if "/" in rest else ""

    def rule(h, p):
        fits = [r for r in url_graph.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    out, links, seeds = [], {}, {"allow": {}, "block": {}}
    for i, u, html in pages:
        h, p = host(u), path(u)
        r = rule(h, p)
        out.append((i, h, p, r))
        if r and h:
            seeds[r.verdict][h] = seeds[r.verdict].get(h, 0) + 1
        for link in re.findall(r"<a [^>]*href=[\"']([^\"']*)", html or ""):
            d = host(link if "://" in link else "x:" + link) if "//" in link else ""
            if h and d and d != h:
                links[h, d] = links.get((h, d), 0) + 1

    def rank(seed, edges):
        total = sum(seed.values()) or 1
        hosts = {x for e in edges for x in e} | {h for _, h, _, _ in out}
        seed = {h: seed.get(h, 0) / total for h in hosts}
        degree = {}
        for (s, _), n in edges.items():
            degree[s] = degree.get(s, 0) + n
        now = dict(seed)
        for _ in range(rounds):
            got = dict.fromkeys(hosts, 0.0)
            for (s, d), n in edges.items():
                got[d] += now[s] * n / degree[s]
            now = {h: damping * got[h] + (1 - damping) * seed[h] for h in hosts}
        return now

    trust, distrust = rank(seeds["allow"], links), rank(seeds["block"], {(d, s): n for (s, d), n in links.items()})
    return sorted((i, h, p, r.text if r else None, r.verdict if r else "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow") for i, h, p, r in out)


def test_urls_against_a_loop(spark):
    rng = random.Random(6)
    hosts = ["a.example.org", "b.example.com", "c.example.net", "d.example.net", "E.Example.NET", "f.example.net", "com", "example.org"]
    paths = ["/", "/fr/1", "/de/2", "/es/3", "/en/1", "/en/2", "", "?q=/de/", "#x"]
    pages = []
    for i in range(150):
        links = "".join(f'<a class=x href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/x">y</a><a href="/here">z</a>' for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", f"<html>{links}</html>"))
    pages += [(200, None, None), (201, "no scheme", ""), (202, "x://", "<a href=//q.example.net>"), (203, "a://b://com/de/", "")]
    docs = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_graph.judge_urls(docs).collect())
    assert got == pages_by_loop(pages)
    assert {"allow", "block"} == {v for _, _, _, r, v in got if r is None}
    assert url_graph.judge_urls(docs.limit(0)).count() == 0


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 19
    pages = [(0, "http://h0.com/de/", "")] + [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}.{"com" if i == 1 else "net"}/">x</a>') for i in range(1, n)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_graph.judge_urls(docs).collect()}
    assert {r["verdict"] for r in got.values()} == {"block"}
    assert [got[i]["distrust"] for i in range(n)] == pytest.approx([0.15 * 0.85**i for i in range(n)])
    with pytest.raises(ValueError):
        url_graph.judge_urls(docs, most_rounds=12)


def test_query_10_against_a_loop(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op10_url_filter"](spark, SF).collect())
    assert got == pages_by_loop(pages)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    deduped = corpus_pipeline.near_dedup(spark, docs, SF)
    comps = linked_components(rows, 5, 80)
    assert sorted(r["doc_id"] for r in deduped.collect()) == sorted({i for i, _ in rows if comps[i] == i})
    cut = corpus_pipeline.substring_dedup(spark, docs, SF)
    expected = cut_by_loop(rows, 50)
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(left) == {i for i, (n, gone, _) in expected.items() if not gone or gone < n}
    for i, text in left.items():
        assert text == dict(rows)[i] if not expected[i][1] else hashlib.sha256(text.encode()).hexdigest() == expected[i][2]
    docs.unpersist()


def test_pipeline_runs_from_end_to_end(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near dedup", "substring dedup", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "bucket" in out.columns


def test_pipeline_of_an_empty_and_an_untidy_table(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat sat " * 40, None, None, None), (3, "the dog ran off", "en", "s", 15)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= 4


def test_stages_take_clashing_columns_and_no_n_chars(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars").withColumns({c: F.lit(1) for c in ("lang_told", "score_told", "n_words", "n_removed", "kept_text", "kept", "component_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() > 50


def test_run_predicts_each_language_once(spark):
    plan = corpus_pipeline.run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
