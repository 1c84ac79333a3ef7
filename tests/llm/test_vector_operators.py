"""Token files, centroid clustering and hard negatives: against the tokenizers library and brute force, and on untidy tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from careflow.llm import negatives, token_files
from careflow.llm.centroids import Bisectors, cluster
from careflow.llm.negatives import Tree, hard_negatives, pack_rows
from careflow.llm.queries import BYTE_VOCABULARY, QUERIES
from careflow.llm.token_files import TextEncoder, TokenFile, TokenFileWriter, open_file, pack_bits, read_documents, unpack_bits, write_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_VOCABULARY)


def expected_documents(library, rows):
    """(id, start, n_tokens, crc) of rows in order, by the library and whole texts."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", range(1, 33))
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    data = pack_bits(ids, bits)
    assert len(data) == -(-1000 // 64) * bits * 8
    assert unpack_bits(data, bits)[:1000].tolist() == ids.tolist()
    assert pack_bits(ids[:0], bits) == b"" and len(unpack_bits(b"", bits)) == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r\x1c\x85\xa0 ᠎​  　abÉ'slre1²٣.,<|>#́中🙂"), max_size=30))
def test_words_make_the_text(text):
    library, encoder = test_words_make_the_text.made
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


test_words_make_the_text.made = (Tokenizer.from_file(BYTE_VOCABULARY), TextEncoder(BYTE_VOCABULARY))


def test_every_latin_character(library):
    """Each character up to U+0250, and of general punctuation, before, after and between letters, digits and signs."""
    encoder = TextEncoder(BYTE_VOCABULARY)
    for c in map(chr, [*range(0x260), *range(0x2000, 0x2070)]):
        text = f"a{c}a 1{c}1 ,{c}, {c} '{c} x{c}'s_ {c}{c}"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_special_tokens_and_long_texts(library):
    encoder = TextEncoder(BYTE_VOCABULARY)
    rng = random.Random(3)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>", "x" * 50_000, "ab " * 50_000, "\n" * 3000, " " * 5001, "".join(rng.choices("ab \n", k=30_000))]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_runs_are_cut(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 100)
    monkeypatch.setattr(token_files, "RUN", 300)
    encoder = TextEncoder(BYTE_VOCABULARY)
    texts = [" ".join(f"word{i} and" for i in range(2000)), "", " ", "a  b" * 400, "x" * 1000 + " " + "y" * 400 + "\n z", "one <|endoftext|> two", "a.\nB c\n\nd e\n f \ng h\ni\nj\n<|endoftext|>\nk", "\n", "a\n", "\na", "é\x85\né"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(encoder.later) <= 100


def test_file_random_access(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 256)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (1, 0, 70, 255, 256, 1000, 3, 64, 64)]
    held = io.BytesIO()

    class Kept:
        write = staticmethod(held.write)
        close = staticmethod(lambda: None)

    writer = TokenFileWriter(Kept(), 16, pa.string())
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else f"d{i}", ids)
    writer.close()
    file = TokenFile(pa.PythonFile(io.BytesIO(held.getvalue()), "r"))
    whole = np.concatenate(docs)
    assert file.n_ids == len(whole) and len(file) == 9 and file.doc_ids.to_pylist()[3] is None
    for _ in range(300):
        a, b = sorted(rng.integers(0, len(whole) + 2, 2).tolist())
        assert file.ids(a, b).tolist() == whole[a:b].tolist()
    for k, ids in enumerate(docs):
        assert file.document(k).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        TokenFile(pa.PythonFile(io.BytesIO(b"x" * 100), "r"))


def test_query_11(spark, library):
    got = QUERIES["op11_token_files"](spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert [tuple(r) for r in got] == expected_documents(library, docs)


def test_token_files_untidy(spark, library, monkeypatch):
    rows = [(5, "five words are in here"), (None, "no id"), (2, None), (2, "two"), (2, "two"), (9, ""), (-1, "x" * 3000), (None, None), (7, " lead  and\ttrail ")]
    schema = "doc_id long, text string, id string, mark int, row int, base int, part int"
    docs = spark.createDataFrame([(i, t, "a", 1, 2, 3, 4) for i, t in rows], schema).repartition(3)
    manifest = write_ids(docs, BYTE_VOCABULARY, 2)
    out = read_documents(manifest, with_ids=True)
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == [None, None, -1, 2, 2, 2, 5, 7, 9]
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*library.encode(t or "").ids, 2])
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and list(r["ids"]) in want[r["id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want[r["id"]].remove(list(r["ids"]))
        start += r["n_tokens"]
    assert not any(want.values())
    part = manifest.orderBy("part", "number").first()
    assert open_file(part["file"]).document(0).tolist() == list(got[0]["ids"])
    assert read_documents(write_ids(docs.limit(0), BYTE_VOCABULARY, 2)).collect() == []


def test_many_files_and_hot_id(spark, library):
    """Files that end after few ids, and one id with most rows, which is not one task's work."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_ids(docs, BYTE_VOCABULARY, 2, file_ids=500).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_docs"] for r in manifest) == 3000 and max(r["n_ids"] for r in manifest) < 510
    most = max(sum(r["n_docs"] for r in manifest if r["part"] == p) for p in {r["part"] for r in manifest})
    assert most < 1500  # of 2000 rows with one id
    at = 0
    for r in sorted(manifest, key=lambda r: (r["part"], r["number"])):
        assert r["base"] == at
        at += r["n_ids"]


def brute_clusters(rows, k, rounds, factor, dims):
    kept = [(i, [int(np.floor(factor * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), n in zip(kept, near) if n == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    each = {j: sum(d for _, n, d in last if n == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, n, d, each[n], sum(each.values()), digest[n]) for i, n, d in last), key=str)


@pytest.mark.parametrize("n,dims,k", [(200, 3, 7), (5, 3, 7), (120, 2, 16)])
def test_clusters_by_brute_force(spark, n, dims, k):
    """Coarse vectors, so that equal distances, equal centroids and empty clusters occur."""
    rng = random.Random(n)
    rows = [(i, [rng.randrange(-3, 4) / 4 for _ in range(dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.1] * (dims + 1)), (n + 3, [float("nan")] * dims), (n + 4, [None] * dims), (n + 5, [float("-inf")] * dims), (0, rows[0][1]), (None, [0.3] * dims)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int, inertia int").repartition(4)
    got = cluster(df, dims=dims, factor=4, k=k).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, 3, 4, dims)


def test_tournament_takes_the_smaller_number_on_ties():
    x = np.array([[0, 0], [1, 0], [5, 5]])
    assert Bisectors.of([[1, 0], [-1, 0], [1, 0], [0, 1]]).nearest(x).tolist() == [0, 0, 0]


def test_clusters_of_nothing_and_too_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster(empty).collect() == [] and cluster(empty).columns[1] == "cluster"
    assert cluster(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        cluster(spark.createDataFrame([(1, [1e30] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")).collect()


def brute_negatives(rows, anchor, factor, p, n, low, high):
    kept = [(i, label, [int(np.floor(factor * x)) for x in v]) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, label, v in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:p]:
            hard = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:n]
            out |= {(i, j, rank + 1, r[1], -s, -r[0]) for rank, r in enumerate(hard)}
    return sorted(out)


@pytest.mark.parametrize("cells,coarse", [(1 << 21, 4), (600, 4), (600, 100)])
def test_negatives_by_brute_force(spark, monkeypatch, cells, coarse):
    """Coarse components, so that many scores are equal; many small trees; shorter vectors; equal rows; and a label with most rows."""
    monkeypatch.setattr(negatives, "TREE_CELLS", cells)
    monkeypatch.setattr(negatives, "LEAF", 16)
    rng = random.Random(cells + coarse)
    rows = [(i, [rng.randrange(-coarse, coarse + 1) / coarse for _ in range(rng.choice([4, 4, 4, 3]))], rng.choice([0, 0, 0, 1, 2])) for i in range(700)]
    rows += [(None, [1.0] * 4, 0), (701, None, 0), (702, [1.0] * 4, None), (703, [float("nan")] * 4, 1), (704, [None, 1.0], 1), (705, [], 1), (706, [2.0] * 4, 9)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, id int, anchor int, goals int").repartition(5)
    got = hard_negatives(df, F.col("vec_id") % 20 == 0, factor=4).collect()
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, got)) == brute_negatives(plain, lambda i: i % 20 == 0, 4, 5, 5, 80, 100)


def test_negatives_of_nothing_and_repeats(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).collect() == []
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    got = hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") == 0, factor=10).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2, 100, 100), (0, 1, 2, 2, 100, 100)]
    one = hard_negatives(spark.createDataFrame(rows[:1], schema), F.col("vec_id") == 0)
    assert one.collect() == []


def test_tree_prunes_and_orders():
    """Far groups of rows: a search looks into few boxes, leaves never mix labels, and the answer is that of a full scan."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 8))
    x = (centres[rng.integers(0, 40, 8000)] + rng.integers(-20, 20, (8000, 8))).astype(np.int64)
    ids, labels = np.arange(8000), rng.integers(0, 3, 8000)
    order, starts = pack_rows(x, labels)
    tree = Tree.over(x[order], ids[order], labels[order], starts)
    assert sorted(order.tolist()) == list(range(8000)) and len(tree.first) > tree.n_leaves > 40
    for a, b in zip(tree.first[: tree.n_leaves], tree.last[: tree.n_leaves]):
        assert b - a <= negatives.LEAF and len(set(tree.labels[a:b].tolist())) == 1
    q = x[:50]
    least, most = tree.intervals(q)
    for i in range(50):
        looked = [0]

        class Rows(np.ndarray):
            def __getitem__(self, at):
                looked[0] += isinstance(at, slice)
                return np.asarray(super().__getitem__(at))

        whole, tree.x = tree.x, np.asarray(tree.x).view(Rows)
        scores, found = tree.search(q[i], least[i], most[i], i, int(labels[i]), True, [(-(1 << 62), 1 << 62)], 5)[0]
        tree.x = whole
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if j != i and labels[j] == labels[i])[:5]
        assert list(zip((-scores).tolist(), found.tolist())) == want
        assert looked[0] <= tree.n_leaves // 4
