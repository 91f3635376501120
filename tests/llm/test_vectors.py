"""Hard negatives, tokens and whitening against plain versions, and on rows that trip things up."""

import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from smelter.llm import anchor_bounds, prefix_bpe, spectrum
from smelter.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

VECTORS = "vec_id long, embedding array<float>, label int, row string, id string, q int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", "i", 1, 2) for i, v, y in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist(), i % 3) for i in range(240)]
    rows += rows[:120:10] + [(300, rows[7][1], 1)] * 60 + [(None, rows[3][1], 0), (350, rows[9][1], 2)]
    rows += [(400, None, 1), (401, [float("nan")] * 6, 1), (402, [1.0, None] * 3, 1), (403, [float("inf")] * 6, 1)]
    rows += [(404, rows[5][1], None), (405, [0.5, -0.5], 1), (450, [], 2), (500, [0.0] * 6, 0)]
    return vectors(spark, rows)


# Hard negatives


def plain_negatives(rows, is_anchor, scale=256, positives=5, negatives=3):
    usable = []
    for n, (i, v, y) in enumerate(rows):
        if y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            usable.append((n, i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y))
    out = []
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for n, i, a, y in usable:
        if not is_anchor(i):
            continue
        scored = [(sum(p * q for p, q in zip(a, b)), j, z) for m, j, b, z in usable if m != n]
        same = sorted((s for s in scored if s[2] == y), key=first)[:positives]
        for top, j, _ in same:
            inside = sorted((s for s in scored if s[2] != y and 50 * top <= 100 * s[0] <= 95 * top), key=first)
            out += [(i, j, k + 1, m, top, s) for k, (s, m, _) in enumerate(inside[:negatives])]
    return sorted(out, key=repr)


def test_negatives_equal_brute_force(spark, odd_vectors, monkeypatch):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd_vectors.collect()]
    expected = plain_negatives(rows, lambda i: i is not None and i % 5 == 0)
    got = anchor_bounds.mine(odd_vectors.repartition(5), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == expected and len(expected) > 300
    # Many small trees in many waves give the same.
    monkeypatch.setattr(anchor_bounds, "BLOCK", 7)
    monkeypatch.setattr(anchor_bounds, "WAVE_BYTES", 7 * 8 * 6 * 4)
    monkeypatch.setattr(anchor_bounds, "CHUNK", 16)
    got = anchor_bounds.mine(odd_vectors.repartition(3), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_negatives_of_nothing(spark, odd_vectors):
    assert anchor_bounds.mine(odd_vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert anchor_bounds.mine(odd_vectors, F.lit(False)).count() == 0
    alone = vectors(spark, [(0, [1.0, 0.0], 1)])
    assert anchor_bounds.mine(alone, F.lit(True)).count() == 0
    huge = vectors(spark, [(0, [1e30, 0.0], 1), (1, [1e30, 0.0], 1)])
    with pytest.raises(Exception, match="too large"):
        anchor_bounds.mine(huge, F.lit(True)).collect()


def test_bounds_spare_scores_among_close_anchors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 1000
    anchors = np.round(centres.repeat(8, axis=0) + rng.normal(size=(64, 16)))
    order, parent, edge = anchor_bounds.spanning_tree(anchors)
    points = anchors[order]
    assert sorted(order) == list(range(64)) and parent[0] == -1 and (parent[1:] < np.arange(1, 64)).all()
    assert np.allclose(edge[1:], np.linalg.norm(points[1:] - points[parent[1:]], axis=1))
    x = np.round(centres.repeat(50, axis=0) + rng.normal(size=(400, 16)))
    norms = np.linalg.norm(x, axis=1)
    tree = {"points": points, "parent": parent, "edge": edge}
    truth = points @ x.T
    scored = 0
    floors = np.sort(truth, axis=1)[:, -10]

    def want(c, low, high):
        assert (low <= truth[c] + 1e-6).all() and (high >= truth[c] - 1e-6).all()
        return high >= floors[c]

    for c, near, scores in anchor_bounds.walk(tree, x, norms, want):
        scored += len(near)
        assert (scores == truth[c, near]).all() and set(np.flatnonzero(truth[c] >= floors[c])) <= set(near)
    assert scored < truth.size / 3


# Tokens


@pytest.fixture(scope="module")
def ranks():
    return prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(spark, odd, ranks, reference):
    got = QUERIES["op12_prefix_bpe"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    more = odd.unionByName(odd.limit(1).withColumn("text", F.lit("<|endoftext|>\x00\x1c  　 é́ﬀ 한국어 ١٢٣ 'S'll\n\n x")))
    coded = more.select("text", prefix_bpe.encode(more, ranks, public_tokenizers.PATTERN, units=prefix_bpe.WORDS, whole=prefix_bpe.LETTERS).alias("ids"))
    whole = coded.select("text", "ids", prefix_bpe.decode(coded, ranks).alias("bytes")).collect()
    assert len(whole) == more.count()
    for r in whole:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
    empty = odd.limit(0)
    assert empty.select(prefix_bpe.encode(empty, ranks, public_tokenizers.PATTERN)).count() == 0
    with pytest.raises(ValueError, match="no token"):
        prefix_bpe.encode(odd, {b"a": 0}, "a")


def test_pieces_of_all_kinds(ranks, reference):
    vocabulary, rng = prefix_bpe.Vocabulary(ranks), np.random.default_rng(1)
    for alphabet in (b"ab", b"etaoinshrdlu", bytes(range(256)), b"-= ", "äöü한".encode()):
        for n in (1, 2, 3, 7, 30, 300):
            piece = bytes(rng.choice(list(alphabet), n).tolist())
            assert prefix_bpe.encode_piece(vocabulary, piece) == reference._encode_single_piece(piece)


def test_units_are_cut_like_whole_texts(ranks, reference):
    vocabulary, pattern = prefix_bpe.Vocabulary(ranks), public_tokenizers.PATTERN
    tables = prefix_bpe.Tables.unpacked(prefix_bpe.Tables(vocabulary).packed())
    plain = prefix_bpe.Encoder(vocabulary, tables, pattern)
    by_unit = prefix_bpe.Encoder(vocabulary, tables, pattern, prefix_bpe.WORDS, prefix_bpe.LETTERS)
    rng = np.random.default_rng(8)
    letters = list("ab1' \n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u3000\u180e\u200b\ufeff-.é한") + ["'s", "  ", "\n\n", "'LL", "'ll"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(3000)]
    want = [reference.encode_ordinary(text) for text in texts]
    assert ["".join(by_unit.parts(text)) for text in texts] == texts
    assert [found.tolist() for found in by_unit(texts)] == want and [found.tolist() for found in plain(texts)] == want


def test_seams_agree_with_merging(ranks):
    vocabulary, rng = prefix_bpe.Vocabulary(ranks), np.random.default_rng(9)
    tables = prefix_bpe.Tables(vocabulary)
    short = np.array([rank for token, rank in ranks.items() if len(token) <= 4])
    left, right = rng.integers(0, 50_000, 60_000), rng.integers(0, 50_000, 60_000)
    left[::2], right[::3] = rng.choice(short, 30_000), rng.choice(short, 20_000)
    usable = np.array([vocabulary.alone(a) and vocabulary.alone(b) for a, b in zip(left.tolist(), right.tolist())])
    left, right = left[usable], right[usable]
    want = [vocabulary.merge(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert len(want) > 59_000 and 0 < sum(want) < len(want)
    assert tables.seams(left, right).tolist() == want and tables.stand(left, right).tolist() == want


def test_pieces_together_are_like_pieces_alone(ranks, reference, monkeypatch):
    vocabulary, rng = prefix_bpe.Vocabulary(ranks), np.random.default_rng(10)
    tables = prefix_bpe.Tables(vocabulary)
    made = [bytes(rng.choice(list(a), int(rng.integers(1, 33))).tolist()) for a in (b"ab", b"etaoins ", bytes(range(256)), "äöüß한국".encode()) for _ in range(1500)]
    made.sort(key=len, reverse=True)
    got = [np.frombuffer(packed, dtype=np.int32).tolist() for packed in tables.encode(made)]
    assert got == [reference._encode_single_piece(piece) if piece not in ranks else [ranks[piece]] for piece in made]
    last = tables.last_tokens(made, 32)
    for piece, own in list(zip(made, last.tolist()))[::50]:
        assert own[: len(piece)] == prefix_bpe.Prefixes(vocabulary, piece).last
    # A memory too small for a batch forgets, and says the same.
    monkeypatch.setattr(prefix_bpe, "REMEMBERED", 50)
    encoder = prefix_bpe.Encoder(vocabulary, tables, public_tokenizers.PATTERN, prefix_bpe.WORDS)
    texts = [" ".join(f"w{rng.integers(0, 300)}" for _ in range(40)) for _ in range(30)]
    for _ in range(3):
        assert [ids.tolist() for ids in encoder(texts)] == [reference.encode_ordinary(text) for text in texts]


def test_a_long_piece_takes_linear_time(ranks, reference):
    vocabulary = prefix_bpe.Vocabulary(ranks)
    text = "".join(np.random.default_rng(2).choice(list("abcdefgh"), 1_000_000))
    begun = time.process_time()
    (ids,) = (found.tolist() for found in prefix_bpe.Encoder(vocabulary, prefix_bpe.Tables(vocabulary), public_tokenizers.PATTERN)([text]))
    assert time.process_time() - begun < 60
    assert b"".join(vocabulary.tokens[i] for i in ids).decode() == text
    assert ids[:2000] == reference.encode_ordinary(text[:20_000])[:2000]


def test_appends_and_edits_are_exact(ranks, reference):
    vocabulary, rng = prefix_bpe.Vocabulary(ranks), np.random.default_rng(4)
    text = bytes(rng.choice(list(b"etaoinshrdlu"), 5000).tolist())
    piece = prefix_bpe.Prefixes(vocabulary)
    for at in range(0, 5000, 613):
        piece.append(text[at : at + 613])
        assert piece.tokens() == reference._encode_single_piece(text[: at + 613])
    for _ in range(30):
        start = int(rng.integers(0, len(text)))
        end = min(len(text), start + int(rng.integers(0, 9)))
        new = bytes(rng.choice(list(b"etaoin "), int(rng.integers(0, 9))).tolist())
        computed = piece.replace(start, end, new)
        text = text[:start] + new + text[end:]
        assert piece.text == text and piece.tokens() == reference._encode_single_piece(text)
        assert piece.last == prefix_bpe.Prefixes(vocabulary, text).last
        assert computed < 1000


# Whitening


def check_whitened(rows, x, k):
    """Whitened rows against an eigenvalue solver of another kind."""
    n = len(x)
    mean = x.mean(axis=0)
    centred = x - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    expected = centred @ axes / np.sqrt(values)
    got = np.zeros((n, k))
    by_row = {}
    for r in rows:
        by_row.setdefault(r["vec_id"], []).append(r)
    for i, own in by_row.items():
        for r in own:
            got[i, r["component"] - 1] = r["whitened"]
            assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / (centred**2).sum() * n) - 1) < 1e-9
            assert r["deviation"] == sum(int(n * a - s) ** 2 for a, s in zip(x[i].tolist(), x.sum(axis=0).tolist()))
            assert r["identity_error"] < 1e-9
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * signs).max() < 1e-6


def test_whitening(spark):
    stored = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = QUERIES["op13_spectrum"](spark, FOLDER).collect()
    table = {r["vec_id"]: r["embedding"] for r in stored.collect()}
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in table[i]] for i in range(len(table))])
    assert len(rows) == 32 * len(x)
    check_whitened(rows, x.astype(np.int64), 32)


def test_whitening_of_odd_rows(spark, odd_vectors):
    fits, scaled = anchor_bounds.whole_vectors(odd_vectors, "embedding", 64)
    whole = odd_vectors.filter(fits).withColumn("x", scaled).withColumn("n", F.lit("n"))
    rows = spectrum.whiten(whole).collect()
    assert len(rows) == whole.count() * 6 and any(r["vec_id"] is None for r in rows)
    assert all(r["identity_error"] < 1e-9 for r in rows)
    assert spectrum.whiten(whole.limit(0)).count() == 0 and spectrum.whiten(whole.limit(1)).count() == 0
    flat = vectors(spark, [(i, [float(i % 2), 1.0, -float(i % 2), float(i == 3)], 0) for i in range(8)])
    _, scaled = anchor_bounds.whole_vectors(flat, "embedding", 64)
    rows = spectrum.whiten(flat.withColumn("x", scaled)).collect()
    # Four dimensions, two of them bound to each other and one constant.
    assert {r["component"] for r in rows} == {1, 2} and abs(sum({r["explained"] for r in rows}) - 1) < 1e-12


def test_slices_of_ties_and_close_values():
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    for spectrum_of in ([5, 5, 5, 2, 2, 1, 0, 0, 0], [3, 3 - 1e-9, 3 - 1e-13, 1, 1e-6, 1e-7, 1e-8, 1e-9, 0], [1] * 9, [0] * 9):
        values = np.sort(np.array(spectrum_of, dtype=float))[::-1]
        matrix = turn @ np.diag(values) @ turn.T
        matrix = (matrix + matrix.T) / 2
        for shift in (0.5, 1.5, 2.5, 4, 6):
            assert spectrum.above(matrix, shift) == (values > shift).sum()
        found, axes = spectrum.leading(matrix, 9)
        assert len(found) == (values > 1e-12).sum() and np.allclose(found, values[: len(found)], atol=1e-12, rtol=0)
        assert np.abs(axes.T @ axes - np.eye(len(found))).max(initial=0) < 1e-12
        assert np.abs(matrix @ axes - axes * found).max(initial=0) < 1e-12


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 10, 40):
        a = rng.normal(size=(size, size))
        a = a + a.T
        np.fill_diagonal(a, 0)
        assert spectrum.above(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum() or size == 1


def test_covariance_of_large_numbers_is_exact(spark):
    rows = [(i, [10**12 + i * 7, -(10**11) * i]) for i in range(11)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    x = [r[1] for r in rows]
    sums = spectrum._column_sums(df, 2)
    assert sums == [sum(c) for c in zip(*x)]
    middle = np.array([round(s / 11) for s in sums], dtype=object)
    products = spectrum._products(df, 2, middle)
    assert products[0, 1] == sum((a - middle[0]) * (b - middle[1]) for a, b in x)
    with pytest.raises(Exception, match="beyond 64 bits"):
        spectrum.whiten(df).collect()


def test_file_of_ranks(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert prefix_bpe.Vocabulary(prefix_bpe.read_ranks(str(path))).merge(b"ab") == [97, 98]


def test_short_pieces_need_no_table_of_endings(ranks):
    vocabulary = prefix_bpe.Vocabulary(ranks)
    encoder = prefix_bpe.Encoder(vocabulary, prefix_bpe.Tables(prefix_bpe.Vocabulary(ranks)), public_tokenizers.PATTERN)
    ids, none = encoder(["some short words", ""])
    assert "_endings" not in vars(vocabulary) and not len(none)
    coded = pa.array([[1], ids.tolist(), None, [], ids.tolist() * 2, [2]], pa.list_(pa.int32())).slice(1, 4)
    text = b"some short words"
    assert prefix_bpe.joined(prefix_bpe.by_rank(ranks), coded).to_pylist() == [text, b"", b"", text * 2]
    assert prefix_bpe.joined(prefix_bpe.by_rank(ranks), coded.slice(0, 0)).to_pylist() == []
