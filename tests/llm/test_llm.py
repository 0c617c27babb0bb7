"""The llm operators against brute force, round trips and held-out accuracy."""

import random

import numpy as np
import pytest

from tickloom.llm import content, mixing, similar, tokens

VEC = "id bigint, vec array<double>"


def vectors(r, n, dims=12, missing=0.15):
    base = r.normal(size=(n, dims))
    for i in range(0, n, 3):  # near copies
        base[i] = base[r.integers(0, n)] + r.normal(size=dims) * 0.012
    z = base.copy()
    for row in z:
        if r.random() < missing:
            row[r.choice(dims, r.integers(1, 4), replace=False)] = np.nan
    return z


def rows_of(z, first=0):
    return [(first + i, [None if np.isnan(x) else float(x) for x in v]) for i, v in enumerate(z)]


def exact(z):
    d = (z[:, None] - z[None]) ** 2
    n = (~np.isnan(d)).sum(-1)
    with np.errstate(all="ignore"):
        return np.sqrt(np.nansum(d, -1) / n), n


@pytest.mark.parametrize("cell", [20_000, 8])
def test_similar_pairs_loses_none(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "COPIES", cell)
    r = np.random.default_rng(1)
    z = vectors(r, 240)
    z[200:230] = np.nan_to_num(z[5])  # a group of exact copies
    d, n = exact(z)
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if n[i, j] >= 10 and d[i, j] <= 0.02}
    rows = rows_of(z)
    df = spark.createDataFrame(rows + rows[:10] + [(None, rows[0][1]), (998, None), (999, [None] * 12)], VEC)
    got = similar.similar_pairs(df, 12, 0.02, 10).collect()
    assert {(x.id_a, x.id_b) for x in got} == want and len(got) == len(want) and len(want) > 400
    for x in got:
        assert x.distance == pytest.approx(d[x.id_a, x.id_b], abs=1e-9) and x.shared == n[x.id_a, x.id_b]


    linked = {x.id: x for x in similar.links(df, 12, 0.02, 10).collect()}
    assert {i: linked[i].links for i in range(240)} == {i: sum(i in p for p in want) for i in range(240)}
    assert {linked[i]["class"] for i in range(200, 230)} == {200 if np.isnan(z[5]).any() else 5}


def test_similar_pairs_of_an_empty_table(spark):
    assert similar.similar_pairs(spark.createDataFrame([], VEC), 12, 0.02, 10).count() == 0


def test_nearest_vectors_recall(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 100)
    r = np.random.default_rng(2)
    z = vectors(r, 1500)
    d, n = exact(z)
    d[n < 5] = 99
    np.fill_diagonal(d, 99)
    df = spark.createDataFrame(rows_of(z), VEC)
    got = similar.nearest_vectors(df, df.filter("id < 300"), 12, 10).collect()
    hits = total = 0
    for i in range(300):
        mine = sorted((x for x in got if x.id == i), key=lambda x: x.rank)
        assert [x.rank for x in mine] == list(range(1, 11)) and i not in {x.neighbour for x in mine}
        assert all(x.distance == pytest.approx(d[i, x.neighbour], abs=1e-9) for x in mine)
        hits += len({x.neighbour for x in mine} & set(np.argsort(d[i])[:10].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_nearest_vectors_edge_cases(spark):
    one = spark.createDataFrame([(1, [0.0, 0.0, None]), (2, [0.0, 0.0, 5.0]), (3, [0.0, None, 5.0])], VEC)
    got = {(x.id, x.neighbour, x.rank) for x in similar.nearest_vectors(one, one, 3, 2, least_shared=2).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (2, 3, 2), (3, 2, 1)}
    assert similar.nearest_vectors(one.limit(0), one, 3, 2).count() == 0


DOC = "doc_id bigint, text string"


def odd_texts():
    r = random.Random(3)
    alphabet = "ab z  \n\t'é日本—😀0129.,!?<|>ß́​" + "ا"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 900))) for _ in range(60)]
    texts += ["x" * 3000, " " * 2500, "word " * 700, "<|endoftext|>" * 60, "日本語の文章。" * 200, "it's we'll " * 150, "a" + " " * 700 + "b", "\n\n \n" * 400, "ab cd " * 40 + "y" * 900 + " ef" * 60 + " " * 500 + "z" * 300]
    return texts


def test_encode_equals_whole_encoding_and_decodes(spark):
    texts = [*odd_texts(), "", None, "  "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "y z " * 100), (5, "again " * 90), (5, "again " * 90)]
    got = tokens.encode(spark.createDataFrame(rows, DOC), chunk=64, overlap=16)
    enc = tokens.encoding(tokens.tokenizer_dir(), "byte_bpe_50k")
    want = sorted((str(i), enc.encode_ordinary(t) if t else []) for i, t in rows)
    out = got.collect()
    assert sorted((str(x.doc_id), list(x.ids)) for x in out) == want
    back = {x.doc_id: x.text for x in tokens.decode(got.filter("doc_id < 5000 and doc_id <> 5")).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i is not None and i != 5)
    assert tokens.encode(spark.createDataFrame([], DOC)).count() == 0


def test_boundaries_are_those_of_the_whole_text():
    for t in odd_texts():
        if len(t) > 120:
            whole = set(tokens.boundaries(t, True))
            assert set(tokens.boundaries(t[:100], False)) <= whole


def test_plan_of_overlapping_sources():
    p = {frozenset("a"): 100, frozenset("b"): 100, frozenset("ab"): 100}
    routed, total = mixing.plan(p, {"a": (0.5, 1), "b": (0.5, 1)})
    assert total == pytest.approx(300, rel=0.01)
    assert sum(routed[frozenset("ab"), "a"]) + sum(routed.get((frozenset("ab"), "b"), [0])) <= 100 * 1 + 1
    # repeats only when fresh text has run out
    routed, total = mixing.plan({frozenset("a"): 10, frozenset("b"): 100}, {"a": (0.5, 5), "b": (0.5, 2)})
    assert total == pytest.approx(100, abs=1) and routed[frozenset("a"), "a"] == [10] * 5 and routed[frozenset("b"), "b"][1] == 0
    assert mixing.plan({}, {"a": (1.0, 1)}) == ({}, 0) and mixing.plan({frozenset("a"): 5}, {"a": (0.0, 1)}) == ({}, 0)


def test_mix_shares_caps_and_seed(spark):
    r = random.Random(4)
    sizes = [(i, ["big"], r.choice([10, 20, 30, 4000 if i % 97 == 0 else 15])) for i in range(3000)] + [(5000 + i, ["small"], 25) for i in range(40)] + [(6000 + i, ["big", "both"], 10) for i in range(50)]
    sizes += [(None, ["big"], 5), (9000, [], 5), (9001, None, 5), (9002, ["big"], 0), (9003, ["big"], None)]
    df = spark.createDataFrame(sizes, "id bigint, sources array<string>, size bigint")
    goal = spark.createDataFrame([("m", " BIG ", 0.7, 1), ("m", "small", 0.2, 4), ("m", "gone", 0.1, 3), ("m", "zero", 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    rows, shares = mixing.mix(df, goal)
    out = rows.collect()
    got = {x.source: x for x in shares.collect()}
    assert got["gone"].tokens == got["zero"].tokens == 0 and got["small"].most_uses <= 4 and got["big"].most_uses == 1
    assert got["big"].actual_share == pytest.approx(7 / 9, abs=0.01) and got["small"].actual_share == pytest.approx(2 / 9, abs=0.01)
    assert all(abs(x.planned - x.tokens) <= 4000 and (x.planned > 0) == (x.tokens > 0) for x in got.values())
    assert len({(x.source, x.id) for x in out}) == len(out) and not {None, 9000, 9001, 9002, 9003} & {x.id for x in out}
    assert sorted(map(tuple, mixing.mix(df.repartition(7), goal)[0].collect())) == sorted(map(tuple, out))
    assert mixing.mix(df.limit(0), goal)[0].count() == 0


@pytest.fixture(scope="module")
def examples(spark):
    return spark.read.parquet("/root/testdata/sf0.001/content_example.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def unlabelled(docs):
    return sorted({r.text for r in docs.select("text").collect() if r.text})


def test_a_model_without_labelled_rows_finds_nothing():
    for m in (content.train([], [], [], []), content.train(["calm text here"], ["none"], ["word"], ["one more calm text. "])):
        assert (m.documents(["you idiot", None, "", "a b c d"])[:, 0] < content.CUT).all()


def test_held_out_accuracy(examples, docs):
    rows = examples.orderBy("example_id").collect()
    r = random.Random(6)
    r.shuffle(rows)
    held, used = rows[:120], rows[120:]
    m = content.train([x.text for x in used], [x.category for x in used], content.vocabulary(), unlabelled(docs))
    said = m.documents([x.text for x in held])[:, 0] >= content.CUT
    true = np.array([x.category != "none" for x in held])
    assert (said == true).mean() >= 0.93


def test_a_flood_of_an_offence_is_not_neutral(examples, docs):
    """Offending lines that fill a twentieth of the texts without labels are found as before, and calm ones stay calm."""
    rows = examples.orderBy("example_id").collect()
    bad = [x.text for x in rows if x.category != "none" and len(x.text) < 90][::14]
    texts, r = unlabelled(docs), random.Random(3)
    flood = [f"{r.choice(texts)[:200]} {x}" for x in bad for _ in range(len(texts) // 20 // len(bad) + 1)] + bad * 5
    m = content.train([x.text for x in rows], [x.category for x in rows], content.vocabulary(), texts[:1900] + flood)
    assert (m.documents(bad)[:, 0] >= content.CUT).all()
    calm = [x.text for x in rows if x.category == "none"]
    assert (m.documents(calm)[:, 0] < content.CUT).mean() > 0.98


def test_pieces_cover_every_word_and_scores_do_not_depend_on_neighbours(examples, docs):
    for sizes in ([], [1], [1, 1], [2, 30, 1], [13, 14, 15], [200]):
        seen = {i for a, n in content.spans(sizes) for i in range(a, a + n)}
        assert seen == set(range(sum(sizes)))
    m = content.fitted(examples, docs)
    texts = [x.text for x in docs.limit(60).collect()]
    together, alone = m.documents(texts), np.array([m.document(t) for t in texts])
    assert np.allclose(together, alone, atol=1e-9)


def test_scores(spark, examples, docs):
    m = content.fitted(examples, docs)
    assert content.fitted(examples, docs) is m
    calm = "volume was light into the close " * 3000
    texts = [None, "", "   ", "you useless idiot, go back to paper trading", "yοu u s e l e s s ıdiоt, go back to paper trading", calm, calm + "hey scumbag, delete your account. " + calm, "My entry was stupid, my own fault.", "12 34 56"]
    df = spark.createDataFrame([(i, "S ", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = content.score(df, m, keep=("source",))
    said = {x.doc_id: x.score >= content.CUT for x in got.collect()}
    assert [said[i] for i in range(9)] == [False, False, False, True, True, False, True, False, False]
    rate = content.rates(got).collect()
    assert [(x.source, x.documents, x.flagged) for x in rate] == [("s", 9, 3)]
    assert content.score(df.limit(0), m).count() == 0
