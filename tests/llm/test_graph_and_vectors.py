import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import cells, common, components, embed_dedup, simhash


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(900, 901), (901, 902), (902, 900)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(edges)
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a != b]
    assert found == brute_components({x for e in real for x in e}, real)


def test_components_without_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [4, 4096])
def test_fingerprints_within_three_bits_link_in_crowded_cells_too(spark, block):
    rng, fps = random.Random(3), set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(4)):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    dealt = cells.spread(simhash.grid_rows(df), F.col("fp"), block)
    links = dealt.mapInArrow(simhash._linked(3), "a long, b long")
    found = dict(tuple(r) for r in components.components(links).collect())
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert found == {k: v for k, v in brute_components(signed, near).items() if any(k in e for e in near)}


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD = [(1, "A b C d"), (2, "a B c D"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two"), (8, "É é Straße x y z"), (9, "one"), (None, "one"), (10, "w " * 70000 + "end")]


def test_simhash_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, fingerprint string, component_id int")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    want = {i: f"{plain_fingerprint(t):016x}" for i, t in ODD}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == want
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[2] == 1 and component[9] == component[6] == component[None] == 6 and component[3] == component[4] == component[5] == 3
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_e8_decoding_finds_the_two_nearest_points():
    import itertools

    x = np.random.default_rng(0).standard_normal((40, 8)) * 2
    own, other = embed_dedup.decode(x)
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=8)))
    for i in range(len(x)):
        points = np.concatenate([(z := np.rint(x[i] - s) + steps)[z.sum(1) % 2 == 0] + s for s in (0, 0.5)])
        near = np.sort(((points - x[i]) ** 2).sum(1))[:2]
        assert np.allclose([((own[i] / 2 - x[i]) ** 2).sum(), ((other[i] / 2 - x[i]) ** 2).sum()], near)


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(40):
        u = rng.standard_normal(32)
        rows.append(u)
        for _ in range(i % 4):
            rows.append(u + rng.standard_normal(32) * 0.12 * np.linalg.norm(u) / 32**0.5)
    rows += [rows[0], rows[0], rows[5]]
    return [r.astype(np.float32).tolist() for r in rows]


@pytest.mark.parametrize("of", [1, 4, 1000])
def test_rows_get_their_class_whether_it_is_common_or_not(spark, of, monkeypatch):
    monkeypatch.setattr(common, "COMMON", of)
    rows = [(i, 7 if i % 3 else 100 + i) for i in range(60)]
    classes = spark.createDataFrame([(7, "seven", 40)] + [(100 + i, str(i), 1) for i in range(0, 60, 3)], "c long, name string, n long")
    joined = common.join_classes(spark.createDataFrame(rows, "id long, k long"), classes, "k", "c", "n")
    assert joined.columns == ["id", "k", "name"]
    assert sorted(tuple(r) for r in joined.collect()) == [(i, k, "seven" if k == 7 else str(i)) for i, k in rows]


@pytest.mark.parametrize("of", [1, 4])
def test_documents_get_the_same_component_whether_a_fingerprint_is_common_or_not(spark, of, monkeypatch):
    monkeypatch.setattr(common, "COMMON", of)
    texts = ["", "same words here"] * 20 + [f"a b c {i} e f g" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [plain_fingerprint(t) for t in texts]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    label = brute_components(range(len(fps)), near)
    assert found == {i: (f"{fp:016x}", label[i]) for i, fp in enumerate(fps)}


@pytest.mark.parametrize("block, of", [(3, 1), (3, 1000), (2048, 30)])
def test_embedding_links_match_brute_force(spark, block, of, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(common, "COMMON", of)
    rows = [(i * 3, v, 0) for i, v in enumerate(vectors())]
    found = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    label = brute_components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    assert [found[i]["component_id"] for i in ids] == [label[i] for i in ids]
    assert [found[i]["n_links"] for i in ids] == near.sum(1).tolist()
    assert all(found[i]["kept"] == (label[i] == i) for i in ids)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-30, 2e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert {i: found[i] for i in (1, 2, 3, 4, 5, 6, 9)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)}
    assert found[7] == (2, 7, True) and found[8] == (2, 7, False) and found[10] == (2, 7, False)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []
    named = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [2.0, 4.0]), (None, [1.0, 2.0]), ("c", None), (None, None)], "vec_id string, embedding array<float>")
    rows = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embed_dedup.near_duplicates(named).collect())
    assert rows == [("None", 0, "None", True), ("None", 2, "a", False), ("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]
