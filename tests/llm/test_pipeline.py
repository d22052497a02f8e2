from collections import Counter

import corpus_pipeline as pipeline
from test_graph_and_vectors import brute_components, plain_fingerprint
from test_texts import check_packing, md5, plain_key, poisson_at, reference_ids

from sparkweft.llm import langid, simhash

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, docs.first()["text"], "en", "s", 5), (None, "some plain words here", "en", "s", 5)], docs.schema)
    at = docs.unionByName(odd)
    sizes = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = at
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(at.count())
        if k < len(pipeline.STAGES) - 1:
            assert at.columns == docs.columns
        if k == 0:
            kept = {r[0] for r in at.select("doc_id").collect()}
            assert 10**6 not in kept and 10**6 + 1 in kept and sizes[0] >= 0.95 * docs.count()
        if k == 2:
            found = simhash.near_duplicates(before).collect()
            want = {r["component_id"] for r in found}
            rows = [r[0] for r in at.select("doc_id").collect()]
            assert Counter(i for i in rows if i is not None) == Counter(i for i in want if i is not None) and 10**6 + 1 not in rows
    assert langid.UNDETERMINED == "und" and sizes[4] > 0


def test_an_id_that_repeats_counts_once(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "q r s t u v", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (None, "z", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.one_of_each_group(spark, df, SF)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "None"]


def test_each_group_keeps_one_row_whatever_the_ids(spark):
    a, b, c = "a b c d e", "q r s t u v", "one two three four five"
    texts = [(5, a), (5, b), (3, b.upper()), (None, a.upper()), (None, c), (None, c.upper()), (7, a), (8, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    found = pipeline.one_of_each_group(spark, df, SF).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in found) == [("3", b), ("5", a), ("8", ""), ("None", c)]


def test_stages_after_scoring_match_brute_force(spark, tmp_path):
    """Near-dedup, mixing and packing of a small table, against plain code; the scoring stages drop what their operators reject."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [tuple(r) for r in docs.collect()]
    prints = {d[0]: plain_fingerprint(d[1]) for d in texts}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    label = brute_components(sorted(prints), links)
    kept = pipeline.one_of_each_group(spark, docs, SF)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(label.values()))
    rows = [tuple(r) for r in kept.collect()]
    sizes = Counter(r[3] for r in rows)
    rate = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) * len(rows) / n for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        want[r] = poisson_at(int(md5(f"42|{plain_key(r)}|1|1")[:13], 16) / 2**52, rate[r[3]])
    pipeline.mixed(spark, kept, SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert Counter(tuple(r) for r in mixed.collect()) == +want
    packed = pipeline.packed(spark, mixed, SF).collect()
    tokens = {r[0]: len(reference_ids(r[1])) for r in rows}
    assert sum(r["length"] for r in packed) == sum(tokens[r[0]] * n for r, n in want.items())
    check_packing(pipeline.packed(spark, kept, SF).collect(), [(r[0], r[1]) for r in rows])  # without copies every piece can be told


def test_run_gives_packed_rows_and_leaves_one_folder(spark):
    import glob

    from sparkweft.llm.common import shared_folder

    before = set(glob.glob(shared_folder(spark).removeprefix("file:") + "/pipeline-*/*"))
    assert "sequence_id" in pipeline.run(spark, "/root/testdata/sf0.001").columns
    after = set(glob.glob(shared_folder(spark).removeprefix("file:") + "/pipeline-*/*")) - before
    assert [f.rsplit("/", 1)[1] for f in after] == [str(len(pipeline.STAGES) - 1)]
