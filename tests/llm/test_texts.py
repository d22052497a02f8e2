import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import chat, host_rules, langid, lm_score, mixing, packing, token_count, toxicity
from sparkweft.llm.queries import ORACLES, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
ODD = [(1, "a<|endoftext|>b  c\n\n d"), (2, None), (3, ""), (4, " \t\n"), (5, "Straße naïve 中文 🙂 it's 42"), (6, "one"), (6, "one"), (None, "one"), (7, "x y " * 40000)]
DOCS = "doc_id long, text string, lang string, source string, length int"


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], DOCS)


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def check_packing(rows, docs):
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = Counter()
    for i, t in docs:
        ids = reference_ids(t)
        want[(i, len(ids))] += 1
        mine = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in pieces[(i, len(ids))]})
        at = 0
        for start, length, crc in mine:
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(k[1] * n for k, n in want.items())
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.CONTEXT
    return windows


def test_packing_holds_every_id_once(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows = packing.pack(documents.repartition(3, "doc_id").cache(), tokenizer("byte_bpe_50k.tiktoken")).collect()
    windows = check_packing(rows, docs)
    total = sum(r["length"] for r in rows)
    assert len(windows) <= total / packing.CONTEXT * 1.05 + 3


def test_packing_of_odd_texts(spark):
    df = odd(spark).coalesce(1)
    check_packing(packing.pack(df, tokenizer("byte_bpe_50k.tiktoken")).collect(), ODD)
    assert packing.pack(df.limit(0), tokenizer("byte_bpe_50k.tiktoken")).collect() == []


def test_packing_of_very_long_white_space(spark):
    docs = [(1, "one two"), (2, " " * 2_000_000), (3, "a" + "\n" * 1_200_000 + "<|endoftext|> b"), (4, "three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check_packing(packing.pack(df, tokenizer("byte_bpe_50k.tiktoken")).collect(), docs)


def test_open_windows_are_bounded():
    cut = lambda p, n: (("a", *p), ("b", *p))
    windows, rng, total, out = packing.OpenWindows(100, 4), random.Random(1), 0, []
    for _ in range(500):
        n = rng.randint(1, 100)
        total += n
        out += windows.add((), n, cut)
        assert len(windows.held) <= 4
    assert sum(p[-1] for w in [*out, *windows.held.values()] for p in w) == total


def greedy(word, starts, continues):
    at, n, pieces = 0, 0, starts
    while at < len(word) or (n == 0 and at == 0):
        for end in range(len(word), at - (n == 0), -1):
            if word[at:end] in pieces:
                break
        else:
            return 1
        n, at, pieces = n + 1, end, continues
    return n


def test_longest_match_counts_as_greedy_matching_does():
    rng = random.Random(5)
    for _ in range(60):
        letters = "abc"
        make = lambda most: {"".join(rng.choice(letters) for _ in range(rng.randint(1, most))).encode() for _ in range(12)}
        starts, continues = make(4), make(5)
        if rng.random() < 0.5:
            starts.add(b"")
        automaton = token_count.Automaton(sorted(starts), sorted(continues))
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))).encode()
            assert automaton.count(word) == greedy(word, starts, continues), (word, starts, continues)


def test_token_counts_of_odd_and_real_texts(spark, documents):
    path = tokenizer("byte_bpe_50k.json")
    starts, continues = map(set, token_count.read_vocabulary(path))
    plain = lambda t: (len((t or "").encode().split()), sum(greedy(w, starts, continues) for w in (t or "").encode().split()))
    few = [(r["doc_id"], r["text"]) for r in documents.limit(15).collect()] + ODD
    df = spark.createDataFrame([(i, t, 0) for i, t in few], "doc_id long, text string, n_tokens int")
    rows = token_count.count_tokens(df, path).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in rows) == Counter((i, *plain(t)) for i, t in few)
    assert token_count.count_tokens(df.limit(0), path).collect() == []


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_key(row):
    return md5("|".join("-" if v is None else md5(str(v)) for v in row))


def poisson_at(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_poisson_rates_and_copies(spark, documents):
    twice = documents.unionByName(documents.limit(20)).unionByName(documents.limit(7).withColumn("doc_id", F.lit(None).cast("long"))).cache()
    rows, docs = mixing.mix(twice).collect(), [tuple(r) for r in twice.collect()]
    sizes = Counter(d[3] for d in docs)
    weights = {s: n**0.5 for s, n in sizes.items()}
    rate = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / n for s, n in sizes.items()}
    want = Counter()
    for d, n in Counter(docs).items():
        for number in range(1, n + 1):
            u = int(md5(f"42|{plain_key(d)}|{number}|1")[:13], 16) / 2**52
            for copy in range(1, poisson_at(u, rate[d[3]]) + 1):
                want[(*d, copy, int(md5(f"42|order|{plain_key(d)}|{number}|{copy}")[:13], 16))] += 1
    assert Counter(tuple(r) for r in rows) == want
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids != sorted(ids)


@pytest.mark.parametrize("sources, keys", [(2_000, 100_000), (0, 0)])
def test_rows_without_an_id_draw_apart(spark, monkeypatch, sources, keys):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    monkeypatch.setattr(mixing, "BROADCAST_KEYS", keys)
    rows = [(None, f"text {i}", "s") for i in range(500)] + [(1, "same", "s")] * 2500 + [(2, f"text {i}", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    out = mixing.mix(df).collect()
    for own, n in (([r for r in out if r["doc_id"] is None], 500), ([r for r in out if r["doc_id"] == 2], 500), ([r for r in out if r["doc_id"] == 1], 2500)):
        assert abs(len(own) - n) < 4 * n**0.5 and len({r["mix_key"] for r in own}) == len(own)


def test_mixing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", None, 5, "p"), (1, "a", None, 5, "p"), (None, None, "s", 5, None), (2, "b", "", 5, "q"), (3, "c " * 500_000, "s", 5, "q")], "doc_id long, text string, source string, copy_no int, `a.b` string")
    df = df.withColumns({c: F.lit(1) for c in ("__source", "row", "key", "number", "n", "s", "parts", "cdf", "times", "rate", "w")})
    weights = spark.createDataFrame([(None, 900.0), ("s", 50.0), ("", None), ("nowhere", 50.0)], "source string, weight double")
    rows = mixing.mix(df, weights=weights).collect()
    assert rows[0].__fields__ == [*(c for c in df.columns if c != "copy_no"), "copy_no", "mix_key"]
    assert sum(r["doc_id"] == 1 for r in rows) > 0 and not any(r["doc_id"] == 2 for r in rows) and all(len(r["text"]) == 10**6 for r in rows if r["doc_id"] == 3)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix(df, weights=weights.limit(0)).collect() == []
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            mixing.mix(df, weights=spark.createDataFrame([("s", bad)], "source string, weight double")).collect()
    heavy = mixing.mix(spark.createDataFrame([(i, "s") for i in range(40)] + [(i, "t") for i in range(40, 40_040)], "doc_id long, source string"), temperature=0.0)
    counts = [r[0] for r in heavy.where("source = 's'").groupBy("doc_id").count().select("count").collect()]
    assert len(counts) == 40 and abs(np.mean(counts) - 500.5) < 4 * (500.5 / 40) ** 0.5 + 1


def test_chat_prefixes_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 6, "assistant", "yo"), (3, 7, "user", "x<|im_end|>")]
    turns += [(4, 0, None, "hi"), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, "z", "z"), (7, 0, "z", "z"), (8, 0, "u", "t"), (8, 0, "u", "t"), (9, 0, "u", "t")]
    turns += [(20, i, "user", str(i)) for i in range(700)] + [(21, i + 3, "user", str(i)) for i in range(600)]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    rows = chat.collapse_and_render(df).collect()
    kept = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in rows}
    assert kept == {3: (3, 1), 4: (1, 1), 5: (1, 1), 6: (1, 1), 7: (1, 2), 8: (2, 1), 20: (700, 1)}
    assert next(r for r in rows if r["conv_id"] == 3)["rendered"].endswith("<|im_start|>user\nx<| im_end|><|im_end|>\n")
    long = "".join(r["rendered"] for r in sorted((r for r in rows if r["conv_id"] == 20), key=lambda r: r["part"]))
    assert long == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(700))
    assert chat.collapse_and_render(df.limit(0)).collect() == []


def plain_chat(turns):
    """(conv, part, n_turns, n_copies, rendered) by lists and prefixes."""
    order = lambda t: tuple((v is not None, v) for v in (t[1], t[2], None if t[3] is None else md5(t[3])))
    of = {}
    for t in turns:
        of.setdefault(t[0], []).append(t)
    said = {c: tuple((t[2], t[3]) for t in sorted(own, key=order)) for c, own in of.items()}
    prefixes = {s[:k] for s in said.values() for k in range(1, len(s))}
    alike = {}
    for c, s in said.items():
        if s not in prefixes:
            alike.setdefault(s, []).append(c)
    broken = lambda x: x.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")
    shown = lambda r, x: f"<|im_start|>{broken('unknown' if r is None else r)}\n{broken(x or '')}<|im_end|>\n"
    out = Counter()
    for s, convs in alike.items():
        first = min((c for c in convs if c is not None), default=None)
        for k in range(0, len(s), 64):
            out[(first, k // 64, len(s), len(convs), "".join(shown(*x) for x in s[k : k + 64]))] += 1
    return out


@pytest.mark.parametrize("crowded, broadcast", [(1024, 100_000), (20, 0)])
def test_chat_matches_plain_prefixes(spark, monkeypatch, crowded, broadcast):
    monkeypatch.setattr(chat, "CROWDED", crowded)
    monkeypatch.setattr(chat, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(chat, "BLOCK", 256 if crowded > 20 else 8)
    turns = [(1, 0, f"r{i % 7}", f"t{i}") for i in range(300)] + [(1, 256, "u", f"x{i}") for i in range(5)]  # many of one number
    turns += [(2, 0, "u", "a"), (2, 1000, "v", "b"), (3, 0, "u", "a"), (4, -700, "u", "z"), (4, None, "u", "y"), (4, None, None, None)]  # sparse, negative, without number
    turns += [(5, i, "u", f"n{i}") for i in range(1, 301)] + [(6, i, "u", f"n{i}") for i in range(1, 100)]  # from 1
    turns += [(None, i % 3, ["u", None][i % 2], [None, "", "w", f"q{i}"][i % 4]) for i in range(400)]
    turns += [(7, 0, "u", "same")] * 90 + [(8, 3, "u", "same")] * 70 + [(9, 0, "u", "a very long text " * 60_000)] + [(10, 5, "u", "same")] * 90
    turns += [(11 + i % 30, i // 30, "u", f"common {i // 30}") for i in range(90)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("id", "block", "pos", "part")}).repartition(3)
    rows = Counter(tuple(r) for r in chat.collapse_and_render(df).collect())
    assert rows == plain_chat(turns)


def plain_measures(text):
    text = text or ""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    words, word = [], ""
    for c in text + " ":
        if c in space:
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("broadcast", [5_000, 0])
def test_host_rules(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", broadcast)
    for text in [t for _, t in ODD] + ["a b c a b c a", "a\n\na\n a\nb", "#x $ |", "x y z \x0b w"] + [r["text"] for r in documents.limit(40).collect()]:
        assert host_rules.measures(text) == plain_measures(text)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "fine", 1) for i in range(30)] + [(100 + i, "bad", "foul", 1) for i in range(29)] + [(200, good, "foul", 1), (201, good, None, 1), (202, None, "fine", 1)]
    found = {r["doc_id"]: r for r in host_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")).collect()}
    assert found[0]["kept"] and not found[200]["kept"] and not found[200]["base_failed"] and found[201]["kept"] and not found[202]["kept"] and found[202]["n_words"] == 0
    assert host_rules.apply_rules(odd(spark).limit(0)).collect() == []


def test_language_is_learned(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    rows = langid.identify(df).where("held_out").collect()
    assert len(rows) > 150 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.96
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    df = odd(spark).unionByName(spark.createDataFrame([(90, "12 34 !?", "fr", "s", 1), (91, "salut", None, "s", 1), (92, "½ ² ①", "fr", "s", 1), (93, "٣ _ 9", "fr", "s", 1)], DOCS))
    df = df.withColumns({"score": F.lit(1), "held_out": F.lit(2), "lang_pred": F.lit(3)})
    rows = langid.identify(df, carry=True).collect()
    said = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == len(ODD) + 4 and {said[i] for i in (2, 3, 4, 90, 92, 93)} == {"und"} and said[5] in ("en", "fr") and rows[0]["row"]["source"] == "s"
    assert langid.identify(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_cover_whole_texts():
    for n in (1, 255, 256, 257, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        own = langid.windows(data)
        covered = np.zeros(n, bool)
        for k, w in enumerate(own):
            part = data[k * langid.STEP : k * langid.STEP + langid.WINDOW]
            assert bytes(w[: len(part)]) == part
            covered[k * langid.STEP : k * langid.STEP + langid.WINDOW] = True
        assert covered.all()
    for n in (0, 1, 32, 33, 500):
        starts = toxicity.window_starts(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n


def test_recurrent_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = toxicity.Recurrent({b"a": 1}, np.array([5, 9]))
    x, mask = rng.standard_normal((6, 3, toxicity.WORD + toxicity.CHAR)).astype(np.float32), np.ones((6, 3), np.float32)
    mask[4:, 1] = 0
    y, weight = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}

    def loss():
        z = network.forward(x.astype(np.float64), mask)[0]
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    g, _ = network.gradients(x.astype(np.float64), mask, y, weight)
    for name in ("inf", "gateb", "candf", "att", "out", "biasb"):
        flat, at = network.w[name].reshape(-1), 3
        old = flat[at]
        flat[at] = old + 1e-4
        up = loss()
        flat[at] = old - 1e-4
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-4 - g[name].reshape(-1)[at]) < 2e-3


def test_byte_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    network = langid.ByteNetwork(3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    x, y = rng.integers(1, 256, (4, 20)).astype(np.uint8), np.array([0, 2, 1, 2])
    loss = lambda: -np.mean(np.log(network.forward(x)[0][np.arange(4), y]))
    found = network.gradients(x, y)
    for name, g in found.items():
        flat = network.w[name].reshape(-1)
        places = np.argsort(-np.abs(g.reshape(-1)))[:3]
        for at in places:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-4, name


def test_byte_network_scores_as_plain_loops_do():
    network = langid.ByteNetwork(2)
    text = "Straße 42 naïve! " * 40
    data, w = text.encode(), network.w
    totals, n_bytes = np.zeros(2), 0
    for start in range(0, max(1, len(data) - langid.WINDOW + langid.STEP), langid.STEP):
        window = data[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        features = []
        for k in langid.WIDTHS:
            for f in range(langid.FILTERS):
                best = max(sum(float(w["embed"][window[i + j]] @ w[f"filter{k}"][j * langid.EMBED : (j + 1) * langid.EMBED, f]) for j in range(k)) for i in range(len(window) - k + 1))
                features.append(max(0.0, best + float(w[f"bias{k}"][f])))
        z = np.exp([sum(x * float(c) for x, c in zip(features, w["out"][:, l])) + float(w["out_bias"][l]) for l in range(2)])
        seen = sum(b != 0 for b in window)
        totals, n_bytes = totals + z / z.sum() * seen, n_bytes + seen
    batch = pa.record_batch([pa.array([1]), pa.array([text]), pa.array([False])], names=["doc_id", "text", "held_out"])
    (out,) = langid._predictions(["x", "y"], network)(iter([batch]))
    assert abs(out.column(3)[0].as_py() - (totals / n_bytes).max()) < 1e-4 and out.column(2)[0].as_py() == ["x", "y"][int(totals.argmax())]


def test_recurrent_scores_as_plain_loops_do():
    rng = np.random.default_rng(2)
    words = [rng.choice([b"calm", b"vile", b"odd", b"\xc3\xa9t\xc3\xa9", b"vile"]) for _ in range(50)] + [b"vile"] * 9
    words = [bytes(x) for x in words]
    hashes = np.unique(toxicity.grams_of(words)[0])[::2]
    network = toxicity.Recurrent({b"calm": 1, b"vile": 2}, hashes)
    network.w["char"][1:] = rng.normal(0, 0.5, network.w["char"][1:].shape)
    network.offset, w, s = 0.3, network.w, toxicity.STATE
    sig = lambda x: 1 / (1 + math.exp(-x))
    joined = b" " + b" ".join(words) + b"   "
    at, vectors = 0, []
    for word in words:
        own = np.zeros(toxicity.CHAR)
        for i in range(at, at + len(word) + 1):
            h = int.from_bytes(joined[i : i + 4], "little") * 2654435761 % 2**32 >> (32 - toxicity.GRAM_BITS)
            own = own + w["char"][network.row[h]]
        vectors.append(np.concatenate([w["word"][network.vocabulary.get(word, 0)], own]))
        at += len(word) + 1

    def run(xs, side):
        h, out = [0.0] * s, []
        for x in xs:
            pre = x @ w["in" + side] + w["bias" + side]
            z = [sig(pre[i] + sum(h[j] * w["gate" + side][j, i] for j in range(s))) for i in range(s)]
            r = [sig(pre[s + i] + sum(h[j] * w["gate" + side][j, s + i] for j in range(s))) for i in range(s)]
            c = [math.tanh(pre[2 * s + i] + sum(r[j] * h[j] * w["cand" + side][j, i] for j in range(s))) for i in range(s)]
            h = [(1 - z[i]) * h[i] + z[i] * c[i] for i in range(s)]
            out.append(h)
        return out

    best = -1e9
    for start in toxicity.window_starts(len(words)):
        xs = vectors[start : start + toxicity.WINDOW]
        states = [np.array(f + b) for f, b in zip(run(xs, "f"), run(xs[::-1], "b")[::-1])]
        energy = np.exp([x @ w["att"] for x in states])
        pooled = sum(e * x for e, x in zip(energy / energy.sum(), states))
        best = max(best, float(pooled @ w["out"] + w["out_bias"][0]))
    batch = pa.record_batch([pa.array([1]), pa.array([b" ".join(words).decode()]), pa.array([False])], names=["doc_id", "text", "held_out"])
    (out,) = toxicity._scores(network)(iter([batch]))
    assert abs(out.column(2)[0].as_py() - sig(best - 0.3)) < 1e-4


def test_samples_are_bounded_whatever_repeats(spark):
    from sparkweft.llm.common import sampled_ids, texts_of

    rows = [(i % 900, f"t{i}", "ab"[i % 900 % 2]) for i in range(1800)] + [(7, f"again {i}", "b") for i in range(3000)] + [(None, "x", "a"), (5000, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).cache()
    found = sampled_ids(df, "doc_id", "lang", 40)
    assert len(found) == len({i for i, _ in found}) == 80 and {c for _, c in found} == {"a", "b"} and all("ab"[i % 2] == c for i, c in found)
    assert sorted(r["doc_id"] for r in texts_of(df, [i for i, _ in found] + [7]).collect()) == sorted({i for i, _ in found} | {7})
    assert sampled_ids(df.limit(0), "doc_id", "lang", 40) == []


def test_toxicity_is_learned(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    wanted = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = [r for r in toxicity.score(wanted, labels).where("held_out").collect()]
    y, s = np.array([toxic[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])
    assert s[y == 1].mean() > 0.75 and s[y == 0].mean() < 0.05


def test_toxicity_threshold_heeds_all_windows_of_long_texts(spark):
    rng = random.Random(3)
    calm, foul = [f"calm{chr(97 + i)}" for i in range(20)], [f"vile{chr(97 + i)}" for i in range(12)]

    def plain(n, words):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice([w for w in words if w != out[-1]]))
        return out

    odd = plain(48, calm)
    odd[16:28] = foul  # in both of the windows that hold it
    odd[0], odd[-1] = "opens", "closes"
    docs, labels = [], []
    for i in range(80):
        words = plain(4000 + 16 * i, calm)
        starts = toxicity.window_starts(len(words))
        order = np.random.default_rng(len(words)).permutation(len(starts)).tolist()
        late = {starts[k] for k in order[6 * toxicity.WINDOWS_PER_TEXT :]}
        at = next(s for s in sorted(late) if s and {s - 16, s + 16, s + 32} <= late)  # nowhere near the first windows of a sample
        words[at : at + 48] = odd
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(plain(64, foul)))]
        labels += [(2 * i, 0), (2 * i + 1, 1)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(df, known).collect()}
    assert sum(rows[d]["predicted"] for d, y in labels if y == 0) == 0
    assert sum(rows[d]["predicted"] for d, y in labels if y == 1) == 80


def test_toxicity_of_odd_texts(spark):
    df = odd(spark).withColumns({"score": F.lit(1), "held_out": F.lit(2), "predicted": F.lit(3)})
    labels = spark.createDataFrame([(1, 1, 9), (5, 0, 9), (6, 0, 9), (6, 1, 9), (None, 1, 9), (3, None, 9)], "doc_id long, toxic int, text int")
    rows = toxicity.score(df, labels, carry=True, steps=30).collect()
    assert rows[0]["row"]["predicted"] == 3 and len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).collect() == []


@pytest.mark.parametrize("common, bucket_bytes", [(32, 20_000), (2, 1 << 30)])
def test_cross_entropy_difference_matches_brute_force(spark, documents, monkeypatch, common, bucket_bytes):
    monkeypatch.setattr(lm_score, "COMMON", common)
    monkeypatch.setattr(lm_score, "BLOCK_DOCS", 50)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()] + ODD
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    texts = [r["text"] for r in target.collect()]

    def grams(t):
        w = lm_score.words_of(t)
        before = [None, *w[:-1]] if w else []
        return [("context", b) for b in before] + [("pair", b, x) for b, x in zip(before, w)]

    aim, back = Counter(g for t in texts for g in grams(t)), Counter(g for _, t in docs for g in grams(t))
    v = len({w for t in [*texts, *(t for _, t in docs)] for w in lm_score.words_of(t)})

    def score(t):
        total = 0.0
        for g in grams(t):
            base = 200.0 if g[0] == "context" else 200.0 / v
            total += math.log((back[g] + base) / (aim[g] + base)) * (-1 if g[0] == "context" else 1)
        return total / max(1, len(lm_score.words_of(t)))

    rows = lm_score.cross_entropy_difference(df.cache(), target, bucket_bytes=bucket_bytes).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((i, len(lm_score.words_of(t))) for i, t in docs)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(score(t))
    assert all(min(abs(r["score"] - s) for s in want[r["doc_id"]]) < 2e-6 for r in rows)
    assert lm_score.cross_entropy_difference(df.limit(0), target).collect() == []
    assert len(lm_score.cross_entropy_difference(df, target.limit(0)).collect()) == len(docs)


def test_vocabulary_of_the_query_is_that_of_both_tables(spark, documents):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    v = len({w for df in (documents, target) for r in df.select("text").collect() for w in lm_score.words_of(r[0])})
    want = lm_score.cross_entropy_difference(documents, target, vocabulary=v).collect()
    assert sorted(QUERIES["op10_lm_score"](spark, SF).collect()) == sorted(want)


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
