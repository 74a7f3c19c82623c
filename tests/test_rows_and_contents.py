"""Splits and shuffles by row, file contents, attention with biases, suffixes, samples, planes, grid fits."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid as G
from tessera.operators import images as IM
from tessera.operators import samples as SM
from tessera.operators import split as SP
from tessera.operators import tokens as TK
from tessera.operators import vectors as V
from tessera.session import scratch_path
from tessera.sources import metadata as MD
from tessera.sources.assets import scan_checkpoint_folders


def frame(spark, rows, schema="national_number string, v int", parts=4):
    return spark.createDataFrame(rows, schema).repartition(parts)


CASES = {
    "one id": [("same", i) for i in range(10)],
    "equal rows": [("same", 1)] * 100,
    "half null": [(None, i) if i % 2 else (str(i), i) for i in range(100)],
    "all null and equal": [(None, None)] * 30,
    "hot id": [("hot" if i % 3 == 0 else str(i), i % 4) for i in range(1000)],
    "two kinds": [("a", 1)] * 13 + [("b", 2)] * 8,
}


@pytest.mark.parametrize("case", CASES)
def test_split_is_exact_by_row(spark, case):
    rows = CASES[case]
    out = SP.three_way_split(frame(spark, rows)).collect()
    n_train, n_val, n_test = SP.split_sizes(len(rows))
    assert collections.Counter(r.split for r in out) == collections.Counter({k: n for k, n in zip(("train", "val", "test"), (n_train, n_val, n_test)) if n})
    assert collections.Counter((r.national_number, r.v) for r in out) == collections.Counter(rows)
    again = SP.three_way_split(frame(spark, rows[::-1], parts=7)).collect()
    assert collections.Counter(again) == collections.Counter(out)


def test_split_divides_only_the_ids_at_a_cut(spark):
    rows = [(str(i % 50), i) for i in range(1000)]
    out = SP.three_way_split(frame(spark, rows)).groupBy("national_number").agg(F.count_distinct("split").alias("k")).collect()
    assert sum(r.k > 1 for r in out) <= 2


def test_split_counts_by_longer_prefixes(spark, monkeypatch):
    rows = [(str(i), i) for i in range(500)] + [("hot", i) for i in range(500)]
    whole = collections.Counter(SP.three_way_split(frame(spark, rows)).collect())
    monkeypatch.setattr(SP, "PREFIX", 1)
    monkeypatch.setattr(SP, "MANY", 10)
    assert collections.Counter(SP.three_way_split(frame(spark, rows)).collect()) == whole


def test_split_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(SP, "COPIES", 7)
    out = collections.Counter(r.split for r in SP.three_way_split(frame(spark, CASES["equal rows"])).collect())
    assert out == {"train": 80, "val": 10, "test": 10}


def test_split_plan_reads_its_input_once(spark):
    from tests.conftest import SMOKE_DIR

    df = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select(F.col("doc_id").cast("string").alias("national_number"), "text")
    plan = SP.three_way_split(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Subquery" not in plan


@pytest.mark.parametrize("case", CASES)
def test_epoch_shuffle_keeps_every_row(spark, case):
    rows = CASES[case]
    out = SP.epoch_shuffle(frame(spark, rows), (1, 2)).collect()
    for epoch in (1, 2):
        mine = [r for r in out if r.epoch == epoch]
        assert sorted(r.pos for r in mine) == list(range(1, len(rows) + 1))
        assert collections.Counter((r.national_number, r.v) for r in mine) == collections.Counter(rows)


def test_epoch_shuffle_spreads_the_rows_of_an_id(spark):
    rows = [("hot", i) for i in range(300)] + [(str(i), i) for i in range(300)]
    out = sorted((r for r in SP.epoch_shuffle(frame(spark, rows), (1,)).collect()), key=lambda r: r.pos)
    runs = sum(a.national_number != b.national_number for a, b in zip(out, out[1:]))
    assert runs > 350
    only = SP.epoch_shuffle(frame(spark, rows).select("national_number"), (1,)).collect()
    assert len(only) == 600 and len({r.pos for r in only}) == 600


# ---------------------------------------------------------------- file contents


def turned(data: bytes, angle: float, h: int, w: int, channels: int) -> bytes:
    return np.rot90(np.frombuffer(data, np.uint8).reshape(h, w, channels), int(angle // 90)).tobytes()


@pytest.mark.parametrize("h,w,channels", [(4, 4, 1), (2, 3, 1), (3, 2, 4), (1, 5, 3)])
def test_turned_bytes_are_quarter_turns(spark, h, w, channels):
    data = bytes(range(7, 7 + h * w * channels))
    df = spark.createDataFrame([(bytearray(data), float(a)) for a in (0, 90, 180, 270, 360, 120)], "content binary, angle double")
    got = {r.angle: r.t for r in df.select("angle", IM.turned_bytes("content", "angle", F.lit(h), F.lit(w), channels).alias("t")).collect()}
    assert got.pop(120.0) is None
    for a, t in got.items():
        assert bytes(t) == turned(data, a % 360, h, w, channels)


def assets(spark, rows):
    return spark.createDataFrame(rows, "split string, name string, path string, angle double")


def test_asset_sink_writes_turned_contents(spark):
    files = spark.createDataFrame([("s/1.png", bytearray(range(16))), ("s/2.png", bytearray(range(16, 32)))], "path string, content binary")
    rows = [("train", "1.png", "s/1.png", 0.0), ("train", "001_aug1.png", "s/1.png", 90.0), ("val", "2.png", "s/2.png", 0.0), ("val", "002_aug2.png", "s/2.png", 180.0)]
    path = scratch_path(spark, "assets")
    turn = lambda c, a: IM.turned_bytes(c, a, F.lit(4), F.lit(4), 1)
    MD.write_split_assets(assets(spark, rows), files, path, turn=turn)
    back = {r.name: r for r in spark.read.parquet(path).collect()}
    assert len(back) == 4
    for split, name, source, angle in rows:
        first = 0 if source == "s/1.png" else 16
        want = turned(bytes(range(first, first + 16)), angle, 4, 4, 1)
        assert (back[name].split, bytes(back[name].content), back[name].digest) == (split, want, hashlib.sha256(want).hexdigest())
    assert back["001_aug1.png"].digest != back["1.png"].digest


@pytest.mark.parametrize("rows,turn,match", [
    ([("train", "9.png", "s/9.png", 0.0)], True, "No contents for 9.png"),
    ([("train", "9_aug1.png", "s/9.png", 90.0)], True, "No contents for"),
    ([("train", "none.png", None, 0.0)], True, "No contents for none.png"),
    ([("train", "001_aug1.png", "s/1.png", 90.0)], False, "No turned contents for 001_aug1.png"),
    ([("train", "001_aug1.png", "s/1.png", 120.0)], True, "No turned contents for"),
])
def test_asset_sink_fails_rather_than_leave_out(spark, rows, turn, match):
    files = spark.createDataFrame([("s/1.png", bytearray(range(16)))], "path string, content binary")
    by = (lambda c, a: IM.turned_bytes(c, a, F.lit(4), F.lit(4), 1)) if turn else None
    with pytest.raises(Exception, match=match):
        MD.write_split_assets(assets(spark, rows), files, scratch_path(spark, "assets"), turn=by)


# ---------------------------------------------------------------- attention


def plain_attention(x, mask, heads, q, k, v, o):
    """One sequence; each of q, k, v, o is (weights, bias)."""
    mean = (x * mask[:, None]).sum(0) / (mask.sum() + 1e-9)
    query, keys, values = mean @ q[0] + q[1], x @ k[0] + k[1], x @ v[0] + v[1]
    width = len(query) // heads
    out, weights = [], []
    for h in range(heads):
        part = slice(h * width, (h + 1) * width)
        s = np.where(mask > 0, keys[:, part] @ query[part] / np.sqrt(width), -np.inf)
        e = np.exp(s - s.max())
        weights.append(e / e.sum())
        out.append(weights[-1] @ values[:, part])
    return np.concatenate(out) @ o[0] + o[1], np.mean(weights, axis=0)


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e5])
def test_attention_with_biases_and_any_scores(spark, scale):
    rng = np.random.default_rng(11)
    params = [(rng.normal(size=(6, 4)), rng.normal(size=4)) for _ in range(3)] + [(rng.normal(size=(4, 5)), rng.normal(size=5))]
    x = rng.normal(size=(3, 9, 6)) * scale
    mask = (rng.random((3, 9)) < 0.7).astype(float)
    mask[:, 0] = 1
    rows = [(s, s * 100 + p, int(mask[s, p]), x[s, p].tolist()) for s in range(3) for p in range(9)] + [(None, 900, 1, [scale] * 6), (7, 901, 0, [1.0] * 6)]
    df = spark.createDataFrame(rows, "seq_id int, vec_id int, mask int, vec array<double>").repartition(5)
    (qw, qb), (kw, kb), (vw, vb), (ow, ob) = params
    pooled, weights = V.attention_pool(df, heads=2, query_proj=qw, query_bias=qb, key_proj=kw, key_bias=kb, value_proj=vw, value_bias=vb, out_proj=ow, out_bias=ob)
    got = collections.defaultdict(dict)
    for r in pooled.collect():
        got[r.seq_id][r.dim] = r.x
    w = {r.vec_id: r.w for r in weights.collect()}
    for s in range(3):
        out, share = plain_attention(x[s], mask[s], 2, *params)
        assert np.allclose([got[s][d] for d in range(5)], out, rtol=1e-8, atol=1e-8 * scale)
        assert np.allclose([w[s * 100 + p] for p in range(9)], share, atol=1e-9)
    assert w[900] == pytest.approx(1.0) and np.isnan(w[901]) and np.isnan(got[7][0]) and not np.isnan(got[None][0])


def test_attention_states_of_far_blocks_merge(spark):
    # Scores of 0 and of many thousands in one sequence: the low ones vanish, nothing overflows.
    rows = [(1, i, 1, [v, 0.0]) for i, v in enumerate([0.0, 300.0, 300.0, -500.0])]
    df = spark.createDataFrame(rows, "seq_id int, vec_id int, mask int, vec array<double>").repartition(3)
    pooled, weights = V.attention_pool(df)
    assert [r.x for r in sorted(pooled.collect(), key=lambda r: r.dim)] == [300.0, 0.0]
    assert {r.vec_id: r.w for r in weights.collect()} == {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.0}


def test_attention_inside_a_row(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 5, 3))
    mask = np.array([[1, 1, 1, 1, 1], [1, 0, 1, 0, 1], [0, 0, 1, 0, 0], [0, 0, 0, 0, 0]])
    df = spark.createDataFrame([(i, x[i].tolist(), mask[i].tolist()) for i in range(4)], "i int, t array<array<double>>, m array<int>")
    got = {r.i: r.p for r in df.select("i", V.attention_pool_rows("t", "m").alias("p")).collect()}
    identity = (np.eye(3), np.zeros(3))
    for i in range(3):
        assert np.allclose(got[i], plain_attention(x[i], mask[i].astype(float), 1, identity, identity, identity, identity)[0])
    assert np.isnan(got[3]).all()


def test_affine_projection_on_both_paths(spark):
    w, b = np.arange(6.0).reshape(2, 3), np.array([1.0, -1.0, 0.5])
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, -1.0],)], "vec array<double>")
    want = np.array([[1.0, 2.0], [0.0, -1.0]]) @ w + b
    assert np.allclose([r.p for r in df.select(V.project("vec", w, b).alias("p")).collect()], want)
    assert np.allclose([r.proj for r in V.project_arrow(df, "vec", w, bias=b).collect()], want)
    assert np.allclose([r.p for r in df.select(V.project("vec", w).alias("p")).collect()], want - b)


# ---------------------------------------------------------------- tokens, samples


VOCAB = {t: i for i, t in enumerate(["[UNK]", "it", "is", "of", "fire", "##s", "ca", "##fe", ".", "type", "a", "##b", "##bc", "x", "ab", "and", "grass"], start=5)}


def vocab(spark):
    return spark.createDataFrame(list(VOCAB.items()), "token string, id int")


def test_trie_goes_back_to_the_longest_entry():
    trie = TK.Trie(VOCAB)
    words = ["abc", "abbc", "abb", "a", "", "q", "axs", "cafes", "x" * 101, "abx"]
    ids, length, at = trie.cut(words)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    v = VOCAB
    assert got == [[v["[UNK]"]], [v["ab"], v["##bc"]], [v["ab"], v["##b"]], [v["a"]], [], [v["[UNK]"]], [v["[UNK]"]], [v["ca"], v["##fe"], v["##s"]], [v["[UNK]"]], [v["[UNK]"]]]
    assert length[at[7]:at[8]].tolist() == [2, 2, 1] and length[at[8]:at[9]].tolist() == [101]


def test_ends_are_places_in_the_text(spark):
    text = "Cafés  It́\tab.abbc  x"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, caption string")
    coded = TK.encode(df.withColumn("segments", TK.segments("caption")), vocab(spark), words_col="segments", ends=True)
    got = {r.doc_id: r for r in coded.collect()}
    assert "".join(df.select(TK.segments("caption").alias("s")).first().s) == text and got[2].ids == got[2].ends == got[3].ids == []
    v = VOCAB
    assert got[1].ids == [v["ca"], v["##fe"], v["##s"], v["it"], v["ab"], v["."], v["ab"], v["##bc"], v["x"]]
    assert got[1].ends == [2, 4, 5, text.index("\t"), text.index("."), text.index(".") + 1, text.index(".") + 3, text.index(".") + 5, len(text)]


def test_segments_lose_nothing(spark):
    texts = ["a b", " a,b  c!\n", "x\uffffy z", "", "Ünï\t\u2003co-de", "..", "$1 a$b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(TK.segments("t").alias("s")).collect()]
    assert ["".join(s) for s in got] == texts and got[1] == [" ", "a", ",", "b", "  ", "c", "!", "\n"] and got[2] == ["x\uffffy", " ", "z"] and got[6] == ["$", "1", " ", "a", "$", "b"]


def test_encoding_in_slices(spark, monkeypatch):
    rows = [(i, ["ab", "abbc", "cafes", "q"] * (i % 4) if i % 5 else []) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, words array<string>").coalesce(1)
    whole = sorted(map(tuple, TK.encode(df, vocab(spark)).collect()))
    monkeypatch.setattr(TK, "WORDS_AT_ONCE", 5)
    assert sorted(map(tuple, TK.encode(df, vocab(spark)).collect())) == whole and len(whole) == 60


def test_lost_suffix(spark):
    rows = [(1, "ab ab ", "it is of fire type"), (2, "ab " * 4, "it is of fire type"), (3, "ab " * 6, "it is of fire type"), (4, "ab " * 9, "it is")]
    df = spark.createDataFrame([(i, a + b, b) for i, a, b in rows], "doc_id int, caption string, types string")
    df = df.select("doc_id", TK.segments("caption").alias("segments"), F.char_length("caption").alias("n"), F.char_length("types").alias("m"))
    coded = TK.encode(df, vocab(spark), words_col="segments", ends=True)
    got = {r.doc_id: (r.n_tokens, r.kept_chars, r.suffix_start, r.suffix) for r in TK.lost_suffix(coded, "m", "n", budget=7).collect()}
    assert got == {1: (7, 24, 6, "whole"), 2: (9, 20, 12, "part"), 3: (11, 20, 18, "part"), 4: (11, 20, 27, "none")}


def test_caption_words_cuts_each_text_once(spark):
    df = spark.createDataFrame([(1, "it is")], "doc_id int, caption string")
    plan = TK.caption_words(df, "doc_id", "caption")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # one expression: plain texts, and others


def test_samples_are_whole_or_fail(spark):
    df = spark.createDataFrame([("7", "it is fire"), ("25_1", "ab")], "national_number string, caption string")
    files = spark.createDataFrame([("007.png", "s/007.png"), ("025.png", "s/025.png")], "name string, path string")
    got = {r.national_number: r for r in SM.samples(df, files, vocab(spark), max_len=6).collect()}
    v = VOCAB
    assert got["7"].input_ids == [101, v["it"], v["is"], v["fire"], 102, 0] and got["7"].attention_mask == [1, 1, 1, 1, 1, 0]
    assert (got["25_1"].image_path, got["25_1"].caption) == ("s/025.png", "ab") and got["25_1"].input_ids[:3] == [101, v["ab"], 102]
    with pytest.raises(Exception, match="Missing asset for #25_1"):
        SM.samples(df, files.where("name = '007.png'"), vocab(spark)).collect()
    loose = SM.samples(df, files.where("name = '007.png'"), vocab(spark), fail=False)
    assert {r.national_number: r.image_path for r in loose.collect()} == {"7": "s/007.png", "25_1": None}


# ---------------------------------------------------------------- planes, checkpoints, grid


def test_channel_planes(spark):
    img = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    df = spark.createDataFrame([(bytearray(img.tobytes()), 2, 3), (bytearray(), 0, 3)], "data binary, h int, w int").withColumn("v", IM.byte_values("data"))
    got = [r.p for r in df.select(IM.channel_planar_expr("v", "h", "w", 4).alias("p")).collect()]
    assert got[0] == img.transpose(2, 0, 1).ravel().tolist() and got[1] == []
    one = df.where("h = 2")
    assert one.select(IM.has_shape("v", 4, "h", "w", (4, 2, 3)).alias("ok")).first().ok
    with pytest.raises(Exception, match="shape mismatch: 4x2x3"):
        one.select(IM.require_shape("v", 4, "h", "w")).collect()


def test_checkpoints_of_many_folders(spark):
    import os

    root = scratch_path(spark, "ckpts")
    for name in ("a/model_epoch_2.pt", "a/model_epoch_10.pt", "b=x+y/name=model_epoch_3.pt/part-0", "b=x+y/name=model_epoch_3.pt/part-1", "stray.pt"):
        path = f"{root.replace('file:', '')}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"x")
    found = scan_checkpoint_folders(spark, root)
    assert sorted(map(tuple, found.collect())) == [("a", "model_epoch_10.pt"), ("a", "model_epoch_2.pt"), ("x+y", "model_epoch_3.pt")]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_grid_from_moments(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(size=300) * 0.1
    split = np.array(["train"] * 200 + ["val"] * 50 + ["test"] * 50)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), str(split[i])) for i in range(300)], "f array<double>, y double, split string").repartition(5)
    axes = {"learning_rate": [0.1, 0.001], "weight_decay": [0.0, 0.5]}
    got = G.grid_search_from_moments(df, "f", "y", axes, 40, labels={"learning_rate": "lr", "weight_decay": "wd"}).orderBy("config_no").collect()
    design = np.column_stack([x, np.ones(300)])
    for r in got:
        w, losses = np.zeros(4), []
        for _ in range(40):
            a = design[split == "train"]
            w = w - r.learning_rate * (2 * a.T @ (a @ w - y[split == "train"]) / 200 + r.weight_decay * w)
            losses.append([np.mean((design[split == s] @ w - y[split == s]) ** 2) for s in ("val", "test")])
        best = int(np.argmin([v for v, _ in losses]))
        assert r.best_epoch == best + 1
        assert np.allclose([r.best_val_loss, r.test_loss], losses[best])
    assert G.grid_search_from_moments(df.where("false"), "f", "y", axes, 3, labels={"learning_rate": "lr", "weight_decay": "wd"}).where("best_epoch is null").count() == 4
