import datetime as dt
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmill import queries
from quillmill.functions import matching
from quillmill.operators import chords, ensemble, imaging, recognition, routing, spelling
from quillmill.sources import config, images, words
from quillmill.streaming.chords import EVENT_SQL, act_on, stream_triggers


def merge(spark, cases):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "doc_id int, variants array<string>")
    wide = [r[1] for r in df.select("doc_id", ensemble.merge_arrays(F.col("variants"))).orderBy("doc_id").collect()]
    long = df.select("doc_id", F.posexplode("variants").alias("engine_ord", "text"))
    return wide, dict(tuple(r) for r in ensemble.merge_long(long).collect())


def test_merge(spark):
    cases = [["Hello world.", "1 Hello world"], ["abcd", "wxyz"], ["a", "a\n  b "], ["x\n\n y", " \n "], [], ["only\n\n one "], [None, ""], ["привет", "hello!"], [" ", "\n"]]
    wide, long = merge(spark, cases)
    assert wide == ["Hello world.", "abcd", "a\n  b ", "x\n y", "", "only\n\n one ", "", "hello!", ""]
    assert {i: v for i, v in enumerate(wide) if cases[i]} == long


def test_merge_of_twins_strips_lines(spark):
    assert merge(spark, [["  a \n\nb", "  a \n\nb"]])[0] == ["a\nb"]


def test_agreement_and_detections(spark):
    df = spark.createDataFrame([(["abcd", "abcd", "abxd"],), (["a"],), ([],)], "v array<string>")
    got = [round(r[0], 6) for r in df.select(ensemble.agreement(F.col("v"))).collect()]
    assert got == [round((1 + 0.75 + 0.75) / 3, 6), 0.5, 0.5]
    d = spark.createDataFrame([([("a", 0.29), ("b", 0.3), ("c", 0.9)],)], "d array<struct<text string, confidence double>>")
    assert d.select(ensemble.keep_detections(F.col("d"))).first()[0] == "b\nc"


def test_similarity_is_difflibs():
    """Grams looked up by length give the blocks that difflib finds by reading the range for each."""
    import random
    from difflib import SequenceMatcher

    g, wide = random.Random(2), "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    for n in (3, 150, 199, 200, 201, 900):
        for letters in ("ab", "abcdefghij kl.\n", wide, "\xe9\U0001f600xyz \ud800"):
            for edits in (0, 1, 4, n // 20, n // 3):
                a = g.choices(letters, k=n)
                b = list(a)
                for _ in range(edits):
                    at = g.randrange(len(b))
                    b[at : at + g.randrange(3)] = g.choices(letters, k=g.randrange(1, 3))
                if g.random() < 0.3:
                    b = b[n // 2 :] + b[: n // 2] + b[:40] * 3
                a, b = "".join(a), "".join(b)
                for x, y in ((a, b), (b, a), (a, " \n "), (a, ""), ("", b), (a, a)):
                    assert matching.ratio(x, y) == SequenceMatcher(None, x, y).ratio()
                    if x and y:
                        assert 2.0 * matching.matches(x, y) / (len(x) + len(y)) == SequenceMatcher(None, x, y).ratio()


def test_similarity_of_long_texts_is_quick():
    import random
    import time

    g = random.Random(3)
    a = "".join(g.choices("etaoinshrdlu" * 6 + "cmfwypvbgkqjxz.,\nABCDEFGHIJ0123456789" + "    " * 5, k=120_000))
    b = "".join(c for c in a if g.random() > 0.01)
    wide = "".join(chr(0x4E00 + g.randrange(9000)) for _ in range(60_000))
    began = time.time()
    assert matching.ratio(a, b) > 0.9 and matching.ratio(wide, wide[:30_000] + "x" + wide[30_000:]) == 120_000 / 120_001
    assert time.time() - began < 10


def features(spark, px, w, h):
    df = spark.createDataFrame([(px, w, h)], "p array<int>, w int, h int")
    return df.select(imaging.features(F.col("p"), F.col("p"), F.col("p"), F.col("w"), F.col("h")).alias("f")).select("f.*").first()


def test_features(spark):
    f = features(spark, [150] * 300, 30, 10)
    assert (round(f.brightness, 9), f.contrast, f.sharpness, f.has_color, f.size_ratio) == (round(150 / 255, 9), 0, 0, 0, 0.6)
    f = features(spark, [10, 9, 10, 9], 2, 2)
    assert f.sharpness == 1.0  # falling edges wrap to 255
    assert np.isnan(features(spark, [1, 2], 2, 1).sharpness)


def test_modes_and_plans(spark):
    df = spark.createDataFrame([(300, 100), (500, 90), (299, 400), (150, 50)], "w int, h int")
    assert [r[0] for r in df.select(imaging.page_mode(F.col("w"), F.col("h"))).collect()] == [6, 7, 11, 11]
    assert tuple(df.where("w = 150").select(imaging.upscale(F.col("w"), F.col("h"))).first()[0]) == (2.0, 300, 100)
    plan = df.where("w = 300").select(imaging.enhance_plan(F.lit(150 / 255), F.lit(0.0), F.col("w"), F.col("h"))).first()[0]
    assert [tuple(s) for s in plan] == [("contrast", 1.8), ("sharpness", 1.5)]
    flat = np.full((2, 3, 1), 100, np.uint8)
    assert (imaging.apply_plan(flat, [("invert", 1.0), ("sharpness", 1.5)]) == 155).all()
    assert imaging.apply_plan(flat, [("upscale", 2.0)]).shape == (4, 6, 1)


def png(path, rgb):
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rgb)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rgb[0]), len(rgb), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 10), (0, 255, 20)]])
    row = images.rgb(images.read_images(spark, str(tmp_path))).first()
    assert (row.r, row.g, row.b, row.unsupported) == ([255, 0], [0, 255], [10, 20], False)


def test_routing(spark):
    df = spark.createDataFrame([(0.6, 0.5), (0.1, 0.9), (0.3, 0.3), (0.45, 0.9), (float("nan"), 0.9)], "c double, s double")
    got = [(r[0][0], round(r[0][1], 6)) for r in df.select(routing.strategy(F.col("c"), F.col("s"))).collect()]
    assert got[:4] == [("fast", 0.56), ("ensemble", 0.9), ("ensemble", 0.7), ("fast", 0.675)]
    assert got[4][0] == "ensemble"


def test_model_agrees_on_clear_cases(spark, tmp_path):
    model = routing.train(spark)
    routing.save(model, str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, 0.7, 0.48, 0.9, 0, 0.5), (2, 0.5, 0.22, 0.25, 0, 0.5)], "id int, brightness double, contrast double, sharpness double, has_color int, size_ratio double")
    got = {r.id: r.strategy for r in routing.with_strategy(rows, routing.load(str(tmp_path / "m"))).collect()}
    assert got == {1: "fast", 2: "ensemble"}
    assert set(routing.importances(model)) == set(imaging.FEATURES)


def test_rare_terms_stay(spark):
    """A term of the dictionary is left alone, however rare; a suggestion must be frequent."""
    d = spark.createDataFrame([("form", 500), ("fork", 5), ("lamp", 9)], "term string, count long")
    docs = spark.createDataFrame([(1, "a fork forn lamq")], "doc_id int, text string")
    assert spelling.correct_spelling(docs, d).first().text == "a fork form lamq"


def test_merge_of_many_lines_is_linear(spark):
    """Twice the lines take about twice the time, not four times."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(["\n".join(f"line {i} of {k}" for i in range(n)) for k in range(3)],)], "v array<string>")
        began = time.time()
        assert df.select(ensemble.merge_arrays(F.col("v"))).first()[0].count("\n") == n - 1
        return time.time() - began

    seconds(100)
    assert min(seconds(6000) for _ in range(2)) < 5


def test_profiles_of_pixels_and_of_channels_agree(spark):
    g = np.random.default_rng(1)
    rows = [(k, w, h, c, g.integers(0, 256, (h, w, c)).astype(np.uint8).tobytes()) for k, (w, h, c) in enumerate([(300, 100, 3), (5, 7, 1), (2, 2, 4), (1, 6, 3)])]
    df = spark.createDataFrame(rows, "id int, width int, height int, n_channels int, data binary")
    whole = {r.id: r.f for r in df.select("id", imaging.profiled("data", "width", "height", "n_channels", F.lit(False)).alias("f")).collect()}
    px, n = images.bytes_of(F.col("data")), F.col("n_channels")
    pick = lambda k: F.when(n == 1, px).otherwise(F.filter(px, lambda _, i: i % n == k))
    split = df.select("id", "width", "height", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
    for r in split.select("id", imaging.features(F.col("r"), F.col("g"), F.col("b"), F.col("width"), F.col("height")).alias("f")).collect():
        assert np.allclose([*r.f], [*whole[r.id]], equal_nan=True), r.id


def test_plans_follow_the_enlarged_image(spark):
    """Dark dots on white are lost in the small image's contrast but not in the plan's measure of the enlarged one."""
    g = np.random.default_rng(4)
    for _ in range(5):
        small = g.integers(0, 256, (8, 8, 3)).astype(np.uint8)
        large = imaging.resized(small, 300, 300)
        assert large.shape == (300, 300, 3) and abs(large.mean() - small.mean()) < 8
        bright, contrast = imaging.profile(large)[:2]
        plan = dict(imaging.plan_of(small))
        assert plan["upscale"] == 37.5 and ("contrast" in plan) == (contrast * 128 < 40) and ("invert" in plan) == (bright * 255 < 100)
        df = spark.createDataFrame([(small.tobytes(),)], "data binary").select(imaging.profiled("data", F.lit(8), F.lit(8), F.lit(3), F.lit(True)).alias("f"))
        shown = df.select(imaging.enhance_plan(F.col("f.brightness"), F.col("f.contrast"), F.lit(8), F.lit(8)).alias("p")).first().p
        assert [tuple(s) for s in shown] == imaging.plan_of(small)
    same = np.full((5, 4, 1), 77, np.uint8)
    assert (imaging.resized(same, 9, 13) == 77).all() and np.allclose(imaging.lanczos_weights(10, 10), np.eye(10))


def test_pixel_kernels_in_whole_numbers():
    """Sums near a half are added in order, and sharpening in 26ths is what floats give."""
    g = np.random.default_rng(8)
    for hi in (2, 256):
        weights, lines = imaging.lanczos_weights(8, 300), g.integers(0, hi, (8, 900)).astype(np.float64)
        total = np.zeros((300, 900))
        for i in range(8):
            total += weights[:, i, None] * lines[i]
        assert (imaging.weighted(weights, lines) == np.clip(np.floor(total + 0.5), 0, 255)).all()
    x = g.integers(0, 256, (60, 50, 3)).astype(np.uint8)
    padded = np.pad(x.astype(np.float64), ((1, 1), (1, 1), (0, 0)), "edge")
    blur = (sum(padded[i : i + 60, j : j + 50] for i in range(3) for j in range(3)) + 4.0 * x) / 13
    for factor in (imaging.SHARPEN, 1.25):
        assert (imaging.sharpened(x, factor) == np.clip(np.round(blur + (x - blur) * factor), 0, 255)).all()
    assert np.allclose(imaging.tone(x), imaging.profile(x)[:2], rtol=1e-12)


def test_many_tiles_are_enhanced_in_parallel_and_bounded_frames(spark, tmp_path):
    import time

    g = np.random.default_rng(6)
    tiles = [g.integers(0, 256, (8, 8, 3)).astype(np.uint8) for _ in range(200)]
    began = time.time()
    ready = [imaging.enhance(t) for t in tiles]
    assert time.time() - began < 5  # 40 ms a tile before
    frames = list(imaging._frames(iter([*ready, None])))
    assert len(frames) > 5 and max(f.data.dropna().map(len).sum() for f in frames) < imaging.MOST_BYTES + 270_000
    assert [None if d is None else bytes(d) for f in frames for d in f.data] == [r.tobytes() for r in ready] + [None]
    spark.range(40).selectExpr("id vec_id", "transform(sequence(1, 64), x -> cast(sin(x * id) as float)) embedding", "0 label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.enhanced_pixels(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 4 and out.select("pixels_sha256").distinct().count() >= 39


def test_images_from_files_to_text(spark, tmp_path):
    """Files are read, profiled, planned, enhanced and recognised."""
    png(tmp_path / "a.png", [[(200, 30, 10)] * 30] * 20)
    (tmp_path / "b.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path)).withColumn("data", images.in_rgb(F.col("data"), F.col("n_channels")))
    shown = read.withColumn("f", imaging.profiled("data", "width", "height", "n_channels", F.lit(True)))
    planned = shown.withColumn("plan", imaging.enhance_plan(F.col("f.brightness"), F.col("f.contrast"), F.col("width"), F.col("height")))
    rows = {r.width: r for r in planned.withColumn("e", imaging.enhanced("data", "width", "height", "n_channels", "plan")).where("width > 0").collect()}
    r = rows[30]
    assert (r.f.has_color, round(r.f.brightness, 6)) == (1, round(80 / 255, 6)) and (r.e.width, r.e.height) == (300, 200)
    assert read.where("width < 1").count() == 1
    own = np.frombuffer(bytes(r.data), np.uint8).reshape(20, 30, 3)
    assert tuple(own[0, 0]) == (200, 30, 10) and bytes(r.e.data) == imaging.enhance(own).tobytes()
    missing = [recognition.Tesseract(), recognition.EasyOcr()]
    assert [b.name for b in missing if not b.is_available()] == ["tesseract", "easyocr"]
    files = images.stream_images(spark, str(tmp_path))
    assert files.isStreaming and files.columns == ["origin", "data"]


def test_model_is_trained_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    first = routing.load_or_train(spark, path)
    monkeypatch.setattr(routing, "train", None)
    assert routing.importances(routing.load_or_train(spark, path)) == routing.importances(first)


def test_training_rows(spark, tmp_path):
    rows = routing.training_rows(spark).collect()
    assert [r.label for r in rows] == [0.0] * 60 + [1.0] * 40 and rows == routing.training_rows(spark).collect()
    assert all(0.4 <= r.contrast <= 0.9 and 0.5 <= r.sharpness <= 1 for r in rows[:60]) and all(r.contrast <= 0.5 or r.sharpness <= 0.7 for r in rows[60:])
    routing.record(spark.createDataFrame([(0.5, 0.5, 0.5, 1, 0.5, "fast", True)], "brightness double, contrast double, sharpness double, has_color int, size_ratio double, strategy string, success boolean"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().strategy == "fast"


def test_spelling(spark, tmp_path):
    (tmp_path / "d.txt").write_text("from 900\nthe 5000\nfrown 40\nhello 99\nrare 3\n")
    d = words.read_dictionary(spark, str(tmp_path / "d.txt"))
    docs = spark.createDataFrame([(1, "(teh) FROM Helo\nfrrom, rarre xx"), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in spelling.correct_spelling(docs, d).collect()}
    assert got == {1: "(the) FROM Hello from, rarre xx", 2: "", 3: ""}
    lines = spelling.correct_spelling(docs.where("doc_id = 1"), d, preserve_lines=True).orderBy("line_no").collect()
    assert [r.text for r in lines] == ["(the) FROM Hello", "from, rarre xx"]


def test_two_edits_against_plain_python(spark):
    terms = [("from", 900), ("form", 50), ("garden", 70), ("grade", 30), ("ab", 20), ("a", 15)]
    cores = ["frorn", "gradne", "fomr", "ba", "xxxxxx", "agrden", "b", "garden"]
    found = spelling.suggest(spark.createDataFrame([(c,) for c in cores], "core string"), spark.createDataFrame(terms, "term string, count long"), 2)
    expected = {}
    for c in cores:
        near = [(spelling.edits(c, t), -n, t) for t, n in terms if spelling.edits(c, t) <= 2]
        if near:
            expected[c] = (min(near)[2], min(near)[0])
    assert {r.core: (r.term, r.distance) for r in found.collect()} == expected
    assert spelling.edits("gradne", "garden") == 2 and spelling.edits("ca", "abc") == 3


EVENTS = [(1, 1, "ctrl_l", "press"), (1, 2, "T", "press"), (1, 3, "x", "press"), (1, 4, "ctrl_l", "release"), (1, 5, "t", "press"), (2, 1, "t", "press"), (2, 2, "ctrl_r", "press"), (2, 3, "t", "release"), (2, 4, "ctrl_r", "press")]


def events(spark):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, at + dt.timedelta(seconds=t), k, a) for s, t, k, a in EVENTS], EVENT_SQL)


def test_chords_stream_equals_batch(spark, tmp_path):
    batch = sorted((r.session_id, r.ts, r.key) for r in chords.triggers(events(spark), ("ctrl",), "t").collect())
    assert [(s, k) for s, _, k in batch] == [(1, "T"), (1, "x"), (2, "ctrl_r")]
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = act_on(stream_triggers(spark.readStream.schema(EVENT_SQL).parquet(str(tmp_path / "in")), ("ctrl",), "t"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.session_id, r.ts, r.key) for r in seen) == batch
    assert chords.triggers(events(spark), (), None).count() == 0


def test_recognition(spark):
    class Broken(recognition.Stub):
        def recognize(self, *a):
            raise ValueError("no")

    df = spark.createDataFrame([(1, bytearray(b"hi "), 3, 1, 1)], "img_id int, data binary, width int, height int, n_channels int")
    got = [tuple(r) for r in recognition.recognise(df, [recognition.Stub(), Broken("bad")]).orderBy("engine_ord").collect()]
    assert got == [(1, 0, "stub", "hi", None), (1, 1, "bad", "", "ValueError: no")]
    assert recognition.codes_for("eng+equ") == ["en", "equ"]


def test_config(tmp_path):
    c = config.Config.load(tmp_path / "c.yaml", ocr_engine="tesseract")
    assert (c.hotkey, c.ocr_language, c.ocr_engine) == ("<ctrl>+<alt>+t", "eng", "tesseract")
    assert config.Config.load(tmp_path / "c.yaml") == config.Config()
    (tmp_path / "d.yaml").write_text("use_gpu: false\nold_key: 1\nocr_confidence_threshold: 0.5\n")
    assert config.Config.load(tmp_path / "d.yaml", ignored=("old_key",)).use_gpu is False
    (tmp_path / "e.yaml").write_text("save_history: true\nnum_threads: 4\nocr_model_path: ~/m  # here\nhotkey: '<alt>+x'\n")
    old = config.Config.load(tmp_path / "e.yaml")
    assert old.hotkey == "<alt>+x" and old.ocr_model_path.endswith("/m") and "~" not in old.ocr_model_path
    assert config._parse_flat((tmp_path / "e.yaml").read_text()) == {"save_history": True, "num_threads": 4, "ocr_model_path": "~/m", "hotkey": "<alt>+x"}
    assert config.first_available(("a", False), ("b", True)) == "b" and config.display_server("auto", "") == "x11"
