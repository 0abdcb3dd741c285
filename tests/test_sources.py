"""Files, stores, streams, settings, text vectors and plugins."""

from __future__ import annotations

import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan import plugins
from sonoplan.config import Config
from sonoplan.operators import changes, jobs
from sonoplan.schema import SCHEMAS
from sonoplan.sources import audio, datasource, playlists, text
from sonoplan.sources.store import Conflict, Store, pack_vector, unpack_vector
from sonoplan.streaming import scan


def write_wav(path, seconds=1.0, rate=8000, width=2, channels=1, hz=440.0):
    x = np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * 0.5
    raw = {1: lambda: (x * 127 + 128).astype(np.uint8), 2: lambda: (x * 32767).astype("<i2"), 4: lambda: (x * 2147483647).astype("<i4")}[width]()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(np.repeat(raw, channels).tobytes())
    return x


@pytest.mark.parametrize("width", [1, 2, 4])
def test_wav_decoding(tmp_path, width):
    x = write_wav(f"{tmp_path}/a.wav", width=width, channels=2)
    got, rate = audio.decode_wav(open(f"{tmp_path}/a.wav", "rb").read())
    assert rate == 8000 and len(got) == 8000 and np.abs(got - x).max() < 0.02
    y, rate = audio.decode(open(f"{tmp_path}/a.wav", "rb").read(), "a.wav", 4000)
    assert rate == 4000 and len(y) == 4000


def test_discovery_and_scan(spark, tmp_path):
    root = tmp_path / "music"
    paths = [f"{root}/{k}.wav" for k in range(5)] + [f"{root}/d{d}/e/{k} ü+.WAV" for d in range(3) for k in range(3)]
    for p in paths:
        write_wav(p)
    (root / "notes.txt").write_text("x")
    (root / "bad.flac").write_bytes(b"not audio")
    found, denied = audio.find_files(str(root))
    assert found == sorted([*paths, f"{root}/bad.flac"]) and not denied
    assert audio.check_read_access(str(root)) is None and audio.check_read_access(str(root / "none"))
    assert sorted(r["path"] for r in audio.listing(spark, str(root)).collect()) == found
    store = Store(spark, str(tmp_path / "store"))
    assert scan.scan(spark, str(root), store)["probed"] == 15
    t = {r["path"]: r for r in store.read("tracks").collect()}
    assert len(t) == 15 and t[paths[0]]["sample_rate"] == 8000 and t[paths[0]]["duration_sec"] == 1.0 and t[paths[0]]["status"] == "new"
    again = scan.scan(spark, str(root), store)
    assert again["probed"] == 1  # the file without a codec is tried again
    os.utime(paths[3], (1e9, 1e9))
    os.remove(paths[4])
    third = scan.scan(spark, str(root), store)
    assert third["probed"] == 2 and third["removed"] == 1 and store.read("tracks").count() == 14


def test_rescans_follow_the_folder(spark, tmp_path):
    """Files come, change and go between runs; each run opens and writes only what it concerns."""
    root, store, checkpoint = tmp_path / "music", Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    other = tuple({"track_id": 5, "folder_id": 2, "path": "/elsewhere.wav", "status": "new"}.get(f.name) for f in SCHEMAS["tracks"])
    store.write("tracks", spark.createDataFrame([other], SCHEMAS["tracks"]))
    for k in "abc":
        write_wav(f"{root}/d/{k} ü.wav")

    def tracks():
        return {os.path.basename(r["path"]): r["duration_sec"] for r in store.read("tracks").where("folder_id = 1").collect()}

    scan.rescan(spark, str(root), store, checkpoint)
    assert tracks() == {"a ü.wav": 1.0, "b ü.wav": 1.0, "c ü.wav": 1.0}
    store.set_status(store.read("tracks").where("path LIKE '%c ü.wav'").first()["track_id"], "error", "mine")
    write_wav(f"{root}/d/b ü.wav", 2.0)
    os.remove(root / "d" / "a ü.wav")
    write_wav(f"{root}/e.wav", 3.0)
    scan.rescan(spark, str(root), store, checkpoint)
    assert tracks() == {"b ü.wav": 2.0, "c ü.wav": 1.0, "e.wav": 3.0}
    before = store.versions()
    scan.rescan(spark, str(root), store, checkpoint)
    assert store.versions() == before  # nothing to change, nothing written
    for k in ("d/b ü.wav", "d/c ü.wav", "e.wav"):
        os.remove(root / k)
    scan.rescan(spark, str(root), store, checkpoint)
    assert tracks() == {} and store.read("tracks").count() == 1


def test_audio_source(spark, tmp_path):
    datasource.register(spark)
    paths = [f"{tmp_path}/m/{k} ü+.wav" for k in range(6)]
    for k, p in enumerate(paths):
        write_wav(p, 1.0 + k / 2, channels=2)
    (tmp_path / "m" / "bad.flac").write_bytes(b"fLaC")
    (tmp_path / "m" / "notes.txt").write_text("x")
    got = {r["path"]: r for r in spark.read.format("audio").load(f"{tmp_path}/m").collect()}
    assert sorted(got) == sorted([*paths, f"{tmp_path}/m/bad.flac"])
    assert [got[p]["duration_sec"] for p in paths] == [1.0 + k / 2 for k in range(6)] and got[paths[0]]["channels"] == 2
    assert got[f"{tmp_path}/m/bad.flac"]["codec"] is None and got[f"{tmp_path}/m/bad.flac"]["container"] == "flac"
    read = spark.read.format("audio").option("partitionBytes", 1).option("openBytes", 1)
    parts = read.schema("path string, size_bytes bigint").load(f"{tmp_path}/m")
    assert parts.rdd.getNumPartitions() == 7
    whole = spark.read.format("audio").schema("content binary, path string").load(f"{tmp_path}/m/3 ü+.wav").collect()
    assert [(bytes(r["content"]), r["path"]) for r in whole] == [(open(paths[3], "rb").read(), paths[3])]
    assert spark.read.format("audio").schema("path string").load(f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("audio").schema("path string, colour int").load(f"{tmp_path}/m").collect()


def test_a_listing_opens_nothing_and_headers_are_enough(tmp_path, monkeypatch):
    from pyspark.sql.types import StructType

    from sonoplan.sources import containers

    write_wav(f"{tmp_path}/a.wav", 30.0)
    files = datasource.list_files(str(tmp_path))
    part, = datasource.plan(str(tmp_path), files, False, {}, 0)
    read, seen = containers._take, []
    monkeypatch.setattr(containers, "_take", lambda f, n: seen.append(n) or read(f, n))
    schema = datasource.to_arrow_schema(StructType.fromDDL("path string, size_bytes bigint, duration_sec double"))
    rows = [r for b in datasource.read_files(part, schema.names, schema) for r in b.to_pylist()]
    assert rows == [{"path": f"{tmp_path}/a.wav", "size_bytes": 480_044, "duration_sec": 30.0}] and sum(seen) < 200
    seen.clear()
    list(datasource.read_files(part, schema.names[:2], schema.remove(2)))
    assert not seen
    sizes = [(str(k), 100, 0.0) for k in range(10)]
    assert [len(p.files) for p in datasource.plan("/", sizes, True, {"partitionbytes": "330", "openbytes": "10"}, 0)] == [3, 3, 3, 1]


def test_analysis_of_files(spark, tmp_path):
    write_wav(f"{tmp_path}/m/a.wav", 2.5)
    (tmp_path / "m" / "b.wav").write_bytes(b"RIFFbroken")
    c = audio.decode_chunks(audio.read_contents(spark, str(tmp_path / "m")), 1.0, 50.0)
    good, bad = c.where("error IS NULL"), c.where("error IS NOT NULL")
    assert bad.count() == 1 and [(r["start_sec"], r["end_sec"]) for r in good.orderBy("idx").collect()] == [(0.0, 1.0), (0.5, 1.5), (1.0, 2.0), (1.5, 2.5)]

    class Fake(plugins.Plugin):
        name, dim, describes = "fake", 4, True

        def _embed(self, chunks, rate):
            return [np.array([np.mean(x), 1, -1, 0.5]) for x in chunks]

        def _describe(self, chunks, rate, top_k):
            return [[("tagA", 0.9), ("tagB", 0.1)][:top_k] for _ in chunks]

    chunks = good.withColumn("chunk_id", F.col("idx").cast("bigint"))
    fake = Fake()
    assert plugins.embed_chunks(chunks, fake).count() == 4 and plugins.describe_chunks(chunks, fake, 5).count() == 8
    plugins.register("fake", Fake)
    assert [p.name for p in plugins.list_plugins()] == ["fft", "fake"] and plugins.get_plugin("fake") is plugins.get_plugin("fake")
    with pytest.raises(KeyError):
        plugins.get_plugin("none")


def test_store_swaps_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("tags").count() == 0
    s.write("tags", spark.createDataFrame([(1, "m", "a", 0.5)], "chunk_id bigint, model string, text string, score double"))
    s.write("tags", s.read("tags").unionByName(s.read("tags").withColumn("text", F.lit("b"))))
    assert sorted(r["text"] for r in s.read("tags").collect()) == ["a", "b"]
    s.write("settings", spark.createDataFrame([("k",)], "key string"))
    assert s.read("settings").columns == ["key", "value"]


def test_settings_file(tmp_path):
    p = str(tmp_path / "c.json")
    assert Config.load(p) == Config()
    json.dump({"models": ["clap"], "chunk_seconds": 5, "unknown": 1}, open(p, "w"))
    c = Config.load(p)
    assert c.models == ["clap", "m2dclap", "muq", "muqlan", "lpmc", "qwen2audio"] and c.chunk_seconds == 5
    c.models = ["fft"]
    c.save(p)
    assert Config.load(p).models == ["fft"]
    open(p, "w").write("{")
    assert Config.load(p) == Config() and Config().excluded_extensions() == ("wav",)


def test_playlist_files(spark, tmp_path):
    items = spark.createDataFrame([(1, 2, "/m/b.mp3", "b.mp3", None, None, None), (1, 1, "/m/a.mp3", "a.mp3", "Beta", "Close Song", 42.0)], "playlist_id bigint, position int, path string, filename string, artist string, title string, duration_sec double")
    p = playlists.write_m3u(items, 1, playlists.free_path(str(tmp_path), "mix"))
    assert open(p, encoding="utf-8").read().split("\n") == ["#EXTM3U", "#EXTINF:42,Beta - Close Song", "/m/a.mp3", "#EXTINF:-1,Unknown artist - b.mp3", "/m/b.mp3", ""]
    assert playlists.free_path(str(tmp_path), "mix").endswith("mix-2.m3u")
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    (tmp_path / "x" / "f.mp3").write_text("one"), (tmp_path / "y" / "f.mp3").write_text("other")
    to = str(tmp_path / "out")
    first = playlists.copy_files([f"{tmp_path}/x/f.mp3", f"{tmp_path}/y/f.mp3"], to)
    assert playlists.copy_files([f"{tmp_path}/x/f.mp3"], to)[f"{tmp_path}/x/f.mp3"] == first[f"{tmp_path}/x/f.mp3"]
    assert sorted(os.listdir(to)) == ["f (2).mp3", "f.mp3"]


def test_text_server():
    calls = []

    def send(path, body):
        calls.append(path)
        if path == "/api/tags":
            return 200, {"models": [{"name": "chat"}, {"name": "nomic-embed"}]}
        if path == "/api/embed":
            return 404, {}
        return 200, {"embedding": [len(body["prompt"]), 1]}

    s = text.TextServer("http://x/", send=send)
    assert s.is_running() and s.embedding_models() == ["nomic-embed"]
    assert s.embed(["a", "bcd"], "m") == [[1.0, 1.0], [3.0, 1.0]] and calls[-1] == "/api/embeddings"
    with pytest.raises(RuntimeError):
        text.TextServer("http://x", send=lambda p, b: (500, {})).embed(["a"], "m")


def test_hashing_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, " "), (4, None)], "track_id bigint, text string")
    got = {r["track_id"]: r["v"] for r in text.embed_texts(df, text.hashing_embedder(16), "ollama:h").collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-9


def stored_library(spark, root):
    """Two folders of two tracks, each with three chunks, and something in every relation."""
    s = Store(spark, root)
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    blank = lambda name, **v: tuple(v.get(f.name) for f in SCHEMAS[name])
    chunks = [(10 * t + i, t, i, float(i), i + 1.0) for t in (1, 2, 3, 4) for i in range(3)]
    s.write_all({
        "folders": make("folders", [(1, "/a", None), (2, "/b", None)]),
        "tracks": make("tracks", [blank("tracks", track_id=t, folder_id=1 + t // 3, path=f"/{t}.wav", status="analyzed", description="d") for t in (1, 2, 3, 4)]),
        "chunks": make("chunks", chunks),
        "vectors": make("vectors", [blank("vectors", chunk_id=c[0], model="m", dim=2, vector=[1.0, float(c[2])], norm=1.0) for c in chunks]),
        "tags": make("tags", [(c[0], "m", "x", 0.5) for c in chunks]),
        "centroids": make("centroids", [blank("centroids", track_id=t, model="m", vector=[1.0, 0.0]) for t in (1, 2, 3, 4)]),
        "noise_chunks": make("noise_chunks", [("m", "optics", 10), ("m", "optics", 30)]),
        "noise_run_tracks": make("noise_run_tracks", [("m", "optics", t, 3, 1, None) for t in (1, 3)]),
        "playlists": make("playlists", [(1, "p", None, 1, "m"), (2, "q", None, 3, "m")]),
        "playlist_items": make("playlist_items", [(1, 1, 1, 1.0), (1, 3, 2, 0.5)]),
        "learning_pairs": make("learning_pairs", [(1, 1, 3), (2, 3, 4)]),
    })
    return s


def test_a_folder_goes_with_all_that_hangs_on_it(spark, tmp_path):
    s = stored_library(spark, str(tmp_path))
    s.put(changes.remove_folder(s.tables(), 1))
    t = s.tables()
    left = {n: t[n].count() for n in ("folders", "tracks", "chunks", "vectors", "tags", "centroids", "noise", "noise_run_tracks", "playlists", "playlist_items", "pairs")}
    assert left == {"folders": 1, "tracks": 2, "chunks": 6, "vectors": 6, "tags": 6, "centroids": 2, "noise": 1, "noise_run_tracks": 1, "playlists": 2, "playlist_items": 1, "pairs": 1}
    assert {r["playlist_id"]: r["seed_track_id"] for r in t["playlists"].collect()} == {1: None, 2: 3}
    s.put(changes.clear_analysis(s.tables(), 3))
    t = s.tables()
    assert t["chunks"].count() == 3 and t["tags"].count() == 3 and t["noise_run_tracks"].count() == 0 and t["pairs"].count() == 1
    assert {r["track_id"]: r["status"] for r in t["tracks"].collect()} == {3: "new", 4: "analyzed"}


def test_a_failed_change_changes_nothing(spark, tmp_path):
    s = stored_library(spark, str(tmp_path))
    before = s.manifest()
    bad = s.read("tracks").withColumn("status", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.write_all({"chunks": s.read("chunks").limit(1), "tracks": bad})
    assert s.manifest() == before and s.read("chunks").count() == 12


def tree_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def setting(spark, key, value="v"):
    return spark.createDataFrame([(key, value)], "key string, value string")


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path)) for _ in range(2))
    a.write("settings", setting(spark, "k"))
    # b commits another table while a is at work: both survive.
    change = a.change()
    change.write("settings", change.read("settings").unionByName(setting(spark, "from a")))
    b.write("tags", spark.createDataFrame([(1, "m", "t", 0.5)], SCHEMAS["tags"]))
    assert change.commit() == 3
    assert a.read("tags").count() == 1 and b.read("settings").count() == 2
    # b commits the same table, written or only read: the change is refused whole.
    for use in ("write", "read"):
        change = a.change()
        if use == "write":
            change.write("settings", setting(spark, "lost"))
        else:
            change.read("settings")
        change.write("folders", spark.createDataFrame([(9, "/x", None)], SCHEMAS["folders"]))
        b.write("settings", b.read("settings").unionByName(setting(spark, f"from b, {use}")))
        with pytest.raises(Conflict, match="settings"):
            change.commit()
        assert a.read("folders").count() == 0
    # The same through plain reads and writes.
    old = a.read("settings")
    b.put_setting("k", "new")
    with pytest.raises(Conflict):
        a.write("settings", old)
    a.write("settings", a.read("settings").where("key != 'from a'"))
    assert {r["key"]: r["value"] for r in b.read("settings").collect()} == {"k": "new", "from b, write": "v", "from b, read": "v"}


def test_interleaved_calls(spark, tmp_path, monkeypatch):
    a, b = (Store(spark, str(tmp_path)) for _ in range(2))
    publish, first = Store._publish, []

    def late(self, state):
        if self is a and not first:
            first.append(True)
            b.write_all({"settings": setting(spark, "b")})
        return publish(self, state)

    monkeypatch.setattr(Store, "_publish", late)
    a.write_all({"folders": spark.createDataFrame([(1, "/x", None)], SCHEMAS["folders"])})  # its number is taken meanwhile
    assert a.versions() == [1, 2] and a.read("settings").count() == 1 and a.read("folders").count() == 1
    first.clear()
    with pytest.raises(Conflict):
        a.write_all({"settings": setting(spark, "a")})
    assert [r["key"] for r in a.read("settings").collect()] == ["b"]


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def put(k):
        Store(spark, str(tmp_path), most_parts=100).put_setting(f"k{k % 6}", str(k))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(put, range(18)))
    s = Store(spark, str(tmp_path))
    got = {r["key"]: int(r["value"]) for r in s.read("settings").collect()}
    assert len(got) == 6 and all(v % 6 == int(k[1:]) for k, v in got.items()) and s.versions() == list(range(1, 19))


def test_small_changes_write_little(spark, tmp_path):
    s = Store(spark, str(tmp_path), most_parts=100)
    blank = lambda **v: tuple(v.get(f.name) for f in SCHEMAS["tracks"])
    s.write("tracks", spark.range(20_000).select(F.col("id").alias("track_id"), F.sha2(F.col("id").cast("string"), 256).alias("path"), F.lit("new").alias("status")))
    s.write("tracks", spark.createDataFrame(s.read("tracks").rdd.map(lambda r: blank(track_id=r["track_id"], path=r["path"], status="new")), SCHEMAS["tracks"]))
    size, log = tree_bytes(tmp_path / "tracks"), tree_bytes(tmp_path / "_log")
    s.set_status(7, "analyzed")
    s.set_status(8, "error", "why")
    s.put_setting("a", "1")
    s.put_setting("a", "2")
    assert tree_bytes(tmp_path / "tracks") - size < 0.05 * size and tree_bytes(tmp_path / "settings") < 10_000 and tree_bytes(tmp_path / "_log") < log + 10_000
    got = {r["track_id"]: r for r in s.read("tracks").where("status != 'new'").collect()}
    assert set(got) == {7, 8} and got[7]["last_analyzed_at"] and got[8]["status_message"] == "why" and s.read("tracks").count() == 20_000
    assert [(r["key"], r["value"]) for r in s.read("settings").collect()] == [("a", "2")]
    with pytest.raises(ValueError, match="unknown status"):
        s.set_status(7, "lost")


def test_merged_parts_equal_the_full_rewrite(spark, tmp_path):
    """Changes of all kinds at random, by parts of few and of many, against a dict."""
    rng = np.random.default_rng(2)
    schema = "chunk_id bigint, model string, text string, score double"
    for most in (2, 50):
        s, want = Store(spark, f"{tmp_path}/{most}", most_parts=most), {}
        for step in range(6):
            ids = rng.choice(12, 4, replace=False)
            rows = [(None if i == 11 else int(i), "m", f"s{step}", float(step)) for i in ids[:3]]
            gone = [(int(ids[3]),)] if step % 2 else None
            s.merge("tags", spark.createDataFrame(rows, schema), ["chunk_id"], None if gone is None else spark.createDataFrame(gone, "chunk_id bigint"))
            for (g,) in gone or ():
                want.pop(g, None)
            want |= {r[0]: r for r in rows}
            if step == 4:  # a list by another key
                s.merge("tags", None, ["text"], spark.createDataFrame([("s3",)], "text string"))
                want = {k: r for k, r in want.items() if r[2] != "s3"}
            assert sorted(map(str, want.values())) == sorted(str(tuple(r)) for r in s.read("tags").collect())
            assert len(s.manifest()["tables"]["tags"]["parts"]) <= most
        full = s.read("tags").collect()
        s.compact("tags")
        assert len(s.manifest()["tables"]["tags"]["parts"]) == 1 and sorted(map(str, s.read("tags").collect())) == sorted(map(str, full))
    s.merge("tags", spark.createDataFrame([(1, "m", "again", 0.0)], schema))  # no key: a plain append
    assert s.read("tags").count() == len(full) + 1
    with pytest.raises(ValueError, match="key"):
        s.merge("tags", None, gone=s.read("tags"))


def test_tables_of_the_former_layout(spark, tmp_path):
    setting(spark, "old").write.parquet(f"{tmp_path}/settings/abc")
    (tmp_path / "MANIFEST").write_text(json.dumps({"tables": {"settings": "abc"}, "old": []}))
    s = Store(spark, str(tmp_path))
    s.put_setting("new", "1")
    assert sorted(r["key"] for r in s.read("settings").collect()) == ["new", "old"]


def test_files_last_until_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for k in range(5):
        s.write("settings", setting(spark, f"k{k}"))
    old = s.read("settings", version=1)  # a long read, and one back in time
    assert s.vacuum() == 0 and [r["key"] for r in old.collect()] == ["k0"] and s.versions() == [1, 2, 3, 4, 5]
    change = s.change()
    change.write("settings", setting(spark, "never"))  # not committed
    assert s.vacuum(older_than=-60) == 5 and s.versions() == [5] and [r["key"] for r in s.read("settings").collect()] == ["k4"]


def test_vectors_come_from_bytes(spark):
    df = spark.createDataFrame([(np.array([1.5, -2], "<f4").tobytes(),), (None,), (b"",)], "b binary")
    assert [r[0] for r in df.select(unpack_vector(F.col("b"))).collect()] == [[1.5, -2.0], None, []]
    assert [r[0] for r in df.select(pack_vector(unpack_vector(F.col("b")))).collect()] == [r[0] for r in df.collect()]


def test_analysis_keeps_what_is_current(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for k in (1, 2):
        write_wav(f"{tmp_path}/m/{k}.wav", 2.5 + k)
    (tmp_path / "m" / "3.wav").write_bytes(b"RIFFbroken")

    class Pitch(plugins.Captions):
        name, title, dim, calls = "pitch", "Pitch", 2, 0

        def _embed(self, chunks, rate):
            return [np.array([1.0, len(x)]) for x in chunks]

        def _captions(self, chunks, rate):
            return [["a tune"] for _ in chunks]

    class Broken(plugins.Plugin):
        name, title = "broken", "Broken"

        def _embed(self, chunks, rate):
            raise RuntimeError("out of memory")

    plugins.register("pitch", Pitch)
    plugins.register("broken", Broken)
    blank = lambda **v: tuple(v.get(f.name) for f in SCHEMAS["tracks"])
    s.write("tracks", spark.createDataFrame([blank(track_id=k, folder_id=1, path=f"{tmp_path}/m/{k}.wav", status="new") for k in (1, 2, 3)], SCHEMAS["tracks"]))
    content = audio.read_contents(spark, str(tmp_path / "m"))

    def run(models, stamp=1.0, **options):
        files = s.read("tracks").select("track_id", "path").join(content, "path").withColumn("mtime", F.lit(stamp)).withColumn("size", F.lit(9).cast("bigint"))
        before = {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
        jobs.analyze_into(s, files, models, 1.0, 0.0, **options)
        assert {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()} <= before
        return s.tables()

    t = run(["pitch", "broken", "none"])
    got = {r["track_id"]: r for r in t["tracks"].collect()}
    assert [got[k]["status"] for k in (1, 2, 3)] == ["analyzed", "analyzed", "error"] and "Decode failed" in got[3]["status_message"]
    assert got[1]["status_message"] == "Broken failed: out of memory; unknown model 'none' skipped"
    assert got[1]["description"] == "Music tags: a tune" and got[1]["duration_sec"] == 3.5 and got[1]["sample_rate"] == 8000 and got[1]["last_analyzed_at"]
    first = {r["chunk_id"] for r in t["chunks"].collect()}
    assert len(first) == 4 + 5 and t["vectors"].count() == 9 and t["tags"].where("score = 1.0").count() == 9
    assert sorted((r["track_id"], r["model"]) for r in t["centroids"].collect()) == [(1, "pitch"), (2, "pitch")]
    # The same plan and file: chunks and vectors stay, one more model is added.
    t = run(["pitch", "fft"])
    assert {r["chunk_id"] for r in t["chunks"].collect()} == first
    assert {r["model"]: r["count"] for r in t["vectors"].groupBy("model").count().collect()} == {"pitch": 9, "fft": 9}
    # Another file under the same name: the chunks are replaced, and what hung on them goes.
    t = run(["fft"], stamp=2.0)
    assert not first & {r["chunk_id"] for r in t["chunks"].collect()}
    assert [r["model"] for r in t["vectors"].select("model").distinct().collect()] == ["fft"] and t["tags"].count() == 0
